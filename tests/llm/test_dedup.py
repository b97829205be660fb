import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillmark.llm import exact_dedup, graph, jaccard_join, line_dedup
from tillmark.session import shared_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def folded(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def written(spark, docs, files=3):
    path = shared_path(spark, "exact-dedup-test")
    docs.repartition(files, "doc_id").write.parquet(path)
    return path


# --- exact ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda text: F.unhex(F.hex(F.length(text) % 3))])
def test_exact_copies(spark, odd_docs, odd_rows, digest):
    """Also with a digest that many texts share: the texts decide."""
    found = exact_dedup.deduplicate(spark, written(spark, odd_docs), digest=digest).collect()
    assert len(found) == len(odd_rows)
    groups = {}
    for i, t, *_ in odd_rows:
        groups.setdefault(folded(t), []).append(i)
    by_id = {i: ids for ids in groups.values() for i in ids}
    for r in found:
        assert r["keep_id"] == max(by_id[r["id"]]) and r["group_size"] == len(by_id[r["id"]])
    assert sum(r["kept"] for r in found) == len(groups)  # of repeated rows only one


def test_exact_null_ids_and_no_rows(spark, odd_docs, no_docs):
    rows = [(None, "x", "", "", 1), (None, "x", "", "", 1), (5, "X", "", "", 1)]
    found = exact_dedup.deduplicate(spark, written(spark, spark.createDataFrame(rows, SCHEMA))).collect()
    assert [(r["keep_id"], r["group_size"]) for r in found] == [(5, 3)] * 3 and sum(r["kept"] for r in found) == 1
    assert exact_dedup.deduplicate(spark, written(spark, no_docs)).count() == 0


def test_exact_state_goes_on(spark):
    """A second run reads new files only, and old digests are still known."""
    path, state = shared_path(spark, "grows"), shared_path(spark, "state")
    spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string").coalesce(1).write.parquet(path)
    assert exact_dedup.run_stream(spark, path, state).count() == 2
    spark.createDataFrame([(3, "A"), (4, "c")], "doc_id long, text string").coalesce(1).write.mode("append").parquet(path)
    rows = exact_dedup.run_stream(spark, path, state, files_per_batch=1).select("keep.id", "n").collect()
    assert sorted(map(tuple, rows)) == [(2, 1), (3, 2), (4, 1)]


# --- lines ------------------------------------------------------------------------------------------


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    s = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[s:] == b[s:] or a[s + 1 :] == b[s + 1 :] or a[s + 1 :] == b[s:] or a[s:] == b[s + 1 :]


def brute_lines(rows, least):
    """Lines of ``least`` characters count as repeated one edit apart, all if they are equal."""
    places = sorted((i, n, line) for i, t, *_ in set(rows) for n, line in enumerate((t or "").split("\n")) if line.strip(" "))
    first = {}
    for i, n, line in places:
        first.setdefault(line, (i, n))
    long = {line for line in first if len(line.strip(" ")) >= least}
    near = {a: [f for b, f in first.items() if a != b and a in long and b in long and one_edit(a, b)] for a in first}
    dropped = {}
    for i, n, line in places:
        if first[line] < (i, n) or any(f < (i, n) for f in near[line]):
            if first[line] < (i, n) or min(near[line]) < first[line]:
                dropped.setdefault(i, []).append(n)
    return dropped


def lines_of(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abé ") for _ in range(rng.choice([5, 20, 21, 22, 60]))) for _ in range(12)]
    rows = []
    for i in range(40):
        lines = []
        for _ in range(rng.randint(0, 4)):
            line = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                at = rng.randrange(len(line))
                line[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "a"])
            lines.append("".join(line))
        rows.append((i, "\n".join(lines), "en", "s", 0))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_lines_like_brute_force(spark, seed):
    rows = lines_of(seed)
    found = line_dedup.repeated_lines(spark.createDataFrame(rows, SCHEMA).repartition(5), edit_chars=4)
    assert {r["id"]: r["ats"] for r in found.collect()} == brute_lines(rows, 4)
    found = line_dedup.repeated_lines(spark.createDataFrame(rows, SCHEMA))
    assert {r["id"]: r["ats"] for r in found.collect()} == brute_lines(rows, 20)


def test_short_lines_repeat(spark):
    rows = [(i, f"Home\nAbout us\n\nStory {str(i) * 4} of this site, told at some length.", "", "", 0) for i in range(5)]
    left = {r["doc_id"]: r["text"] for r in line_dedup.without_repeated_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert left[0] == rows[0][1] and left[3].startswith("\n") and "Home" not in left[3] and "About" not in left[4]


def test_odd_lines(spark, odd_docs, odd_rows, no_docs):
    kept = line_dedup.without_repeated_lines(odd_docs)
    assert kept.columns == odd_docs.columns
    left = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert 8 not in left  # nothing but a repeated line
    assert left[1] == odd_rows[0][1] and left[2] == odd_rows[1][1] and left[3] is None and left[4] == "" and left[5] == odd_rows[4][1]
    assert line_dedup.without_repeated_lines(no_docs).count() == 0
    text = "a line that is long enough\n\n}\na line that is long enough\nthe end of this document\n"
    (row,) = line_dedup.without_repeated_lines(spark.createDataFrame([(1, text, "", "", 99)], SCHEMA)).collect()
    assert row["text"] == "a line that is long enough\n\n}\nthe end of this document\n" and row["n_chars"] == len(row["text"])


# --- near duplicates --------------------------------------------------------------------------------


def brute_classes(rows, threshold=0.8):
    sets = [set(jaccard_join.shingles(t or "").tolist()) for _, t, *_ in rows]
    ids = [i for i, *_ in rows]
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        if not either or both >= threshold * either - 1e-9:
            links[a] += 1
            links[b] += 1
            x, y = sorted((find(a), find(b)), key=lambda r: min(ids[i] for i in range(len(ids)) if find(i) == r))
            root[y] = x
    smallest = {}
    for n, i in enumerate(ids):
        smallest[find(n)] = min(i, smallest.get(find(n), i))
    return sorted((i, smallest[find(n)], links[n]) for n, i in enumerate(ids))


def copies_of(seed, n, changes, common=""):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    rows = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.randint(0, changes)):
            words[rng.randrange(len(words))] = f"v{rng.randrange(9999)}"
        rows.append(common + " ".join(words))
    return rows


def classes_of(df, **options):
    return sorted((r["id"], r["class_id"], r["n_links"]) for r in jaccard_join.near_duplicates(df, **options).collect())


def test_near_duplicates_like_brute_force(spark):
    passage = " ".join(f"common{i}" for i in range(60)) + " "
    texts = copies_of(1, 30, 4) + copies_of(2, 20, 2, passage) + copies_of(3, 10, 1) + [passage + f"tail {i} {i * 7} {i * 13}" for i in range(40)]
    rows = [(i, t, "", "", 0) for i, t in enumerate(texts + texts[:5])]
    random.Random(4).shuffle(rows)
    assert classes_of(spark.createDataFrame(rows, SCHEMA)) == brute_classes(rows)


def isolated_pairs(seed, n, words, first_id=0):
    """Pairs of texts that differ by their last word alone, and share no word with other pairs."""
    rng, rows = random.Random(seed), []
    for pair in range(n):
        length = rng.choice(words)
        base = [f"p{pair}w{i}" for i in range(length)]
        rows += [(first_id + 2 * pair, " ".join(base), "", "", 0), (first_id + 2 * pair + 1, " ".join([*base[:-1], f"x{pair}"] if length > 12 else [*base, f"x{pair}"]), "", "", 0)]
    return rows


def test_isolated_pairs_of_short_texts(spark):
    """Every pair is found, however few shingles it shares."""
    rows = isolated_pairs(8, 400, [8, 9, 10, 12, 15, 20, 30, 45, 60])
    wanted = brute_classes(rows[:40])
    assert sum(links for *_, links in wanted) >= 36
    assert all(links == 1 for *_, links in classes_of(spark.createDataFrame(rows, SCHEMA)))


def pairs_of_passages(seed, n, pool=40, each=10):
    """Pairs made of the same frequent passages, one of them with a passage more; no other shingles."""
    rng, rows = random.Random(seed), []
    stop = " ".join(f"stop{i}" for i in range(5))
    passage = [" ".join(f"q{p}w{i}" for i in range(5)) for p in range(pool)]
    for pair in range(n):
        own = rng.sample(range(pool), each + 1)
        rows += [(2 * pair + more, " ".join(f"{stop} {passage[p]}" for p in [*own[: each + more]]) + f" {stop}", "", "", 0) for more in (0, 1)]
    return rows


def test_pairs_of_frequent_passages(spark):
    """A pair is found however often the buckets of what it shares split."""
    assert jaccard_join.runs_for(1 - 1e-5) < jaccard_join.runs_for(1 - 1e-5, 4) < jaccard_join.runs_for(1 - 1e-5, 7) < 30
    rows = pairs_of_passages(9, 500)
    found = classes_of(spark.createDataFrame(rows, SCHEMA), small=3)
    assert found == brute_classes(rows) and all(links for *_, links in found)


def test_large_buckets_and_groups(spark, monkeypatch):
    """Paths that split no further, and groups of several blocks, give the same classes."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 9)
    texts = copies_of(5, 60, 4) + copies_of(6, 25, 3)
    rows = [(i, t, "", "", 0) for i, t in enumerate(texts)]
    assert classes_of(spark.createDataFrame(rows, SCHEMA), small=4, task=6, steps=2) == brute_classes(rows)
    assert classes_of(spark.createDataFrame(rows, SCHEMA), small=4, steps=3) == brute_classes(rows)


def test_odd_near_duplicates(spark, odd_docs, odd_rows, no_docs):
    assert classes_of(odd_docs) == brute_classes(odd_rows)
    kept = jaccard_join.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 5, 7, 9]
    assert jaccard_join.one_of_each(no_docs).count() == 0
    same_id = [(1, "a b c d e f g", "", "", 0), (1, "u v w x y z 1", "", "", 0), (None, "a b c d e f g", "", "", 0), (2, "u v w x y z 1", "", "", 0)]
    left = jaccard_join.one_of_each(spark.createDataFrame(same_id, SCHEMA)).collect()
    assert sorted((r["doc_id"] or 0, r["text"][0]) for r in left) == [(0, "a"), (1, "a"), (1, "u")]


def test_rows_without_an_id_change_nothing(spark):
    """Neither for copies and near copies of their text, nor for each other."""
    base = [f"w{i}" for i in range(300)]
    near = [*base[:-1], "other"]
    rows = [(1, " ".join(base)), (2, " ".join(base)), (None, " ".join(base)), (3, " ".join(near)), (None, "of another text"), (7, "quite another text")]
    df = spark.createDataFrame([(*r, "", "", 0) for r in rows], SCHEMA)
    found = sorted((r["id"], r["copy_id"], r["copies"], r["class_id"], r["n_links"]) for r in jaccard_join.near_duplicates(df).where("id is not null").collect())
    assert found == [(1, 1, 2, 1, 2), (2, 1, 2, 1, 2), (3, 3, 1, 1, 2), (7, 7, 1, 7, 0)]
    left = jaccard_join.one_of_each(df).collect()
    assert sorted(r["doc_id"] or 0 for r in left) == [0, 0, 1, 7]


def test_work_for_a_large_cluster_is_linear(spark, monkeypatch):
    rows = {}
    stored = jaccard_join.stored

    def counting(df, purpose):
        made = stored(df, purpose)
        if purpose.startswith("paths-"):
            rows["paths"] = rows.get("paths", 0) + made.count()
        return made

    monkeypatch.setattr(jaccard_join, "stored", counting)
    each = []
    for n in (250, 1000):
        rows.clear()
        texts = copies_of(11, n, 2)
        found = classes_of(spark.createDataFrame([(i, t, "", "", 0) for i, t in enumerate(texts)], SCHEMA))
        assert len({c for _, c, _ in found}) < 5
        each.append(rows["paths"] / n)
    assert each[1] < 1.3 * each[0]


def test_intersections():
    rng = np.random.RandomState(3)
    sets = [np.unique(rng.randint(0, 60, rng.randint(0, 40))).astype(np.uint64) for _ in range(20)]
    others = [np.unique(rng.randint(0, 60, 25)).astype(np.uint64) for _ in range(7)]
    among, between = jaccard_join.overlaps(sets), jaccard_join.overlaps(sets, others)
    for i, s in enumerate(sets):
        assert [len(np.intersect1d(s, o)) for o in others] == between[i].tolist()
        assert all(among[i][j] == len(np.intersect1d(s, o)) for j, o in enumerate(sets) if i != j)


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(110)] + [(500, i) for i in range(600, 900)] + [(i, i + 1) for i in range(1000, 1064)]
    edges += [(None, 3), (5, 5)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        return x if root[x] == x else find(root[x])

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    found = graph.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert {r["node"]: r["component"] for r in found} == {x: find(x) for x in root} and len(found) == len(root)


def test_work_within_a_bucket_of_near_copies(monkeypatch):
    """Members that no pivot settles are not compared pair by pair once they are connected; those that are not are found all the same."""
    rng = np.random.RandomState(5)
    base = rng.randint(0, 2**32, 110).astype(np.uint64)

    def near(kept):
        return np.unique(np.concatenate([rng.permutation(base)[:kept], rng.randint(0, 2**32, 110 - kept).astype(np.uint64)]))

    # Some 0.5 similar to each other; a few chains that lead to them, whose ends are like none but the one before.
    samples = [near(92) for _ in range(900)]
    for at in (5, 700):
        link = np.unique(np.concatenate([samples[at][:80], rng.randint(0, 2**32, 30).astype(np.uint64)]))
        samples += [link, np.unique(np.concatenate([link[-80:], rng.randint(0, 2**32, 30).astype(np.uint64)]))]
    samples.append(rng.randint(0, 2**32, 110).astype(np.uint64))
    compared, overlaps = [], jaccard_join.overlaps
    monkeypatch.setattr(jaccard_join, "overlaps", lambda sets, others=None: compared.append(len(sets)) or overlaps(sets, others))
    edges = jaccard_join.bucket_edges(7, samples, 0.8, 32, 6)
    assert sum(n * n for n in compared) < 20 * len(samples)
    sizes = np.array([len(s) for s in samples])
    root = {i: i for i in range(len(samples))}

    def find(x):
        return x if root[x] == x else find(root[x])

    for i, j, _ in edges:
        a, b = sorted((find(i), find(j)))
        root[b] = a
    wanted = list(range(len(samples)))
    for i, j in jaccard_join.spanning(jaccard_join.similar(sizes, overlaps(samples), jaccard_join.MARGIN * 0.8)):
        wanted[j] = wanted[i]
    assert [find(i) for i in range(len(samples))] == wanted and len(set(wanted)) > 1
