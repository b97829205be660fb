"""Line deduplication within one edit, by a deletion-neighbourhood join.

Two lines are at most one edit (a character put in, left out or exchanged) apart exactly if

* both turn into the same string when their character at the same place is left out (exchanged), or
* one is the other with one of its characters left out (put in or left out).

So each line emits its variants with one character left out, as hashed keys, and equal keys meet.
Groups are never expanded into pairs: for exchanges all lines of a key (string and place) are within one
edit of each other, for deletions all longer lines are within one edit of the shorter one; the
earliest on the other side is all that a line needs to know, and aggregations find it.

A line has as many variants as characters, so places where it has no possible partner are sorted out
first, losing nothing: cut a line into parts, and whatever the edit, what is left without the part that
holds it is equal in both lines. Lines are cut in 2 parts, those with a partner in 16, and only
what remains emits variants. What the hashed keys find is verified by edit distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import likely, packed, salted_join, stored, table, text_of, unpacked

#: Lines of this many characters (spaces at the ends aside) count as repeated one edit apart; in shorter ones an edit makes
#: another word, so they only count if they are equal.
EDIT_CHARS = 20
#: Parts a line is cut in, and what remains of it with a partner, and so on.
PARTS = (2, 16)


def _hash(*columns: Column) -> Column:
    return F.xxhash64(F.lit(7), *columns)


def _hash128(*columns: Column) -> Column:
    return F.struct(F.xxhash64(F.lit(1), *columns).alias("h1"), F.xxhash64(F.lit(2), *columns).alias("h2"))


def _cut(m: Column, a: Column, b: Column, parts: int) -> Column:
    """Parts (m, a, b) of the places from a up to b of a line, cut as for a line of length m."""
    edge = lambda i: (a + F.floor((b - a) * i / parts)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.struct(m.alias("m"), edge(i).alias("a"), edge(i + 1).alias("b")))
    return F.filter(cut, lambda e: e["a"] < e["b"])


def _rest(body: Column, part: Column) -> Column:
    """Key of a line without a part. Seen from the end, the part of a longer line is one longer."""
    return _hash(part["m"], part["a"], part["b"], F.left(body, part["a"]), F.right(body, part["m"] - part["b"]))


def _met(keyed: DataFrame, purpose: str) -> DataFrame:
    """``line, part`` of the rows (``line, part, key``, once each) whose key another line has as well."""
    several = stored(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), purpose)
    return salted_join(keyed, several, ["key"], "n", ["line"]).select("line", "part")


def _finer(parts: DataFrame, lines: DataFrame, into: int, purpose: str) -> DataFrame:
    cut = F.explode(_cut(F.col("part.m"), F.col("part.a"), F.col("part.b"), into)).alias("part")
    each = parts.join(lines.select("line", "body"), "line").select("line", "body", cut)
    return stored(_met(each.select("line", "part", _rest(F.col("body"), F.col("part")).alias("key")), f"{purpose}-keys"), purpose)


def similar_lines(parts: DataFrame, lines: DataFrame) -> DataFrame:
    """``line, earlier``: lines with an earlier line one edit away, and the place of the earliest.

    ``lines``: ``line`` (a hash), ``first`` (its place), ``body``, once each; ``parts``: where a line may have
    a partner.
    """
    for number, into in enumerate(PARTS[1:]):  # the first cut needs no texts
        parts = _finer(parts, lines, into, f"line-parts{number}")
    rows = parts.join(lines, "line").withColumn("length", F.char_length("body"))
    # In a part cut for a line one shorter, the additional character may also stand right behind.
    longer = (F.col("length") > F.col("part.m")).cast("int")
    places = F.explode(F.sequence(F.col("part.a") + 1, F.col("part.b") + longer))
    left_out = rows.select("line", "first", longer.alias("longer"), "body", places.alias("place"))
    string = F.concat(F.left("body", F.col("place") - 1), F.expr("substring(body, place + 1)"))
    left_out = left_out.select("line", "first", "longer", "place", _hash128(string).alias("text"))
    # Exchanges meet at the string and the place (0 stands for deletions), deletions at the string.
    exchanged = left_out.where("longer = 0").select("line", "first", "text", "place", F.lit(False).alias("deleted"))
    deleted = left_out.where("longer = 1").select("line", "first", "text", F.lit(0).alias("place"), F.lit(True).alias("deleted"))
    whole = rows.where("length = part.m").select(
        "line", "first", _hash128(F.col("body")).alias("text"), F.lit(0).alias("place"), F.lit(False).alias("deleted")
    )
    variants = stored(exchanged.union(deleted).union(whole), "line-variants")
    own = F.struct("first", "line")
    groups = variants.groupBy("text", "place").agg(
        F.min(F.when(~F.col("deleted"), own)).alias("as_it_is"),
        F.min(F.when(F.col("deleted"), own)).alias("with_more"),
        F.count(F.lit(1)).alias("n"),
    )
    groups = stored(groups.where("n > 1"), "line-groups")
    met = salted_join(variants, groups, ["text", "place"], "n", ["line"])
    # Lines of one exchange are all one edit apart; of a deletion only the two sides are.
    other = F.when((F.col("place") == 0) & ~F.col("deleted"), F.col("with_more")).otherwise(F.col("as_it_is"))
    linked = met.select("line", "first", other.alias("other")).where("other.first < first").select("line", "other").distinct()
    partner = lines.select(F.col("line").alias("other_line"), F.col("body").alias("other_body"))
    pairs = linked.join(lines.select("line", "body"), "line").join(partner, F.col("other.line") == F.col("other_line"))
    near = pairs.where(F.levenshtein("body", "other_body", 1) >= 0)
    return near.groupBy("line").agg(F.min("other.first").alias("earlier"))


def _lines(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``place, line, body`` of all lines but blank ones; a place is id, number and the text's hash."""
    rows = docs.select(F.col(id_column).alias("id"), text_of(text_column).alias("text"))
    rows = rows.select("id", F.xxhash64("text").alias("text_hash"), F.split("text", "\n", -1).alias("lines"))
    each = rows.select("id", "text_hash", F.posexplode("lines").alias("at", "body"))
    each = each.where(F.trim("body") != "")
    return each.select(F.struct("id", "at", "text_hash").alias("place"), _hash128(F.col("body")).alias("line"), "body")


def repeated_lines(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", edit_chars: int = EDIT_CHARS) -> DataFrame:
    """``id, text_hash, ats``: numbers of the lines that repeat an earlier one, for documents with any.

    Earlier is smaller by id, then by number of the line. A line repeats one that is equal or, if
    both have ``edit_chars`` characters, one edit away, even if that one repeats another.
    """
    each = _lines(docs, id_column, text_column)
    length = F.char_length("body")
    halves = F.flatten(F.transform(F.array(length, length - 1), lambda m: _cut(m, F.lit(0), m, PARTS[0])))
    keyed = F.transform(halves, lambda part: F.struct(part.alias("part"), _rest(F.col("body"), part).alias("key")))
    keyed = F.when(F.char_length(F.trim("body")) >= edit_chars, keyed).otherwise(F.filter(keyed, lambda k: F.lit(False)))
    unique = each.select("line", "place", keyed.alias("keyed")).groupBy("line").agg(
        F.min("place").alias("first"), F.any_value("keyed").alias("keyed"), F.count(F.lit(1)).alias("n")
    )
    unique = stored(unique, "lines-unique")
    cut = unique.select("line", F.explode("keyed").alias("k")).select("line", "k.part", "k.key")
    parts = stored(_met(cut, "line-halves-keys"), "line-halves")
    # Texts are fetched for lines that may have a partner only, from where they first stand.
    wanted = stored(unique.join(parts, "line", "left_semi").select("line", "first"), "lines-wanted")
    texts = likely(each, F.xxhash64("place"), wanted, F.xxhash64("first"))
    texts = texts.join(wanted, "line").where(F.col("place").eqNullSafe(F.col("first")))
    texts = stored(texts.select("line", "first", "body").dropDuplicates(["line"]), "lines-texts")
    alike = similar_lines(parts, texts)
    drops = unique.select("line", "first", "n").join(alike, "line", "left").where("n > 1 or earlier is not null")
    drops = stored(drops.select("line", F.least("first", F.coalesce("earlier", "first")).alias("keep"), "n"), "lines-repeated")
    later = salted_join(each.select("line", "place"), drops, ["line"], "n", ["place"]).where(F.col("keep") < F.col("place"))
    return later.groupBy("place.id", "place.text_hash").agg(F.sort_array(F.collect_set("place.at")).alias("ats"))


def deduplicated(
    docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", edit_chars: int = EDIT_CHARS, counts: str | None = "n_chars"
) -> DataFrame:
    """``docs`` packed as ``_row``, with ``lines`` (number of lines), ``ats`` (of the repeated ones)
    and ``left`` (the text without them).

    Lines end at a line feed. Null texts count as empty and stay as they are. Blank lines are left alone; lines of fewer than
    ``edit_chars`` characters, spaces at the ends aside, go if they equal an earlier one. Repeated rows (one id, one text) are one document: what one keeps, all keep.
    No rows give no rows; other columns pass through, whatever their names.
    """
    found = repeated_lines(docs, id_column=id_column, text_column=text_column, edit_chars=edit_chars)
    found = stored(found.select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("ats").alias("_ats")), "lines-dropped")
    text = text_of(text_column)
    rows = packed(docs, _own=F.col(id_column), _text=F.xxhash64(text), _lines=F.split(text, "\n", -1))
    # What is dropped grows with the documents, so it is never broadcast, at any size.
    found = found.hint("merge")
    joined = rows.join(found, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_hash")), "left")
    none = F.array().cast("array<int>")
    joined = joined.select("_row", "_lines", F.coalesce("_ats", none).alias("ats"))
    # What stands between two repeated lines is one slice, so the work is linear in the lines.
    before = F.concat(F.array(F.lit(-1)), F.col("ats"))
    after = F.concat(F.col("ats"), F.array(F.size("_lines")))
    slices = F.zip_with(before, after, lambda a, b: F.slice("_lines", a + 2, b - a - 1))
    left = F.when(F.size("ats") > 0, F.array_join(F.flatten(slices), "\n")).otherwise(F.col(f"_row.`{text_column}`"))
    return joined.select("_row", F.size("_lines").alias("lines"), "ats", left.alias("left"))


def without_repeated_lines(docs: DataFrame, **options) -> DataFrame:
    """The documents without repeated lines, ``n_chars`` (if there) following the text. Documents with
    nothing but repeated lines go."""
    found = deduplicated(docs, **options)
    kept = found.where((F.size("ats") == 0) | (F.trim("left") != ""))
    changed = {"text": F.col("left")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        count = F.when(F.size("ats") > 0, F.char_length("left")).otherwise(F.col("_row.n_chars"))
        changed["n_chars"] = count.cast(kind)
    return unpacked(kept, **changed)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicated(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("_row.doc_id").alias("doc_id"), "lines", F.array_join("ats", ",").alias("repeated"),
        F.sha2(F.coalesce("left", F.lit("")), 256).alias("text_sha256"),
    )


QUERIES = {"op7_line_dedup": op7}

# Of lines of 20 characters or more, one edit leaves the first 10 or the last 9 as they are. Lines are one
# edit apart if their common start and end leave at most one character of either.
ORACLE = {
    "op7_line_dedup": f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
each AS (SELECT doc_id, unnest(ls) AS body, unnest(range(0, len(ls))) AS num FROM split),
line AS (SELECT *, [doc_id, num] AS place FROM each WHERE trim(body, ' ') <> ''),
a AS (SELECT body, min(place) AS first, length(body) AS n FROM line GROUP BY body),
u AS (SELECT * FROM a WHERE length(trim(body, ' ')) >= {EDIT_CHARS}),
pair AS (
  SELECT x.body AS b, y.body AS o, x.first AS f, y.first AS g FROM u AS x JOIN u AS y
    ON left(x.body, 10) = left(y.body, 10) AND y.first < x.first AND abs(x.n - y.n) <= 1
  UNION
  SELECT x.body, y.body, x.first, y.first FROM u AS x JOIN u AS y
    ON right(x.body, 9) = right(y.body, 9) AND y.first < x.first AND abs(x.n - y.n) <= 1),
same AS (
  SELECT b, f, g, greatest(length(b), length(o)) AS n,
    len(list_filter(range(1, least(length(b), length(o)) + 1), lambda i: left(b, i) = left(o, i))) AS s,
    len(list_filter(range(1, least(length(b), length(o)) + 1), lambda i: right(b, i) = right(o, i))) AS e
  FROM pair),
near AS (SELECT b, min(g) AS g FROM same WHERE s + e >= n - 1 GROUP BY b),
gone AS (
  SELECT line.doc_id, list(line.num ORDER BY line.num) AS ats
  FROM line JOIN a USING (body) LEFT JOIN near ON near.b = line.body
  WHERE line.place > a.first OR line.place > near.g GROUP BY line.doc_id)
SELECT doc_id, CAST(len(ls) AS INTEGER) AS lines, coalesce(array_to_string(ats, ','), '') AS repeated,
  sha256(coalesce(array_to_string(list_filter(ls, lambda x, i: NOT list_contains(coalesce(ats, []), i - 1)), chr(10)), '')) AS text_sha256
FROM split LEFT JOIN gone USING (doc_id)"""
}
