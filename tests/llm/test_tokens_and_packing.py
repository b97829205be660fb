import random
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tillmark.llm import packing, token_counts, word_bpe
from tillmark.llm.word_bpe import SPECIAL, PrefixCounter, counter, word_ids

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
TEXTS = st.lists(
    st.one_of(
        st.text(max_size=12), st.sampled_from([*SPECIAL, "it's", "'re", "we'll", "ñandú", "İ", "é", "\x85", "\x1f", "½", "日本", "  "]),
        st.text("abcdefgh'é ", max_size=20),
    ),
    max_size=8,
).map("".join)


@pytest.fixture(scope="module")
def library():
    return LIBRARY


@settings(max_examples=1500, deadline=None)
@given(TEXTS)
def test_ids_are_the_librarys(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(counter(PATH).ids(text), "<u4").tolist() == want
    (got,) = word_ids(PATH).of([text])
    assert np.frombuffer(got, word_ids(PATH).kind).tolist() == want


def test_every_prefix(library):
    for text in ["don't stop'rest we'll 12 unbelievably-long?! wörter über alles", "x" * 300 + "antidisestablishmentarianism", "a\n\n b  ", "ab<|endoftext|>c"]:
        text = text.lower()
        counts = token_counts.counts(counter(PATH).deltas(text))
        want = [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
        assert counts.tolist() == want
        for budget in (0, 3, 10, 1000):
            assert token_counts.longest_within(counter(PATH).deltas(text), budget) == max(i for i, n in enumerate(want) if n <= budget)


def made_up_words(seed, n):
    pick = random.Random(seed)
    parts = ["an", "the", "or", "ing", "ti", "on", "re", "ver", "é", "ção", "st", "x"]
    return ["".join(pick.choices(parts, k=pick.randint(3, 6))) for _ in range(n)]


def test_new_words_take_remembered_steps():
    """Calls for each character of words not seen before, whose parts were: one to remember its change, few others."""
    known = PrefixCounter(PATH)
    seen = made_up_words(1, 30_000)
    known.deltas(" ".join(seen))
    new = sorted({*made_up_words(2, 5000)} - {*seen})
    calls = 0

    def count(frame, event, _):
        nonlocal calls
        calls += event in ("call", "c_call")

    text = " ".join(new)
    before = sys.getprofile()
    sys.setprofile(count)
    try:
        known.deltas(text)
    finally:
        sys.setprofile(before)
    assert len(new) > 2000 and calls < 4 * len(text)


@pytest.mark.parametrize("words,states", [(300_000, 250_000), (4, 7)])
def test_prefixes_whatever_is_remembered(library, monkeypatch, words, states):
    monkeypatch.setattr(word_bpe, "REMEMBERED", words)
    monkeypatch.setattr(word_bpe, "REMEMBERED_STATES", states)
    known = PrefixCounter(PATH)
    for seed in range(20):
        text = " ".join(made_up_words(seed, 6) * 2) + " ñ日本 it's <|endoftext|> \n"
        plain = text[: text.index("<")]
        counts = token_counts.counts(known.deltas(plain)).tolist()
        assert counts == [len(library.encode(plain[:i], add_special_tokens=False).ids) for i in range(len(plain) + 1)]
        want = library.encode(text, add_special_tokens=False).ids
        assert known.count(text) == len(want) and np.frombuffer(known.ids(text), "<u4").tolist() == want
        assert len(known.words) <= max(2, words // 2) and len(known.states) <= states


def test_odd_documents(spark, odd_docs, odd_rows, no_docs, library):
    store = token_counts.prefix_counts(odd_docs, PATH)
    rows = sorted((r["id"], r["n_bytes"], r["n_tokens"]) for r in store.collect())
    want = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in odd_rows]
    assert rows == sorted(want)
    answers = {r["id"]: r for r in token_counts.answers(store, 2048).collect()}
    assert answers[5]["over_limit"] and not answers[4]["over_limit"] and answers[4]["prefix_length"] == 0
    prefix = odd_rows[4][1][: answers[5]["prefix_length"]]
    assert len(library.encode(prefix, add_special_tokens=False).ids) <= 2048
    assert token_counts.prefix_counts(no_docs, PATH).count() == 0


def whole(pieces, rows, library, size):
    """Every id in exactly one piece, sequences without gaps, padding in the last one only."""
    want = sorted(library.encode(t or "", add_special_tokens=False).ids + [packing.END_ID] for _, t, *_ in rows)
    assert sum(p["length"] for p in pieces) == sum(map(len, want))
    ordered = sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"]))
    at = 0
    for p in ordered:
        assert p["sequence_id"] * size + p["offset"] == at and p["offset"] + p["length"] <= size
        at += p["length"]
    by_id = {}
    for i, t, *_ in rows:
        by_id[i] = library.encode(t or "", add_special_tokens=False).ids + [packing.END_ID]
    for p in pieces:
        ids = by_id[p["doc_id"]]
        assert p["doc_tokens"] == len(ids)
        assert p["ids_crc32"] == zlib.crc32(np.array(ids[p["start"] : p["start"] + p["length"]], "<u4").tobytes())


def test_packing(spark, odd_docs, odd_rows, no_docs, library):
    pieces = packing.pack(odd_docs, PATH, size=512).collect()
    whole(pieces, odd_rows, library, 512)
    again = packing.pack(odd_docs.repartition(7), PATH, size=512).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, pieces))
    assert packing.pack(no_docs, PATH).count() == 0


def test_neighbours_are_alike(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    pieces = packing.pack(docs, PATH).join(docs.select("doc_id", "lang"), "doc_id")
    each = pieces.groupBy("sequence_id", "lang").agg(F.sum("length").alias("n")).groupBy("sequence_id")
    purity = each.agg((F.max("n") / F.sum("n")).alias("p")).agg(F.avg("p")).first()[0]
    assert purity > 0.8


@pytest.mark.parametrize("dimensions,bits", [(2, 4), (3, 3), (4, 2)])
def test_hilbert_curve_moves_by_one(dimensions, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dimensions, indexing="ij"), -1).reshape(-1, dimensions)
    keys = packing.hilbert_keys(cells, bits)
    assert sorted(keys) == list(range(len(cells)))
    assert set(np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1)) == {1}
