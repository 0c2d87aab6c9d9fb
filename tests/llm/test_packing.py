import struct
import zlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sparquill.llm import packing as op
from sparquill.llm.common import read


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 200), max_size=40))
def test_plan_uses_each_length_as_counted(counts):
    used, sequences = Counter(), 0
    for lengths, times in op.plan(counts, 64):
        assert sum(lengths) <= 64
        sequences += times
        for x in lengths:
            used[x] += times
    assert used == Counter(counts)
    total = sum(k * n for k, n in counts.items())
    assert sequences <= max(1, -(-2 * total // 64) + 1)


def test_exact_fillings_are_found():
    assert sum(t for _, t in op.plan({40: 10, 24: 10}, 64)) == 10
    assert sum(t for _, t in op.plan({30: 6, 20: 6, 14: 6}, 64)) == 6
    assert sum(t for _, t in op.plan({30: 4, 17: 4, 10: 4, 7: 4}, 64)) == 4


def fewest(pieces, room, bins=()):
    """Exact: the fewest sequences, by trying all places for each piece."""
    if not pieces:
        return len(bins)
    first, best = pieces[0], fewest(pieces[1:], room, (*bins, pieces[0]))
    for k, used in enumerate(bins):
        if used + first <= room and used not in bins[:k]:
            best = min(best, fewest(pieces[1:], room, (*bins[:k], used + first, *bins[k + 1 :])))
    return best


@settings(max_examples=80, deadline=None, derandomize=True)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=7))
def test_plan_is_near_the_exact_one(pieces):
    found = sum(t for _, t in op.plan(Counter(pieces), 20))
    assert found <= fewest(sorted(pieces, reverse=True), 20) + 1


@settings(max_examples=80, deadline=None, derandomize=True)
@given(st.lists(st.tuples(st.integers(1, 61), st.integers(1, 61), st.integers(1, 61)), min_size=1, max_size=1), st.integers(1, 50))
def test_sequences_that_can_be_full_are_full(cuts, times):
    edges = sorted({0, 64, *cuts[0]})
    parts = Counter(b - a for a, b in zip(edges, edges[1:]))
    assert sum(t for _, t in op.plan({x: n * times for x, n in parts.items()}, 64)) <= times + 1


def test_ids_are_those_of_the_tokenizers_library_on_a_whole_table():
    import pyarrow.parquet as pq

    path, n = op.tokenizer_path(), 0
    encode, exact = op._encoder(path), Tokenizer.from_file(path)
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"])["text"].to_pylist()]
    for at in range(0, len(texts), 500):
        for text, coded in zip(texts[at : at + 500], exact.encode_batch(texts[at : at + 500], add_special_tokens=False)):
            assert encode(text) == struct.pack(f"<{len(coded.ids)}I", *coded.ids)
            n += 1
    assert n == len(texts) == 10_000


def held(pieces, docs, path):
    tokenizer = Tokenizer.from_file(path)
    want = Counter()
    for doc_id, text in docs:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for k, (s, e) in enumerate(zip(cuts, cuts[1:])):
            want[(doc_id, k, s, e - s, zlib.crc32(struct.pack(f"<{e - s}I", *ids[s:e])))] += 1
    assert Counter((p.doc_id, p.piece, p.start, p.length, p.ids_crc32) for p in pieces) == want
    by = {}
    for p in pieces:
        by.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for rows in by.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= 1024
    return len(by)


def test_whole_table(spark, sf_dir):
    docs = [tuple(r) for r in read(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    pieces = op.op6_best_fit_packing(spark, sf_dir).collect()
    n = held(pieces, docs, op.tokenizer_path())
    assert n <= 1.1 * sum(p.length for p in pieces) / 1024 + 1


def test_odd_texts_and_repeats(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "a"), (3, " a  b\n\nc\t d "), (4, "<|endoftext|> x<|endoftext|>"), (5, "naïve ça 日本語 \U0001f600 \x00 e\r\nf"), (6, "word " * 20000), (7, "y" * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    held(op.packed(df).collect(), rows, op.tokenizer_path())
    assert op.packed(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_ids_column(spark):
    df = spark.createDataFrame([(1, "hello there")], "doc_id long, text string")
    row = op.packed(df, ids=True).first()
    assert len(row.ids) == 4 * row.length and zlib.crc32(row.ids) == row.ids_crc32


def test_clashing_columns_are_left_out(spark):
    docs = spark.createDataFrame([(1, "hello there", 5, "x", 2)], "doc_id long, text string, piece int, length string, sequence_id int")
    assert op.packed(docs).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and op.packed(docs).count() == 1
