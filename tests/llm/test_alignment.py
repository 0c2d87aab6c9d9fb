import json
from bisect import bisect_left
from collections import Counter, defaultdict
from itertools import groupby

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sparquill.llm import alignment as op
from sparquill.llm.common import read
from sparquill.llm.packing import byte_ranks, tokenizer_path

DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def both():
    """Tokens of whole texts, as (id, end in bytes), by the libraries alone."""
    a = Tokenizer.from_file(tokenizer_path())
    a.encode_special_tokens = True
    with open(tokenizer_path(), encoding="utf-8") as file:
        words = {k: w for w, k in byte_ranks(json.load(file)["model"]["vocab"], {"<|endoftext|>"}).items()}
    b = sentencepiece.SentencePieceProcessor(model_file=op.piece_path())

    def tokens(text):
        found = []
        for ids, spell in ((a.encode(" " + text, add_special_tokens=False).ids, words.get), (b.encode(text), lambda k: bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode())):
            spelled, ends = b"", []
            for k in ids:
                spelled += spell(k)
                ends.append((k, len(spelled)))
            found.append(ends if spelled == (" " + text).encode() else None)
        return found

    return tokens


def brute(texts, tokens):
    coded = []
    for text in texts:
        a, b = tokens(text) if text else (None, None)
        if a is None or b is None:
            coded.append(([], [], [], []))
            continue
        ends_b = {e: k for k, e in b}
        links = [(k, ends_b[e], e) for k, e in a if e in ends_b]
        shared = [end for *_, end in links]
        sides = [[",".join(str(k) for k, _ in part) for _, part in groupby(side, lambda x: bisect_left(shared, x[1]))] for side in (a, b)]
        groups = ["|".join(x) for x in zip(*sides, strict=True)]
        coded.append((a, b, groups, [x[:2] for x in links]))
    count = Counter(x for *_, links in coded for x in links)
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    return [(len(a), len(b), len(groups), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), ";".join(groups)) for a, b, groups, links in coded]


def got(df):
    return [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in df.collect()]


@pytest.mark.parametrize("hot_bytes", [op.HOT_BYTES, 500])
def test_whole_table(spark, sf_dir, both, hot_bytes):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = op.align_tokenizers(docs, hot_bytes=hot_bytes)
    ids, texts = zip(*((r.doc_id, r.text) for r in docs.collect()), strict=True)
    assert {r.doc_id: x for r, x in zip(found.collect(), got(found), strict=True)} == dict(zip(ids, brute(texts, both), strict=True))


ODD = st.one_of(
    st.text(max_size=30),
    st.text(" \t\n\r\x0b\x0c\x1c\x85\xa0 ᠎  ▁　ab1.'é中", max_size=30),
    st.lists(st.sampled_from(["  ", "<|endoftext|>", "<s>", "<0x41>", "the", ");\r", "\r\n", "don't", "   ", "\x00", "\U0001f600", "́", "\n\n", "x" * 40]), max_size=12).map("".join),
)


@settings(max_examples=400, deadline=None)
@given(ODD.filter(lambda t: "\ud800" not in t))
def test_segments_have_the_tokens_of_the_whole_text(both, text):
    try:
        text.encode()
    except UnicodeEncodeError:
        return
    import re

    pair = op.pair_of(tokenizer_path(), op.piece_path())
    parts = re.findall(pair.pattern(), " " + text)
    assert pair.splitter()(" " + text) == parts
    assert "".join(parts) == " " + text
    if text and op.MARK not in text:
        a, b = pair.encode(parts)
        assert [sum(a, []), sum(b, [])] == [[k for k, _ in side] for side in both(text)]


def test_cuts_are_where_no_entry_goes_across():
    assert op.pair_of(tokenizer_path(), op.piece_path()).cut == "\t\n\x0b\x0c "  # pieces end in a carriage return


def test_nulls_repeats_long_texts_and_clashing_columns(spark, both):
    texts = [None, "", " ", "a▁b", "same text here", "same text here", "same text here", "word " * 20000, "x" * 30000, "\r\n \r", "rare-1 rare-2", "trailing \n"]
    ids = [1, None, 3, 4, 5, 5, None, 8, 9, 10, None, 12]
    docs = spark.createDataFrame([(d, t, k, "x") for k, (d, t) in enumerate(zip(ids, texts, strict=True))], DOCS + ", row int, groups string").repartition(3)
    for hot_bytes, chunk_bytes in ((op.HOT_BYTES, op.CHUNK_BYTES), (40, 5000), (0, 100)):
        found = op.align_tokenizers(docs, hot_bytes=hot_bytes, chunk_bytes=chunk_bytes).orderBy("row")
        assert found.columns == ["doc_id", "text", "row", *op.ADDED] and got(found) == brute(texts, both)
    assert op.align_tokenizers(spark.createDataFrame([], DOCS)).count() == 0


def test_pair_counts_by_a_join(spark, both, monkeypatch):
    monkeypatch.setattr(op, "HOT_PAIRS", 3)
    texts = ["one text and another", "one more text, and more", "and, and, and"]
    found = op.align_tokenizers(spark.createDataFrame(list(enumerate(texts)), DOCS)).orderBy("doc_id")
    assert got(found) == brute(texts, both)


def test_query(spark, sf_dir):
    row = op.op11_tokenizer_alignment(spark, sf_dir).where("n_a > 0").first()
    assert len(row.groups_sha256) == 64 and row.n_links == row.n_groups > 0


def test_packed_groups_of_small_and_large_ids():
    for big in (3, 0xFFFD, 0xFFFE, 0xFFFF, 70000):
        assert op.written(op.packed([big, 1, op.BAR, 2, op.END, 5, op.BAR, 7, big, op.END])) == f"{big},1|2;5|7,{big}"
    assert op.written(op.packed([])) == ""
