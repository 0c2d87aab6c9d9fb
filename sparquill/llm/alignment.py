"""Cross-tokenizer alignment by segment deduplication.

A text falls into segments, cut before white space that neither vocabulary can merge to what stands before it:
that is verified on the entries of both. Each segment's tokens are then what they are in the whole text. Spark counts
the distinct segments of the corpus, each is tokenised by both tokenizers and aligned once, and the counts of id
pairs follow from the segments' counts. Alignments are joined back: those of the most frequent segments, whose
texts together are bounded in bytes, by broadcast, all others by an equi-join on the segment, for chunks of
documents that need them. Documents are composed of their segments' alignments, chunk by chunk.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparquill.llm.common import fresh, read, row_key, spread_join, stored, text_of
from sparquill.llm.packing import byte_ranks, tokenizer_path

#: Whatever any of the pattern languages at hand takes for white space.
WHITE = r"\x09-\x0D\x1C-\x20\x85\xA0\u1680\u180E\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
MARK = "\u2581"  # how pieces write a space
BAR, END = 0xFFFFFFFF, 0xFFFFFFFE  # marks in packed groups
HOT_BYTES = 3 << 20  # of the texts of all segments that are broadcast, at most
HOT_PAIRS = 1 << 20  # id pairs whose counts are broadcast, at most; more are joined
CHUNK_BYTES = 1 << 24  # of the texts of a chunk, about; fewer where the corpus is small
HEAVY = 10_000  # a row that more than the 1/HEAVY of all rows repeat is dealt over chunks
ADDED = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
STATS = ["n_a", "n_b", "n_groups", "n_best", "count_sum"]
_ALIGNED = "segment string, n long, n_a int, n_b int, groups binary, links array<long>"


def piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pair:
    """Tokenizer A, a byte-level one of the tokenizers library, and B, a sentencepiece model."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        with open(path_a, encoding="utf-8") as file:
            held = json.load(file)
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.bytes_a = {k: word for word, k in byte_ranks(held["model"]["vocab"], {t["content"] for t in held["added_tokens"]}).items()}
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.vocab_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace(MARK, " ").encode() for k, p in enumerate(pieces)]
        odd = " \n\ufb01  \u2460\t "
        if b"".join(self._pieces(odd)).decode() != " " + odd:
            raise ValueError(f"{path_b} rewrites its texts, or adds no space before them")
        words = [w.decode(errors="replace") for w in self.bytes_a.values()] + [w.decode(errors="replace") for w in self.bytes_b]
        joined = re.compile(rf"[^{WHITE}]([\x09-\x0D\x20])")
        self.cut = "".join(sorted(set(" \t\n\x0b\x0c\r") - {c for w in words for c in joined.findall(w)}))
        if " " not in self.cut or "\n" not in self.cut or any("\n" in p and len(p) > 1 for p in pieces):
            raise ValueError("a vocabulary merges across spaces or line ends: no place to cut texts at")

    def _pieces(self, text: str) -> list[bytes]:
        return [self.bytes_b[k] for k in self.b.encode(text)]

    def pattern(self) -> str:
        """A segment: white space, then what is none, on through white space that is no place to cut."""
        kept = "".join(f"\\x{ord(c):02X}" for c in sorted(set(" \t\n\x0b\x0c\r") - set(self.cut)))
        kept += WHITE.replace(r"\x09-\x0D", "").replace(r"\x1C-\x20", r"\x1C-\x1F")
        end = r"(?![\s\S])"
        return rf"[{WHITE}]*[^{WHITE}]+(?:[{kept}][{WHITE}]*[^{WHITE}]+)*(?:[{kept}][{WHITE}]*{end})?|[{WHITE}]+"

    def odd_white(self) -> str:
        """All other white space."""
        return "".join(c for c in map(chr, range(0x3001)) if re.match(f"[{WHITE}]", c) and c not in self.cut)

    def splitter(self):
        """A function from a text to its segments."""
        odd, plain, general = self.odd_white(), re.compile(r"\s*\S+|\s+").findall, re.compile(self.pattern()).findall
        return lambda text: general(text) if any(c in text for c in odd) else plain(text)

    def encode(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A and B of each segment as they are within a text. For B each follows a line end, as that merges with nothing."""
        first = len(self.b.encode("\n"))
        return [e.ids for e in self.a.encode_batch(segments, add_special_tokens=False)], [ids[first:] for ids in self.b.encode(["\n" + s for s in segments], num_threads=1)]


@lru_cache(2)
def pair_of(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


def align(ids_a: list[int], ids_b: list[int], size_a: list[int], size_b: list[int]) -> tuple[list[int], list[int]]:
    """Groups, each as ids of A, BAR, ids of B, END, and the links as numbers: A's id times 2**32 plus B's."""
    groups, links, i, j, end_a, end_b, from_a, from_b = [], [], 0, 0, 0, 0, 0, 0
    while i < len(ids_a) or j < len(ids_b):
        if end_a <= end_b:
            end_a += size_a[i]
            i += 1
        else:
            end_b += size_b[j]
            j += 1
        if end_a == end_b:
            groups += [*ids_a[from_a:i], BAR, *ids_b[from_b:j], END]
            links.append(ids_a[i - 1] << 32 | ids_b[j - 1])
            from_a, from_b = i, j
    return groups, links


def written(groups: bytes) -> str:
    """Groups in the form `a1,a2|b1;a3|b2` from their ids as little-endian unsigned 32-bit numbers, or 16-bit ones after a zero byte."""
    ids = np.frombuffer(groups, "<u2", offset=1) if len(groups) % 2 else np.frombuffer(groups, "<u4")
    ends = (0xFFFF, 0xFFFE) if len(groups) % 2 else (BAR, END)
    out = ",".join(["|" if k == ends[0] else ";" if k == ends[1] else str(k) for k in ids.tolist()])
    return out.replace(",|,", "|").replace(",;,", ";").removesuffix(",;")


def packed(groups: list[int]) -> bytes:
    """The bytes that written() reads: two for each id where all are small."""
    if max((k for k in groups if k < END), default=0) < 0xFFFE:
        return b"\0" + np.array(groups, np.int64).astype("<u2").tobytes()
    return np.array(groups, np.int64).astype("<u4").tobytes()


def segments(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(segment, n): the distinct segments of all texts and how often each stands there, counted by batches first."""
    schema = pa.schema([("segment", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = pair_of(path_a, path_b).splitter()
        for batch in batches:
            counts: Counter = Counter()
            for text in batch.column(0):
                counts.update(split(" " + text.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], schema=schema)

    texts = docs.select(spelled().alias("spelled")).where("spelled IS NOT NULL")
    return texts.mapInArrow(run, "segment string, n long").groupBy("segment").agg(F.sum("n").alias("n"))


def spelled() -> Column:
    """The text if its tokens can spell it, else null: not where it is empty or has the character that stands for a space."""
    text = text_of()
    return F.when((text != "") & ~F.contains(text, F.lit(MARK)), text)


def aligned(found: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Each of the segments (segment, n) tokenised twice and aligned: n_a, n_b, groups and links."""
    schema = pa.schema([("segment", pa.string()), ("n", pa.int64()), ("n_a", pa.int32()), ("n_b", pa.int32()), ("groups", pa.binary()), ("links", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair_of(path_a, path_b)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                texts, counts = (c.to_pylist() for c in batch.slice(at, 1024).columns)
                out: list[list] = [[] for _ in schema]
                for text, n, a, b in zip(texts, counts, *both.encode(texts), strict=True):
                    words_a, words_b = [both.bytes_a[k] for k in a], [both.bytes_b[k] for k in b]
                    if not text.encode() == b"".join(words_a) == b"".join(words_b):
                        raise ValueError(f"tokens do not spell {text!r}")
                    groups, links = align(a, b, [len(w) for w in words_a], [len(w) for w in words_b])
                    for column, value in zip(out, (text, n, len(a), len(b), packed(groups), links), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, schema.types, strict=True)], schema=schema)

    return found.mapInArrow(run, _ALIGNED)


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, n_rows, count, best) of aligned segments: count is how many links of the corpus hold the id pair, best
    whether no pair with the same B id has more, n_rows how many links of distinct segments hold it."""
    pairs = found.select("n", F.explode("links").alias("pair")).groupBy("pair").agg(F.count("*").alias("n_rows"), F.sum("n").alias("count"))
    same_b = Window.partitionBy(F.expr("pair & 4294967295"))  # at most as many rows as A has ids
    return pairs.withColumn("best", (F.col("count") == F.max("count").over(same_b)).cast("long"))


def _scored(found: DataFrame) -> DataFrame:
    """Aligned segments with n_best and count_sum in place of their links."""
    pairs = stored(pair_counts(found))
    n, total = pairs.agg(F.count("*"), F.sum("n_rows")).first()
    numbers = ["n_a", "n_b", F.size("links").alias("n_groups")]
    if n <= HOT_PAIRS:
        rows = pairs.orderBy("pair").select("pair", "best", "count").toArrow()
        held = found.sparkSession.sparkContext.broadcast(tuple(rows.column(c).to_numpy() for c in ("pair", "best", "count")))

        @F.arrow_udf("struct<n_best:bigint,count_sum:bigint>")
        def sums(links: pa.Array) -> pa.Array:
            pair, *values = held.value
            at = np.searchsorted(pair, links.flatten().to_numpy())
            ends = np.concatenate([[0], np.cumsum(links.value_lengths().to_numpy(zero_copy_only=False))])
            parts = [np.diff(np.concatenate([[0], np.cumsum(v[at])])[ends]) for v in values]
            return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in parts], ["n_best", "count_sum"])

        return found.withColumn("sums", sums("links")).select("segment", "n", *numbers, "sums.*", "groups")
    links = spread_join(found.select("segment", F.explode("links").alias("pair")), pairs, "pair", "n_rows", "segment", total)
    totals = links.groupBy("segment").agg(F.sum("best").alias("n_best"), F.sum("count").alias("count_sum"))
    return stored(found.join(totals, "segment").select("segment", "n", *numbers, "n_best", "count_sum", "groups"))


def _hot(table: DataFrame, hot_bytes: int) -> Column:
    """Whether a segment is one of the most frequent, whose texts together have at most hot_bytes bytes."""
    level = F.floor(F.log2("n") * 8).cast("int")
    least = None
    for found, size in sorted(table.groupBy(level).agg(F.sum(F.octet_length("segment"))).collect(), reverse=True):  # at most 8 * 63
        hot_bytes -= size
        if hot_bytes < 0:
            break
        least = found
    return F.lit(False) if least is None else level >= least


def _lookup(held: Broadcast) -> dict[str, int]:
    """Places of the broadcast segments, once in each Python worker."""
    if getattr(_lookup, "of", None) != held._path:
        _lookup.of, _lookup.found = held._path, {s: k for k, s in enumerate(held.value[0].to_pylist())}
    return _lookup.found


def _found(rows: DataFrame, held: Broadcast, path_a: str, path_b: str) -> DataFrame:
    """(row, times, segment): the segments of rows (row, times, spelled) that are not among the broadcast ones."""
    schema = pa.schema([("row", pa.int64()), ("times", pa.int32()), ("segment", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, split = _lookup(held), pair_of(path_a, path_b).splitter()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows, times, texts = batch.slice(at, 512).columns
                lists = [list({s for s in split(" " + t.as_py()) if s not in place}) for t in texts]
                sizes = [len(x) for x in lists]
                columns = [pa.array(np.repeat(c.to_numpy(), sizes), t) for c, t in ((rows, pa.int64()), (times, pa.int32()))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([s for x in lists for s in x], pa.string())], schema=schema)

    return rows.mapInArrow(run, "row long, times int, segment string")


def _composer(held: Broadcast, path_a: str, path_b: str, keep: list[str], spelling: str):
    def compose(docs: pa.Table, rare: pa.Table) -> pa.Table:
        place, split = _lookup(held), pair_of(path_a, path_b).splitter()
        own = {s: len(place) + k for k, s in enumerate(rare.column("segment").to_pylist())}
        table = np.stack([rare.column(c).to_numpy() for c in STATS], axis=1).astype(np.int64)
        names = [written(g) for g in rare.column("groups").to_pylist()]
        parts, lengths = [np.zeros(0, np.int32)], []
        for text in docs.column(spelling):
            at = [own[s] if (i := place.get(s)) is None else i for s in split(" " + text.as_py())] if text.is_valid else []
            parts.append(np.array(at, np.int32))
            lengths.append(len(at))
        at, ends = np.concatenate(parts), np.concatenate([[0], np.cumsum(lengths, dtype=np.int32)])
        groups = pa.concat_arrays([held.value[2], pa.array(names, pa.large_string())])
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), groups.take(pa.array(at))), pa.scalar(";", pa.large_string()))
        values = [np.concatenate([held.value[1][:, k], table[:, k]])[at] for k in range(len(STATS))]
        n_a, n_b, n_groups, n_best, count_sum = (pa.array(np.diff(np.concatenate([[0], np.cumsum(v)])[ends]), pa.int64()) for v in values)
        return pa.table([*(docs.column(c) for c in keep), n_a, n_b, n_groups, n_groups, n_best, count_sum, text.cast(pa.string())], names=[*keep, *ADDED])

    return compose


def align_tokenizers(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, hot_bytes: int = HOT_BYTES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """docs (doc_id, text, any other columns) with n_a, n_b, n_groups, n_links, n_best, count_sum and groups.

    Tokens are those of A for a space and the text, and of B for the text, which adds the space. A group ends where a
    token of A and one of B both end, and its last tokens are linked. groups lists them as `a1,a2|b1;a3|b2`. A text
    that is null, empty or not spelled by its tokens has none: zeros and an empty string, and its segments count
    nowhere. Repeated rows count each. Columns of docs that are named as the added ones are replaced. An empty table
    gives an empty result. A chunk's texts must fit a task, and so must any single one.
    """
    path_a, path_b = path_a or tokenizer_path(), path_b or piece_path()
    docs = docs.drop(*ADDED)
    spelling, chunk, row, times = fresh(docs, "spelling", "chunk", "row", "times")
    found = stored(aligned(segments(docs, path_a, path_b), path_a, path_b), codec="zstd")
    table = _scored(found)
    n_bytes = found.agg(F.sum(F.col("n") * F.octet_length("segment"))).first()[0] or 0
    often = _hot(found, hot_bytes)
    rows = table.where(often).select("segment", *STATS, "groups").toArrow()
    stats = np.stack([rows.column(c).to_numpy() for c in STATS], axis=1).astype(np.int64).reshape(-1, len(STATS))
    held = docs.sparkSession.sparkContext.broadcast((rows.column("segment").combine_chunks(), stats, pa.array([written(g) for g in rows.column("groups").to_pylist()], pa.large_string())))

    chunks = max(math.isqrt(n_bytes // 4096), n_bytes // chunk_bytes) + 1
    here = F.xxhash64("doc_id", text_of())
    copies = docs.groupBy(here.alias(row)).agg(F.count("*").alias(times))
    least = max(1, docs.count() // HEAVY)
    heavy = copies.where(F.col(times) > least).select(row, F.lit(min(chunks, 64)).cast("int").alias(times))  # under HEAVY rows
    placed = docs.withColumn(row, here).join(F.broadcast(heavy), row, "left")
    one = F.coalesce(F.col(times), F.lit(1))

    needed = _found(placed.select(row, one, spelled().alias("spelled")).where("spelled IS NOT NULL"), held, path_a, path_b)
    needed = needed.select(F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("k"), "row", "segment").select(F.pmod(F.col("row") + F.col("k"), F.lit(chunks)).cast("int").alias(chunk), "segment")
    needed = needed.groupBy("segment").agg(F.collect_set(chunk).alias("chunks"))  # at most as many as there are chunks
    lists = needed.join(table.where(~often), "segment").select(F.explode("chunks").alias(chunk), "segment", *STATS, "groups")
    dealt = F.pmod(F.col(row) + F.pmod(F.xxhash64(row_key()), one), F.lit(chunks)).cast("int")
    texts = placed.select(*docs.columns, spelled().alias(spelling), dealt.alias(chunk))
    kind = T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in ADDED[:-1]), T.StructField(ADDED[-1], T.StringType())])
    return texts.groupBy(chunk).cogroup(lists.groupBy(chunk)).applyInArrow(_composer(held, path_a, path_b, docs.columns, spelling), kind)


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = align_tokenizers(read(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest)
