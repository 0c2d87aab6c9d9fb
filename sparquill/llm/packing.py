"""Best-fit packing by exact-complement hashing.

Documents are tokenised in tasks and cut into pieces of at most one sequence. What is packed are lengths, not
documents: Spark counts the pieces of each length, so the plan is made from at most 1,024 numbers however many
pieces there are. From the longest length down, the gap that a piece leaves is looked up in an index of the sums
of one, two and three lengths, and as many such combinations are consumed as the counts allow; what no
combination fills exactly is packed best-fit decreasing. Each piece then finds its place by its length and its
rank among the pieces of that length, counted in parts so that a common length is no task of its own.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparquill.llm.common import read, stored, text_of

SEQUENCE = 1024
END = 2
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_ranks(vocabulary: dict[str, int], special: set[str]) -> dict[bytes, int]:
    """Ids by bytes of a byte-level vocabulary, whose strings show each byte as a printable character."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
    return {bytes(byte[c] for c in word): k for word, k in vocabulary.items() if word not in special}


def _encoder(path: str):
    """A function from a text to the bytes of its ids, as little-endian unsigned 32-bit numbers.

    The tokenizer file's vocabulary is run by tiktoken, which gives the ids that tokenizers gives, several times
    faster: in byte-level files of this kind the ids are in the order of the merges. Texts with the string of a
    special token go to tokenizers itself, which reads that as one id.
    """
    import json

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        held = json.load(file)
    special = {t["content"] for t in held["added_tokens"]}
    ranks = byte_ranks(held["model"]["vocab"], special)
    fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    exact = Tokenizer.from_file(path)

    def run(text: str) -> bytes:
        if any(t in text for t in special):
            ids = exact.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        return fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()

    return run


def tokenised(docs: DataFrame, path: str | None = None, sequence: int = SEQUENCE, end: int = END, ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of each row of docs (doc_id, text).

    A document's ids end with `end`. One of over `sequence` ids is cut from its end, so its first piece may be
    shorter. ids are little-endian unsigned 32-bit. A null text is empty: its one piece is `end`.
    """
    path = path or tokenizer_path()
    kind = _PIECES + (", ids binary" if ids else "")
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * ids)
    last = struct.pack("<I", end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                names, texts = (c.to_pylist() for c in batch.slice(at, 256).columns)
                out: list[list] = [[] for _ in schema]
                for doc_id, text in zip(names, texts, strict=True):
                    coded = encode(text) + last
                    n = len(coded) // 4
                    start, piece = 0, 0
                    while start < n:
                        stop = start + ((n - start) % sequence or sequence)
                        own = coded[4 * start : 4 * stop]
                        for column, value in zip(out, (doc_id, piece, start, stop - start, zlib.crc32(own), own), strict=False):
                            column.append(value)
                        start, piece = stop, piece + 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, schema.types, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, kind)


class Sums:
    """Which lengths there are by the sums of one, two and three of them. The index holds lengths, not pieces: a filling
    counts only while `left`, the number of pieces of each length, has all its parts.
    """

    def __init__(self, left: np.ndarray):
        self.left = left
        some = np.nonzero(left)[0]
        two = np.add.outer(some, some)
        i, j = np.nonzero(np.tril(two < len(left)))
        order = np.lexsort((-some[i], two[i, j]))
        self.large, self.small = some[i][order], some[j][order]  # all pairs, by sum, the larger first
        self.begins = np.searchsorted(two[i, j][order], np.arange(len(left) + 1))

    def single(self, gap: int) -> tuple[int, ...] | None:
        return (gap,) if self.left[gap] else None

    def pair(self, gap: int, most: int | None = None) -> tuple[int, ...] | None:
        """Two available lengths of that sum, the larger first and as large as can be, most at most."""
        rows = slice(self.begins[gap], self.begins[gap + 1])
        a, b = self.large[rows], self.small[rows]
        fits = (self.left[a] > 0) & (self.left[b] > (a == b))
        if most is not None:
            fits &= a <= most
        k = int(fits.argmax()) if len(fits) else 0
        return (int(a[k]), int(b[k])) if len(fits) and fits[k] else None

    def triple(self, gap: int) -> tuple[int, ...] | None:
        """A length, as large as can be, and a pair of what remains."""
        for a in range(gap - 2, (gap - 1) // 3, -1):
            if self.left[a]:
                self.left[a] -= 1
                two = self.pair(gap - a, a)
                self.left[a] += 1
                if two:
                    return (a, *two)
        return None


def plan(counts: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences) that use each length as often as counted.

    Gaps are filled exactly by one, two or three lengths, one kind of filling after another for all gaps, then
    what is left is packed best-fit. Which kind should come first, and whether short lengths are better kept for
    the end, depends on the counts; so plans are made for the orders of one kind or more, quick ones first, until
    none of the others could save one sequence in a thousand, and the one with the fewest sequences is taken. No
    plan leaves the exact fillings out.
    """
    least = -(-sum(x * n for x, n in counts.items()) // sequence)
    orders = [k for n in (1, 2, 3) for k in permutations(("single", "pair", "triple"), n)]
    best, fewest = [], None
    for kinds in sorted(orders, key=lambda k: ("single", "pair", "triple").index(k[0])):
        found = _plan(counts, sequence, kinds)
        total = sum(times for _, times in found)
        if fewest is None or total < fewest:
            best, fewest = found, total
        if fewest - least <= least // 1000:
            break
    return best


def _plan(counts: dict[int, int], sequence: int, kinds: tuple[str, ...]) -> list[tuple[tuple[int, ...], int]]:
    have = np.zeros(sequence + 1, np.int64)
    for length, n in counts.items():
        have[length] = n
    recipes: dict[tuple[int, ...], int] = defaultdict(int)
    if have[sequence]:
        recipes[(sequence,)] = int(have[sequence])
        have[sequence] = 0
    sums = Sums(have)
    for kind in kinds:
        complement = getattr(sums, kind)
        for length in range(sequence - 1, 0, -1):
            while have[length]:
                have[length] -= 1
                others = complement(sequence - length)
                have[length] += 1
                if not others:
                    break
                recipe = (length, *others)
                times = min(int(have[x]) // recipe.count(x) for x in set(recipe))
                for x in recipe:
                    have[x] -= times
                recipes[recipe] += times
    rest = {int(x): int(have[x]) for x in np.nonzero(have)[0]}
    bins: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)  # by room

    def put(recipe: tuple[int, ...], times: int) -> None:
        room = sequence - sum(recipe)
        bins[room][recipe] = bins[room].get(recipe, 0) + times

    for length in sorted(rest, reverse=True):
        n = rest[length]
        while n:
            room = min((r for r, held in bins.items() if r >= length and held), default=None)
            if room is None:
                each = min(n, sequence // length)
                times = n // each
                put((length,) * each, times)
                n -= each * times
                continue
            recipe, there = bins[room].popitem()
            times = min(n, there)
            if there > times:
                bins[room][recipe] = there - times
            put((*recipe, length), times)
            n -= times
    for held in bins.values():
        for recipe, times in held.items():
            recipes[recipe] += times
    return list(recipes.items())


def slots(recipes: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """(length, first rank, sequence_id of that rank, offset): the runs of ranks of each length that stand alike."""
    ranks: dict[int, int] = defaultdict(int)
    rows, sequence_id = [], 0
    for recipe, times in recipes:
        offset = 0
        for length in recipe:
            rows.append((length, ranks[length], sequence_id, offset))
            ranks[length] += times
            offset += length
        sequence_id += times
    return pd.DataFrame(rows, columns=["length", "rank", "sequence_id", "offset"]).sort_values(["length", "rank"])


def pack(pieces: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """pieces (doc_id, piece, length, any others) with sequence_id and offset. pieces should be stored: they are read twice."""
    lengths = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `sequence` rows
    if not lengths:
        return pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    found = slots(plan(lengths, sequence))
    keys = (found["length"].to_numpy(np.int64) << 48) + found["rank"].to_numpy(np.int64)
    first, sequence_id, offset = (found[c].to_numpy(np.int64) for c in ("rank", "sequence_id", "offset"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        k = np.searchsorted(keys, (length.to_numpy(np.int64) << 48) + rank.to_numpy(np.int64), side="right") - 1
        return pd.DataFrame({"sequence_id": sequence_id[k] + rank.to_numpy(np.int64) - first[k], "offset": offset[k]})

    parts = math.isqrt(max(lengths.values())) + 1  # so the pieces of a part, and the parts of a length, are few next to the pieces
    rows = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("length", "part").count().select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    inner = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece")) - 1
    ranked = rows.withColumn("rank", inner).join(base, ["length", "part"]).withColumn("at", place("length", F.col("base") + F.col("rank")))
    return ranked.select(*pieces.columns, F.col("at.sequence_id").alias("sequence_id"), F.col("at.offset").alias("offset"))


def packed(docs: DataFrame, path: str | None = None, sequence: int = SEQUENCE, end: int = END, ids: bool = False) -> DataFrame:
    """The pieces of docs (doc_id, text) with their places: sequence_id, and offset, gapless from 0.

    A row of docs that is repeated is packed as often. A null text is empty, a null doc_id is kept; an empty table
    gives an empty result; other columns of docs are left out, whatever their names.
    """
    return pack(stored(tokenised(docs, path, sequence, end, ids)), sequence)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(read(spark, sf_dir, "documents").select("doc_id", "text"))
