import random
import re

from sparquill.functions import text


def brute(body, size, overlap):
    lines = re.findall("[^\n]*\n|[^\n]+", body)
    words = len(body.split())
    if not words:
        return []
    per, lap = max(1, int(size * len(lines) / words)), max(1, int(overlap * len(lines) / words))
    out, at = [], 0
    while at < len(lines):
        end = min(at + per, len(lines))
        chunk = "".join(lines[at:end])
        if len(chunk.strip()) < 50:
            at = end
            continue
        out.append((len(out), at + 1, end, chunk))
        at = end if end == len(lines) or end - lap <= 0 else max(end - lap, at + 1)
    return out


def test_chunks_of_lines(spark):
    rng = random.Random(3)
    texts = [None, "", "\n\n", "word", "a b c " * 20, *("".join(" ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(0, 9))) + rng.choice(["\n", "\n\n", ""]) for _ in range(rng.randint(1, 60))) for _ in range(40))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for size, overlap in ((40, 10), (20, 30)):
        got = {}
        for r in text.line_chunks(docs, size, overlap).orderBy("doc_id", "chunk_index").collect():
            got.setdefault(r.doc_id, []).append((r.chunk_index, r.start_line, r.end_line, r.chunk))
        assert got == {k: b for k, t in enumerate(texts) if (b := brute(t or "", size, overlap))}
