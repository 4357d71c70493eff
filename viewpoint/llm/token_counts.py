"""Token counts of whole texts; long texts are encoded in overlapping chunks in many tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewpoint.llm.common import materialize, split_join
from viewpoint.llm.encoders import encoder

#: Characters of a chunk, and of the stretch that it shares with the next one.
CHUNK, OVERLAP = 1 << 15, 1 << 9

PARTS = "k1 bigint, k2 bigint, seq int, last boolean, part string"
SEAMS = "k1 bigint, k2 bigint, seam int, side int, at array<bigint>, before array<bigint>, total bigint"


def chunk_starts(n: int, stride: int, overlap: int) -> range:
    """Starts of the chunks of a text of ``n`` characters; each ends ``overlap``
    characters after the next one's start, the last one at the end."""
    return range(0, max(1, n - overlap), stride)


def text_counts(texts: DataFrame, vocabulary: str, stride: int, overlap: int) -> DataFrame:
    """(k1, k2, n_tokens) of the texts (k1, k2, text), a row per key; n_tokens is
    NULL where two neighbouring chunks share no proven boundary.

    With F(p) the tokens of a chunk before character p, a text has the last
    chunk's tokens plus, for every seam, F(p) of the left chunk less F(p) of the
    right one at the first boundary p that both have in their overlap."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k1, k2, text in zip(*(batch.column(c) for c in ("k1", "k2", "text")), strict=True):
                text = text.as_py()
                starts = chunk_starts(len(text), stride, overlap)
                for lo in range(0, len(starts), 64):
                    part = starts[lo : lo + 64]
                    n = len(part)
                    ends = [x + stride + overlap if i < len(starts) - 1 else len(text) for i, x in enumerate(part, lo)]
                    yield pa.RecordBatch.from_pydict({
                        "k1": pa.array([k1.as_py()] * n), "k2": pa.array([k2.as_py()] * n), "seq": pa.array(range(lo, lo + n), pa.int32()),
                        "last": pa.array([i == len(starts) - 1 for i in range(lo, lo + n)]), "part": pa.array([text[a:b] for a, b in zip(part, ends, strict=True)], pa.string()),
                    })

    def seams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, names = encoder(vocabulary), ("k1", "k2", "seam", "side", "at", "before", "total")
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64())
        for batch in batches:
            rows = []
            for k1, k2, seq, last, part in zip(*(batch.column(c) for c in ("k1", "k2", "seq", "last", "part")), strict=True):
                key, seq, last = (k1.as_py(), k2.as_py()), seq.as_py(), last.as_py()
                at, before, total = enc.boundaries(part.as_py(), not last)
                if seq:
                    head = at < overlap
                    rows.append((*key, seq - 1, 1, at[head], before[head], None))
                if last:
                    rows.append((*key, seq, 2, [], [], total))
                else:
                    tail = at >= stride
                    rows.append((*key, seq, 0, at[tail] - stride, before[tail], None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    parts = texts.mapInArrow(split, PARTS).groupBy("k1", "k2", "seq").agg(F.first("last").alias("last"), F.first("part").alias("part"))
    found = parts.mapInArrow(seams, SEAMS).groupBy("k1", "k2", "seam").agg(F.collect_list(F.struct("side", "at", "before", "total")).alias("x"))
    side = lambda i: F.element_at(F.filter("x", lambda r: r["side"] == i), 1)
    found = found.select("k1", "k2", F.get("x", 0)["total"].alias("total"), F.size("x").alias("sides"), F.when(F.size("x") == 2, F.struct(side(0).alias("l"), side(1).alias("r"))).alias("s"))
    found = found.withColumn("p", F.array_min(F.array_intersect("s.l.at", "s.r.at")))
    tokens = [F.element_at(f"s.{x}.before", F.array_position(f"s.{x}.at", F.col("p")).cast("int")) for x in "lr"]
    found = found.select("k1", "k2", F.when(F.col("sides") == 1, F.col("total")).when(F.col("p").isNotNull(), tokens[0] - tokens[1]).alias("n"))
    n = F.when(F.count("n") == F.count(F.lit(1)), F.sum("n"))
    return found.groupBy("k1", "k2").agg(n.alias("n_tokens"))


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_bytes (UTF-8), n_tokens
    (bigint) and over_limit (n_tokens > ``limit``), as the tokenizer at the path
    ``vocabulary`` (see :mod:`viewpoint.llm.encoders`) encodes the whole text.

    A text of up to ``chunk`` characters is encoded in one go. A longer one is cut into
    chunks that overlap; every distinct long text is cut once, and its chunks are
    encoded in tasks of their own. Neighbours are spliced at the first boundary that is
    proven stable and that both have; where there is none, the text is cut again with chunks twice and
    overlaps four times as long (chunk-long at most), until it is one chunk at last.

    Null texts count as empty (0 bytes, 0 tokens). Rows that repeat an id or a text each give
    a row, null ids pass, other columns of ``docs`` are left out. Long texts are told apart by 120 bits of SHA-256.
    """
    if not 0 < overlap <= chunk:
        raise ValueError("overlap must lie between 1 and chunk")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    long = F.length("text") > chunk

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t or "" for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "n_bytes": part.column("n_bytes"), "n_tokens": pa.array(list(map(len, enc.encode(texts))), pa.int64())})

    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes")
    short = rows.where(F.col("text").isNull() | ~long).select("doc_id", n_bytes, "text").mapInArrow(count, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    digest = F.sha2("text", 256)
    keys = [F.conv(F.substring(digest, at, 15), 16, 10).cast("bigint").alias(k) for at, k in ((1, "k1"), (16, "k2"))]
    keyed = rows.where(long).select("doc_id", n_bytes, *keys, "text")

    texts, stride = keyed.select("k1", "k2", "text"), chunk
    counts = left = None
    while True:
        found = materialize(text_counts(texts, vocabulary, stride, overlap), "token_counts")
        done = found.where("n_tokens is not null")
        counts = done if counts is None else counts.union(done)
        left = found.where("n_tokens is null").select("k1", "k2")
        if left.isEmpty():
            break
        stride, overlap = 2 * stride, min(2 * stride, 4 * overlap)
        texts = keyed.select("k1", "k2", "text").join(left, ["k1", "k2"], "left_semi")
    whole = split_join(keyed.drop("text"), counts, "k1", "k2").select("doc_id", "n_bytes", "n_tokens")
    return short.union(whole).withColumn("over_limit", F.col("n_tokens") > limit)
