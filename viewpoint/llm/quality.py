"""Quality classifier: importance resampling with hashed n-gram models and Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewpoint.llm.common import Powers, chunks, materialize, prefix_hash, splitmix, text_bytes

#: Hash buckets of the n-gram models (words and word pairs).
BUCKETS = 1 << 20
#: Buckets per row of the count tables that tasks exchange, and the parts in which a
#: segment's rows are added up before they meet.
SEGMENT, PARTS = 1 << 9, 64
#: Labelled rows that the target model is fitted on, at most: those with the smallest MD5 of doc_id.
MAX_LABELLED = 20_000
#: Pseudo-count of the ratio target count / expected count.
PRIOR = 2.0
#: Log ratios above this are within sampling noise and count as 0.
NOISE = -1.0
#: A document's log weight is that of so many n-grams; shorter ones than LEAST count as that long.
SCALE, LEAST = 1000.0, 200
#: Longer documents weigh what their worst passage of so many words weighs.
WINDOW = 512
#: Share of the labelled target rows that the sample size is set to keep.
RECALL = 0.99
_U = np.uint64


def ngram_buckets(texts: list[bytes | None], table: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word, doc, two, first): the bucket of every lower-cased word and the text it belongs
    to; the bucket of every word pair and the place of its first word among the words."""
    split = [(t or b"").lower().split() for t in texts]
    counts = np.fromiter((len(w) for w in split), dtype=np.int64, count=len(split))
    n = int(counts.sum())
    if not n:
        return (np.zeros(0, dtype=np.int64),) * 4
    flat = [w for ws in split for w in ws]
    lens = np.fromiter(map(len, flat), dtype=np.int64, count=n)
    ends = np.cumsum(lens)
    acc = prefix_hash(np.frombuffer(b"".join(flat), dtype=np.uint8), table)
    _, down = table.get(int(ends[-1]) + 1)
    word = splitmix((acc[ends] - acc[ends - lens]) * down[ends - lens] + lens.astype(_U))
    doc = np.repeat(np.arange(len(split)), counts)
    first = np.flatnonzero(doc[1:] == doc[:-1])
    two = splitmix(word[first] * _U(3) + word[first + 1])
    mask = _U(BUCKETS - 1)
    return (word & mask).astype(np.int64), doc, (two & mask).astype(np.int64), first


def text_weights(texts: list[bytes | None], w: np.ndarray, table: Powers) -> np.ndarray:
    """SCALE times the mean of ``w`` over the n-grams of each text, or over those of its
    worst window of WINDOW words. A text's weight depends on nothing beside it."""
    word, doc, two, first = ngram_buckets(texts, table)
    value = w[word].astype(np.float64)
    value[first] += w[two]
    words = np.bincount(doc, minlength=len(texts))
    total, n = np.bincount(doc, value, len(texts)), 2 * words - 1
    starts = np.cumsum(words) - words
    for i in np.flatnonzero(words > WINDOW):
        sums = np.concatenate([[0.0], np.cumsum(value[starts[i] : starts[i] + words[i]])])
        total[i], n[i] = (sums[WINDOW:] - sums[:-WINDOW]).min(), 2 * WINDOW
    return SCALE * total / np.maximum(n, LEAST)


def labelled_rows(labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, target): at most ``most`` labelled documents; the target is good and not toxic."""
    one = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(
        F.min(((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int")).alias("target")
    )
    return one.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(most)


def fit(docs: DataFrame, labelled: DataFrame) -> np.ndarray:
    """Log ratio of the target model to the raw model, one number a bucket.

    The raw model counts the n-grams of every document, the target model those
    of the labelled target rows (``labelled`` is bounded, hence broadcast). The
    ratio is smoothed with PRIOR expected occurrences."""
    flagged = docs.select("doc_id", "text").join(F.broadcast(labelled), "doc_id", "left").select("text", (F.col("target") == 1).alias("is_target"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, raw, good = Powers(), np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            texts, flag = text_bytes(batch.column("text")), np.array([x is True for x in batch.column("is_target").to_pylist()], dtype=bool)
            for part in chunks([len(t or b"") for t in texts], 1 << 21):
                word, doc, two, first = ngram_buckets(texts[part], table)
                of_target = flag[part][doc]
                for buckets, ours in ((word, of_target), (two, of_target[first])):
                    np.add.at(raw, buckets, 1)
                    np.add.at(good, buckets[ours], 1)
        yield from segments(raw, good)

    def segments(raw: np.ndarray, good: np.ndarray) -> Iterator[pa.RecordBatch]:
        part = (TaskContext.get().partitionId() if TaskContext.get() else 0) % PARTS
        for i in np.flatnonzero(raw.reshape(-1, SEGMENT).any(axis=1)).tolist():
            at = slice(i * SEGMENT, (i + 1) * SEGMENT)
            yield pa.RecordBatch.from_pydict(
                {"segment": pa.array([i], pa.int32()), "part": pa.array([part], pa.int32()), "raw": pa.array([raw[at]], pa.list_(pa.int64())), "good": pa.array([good[at]], pa.list_(pa.int64()))}
            )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            at = np.array(batch.column("segment"))[:, None] * SEGMENT + np.arange(SEGMENT)
            np.add.at(raw, at, batch.column("raw").flatten().to_numpy().reshape(-1, SEGMENT))
            np.add.at(good, at, batch.column("good").flatten().to_numpy().reshape(-1, SEGMENT))
        yield from segments(raw, good)

    schema = "segment int, part int, raw array<bigint>, good array<bigint>"
    # A task adds up what comes to it batch by batch: PARTS rows a segment are left whatever the
    # number of tasks, then one. BUCKETS numbers in all come back, whatever the corpus.
    parts = flagged.mapInArrow(count, schema).repartition("segment", "part").mapInArrow(add, schema)
    got = parts.repartition("segment").mapInArrow(add, schema).collect()
    raw, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in got:
        at = slice(r["segment"] * SEGMENT, (r["segment"] + 1) * SEGMENT)
        raw[at], good[at] = r["raw"], r["good"]
    expected = raw * (good.sum() / max(raw.sum(), 1.0))
    ratio = np.log((good + PRIOR) / (expected + PRIOR))
    return np.where(ratio < NOISE, ratio, 0.0).astype(np.float32)


def score(docs: DataFrame, model: np.ndarray, seed: int = 0) -> DataFrame:
    """(doc_id, log_weight, key): the document's log importance weight, and that
    plus standard Gumbel noise drawn from its id."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, w = Powers(), shared.value
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            weight = np.zeros(len(texts))
            for part in chunks([len(t or b"") for t in texts], 1 << 21):
                weight[part] = text_weights(texts[part], w, table)
            ids = batch.column("doc_id")
            x = splitmix(splitmix(ids.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64).view(_U)) + _U(seed))
            u = ((x >> _U(11)).astype(np.float64) + 0.5) / (1 << 53)
            yield pa.RecordBatch.from_pydict({"doc_id": ids, "log_weight": pa.array(weight), "key": pa.array(weight - np.log(-np.log(u)))})

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "text").mapInArrow(run, "doc_id bigint, log_weight double, key double")


def kth_largest(scores: DataFrame, k: int) -> tuple[float, int] | None:
    """(key, doc_id) of the k-th row by (key descending, doc_id), found by
    counting: whole parts of the key first, then 65,536ths inside the part that
    holds the k-th, then an ordinary sort of the few rows left. Keys span a
    bounded range, so the driver sees a bounded number of counts."""
    left, part = k, scores
    for bin_of in (F.floor("key"), F.floor((F.col("key") - F.floor("key")) * 65536)):
        counts = sorted(((r["b"], r["n"]) for r in part.groupBy(bin_of.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
        for b, n in counts:
            if left <= n:
                part = part.where(bin_of == b)
                break
            left -= n
        else:
            return None
    row = part.orderBy(F.desc("key"), F.asc_nulls_first("doc_id")).limit(left).agg(F.max(F.struct(-F.col("key"), F.coalesce("doc_id", F.lit(-(1 << 62))))).alias("x")).first()["x"]
    return -row[0], row[1]


def classify(docs: DataFrame, labels: DataFrame, recall: float = RECALL, max_labelled: int = MAX_LABELLED, seed: int = 0) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, log_weight, key and
    kept (boolean).

    A document's log weight is SCALE times the mean log ratio of its hashed words
    and word pairs under the target and the raw model, ratios above NOISE counted
    as 0; of a document of more than WINDOW words it is that of its worst WINDOW
    words in a row, so that no length hides a bad passage. With Gumbel noise added, the
    k largest keys are a sample without replacement in proportion to the weights.
    (The plain sum of all ratios, the usual importance weight, grows with the
    length: it rejects long clean documents before short toxic ones.)
    k is the number of documents times the share of labelled rows whose key
    reaches the (1 - recall) quantile of the labelled target rows.

    ``labels`` (doc_id, quality, toxic): rows with null doc_id or quality are
    skipped, a null toxic counts as 0, and an id labelled twice is a target
    only if both say so. With no target row at all, everything is kept. Null
    and empty texts have log weight 0. Rows that repeat an id and text get the
    same key and the same verdict; ties in the key go to the smaller doc_id, a
    null id first. Other columns are ignored.
    """
    labelled = materialize(labelled_rows(labels, max_labelled), "labelled")
    scores = materialize(score(docs, fit(docs, labelled), seed), "scores")
    known = scores.join(F.broadcast(labelled), "doc_id").groupBy("target").agg(F.array_agg("key").alias("keys")).collect()
    keys = {r["target"]: np.array(r["keys"]) for r in known}
    if 1 not in keys:
        return scores.withColumn("kept", F.lit(True))
    every = np.concatenate(list(keys.values()))
    share = float(np.mean(every >= np.quantile(keys[1], 1 - recall)))
    last = kth_largest(scores, max(1, round(share * scores.count())))
    at, who = last
    kept = (F.col("key") > at) | ((F.col("key") == at) & (F.coalesce("doc_id", F.lit(-(1 << 62))) <= who))
    return scores.withColumn("kept", kept)
