"""Suffix-array dedup: a logarithmic family of sparse suffix arrays, exact to the byte."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewpoint.llm.common import Powers, chunks, materialize, prefix_hash, splitmix, text_bytes

#: Length of the strings that count as repeats.
LENGTH = 100
#: Length of the grams of which each string names its smallest as its anchor.
GRAM = 24
#: Bytes of text that are indexed together, and entries that a task gathers
#: before it sorts them and drops its own repeats.
CHUNK, GATHER = 1 << 21, 1 << 20
#: Distinct surroundings of an anchor up to which one task compares them.
COMMON = 4096
_U = np.uint64
_POS = _U(24)


class Corpus:
    """Bytes of some texts, one after another, with their rolling hashes."""

    def __init__(self, texts: list[bytes], table: Powers) -> None:
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        self.lens = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.ends = np.cumsum(self.lens)
        self.starts = self.ends - self.lens
        self.acc = prefix_hash(data, table)
        self.down = table.get(len(data) + 1)[1]

    def hashes(self, start: np.ndarray, end: np.ndarray, salt: np.ndarray | int = 0) -> np.ndarray:
        """64-bit hashes of the byte ranges [start, end)."""
        return splitmix((self.acc[end] - self.acc[start]) * self.down[start] + np.asarray(salt).astype(_U))


def entries(texts: list[bytes], table: Powers) -> tuple[np.ndarray, ...]:
    """The sparse suffix entries of some texts: (gram, around, text, first, last).

    Every LENGTH-byte string names the position of its smallest GRAM hash
    (leftmost of equal ones) as its anchor; equal strings name the same place.
    Consecutive strings with one anchor make an entry: the hash of the anchor's
    gram, the hash of all bytes that its strings cover (with the anchor's place
    among them), the text's number, and the starts of the first and last string."""
    c = Corpus(texts, table)  # under 16 MB, so that a position takes 24 bits
    n, w = len(c.acc) - 1, LENGTH - GRAM + 1
    if n < LENGTH:
        return tuple(np.zeros(0, dtype=t) for t in (_U, _U, np.int64, np.int64, np.int64))
    gram = splitmix((c.acc[GRAM:] - c.acc[:-GRAM]) * c.down[: n - GRAM + 1])
    low = (gram >> _POS << _POS) | np.arange(len(gram), dtype=_U)
    span = 1
    while span * 2 <= w:
        low, span = np.minimum(low[:-span], low[span:]), span * 2
    low = np.minimum(low[: len(low) - (w - span)], low[w - span :])
    text = np.repeat(np.arange(len(texts)), c.lens)[: len(low)]
    at = np.flatnonzero(np.arange(len(low)) + LENGTH <= c.ends[text])
    if not len(at):
        return tuple(np.zeros(0, dtype=t) for t in (_U, _U, np.int64, np.int64, np.int64))
    anchor = (low[at] & _U((1 << 24) - 1)).astype(np.int64)
    cut = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)]))
    first, last, anchor = at[cut], at[np.concatenate([cut[1:] - 1, [len(at) - 1]])], anchor[cut]
    around = c.hashes(first, last + LENGTH, ((last - first) << 8) + (anchor - first))
    number = text[first]
    return gram[anchor], around, number, first - c.starts[number], last - c.starts[number]


def long_entries(text: bytes, table: Powers) -> Iterator[tuple[np.ndarray, ...]]:
    """Entries of one text of any length, piece by piece: pieces overlap by
    LENGTH - 1 bytes, so each string lies in one piece."""
    step = 1 << 23
    for at in range(0, max(1, len(text) - LENGTH + 1), step):
        g, a, n, first, last = entries([text[at : at + step + LENGTH - 1]], table)
        yield g, a, n, first + at, last + at


def pack(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return first << 8 | last - first


def unpack(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return place >> 8, (place >> 8) + (place & 255)


def runs(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ranges merged where they touch or overlap, in (doc, start) order."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    new_doc = np.concatenate([[True], doc[1:] != doc[:-1]])
    # Largest end so far within the document: ends are lifted above those of earlier documents.
    lift = np.cumsum(new_doc) * (int(end.max()) + 1)
    top = np.maximum.accumulate(end + lift) - lift
    cut = np.flatnonzero(new_doc | np.concatenate([[True], start[1:] > top[:-1]]))
    return doc[cut], start[cut], top[np.concatenate([cut[1:] - 1, [len(doc) - 1]])]


def repeats(gram: np.ndarray, around: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries in suffix order (gram, around, doc, place), each place once,
    and whether the entry before has the same bytes."""
    order = np.lexsort((place, doc, around, gram))
    same = np.zeros(len(order), dtype=bool)
    same[1:] = (gram[order][1:] == gram[order][:-1]) & (around[order][1:] == around[order][:-1])
    once = np.ones(len(order), dtype=bool)
    once[1:] = ~(same[1:] & (doc[order][1:] == doc[order][:-1]) & (place[order][1:] == place[order][:-1]))
    return order[once], same[once]


class Family:
    """A logarithmic family of sorted entry arrays, at most one of each size class.

    A batch, whose entries all come later than those it holds, is sorted into
    an array of its own, scanned against every level for entries with the same
    bytes, and what is new becomes a level; levels of equal size class merge."""

    def __init__(self) -> None:
        self.levels: list[tuple[np.ndarray, ...]] = []

    @staticmethod
    def find(level: tuple[np.ndarray, ...], gram: np.ndarray, around: np.ndarray) -> np.ndarray:
        """Index in ``level`` of the entry with the same (gram, around), else -1."""
        lo, end = np.searchsorted(level[0], gram, "left"), np.searchsorted(level[0], gram, "right")
        hi = end.copy()
        while (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            less = open_ & (level[1][np.minimum(mid, len(level[1]) - 1)] < around)
            lo, hi = np.where(less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
        at = np.minimum(lo, len(level[1]) - 1)
        return np.where((lo < end) & (level[1][at] == around), at, -1)

    def add(self, gram: np.ndarray, around: np.ndarray, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Adds a batch and returns the indices of its entries that occur earlier."""
        order, same = repeats(gram, around, doc, place)
        old = [order[same]]
        new = order[~same]
        for level in self.levels:
            at = self.find(level, gram[new], around[new])
            hit = at >= 0
            own = hit & (level[2][at] == doc[new]) & (level[3][at] == place[new])  # a repeated row of the same document
            old.append(new[hit & ~own])
            new = new[~hit]
        if len(new):
            self.levels.append((gram[new], around[new], doc[new], place[new]))
        while len(self.levels) > 1 and len(self.levels[-1][0]).bit_length() >= len(self.levels[-2][0]).bit_length():
            x, y = self.levels.pop(), self.levels.pop()
            joined = [np.concatenate(z) for z in zip(y, x, strict=True)]
            by = np.lexsort((joined[1], joined[0]))
            self.levels.append(tuple(z[by] for z in joined))
        return np.concatenate(old)

    def all(self) -> tuple[np.ndarray, ...]:
        if not self.levels:
            return tuple(np.zeros(0, dtype=t) for t in (_U, _U, np.int64, np.int64))
        joined = [np.concatenate(z) for z in zip(*self.levels, strict=True)]
        by = np.lexsort((joined[1], joined[0]))
        return tuple(z[by] for z in joined)


def batch_arrays(docs: DataFrame) -> DataFrame:
    """(gram, around, doc, place): the entries of every task's documents, sorted
    and without those that the task itself has seen earlier. For those, which
    are repeats for certain, come rows of merged byte ranges: gram a hash of the
    document, around null, place the start, and ``until`` the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held, n = Powers(), [], 0

        def flush() -> pa.RecordBatch:
            gram, around, doc, place = (np.concatenate(x) for x in zip(*held, strict=True))
            order, same = repeats(gram, around, doc, place)
            first, last = unpack(place[order[same]])
            d, start, end = runs(doc[order[same]], first, last + LENGTH)
            keep = order[~same]
            gone = np.concatenate([np.zeros(len(keep), dtype=bool), np.ones(len(d), dtype=bool)])
            return pa.RecordBatch.from_pydict(
                {
                    "gram": pa.array(np.concatenate([gram[keep], splitmix(d.view(_U))]).view(np.int64)),
                    "around": pa.array(np.concatenate([around[keep].view(np.int64), np.zeros(len(d), np.int64)]), mask=gone),
                    "doc": pa.array(np.concatenate([doc[keep], d])),
                    "place": pa.array(np.concatenate([place[keep], start])),
                    "until": pa.array(np.concatenate([np.zeros(len(keep), np.int64), end]), mask=~gone),
                }
            )

        for batch in batches:
            texts, ids = text_bytes(batch.column("text")), batch.column("doc_id").to_numpy()
            for part in chunks([len(t) for t in texts], CHUNK):
                some = texts[part]
                each = long_entries(some[0], table) if len(some) == 1 else [entries(some, table)]
                for gram, around, number, first, last in each:
                    held.append((gram, around, ids[part][number], pack(first, last)))
                    n += len(gram)
                if n >= GATHER:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()

    return docs.mapInArrow(run, "gram bigint, around bigint, doc bigint, place bigint, until bigint")


def scanned(arrays: DataFrame) -> DataFrame:
    """(doc, start, until, gram, common): with ``gram`` null, byte ranges that
    occur earlier; else an entry's strings, from ``start`` to ``until``, whose
    anchor's gram has other surroundings elsewhere, so that they may repeat one
    by one (``common``: over COMMON of them).

    Entries are dealt out by gram and come in document order; each task feeds
    its share, batch by batch, to a :class:`Family`. Tasks have dropped their
    own repeats before, so a hot passage sends one entry a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = Family()

        def out(doc, start, until, gram=None, common=None) -> pa.RecordBatch:
            n = len(doc)
            return pa.RecordBatch.from_pydict(
                {
                    "doc": pa.array(doc, pa.int64()), "start": pa.array(start, pa.int64()), "until": pa.array(until, pa.int64()),
                    "gram": pa.nulls(n, pa.int64()) if gram is None else pa.array(gram.view(np.int64)),
                    "common": pa.nulls(n, pa.bool_()) if common is None else pa.array(common),
                }
            )

        for batch in batches:
            known = batch.column("around").is_null().to_numpy(zero_copy_only=False)
            gram, doc, place = (batch.column(x).to_numpy() for x in ("gram", "doc", "place"))
            if known.any():
                yield out(doc[known], place[known], batch.column("until").to_numpy(zero_copy_only=False)[known].astype(np.int64))
            fresh = np.flatnonzero(~known)
            around = batch.column("around").fill_null(0).to_numpy()[fresh].view(_U)
            old = family.add(gram[fresh].view(_U), around, doc[fresh], place[fresh])
            first, last = unpack(place[fresh][old])
            yield out(*runs(doc[fresh][old], first, last + LENGTH))
        gram, _, doc, place = family.all()
        if len(gram):
            cut = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
            size = np.diff(np.concatenate([cut, [len(gram)]]))
            many = np.repeat(size, size)
            some = many > 1
            first, last = unpack(place[some])
            yield out(doc[some], first, last, gram[some], many[some] > COMMON)

    parts = int(arrays.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = arrays.repartition(parts, "gram").sortWithinPartitions("doc", "place")
    return dealt.mapInArrow(run, "doc bigint, start bigint, until bigint, gram bigint, common boolean")


def string_hashes(partial: DataFrame, texts: DataFrame) -> DataFrame:
    """(gram, common, doc, start, h): hashes of the strings of the given entries."""
    asked = partial.groupBy("doc").agg(F.collect_list(F.struct("gram", "common", "start", "until")).alias("asked"))
    both = texts.join(asked.withColumnRenamed("doc", "doc_id").hint("merge"), "doc_id").select("doc_id", "text", "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Powers()
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            for part in chunks([len(t) for t in texts], CHUNK):
                c = Corpus(texts[part], table)
                rows = []
                for i, (doc, asked) in enumerate(zip(batch.column("doc_id")[part.start : part.stop].to_pylist(), batch.column("asked")[part.start : part.stop].to_pylist(), strict=True)):
                    for x in asked:
                        at = np.arange(x["start"], x["until"] + 1) + c.starts[i]
                        at = at[at + LENGTH <= c.ends[i]]
                        rows.append((x["gram"], x["common"], doc, x["start"], c.hashes(at, at + LENGTH).view(np.int64)))
                if rows:
                    g, o, d, s, h = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_pydict({"gram": pa.array(g, pa.int64()), "common": pa.array(o), "doc": pa.array(d, pa.int64()), "start": pa.array(s, pa.int64()), "h": pa.array(h, pa.list_(pa.int64()))})

    return both.mapInArrow(run, "gram bigint, common boolean, doc bigint, start bigint, h array<bigint>")


def repeated_strings(hashed: DataFrame) -> DataFrame:
    """(doc, start, until): byte ranges of single strings that occur earlier.
    Entries of one gram meet in a task, in document order; those of a common
    gram are aggregated string by string instead, first within each task."""

    def compare(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        size = np.array([len(x) for x in t.column("h")])
        flat = t.column("h").combine_chunks().flatten().to_numpy()
        row = np.repeat(np.arange(len(size)), size)
        start = t.column("start").to_numpy()[row] + np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        gram, doc = t.column("gram").to_numpy()[row], t.column("doc").to_numpy()[row]
        order = np.lexsort((start, doc, flat, gram))
        same = (gram[order][1:] == gram[order][:-1]) & (flat[order][1:] == flat[order][:-1])
        # A repeated row of the document gives the same place again: that is not an earlier one.
        lead = np.concatenate([[0], np.where(same, 0, np.arange(1, len(order)))]) if len(order) else np.zeros(0, np.int64)
        lead = order[np.maximum.accumulate(lead)]
        again = (lead != order) & ((doc[lead] != doc[order]) | (start[lead] != start[order]))
        at = order[again]
        d, s, e = runs(doc[at], start[at], start[at] + LENGTH)
        return pa.RecordBatch.from_pydict({"doc": pa.array(d, pa.int64()), "start": pa.array(s, pa.int64()), "until": pa.array(e, pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            grams = t.column("gram").to_numpy()
            cut = int(np.searchsorted(grams, grams[-1], "left"))  # the last gram may go on in the next batch
            if cut:
                yield compare(t.slice(0, cut))
            held = t.slice(cut)
        if held is not None and held.num_rows:
            yield compare(held)

    parts = int(hashed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    few = hashed.where("not common").select("gram", "doc", "start", "h").repartition(parts, "gram").sortWithinPartitions("gram", "doc", "start")
    few = few.mapInArrow(run, "doc bigint, start bigint, until bigint")
    many = hashed.where("common").select("gram", "doc", "start", F.posexplode("h").alias("i", "x"))
    many = many.select("gram", "x", F.struct("doc", (F.col("start") + F.col("i")).alias("start")).alias("at"))
    first = many.groupBy("gram", "x").agg(F.min("at").alias("first"), F.max("at").alias("last")).where("first <> last").drop("last")
    many = many.join(first.hint("merge"), ["gram", "x"]).where("at <> first").select("at.doc", "at.start", (F.col("at.start") + LENGTH).alias("until"))
    return few.union(many)


def removed_ranges(docs: DataFrame) -> DataFrame:
    """(doc, start, until): byte ranges of ``docs`` that a LENGTH-byte string
    covers which also starts earlier; they may overlap."""
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    found = materialize(scanned(batch_arrays(texts)), "scanned")
    hashed = materialize(string_hashes(found.where("gram is not null"), texts), "strings")
    return found.where("gram is null").select("doc", "start", "until").union(repeated_strings(hashed))


def dedup_bytes(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed,
    n_spans (bigint), kept_sha256 and, where asked for, ``kept``, the remaining
    bytes (binary, as a range may cut a character).

    Texts are taken as UTF-8 bytes, null as empty. Every byte goes that is
    covered by a string of LENGTH bytes which also starts earlier: at a smaller
    doc_id, or earlier in the same document. Strings are judged on the input;
    overlaps count; spans are maximal removed runs.

    Rows that repeat a doc_id are the same document: equal texts take nothing
    from each other, and with different texts each row loses the ranges found
    in any of them, as far as it goes. Rows with a null doc_id keep all their
    bytes and take none from others. Other columns are ignored. A document is
    one row, so its ranges meet in one task, as its text does.
    """
    ranges = removed_ranges(docs).groupBy("doc").agg(F.collect_list(F.struct("start", "until")).alias("ranges"))
    both = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(ranges.withColumnRenamed("doc", "doc_id").hint("merge"), "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = []
                for text, found in zip(text_bytes(part.column("text")), part.column("ranges"), strict=True):
                    text, spans = text or b"", []
                    if found.is_valid and text:
                        flat = found.values
                        start, until = (np.minimum(flat.field(i).to_numpy(), len(text)) for i in (0, 1))
                        _, s, e = runs(np.zeros(len(start), np.int64), start, until)
                        spans = [(x, y) for x, y in zip(s.tolist(), e.tolist(), strict=True) if y > x]
                    kept = b"".join(text[x:y] for x, y in zip([0, *[e for _, e in spans]], [*[s for s, _ in spans], len(text)], strict=True))
                    rows.append((len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept))
                n, m, k, sha, kept = zip(*rows, strict=True)
                cols = {"doc_id": part.column("doc_id"), "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(m, pa.int64()), "n_spans": pa.array(k, pa.int64()), "kept_sha256": pa.array(sha)}
                yield pa.RecordBatch.from_pydict(cols | ({"kept": pa.array(kept, pa.binary())} if with_text else {}))

    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * with_text
    return both.select("doc_id", "text", "ranges").mapInArrow(run, schema)
