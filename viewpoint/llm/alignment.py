"""Cross-tokenizer alignment: which tokens of two tokenizers lie on the same bytes, and how often id pairs do."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewpoint.llm.common import materialize, split_join
from viewpoint.llm.encoders import ByteLevel, Pieces, encoder

#: Links that a task gathers as a block, documents of a block, and characters that are aligned at a time.
BLOCK, BLOCK_DOCS, STEP = 1 << 20, 1 << 16, 1 << 17
#: An id pair is one whole number: the A id times 2 ** SHIFT plus the B id.
SHIFT = 24

BLOCKS = (
    "block bigint, i int, pair bigint, times bigint,"
    " doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, places array<int>, uses array<int>"
)
RESULT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
#: A space after another character: neither tokenizer has a token across it, and B's own leading space can stand for it.
_CUT = regex.compile(rf"(?<=[^\s▁]) (?=[^\s▁])")


def steps(text: str, size: int) -> list[str]:
    """``text`` with its space in front, cut at places that no token crosses, in
    parts of about ``size`` characters that start with a space, too."""
    if len(text) <= size:
        return [" " + text]
    out, start = [], 0
    while start < len(text):
        m = _CUT.search(text, start + size)
        end = m.start() if m else len(text)
        out.append(" " + text[start:end])
        start = end + 1
    return out


class Aligner:
    """Aligns texts token by token; the decimal strings of the ids are made once."""

    def __init__(self, path_a: str, path_b: str) -> None:
        self.a, self.b = encoder(path_a), encoder(path_b)
        if not isinstance(self.a, ByteLevel) or not isinstance(self.b, Pieces):
            raise ValueError("the alignment takes a byte-level .json file and a sentencepiece .model file")
        self.len_a, self.len_b = (np.array([len(p) for p in e.pieces], dtype=np.int64) for e in (self.a, self.b))
        self.sizes_a = self.len_a.tolist()
        n = self.a.size
        #: An A id is followed by "," or "|", a B id by "," or ";".
        self.words = [f"{i}{c}" for size, marks in ((n, ",|"), (self.b.size, ",;")) for c in marks for i in range(size)]

    def align(self, parts: list[str]) -> list[tuple | None]:
        """For each part (its leading space included): numbers of A tokens, B tokens and
        groups, the groups as text with a final ";", and the links as pairs; None where the bytes of the tokens are not the part's."""
        ids_a, ids_b = self.a.encode_plain(parts), self.b.encode_plain([p[1:] for p in parts])
        size_a, piece_b = self.sizes_a.__getitem__, self.b.pieces.__getitem__
        good = []
        for p, x, y in zip(parts, ids_a, ids_b, strict=True):
            data = p.encode()
            # A splits the text's bytes and loses none, so A's bytes are the text's if there are as many.
            good.append(sum(map(size_a, x)) == len(data) and b"".join(map(piece_b, y)) == data)
        ids_a = [x for x, g in zip(ids_a, good, strict=True) if g]
        ids_b = [x for x, g in zip(ids_b, good, strict=True) if g]
        n_a, n_b = (np.array(list(map(len, x)), dtype=np.int64) for x in (ids_a, ids_b))
        if not len(n_a):
            return [None] * len(parts)
        a, b = (np.fromiter(chain.from_iterable(x), dtype=np.int64, count=int(n.sum())) for x, n in ((ids_a, n_a), (ids_b, n_b)))
        end_a, end_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        # Ends that both have cut the tokens into groups: a look-up of A's ends among B's, in their order.
        index_b = dict(zip(end_b.tolist(), range(len(b)), strict=True))
        hit = np.fromiter(map(index_b.get, end_a.tolist(), repeat(-1)), dtype=np.int64, count=len(a))
        last_a = np.flatnonzero(hit >= 0)
        last_b = hit[last_a]
        group_a = np.cumsum(hit >= 0) - (hit >= 0)
        is_last_b = np.zeros(len(b), dtype=bool)
        is_last_b[last_b] = True
        group_b = np.cumsum(is_last_b) - is_last_b
        # A's tokens of a group, then B's, then the next group.
        word = np.empty(len(a) + len(b), dtype=np.int64)
        before = np.concatenate([[0], last_b[:-1] + 1])
        word[np.arange(len(a)) + before[group_a]] = a + self.a.size * (hit >= 0)
        word[np.arange(len(b)) + last_a[group_b] + 1] = 2 * self.a.size + b + self.b.size * is_last_b
        # Links: every B token whose bytes meet those of an A token, within the slices of a group.
        first = np.searchsorted(end_b, end_a - self.len_a[a], side="right")
        each = np.searchsorted(end_b, end_a, side="left") - first + 1
        at = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each - first, each)
        pairs = np.repeat(a, each) << SHIFT | b[at]

        stop_a, stop_b = np.cumsum(n_a), np.cumsum(n_b)
        stop_link, stop_group = np.cumsum(each)[stop_a - 1], np.cumsum(hit >= 0)[stop_a - 1]
        stop_word = stop_a + stop_b
        out, k, say = [], 0, self.words.__getitem__
        lo_link = lo_group = lo_word = 0
        for g in good:
            if not g:
                out.append(None)
                continue
            text = "".join(map(say, word[lo_word : stop_word[k]].tolist()))
            out.append((int(n_a[k]), int(n_b[k]), int(stop_group[k] - lo_group), text, pairs[lo_link : stop_link[k]]))
            lo_link, lo_group, lo_word = stop_link[k], stop_group[k], stop_word[k]
            k += 1
        return out


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """The aligner of two files, made once per Python worker."""
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


class Document:
    """What the parts of one text add up to."""

    __slots__ = ("doc_id", "good", "n_a", "n_b", "n_groups", "sha", "pairs")

    def __init__(self, doc_id: int | None, good: bool) -> None:
        self.doc_id, self.good, self.n_a, self.n_b, self.n_groups, self.sha, self.pairs = doc_id, good, 0, 0, 0, None, []

    def add(self, part: tuple | None) -> None:
        if part is None:
            self.good = False
        elif self.good:
            self.n_a, self.n_b, self.n_groups = self.n_a + part[0], self.n_b + part[1], self.n_groups + part[2]
            text = part[3][:-1].encode()
            if self.sha is None:
                self.sha = hashlib.sha256(text)
            else:
                self.sha.update(b";" + text)
            self.pairs.append(part[4])

    def row(self) -> tuple:
        """(doc_id, n_a, n_b, n_groups, digest, pairs); zeros and '' without tokens."""
        if not self.good or not self.pairs:
            return self.doc_id, 0, 0, 0, "", np.zeros(0, dtype=np.int64)
        return self.doc_id, self.n_a, self.n_b, self.n_groups, self.sha.hexdigest(), np.concatenate(self.pairs)


def block_rows(block: int, docs: list[tuple]) -> Iterator[pa.RecordBatch]:
    """A block as rows: one for each of its distinct pairs (i, pair, and the number of its links),
    and one for each document, with its distinct pairs as places among these. Readers and writers
    hold some thousands of rows at a time, so a row has no more than a document."""
    n_links = np.array([len(d[5]) for d in docs], dtype=np.int64)
    pairs, place, times = np.unique(np.concatenate([d[5] for d in docs]), return_inverse=True, return_counts=True)
    width = max(len(pairs), 1)
    of_doc, uses = np.unique(np.repeat(np.arange(len(docs)), n_links) * width + place, return_counts=True)
    ends = np.concatenate([[0], np.searchsorted(of_doc, np.arange(1, len(docs) + 1) * width)]).astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (of_doc % width, uses)]
    of_docs = [*[pa.array([d[i] for d in docs], pa.int64()) for i in range(4)], pa.array(n_links), pa.array([d[4] for d in docs], pa.string()), *lists]
    of_pairs = [pa.array(np.arange(len(pairs), dtype=np.int32)), pa.array(pairs), pa.array(times.astype(np.int64))]
    names = [c.split()[0] for c in BLOCKS.split(", ")]
    for n, left, right in ((len(pairs), of_pairs, [pa.nulls(len(pairs), x.type) for x in of_docs]), (len(docs), [pa.nulls(len(docs), x.type) for x in of_pairs], of_docs)):
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), *left, *right], names=names)


def aligned_blocks(docs: DataFrame, path_a: str, path_b: str, step: int = STEP, block: int = BLOCK) -> DataFrame:
    """The rows of blocks of documents, see :func:`block_rows`. Texts are taken about ``step``
    characters at a time, and a block ends after the document that brings its links to ``block``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al = aligner(path_a, path_b)
        number = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []
        links = 0
        waiting: list[Document] = []  # documents whose parts may not all be aligned yet
        parts: list[tuple[Document, str]] = []
        size = 0

        def work() -> None:
            nonlocal parts, size
            for (doc, _), got in zip(parts, al.align([p for _, p in parts]), strict=True):
                doc.add(got)
            parts, size = [], 0

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py()
                doc = Document(doc_id, bool(text))
                waiting.append(doc)
                for part in steps(text, step) if text else []:
                    parts.append((doc, part))
                    size += len(part)
                    if size >= step:
                        work()
                if not parts or len(waiting) >= BLOCK_DOCS:
                    if parts:
                        work()
                    for d in waiting:
                        rows.append(d.row())
                        links += len(rows[-1][5])
                    waiting = []
                    if links >= block or len(rows) >= BLOCK_DOCS:
                        yield from block_rows(number, rows)
                        number, rows, links = number + 1, [], 0
        if parts:
            work()
        rows += [d.row() for d in waiting]
        if rows:
            yield from block_rows(number, rows)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, BLOCKS)


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str, step: int = STEP, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best,
    count_sum (bigint) and groups_sha256 (string).

    A (a byte-level .json file) encodes a space and the text, B (a sentencepiece
    .model file, which puts the space itself) the text; special strings are plain text. Byte offsets at which tokens of both
    end cut them into groups. A link is an A token and a B token that share a byte; the count of an id pair
    is the number of its links in the whole table. n_best counts the links whose pair has the highest count of
    all pairs of its B id (ties included), count_sum adds up the counts over the links. groups_sha256 is the hex digest of
    ``a1,a2|b1;a3|b2,b3``: A ids, then B ids, group by group.

    Texts that are null or empty, or that A or B do not give back byte for byte (U+2581 in the text, for example), have no
    token: zeros and an empty groups_sha256. Each row counts, repeated ids and texts, too; null ids pass, other
    columns are left out, an empty table gives an empty result. Long texts are aligned in parts cut where no token crosses.

    The corpus is encoded once. Tasks write blocks of documents with the block's distinct pairs; counts are summed
    over blocks, and each block asks once per distinct pair, so what is shuffled grows with blocks times distinct pairs and not with the links.
    Answers and documents are sorted by block and read as a stream: a task holds the counts of one block's pairs.
    """
    blocks = materialize(aligned_blocks(docs, path_a, path_b, step, block), "aligned_blocks")
    pairs = blocks.where("pair is not null").select("block", "i", "pair", "times")
    counts = pairs.groupBy("pair").agg(F.sum("times").alias("n"))
    counts = counts.withColumn("b", F.expr(f"pair & {(1 << SHIFT) - 1}L"))
    best = counts.groupBy("b").agg(F.max("n").alias("most"))
    known = counts.join(best, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    answers = split_join(pairs.drop("times"), known, "pair").select("block", F.lit(0).alias("role"), "i", "n", "best")
    texts = blocks.where("places is not null").drop("i", "pair", "times").withColumn("role", F.lit(1))
    both = answers.unionByName(texts, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", "role")

    def gathered(answers: list[pa.RecordBatch]) -> np.ndarray:
        """Counts of a block's pairs, and whether each is its B id's highest."""
        out = np.zeros((2, sum(a.num_rows for a in answers)), dtype=np.int64)
        for a in answers:
            i = a.column("i").to_numpy()
            out[0, i] = a.column("n").to_numpy()
            out[1, i] = a.column("best").to_numpy(zero_copy_only=False)
        return out

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, known = None, [], None
        for batch in batches:
            block, role = batch.column("block").to_numpy(), batch.column("role").to_numpy()
            starts = [0, *(np.flatnonzero((block[1:] != block[:-1]) | (role[1:] != role[:-1])) + 1).tolist()] if batch.num_rows else []
            for start, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                part = batch.slice(start, end - start)
                if block[start] != current:
                    current, held, known = block[start], [], None
                if role[start] == 0:
                    held.append(part.select(["i", "n", "best"]))
                    continue
                if known is None:
                    known, held = gathered(held), []
                places, uses = part.column("places"), part.column("uses").flatten().to_numpy().astype(np.int64)
                sums = np.zeros((2, len(uses) + 1), dtype=np.int64)
                np.cumsum(known[:, places.flatten().to_numpy()] * uses, axis=1, out=sums[:, 1:])
                ends = np.cumsum(places.value_lengths().to_numpy())
                per_doc = np.diff(sums[:, ends], axis=1, prepend=0)
                names = ("doc_id", "n_a", "n_b", "n_groups", "n_links")
                columns = [part.column(c) for c in names] + [pa.array(per_doc[1]), pa.array(per_doc[0]), part.column("groups_sha256")]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "n_best", "count_sum", "groups_sha256"])

    return both.mapInArrow(finish, RESULT)
