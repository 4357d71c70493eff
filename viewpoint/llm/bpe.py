"""Byte-level BPE encoding and decoding from a public vocabulary file."""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed pattern of the byte-level pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces in each of a worker's two memories, a younger and an older one;
#: results do not depend on them.
MEMO = 400_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary:
    visible Latin-1 characters stand for themselves, the others take the
    characters from 256 on, in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b if b in shown else spare))
        spare += b not in shown
    return out


class BytePairCodec:
    """Encodes and decodes with the ``tokenizers`` JSON file at ``path``
    (model BPE, pre-tokenizer and decoder ByteLevel without prefix space)."""

    def __init__(self, path: str) -> None:
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or spec["normalizer"]:
            raise ValueError(f"not a byte-level BPE file of the kind that is read here: {path}")
        vocab = model["vocab"]
        symbol = byte_symbols()
        of_symbol = {s: bytes([b]) for b, s in enumerate(symbol)}
        self.byte_id = [vocab[s] for s in symbol]
        merges = [pair if isinstance(pair, list) else pair.split(" ") for pair in model["merges"]]
        # A dead symbol is -1, so its pairs have keys that no merge has.
        self.size = 1 + max(vocab.values())
        self.ranks = {vocab[a] * self.size + vocab[b]: rank for rank, (a, b) in enumerate(merges)}
        self.results = [vocab[a + b] for a, b in merges]
        self.pieces = {i: b"".join(of_symbol[c] for c in s) for s, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pieces |= {i: s.encode() for s, i in self.special.items()}
        self.split = regex.compile(PATTERN)
        at = "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))
        self.special_split = regex.compile(f"({at})") if at else None
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Token ids of one pre-token. The symbols form a doubly linked list; a
        heap holds rank * length + place of adjacent pairs. A popped entry is
        stale when the pair now at its place has another rank, and is skipped."""
        ids = [self.byte_id[b] for b in piece]
        n = len(ids)
        if n < 2:
            return ids
        rank_of, result, size = self.ranks.get, self.results, self.size
        heap = [r * n + i for i, r in enumerate([rank_of(a * size + b, -1) for a, b in zip(ids, ids[1:])]) if r >= 0]
        heapq.heapify(heap)
        prev, nxt = list(range(-1, n - 1)), list(range(1, n + 1))
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            top = pop(heap)
            i = top % n
            j = nxt[i]
            rank = top // n
            if j == n or rank_of(ids[i] * size + ids[j]) != rank:
                continue
            new = ids[i] = result[rank]
            ids[j] = -1
            k = nxt[i] = nxt[j]
            if k < n:
                prev[k] = i
                r = rank_of(new * size + ids[k], -1)
                if r >= 0:
                    push(heap, r * n + i)
            h = prev[i]
            if h >= 0:
                r = rank_of(ids[h] * size + new, -1)
                if r >= 0:
                    push(heap, r * n + h)
        return [x for x in ids if x >= 0]

    def _piece(self, piece: str) -> bytes:
        """A piece that the younger memory lacks: from the older one, or merged now."""
        got = self.old.get(piece)
        if got is None:
            got = array("I", self.merge(piece.encode())).tobytes()
        if len(self.young) >= MEMO:
            self.old, self.young = self.young, {}
        self.young[piece] = got
        return got

    def _plain(self, text: str) -> bytes:
        pieces = self.split.findall(text)
        got = list(map(self.young.get, pieces))
        if None in got:
            young = self.young
            for i, x in enumerate(got):
                if x is None:
                    got[i] = young.get(pieces[i]) or self._piece(pieces[i])
        return b"".join(got)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text. Strings of added tokens in it become those tokens."""
        if self.special_split is None or not any(s in text for s in self.special):
            out = self._plain(text)
        else:
            parts = self.special_split.split(text)
            out = b"".join(np.array([self.special[p]], dtype="<u4").tobytes() if p in self.special else self._plain(p) for p in parts)
        return np.frombuffer(out, dtype="<u4")

    def decode(self, ids: np.ndarray) -> str:
        """The concatenated vocabulary strings, as UTF-8 with U+FFFD for broken sequences."""
        pieces = self.pieces
        return b"".join([pieces[i] for i in ids.tolist()]).decode("utf-8", "replace")


_CODECS: dict[str, BytePairCodec] = {}


def codec(path: str) -> BytePairCodec:
    """The codec of ``path``, read once per Python worker."""
    if path not in _CODECS:
        _CODECS[path] = BytePairCodec(path)
    return _CODECS[path]


def tokenize(docs: DataFrame, vocabulary: str, with_ids: bool = True, with_text: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_tokens (bigint),
    ids_sha256 and decoded_sha256 (hex digests of the ids as little-endian
    unsigned 32-bit integers and of the decoded text as UTF-8), and, where asked
    for, ``ids`` (array<int>) and ``decoded``; then the columns of ``docs`` named in ``keep``.

    Null texts count as empty: no token, digests of the empty string. Rows are
    independent, so repeated ids and texts and null doc_ids pass through; all other
    columns of ``docs`` are left out. ``vocabulary`` is a file path that the
    executors can read; each Python worker reads it once.
    """
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>" * with_ids + ", decoded string" * with_text
    schema += "".join(f", {x} {docs.schema[x].dataType.simpleString()}" for x in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n, ids_sha, text_sha, all_ids, texts = [], [], [], [], []
                for value in part.column("text"):
                    ids = c.encode(value.as_py() or "")
                    text = c.decode(ids)
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(ids.tobytes()).hexdigest())
                    text_sha.append(hashlib.sha256(text.encode()).hexdigest())
                    if with_ids:
                        all_ids.append(ids.astype(np.int32))
                    if with_text:
                        texts.append(text)
                cols = {"doc_id": part.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha), "decoded_sha256": pa.array(text_sha)}
                if with_ids:
                    cols["ids"] = pa.array(all_ids, pa.list_(pa.int32()))
                if with_text:
                    cols["decoded"] = pa.array(texts, pa.string())
                cols |= {x: part.column(x) for x in keep}
                yield pa.RecordBatch.from_pydict(cols)

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "text", *keep).mapInArrow(run, schema)
