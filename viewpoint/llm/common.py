"""Shared pieces of the operators: shared-folder tables, word shingles, connected components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewpoint.session import materialize

__all__ = ["chunks", "components", "materialize", "shingle_sets", "split_join", "splitmix", "text_bytes"]

SHINGLE = 5
#: Bytes from which on a word is hashed by blake2b.
LONG_WORD = 64
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_BASE_INV = _U(pow(int(_BASE), -1, 1 << 64))
#: Bytes that are no ASCII white space, as ``bytes.split`` has it.
_IN_WORD = ~np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
#: One odd multiplier per word of a shingle.
_WORD_MULT = np.array([pow(0xD1342543DE82EF95, i + 1, 1 << 64) | 1 for i in range(SHINGLE)], dtype=_U)


def splitmix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer: spreads the bits of 64-bit values."""
    x = x + _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    out = np.ones(max(n, 1), dtype=_U)
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * _U(int(out[done - 1]) * int(base) % (1 << 64))
        done += step
    return out[:n]


class Powers:
    """Power tables that grow as longer chunks come; up to SHARED numbers they are made once per Python worker."""

    SHARED = 1 << 22
    up = down = np.zeros(0, dtype=_U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n + n // 4, 1 << 16)
            of = Powers if size <= self.SHARED else self
            of.up, of.down = powers(size), powers(size, _BASE_INV)
        return self.up[:n], self.down[:n]


def prefix_hash(data: np.ndarray, table: Powers) -> np.ndarray:
    """Prefix sums of byte * base ** position; a difference of two, times the
    inverse power of its start, is the same for equal strings at any place."""
    up, _ = table.get(len(data))
    out = np.zeros(len(data) + 1, dtype=_U)
    np.add(data, _U(1), out=out[1:], dtype=_U)
    out[1:] *= up
    np.cumsum(out[1:], out=out[1:])
    return out


def text_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding them."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def chunks(sizes: list[int], most: int) -> Iterator[slice]:
    """Consecutive slices of at most ``most`` bytes each (one longer text is a slice of its own)."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield slice(start, len(sizes))


def shingle_hashes(texts: list[bytes | None], table: Powers) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the 5-word shingles of each text in reading order, and
    the offset of each text's first one. ASCII letters are lower-cased; words
    are runs without ASCII white space; fewer than five words make one shingle;
    null and wordless texts have none."""
    size = np.fromiter((len(t) if t else 0 for t in texts), dtype=np.int64, count=len(texts))
    data = b" ".join([t or b"" for t in texts]).lower()
    raw = np.frombuffer(data, dtype=np.uint8)
    inside = np.zeros(len(raw) + 2, dtype=bool)
    np.take(_IN_WORD, raw, out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    n_words = len(starts)
    counts = np.diff(np.searchsorted(starts, np.append(0, np.cumsum(size + 1))))
    n_sh = np.where(counts == 0, 0, np.maximum(counts - SHINGLE + 1, 1))
    offsets = np.concatenate([[0], np.cumsum(n_sh)])
    if n_words == 0:
        return np.zeros(0, dtype=_U), offsets
    lens = ends - starts
    acc = prefix_hash(raw, table)
    _, down = table.get(len(raw) + 1)
    word = splitmix((acc[ends] - acc[starts]) * down[starts] + lens.astype(_U))
    # A polynomial modulo 2 ** 64 gives some pairs of long words (abbabaab...) one value for certain.
    for i in np.flatnonzero(lens > LONG_WORD).tolist():
        word[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    # Start word of every shingle: the text's first word plus the place within the text.
    at = np.repeat(first - offsets[:-1], n_sh) + np.arange(offsets[-1])
    padded = np.concatenate([word, np.zeros(SHINGLE, dtype=_U)])
    out = word * _WORD_MULT[0]
    for i in range(1, SHINGLE):
        out += padded[i : i + n_words] * _WORD_MULT[i]
    out = out[at] + _U(SHINGLE)
    for t in np.flatnonzero((counts > 0) & (counts < SHINGLE)).tolist():
        n = int(counts[t])
        out[offsets[t]] = np.sum(word[first[t] : first[t] + n] * _WORD_MULT[:n], dtype=_U) + _U(n)
    return splitmix(out), offsets


def shingle_sets(texts: list[bytes | None], table: Powers | None = None) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    h, off = shingle_hashes(texts, table or Powers())
    return [np.unique(h[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)]


def split_join(rows: DataFrame, per_key: DataFrame, *keys: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``per_key``, an aggregate with a row per key (bigint
    columns). The adaptive skew join splits a hot key's rows only where both sides
    come straight from an exchange; the planner would let the aggregate's own
    partitioning stand, so the join is on the keys' complements, and the few
    aggregated rows are dealt out once more."""
    flip = [F.bitwise_not(k).alias(f"_{k}") for k in keys]
    right = per_key.select(*flip, *[c for c in per_key.columns if c not in keys])
    both = rows.select("*", *flip).join(right.hint("merge"), [f"_{k}" for k in keys], how)
    return both.drop(*[f"_{k}" for k in keys])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component_id) of every node of ``edges`` (src, dst): the smallest
    node that can be reached. Alternates large-star and small-star steps, each
    a group-by and a join; the edge table is written to the shared folder after
    each round, so a lost executor costs one round at most. A hub's edges are
    split (see :func:`split_join`); the minimum is aggregated on the map side."""
    e = edges.select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).where("a <> b").distinct()
    e = materialize(e, "edges")
    state = None
    for _ in range(rounds):
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = split_join(both, low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = split_join(large, low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        e = materialize(small.union(low).distinct(), "edges")
        seen = e.agg(F.count(F.lit(1)), F.sum(F.col("b").cast("decimal(38,0)")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component_id")).union(
        e.select(F.col("b").alias("node"), F.col("b").alias("component_id")).distinct()
    )
