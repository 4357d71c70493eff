"""Array expressions for model outputs: softmax, arg-max, stance gap, RMSE,
padding/truncation of id sequences and segment ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stance classes in model output order.
STANCE_LABELS = ["pro", "con", "neutral"]


def softmax(logits: Column) -> Column:
    """exp(x - max) / sum, max subtracted for stability."""
    ex = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    total = F.aggregate(ex, F.lit(0.0), lambda a, x: a + x)
    return F.transform(ex, lambda x: x / total)


def argmax1(arr: Column) -> Column:
    """1-based index of the first maximum."""
    return F.array_position(arr, F.array_max(arr))


def stance_gap(p_pred: Column, p_ref: Column) -> Column:
    """|p_pred[k] - p_ref[k]| at k = arg-max of the reference probabilities
    (the RMSE of two scalars)."""
    k = argmax1(p_ref)
    return F.abs(F.element_at(p_pred, k.cast("int")) - F.element_at(p_ref, k.cast("int")))


def rmse(a: Column, b: Column) -> Column:
    """RMSE of two equal-length arrays."""
    sq = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(sq, F.lit(0.0), lambda s, x: s + x) / F.size(a))


def pad_truncate(seq: Column, maxlen: int, padding: str = "post", truncating: str = "post", value: int = 0) -> Column:
    """Keras-style fixed-length sequence: keep the first (or last, 'pre')
    ``maxlen`` items, pad with ``value`` after (or before, 'pre')."""
    n = F.size(seq)
    if truncating == "pre":
        kept = F.when(n > maxlen, F.slice(seq, n - maxlen + 1, maxlen)).otherwise(seq)
    else:
        kept = F.slice(seq, 1, maxlen)
    pad = F.array_repeat(F.lit(value).cast("bigint"), F.greatest(F.lit(maxlen) - F.size(kept), F.lit(0)))
    kept = kept.cast("array<bigint>")
    return F.concat(kept, pad) if padding == "post" else F.concat(pad, kept)


def segment_ids(text_len: Column, aspect_len: Column, maxlen: int) -> Column:
    """[0] * (text_len + 2) + [1] * (aspect_len + 1), padded/truncated post."""
    ids = F.concat(F.array_repeat(F.lit(0).cast("bigint"), text_len + 2), F.array_repeat(F.lit(1).cast("bigint"), aspect_len + 1))
    return pad_truncate(ids, maxlen)


def nonzero_count(ids: Column) -> Column:
    return F.size(F.filter(ids, lambda x: x != 0))
