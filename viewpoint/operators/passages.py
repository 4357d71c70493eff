"""Passage explode and extraction facts (one row per model, topic, passage).

Topic-level work (passage split, side, length, token sets, ignore sets) is
row-local: it needs neither a join nor a shuffle. Predictions contribute four
small first-sentence token sets per (model, topic). The two meet in one
equi-join on ``row_id``, one exchange a side, and the passages are exploded
after it, carrying ids, side, length and token sets only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewpoint.functions import coverage as C
from viewpoint.functions import text as T
from viewpoint.operators import lexicon as LX

SUMMARY_KEYS = ["spl", "spr", "mpl", "mpr"]
SUMMARY_SOURCES = {"spl": "sp_left_pred", "spr": "sp_right_pred", "mpl": "mp_left_pred", "mpr": "mp_right_pred"}


def pinned(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """(keep..., columns...), each of ``columns`` computed once per row: the
    explode of a one-element array keeps the optimizer from copying the
    expressions into every place, and every lambda, that uses them."""
    one = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_x")
    return df.select(*keep, one).select(*keep, *[F.col(f"_x.{n}").alias(n) for n in columns])


def _split(topics: DataFrame) -> DataFrame:
    """(row_id, ops, nl, nr, _info): passages and normalised sides of each
    topic, and side and length of every passage. All heads of a topic are looked up in a side together."""
    ops = F.split(F.coalesce(F.col("alt_op"), F.lit("")), "\n")
    t = pinned(topics, ["row_id"], ops=ops, nl=T.normalize("left_op"), nr=T.normalize("right_op"))
    t = t.select("*", F.transform("ops", lambda op: T.head_of(op)).alias("_heads"), F.transform("ops", T.passage_length).alias("_lengths"))
    t = t.withColumn("_sides", T.sides_of("_heads", "nl", "nr"))
    info = F.zip_with("_sides", "_lengths", lambda side, length: F.struct(side.alias("side"), length.alias("length")))
    return t.select("row_id", "ops", "nl", "nr", info.alias("_info"))


def explode_passages(topics: DataFrame) -> DataFrame:
    """(row_id, pos, op, side, length): ``alt_op.split('\n')`` with 0-based
    positions (empty passages kept), side of each passage, ``len(re.split)``."""
    p = _split(topics).select("row_id", F.posexplode(F.arrays_zip(F.col("ops").alias("op"), F.col("_info").alias("info"))).alias("pos", "p"))
    return p.select("row_id", "pos", F.col("p.op").alias("op"), F.col("p.info.side").alias("side"), F.col("p.info.length").alias("length"))


def lead_side() -> Column:
    """Side of the whole ``alt_op`` (its first 30 characters)."""
    return T.side_of("alt_op", T.normalize("left_op"), T.normalize("right_op"))


def topic_passages(topics: DataFrame) -> DataFrame:
    """Per topic: ``_toks`` (token set of each passage, in order), ``_info``
    (side and length of each), ``lead_side`` and ``_chars``, the characters of
    passage 0 (normalised, not tokenised)."""
    t = _split(topics)
    toks = F.transform(F.transform("ops", T.normalize), lambda n: F.array_distinct(T.word_tokens_of_normalized(n)))
    lead = T.side_of(F.array_join("ops", "\n"), F.col("nl"), F.col("nr"))
    chars = T.char_set(T.normalize(F.get("ops", 0)))
    return pinned(t, ["row_id"], _toks=toks, _info=F.col("_info"), lead_side=lead, _chars=chars)


def summary_sets(preds: DataFrame, reference: bool = False) -> DataFrame:
    """(model, row_id, spl, spr, mpl, mpr): token sets of the first sentence of
    each summary. With ``reference`` the reference summaries stand in for all
    four (left_sum for the left ones, right_sum for the right ones)."""
    if reference:
        src = {"spl": "left_sum", "spr": "right_sum", "mpl": "left_sum", "mpr": "right_sum"}
    else:
        src = SUMMARY_SOURCES
    firsts = pinned(preds, ["model", "row_id"], **{k: T.first_sentence(src[k]) for k in SUMMARY_KEYS})
    return firsts.select("model", "row_id", *[F.array_distinct(T.word_tokens(k)).alias(k) for k in SUMMARY_KEYS])


def arousal_by_passage(passages: DataFrame, lookup: DataFrame, extra: tuple[str, ...] = (), common: DataFrame | None = None) -> DataFrame:
    """(row_id, pos, extra..., num_arous, perc_arous, arous_score): notebook
    arousal features with inclusive polar bounds. ``length`` and ``extra``
    columns ride along as keys (they are functions of the passage)."""
    keys = ["row_id", "pos", "length", *extra]
    s = LX.token_stats(passages.select(*keys, "op"), keys, "op", lookup, strict=False, common=common)
    return s.select(
        "row_id",
        "pos",
        *extra,
        F.col("num_arous"),
        (F.col("num_arous") / F.col("length")).alias("perc_arous"),
        LX.mean_arousal(F.col("num_pol"), F.col("sum_a")).alias("arous_score"),
    )


def topic_arousal(topics: DataFrame, lookup: DataFrame, common: DataFrame | None = None) -> DataFrame:
    """(row_id, _arous): what :func:`arousal_by_passage` counts, as one array per topic
    in the order of the passages. ``row_id`` is the topics' key.

    The texts are dealt by ``row_id`` before they are split into tokens: with a lookup that
    is broadcast, the sums per passage, those per topic and the join on ``row_id`` that
    follows all use this one exchange, and no token or partial sum moves. With a large one
    and its ``common`` tokens, only the others move, see :func:`lexicon.token_stats`."""
    dealt = topics.select("row_id", F.coalesce("alt_op", F.lit("")).alias("_text")).repartition("row_id")
    passages = dealt.select("row_id", F.posexplode(F.split("_text", "\n")).alias("pos", "op"))
    s = LX.token_stats(passages, ["row_id", "pos"], "op", lookup, strict=False, common=common)
    return s.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("pos", "num_arous", "num_pol", "sum_a"))).alias("_arous"))


def extraction_facts(
    topics: DataFrame,
    summaries: DataFrame,
    lookup: DataFrame | None = None,
    unique_mode: str = "as_coded",
    common: DataFrame | None = None,
) -> DataFrame:
    """Extraction fact table: (model, row_id, lead_side, pos, side, length,
    {spl,spr,mpl,mpr}_ext, {..}_ext_unq [, num_arous, perc_arous, arous_score]).

    ``summaries`` comes from :func:`summary_sets` (models and/or reference).
    ``unique_mode`` picks the ignore set of the ``_unq`` columns. 'as_coded':
    characters of passage 0 union the tokens of passages 1..n, as the reference
    computes it. 'shared': tokens present in every passage (the stated intent).

    All model-independent work is done once per topic; the model join is on
    ``row_id``. After it, each passage's tokens are cut down, in one pass, to those
    that the model's summaries have: coverage and ignore sets are worked out on
    these few. The passage explode is the last step, and the facts are computed
    once a row, whatever expressions use them.
    """
    if unique_mode not in ("as_coded", "shared"):
        raise ValueError("unique_mode must be 'as_coded' or 'shared'")
    tp = topic_passages(topics)
    arousal = []
    if lookup is not None:
        tp = tp.join(topic_arousal(topics, lookup, common), "row_id")
        n = F.col("p.arous.num_arous")
        score = LX.mean_arousal(F.col("p.arous.num_pol"), F.col("p.arous.sum_a"))
        arousal = [n.alias("num_arous"), (n / F.col("p.info.length")).alias("perc_arous"), score.alias("arous_score")]
    j = summaries.join(tp, "row_id")
    every = F.array_distinct(F.flatten(F.array(*[F.coalesce(k, F.array().cast("array<string>")) for k in SUMMARY_KEYS])))
    ids = ["model", "row_id", "lead_side", *SUMMARY_KEYS, "_info", *["_arous"] * bool(arousal)]
    j = pinned(j, [*ids, "_toks", "_chars"], _every=every)
    few = F.transform("_toks", lambda t: F.array_intersect(t, F.col("_every")))
    j = pinned(j, [*ids, "_chars"], _few=few)
    j = pinned(j, [*ids, "_few"], _ign=C.ignore_as_coded(F.col("_chars"), F.col("_few")) if unique_mode == "as_coded" else C.ignore_shared(F.col("_few")))
    # Summary token sets minus the topic's ignore set, once per (model, topic).
    sets = {k: F.col(k) for k in SUMMARY_KEYS} | {k + "_u": F.array_except(F.col(k), F.col("_ign")) for k in SUMMARY_KEYS}
    parts = [F.col("_few").alias("toks"), F.col("_info").alias("info")] + [F.col("_arous").alias("arous")] * bool(arousal)
    j = pinned(j, ["model", "row_id", "lead_side"], **sets, p=F.arrays_zip(*parts))
    rows = j.select("model", "row_id", "lead_side", *sets, F.posexplode("p").alias("pos", "p"))
    rows = rows.select(
        "model",
        "row_id",
        "lead_side",
        F.col("pos").cast("bigint").alias("pos"),
        F.col("p.info.side").alias("side"),
        F.col("p.info.length").cast("bigint").alias("length"),
        *[C.coverage(F.col(k), F.col("p.toks")).alias(f"{k}_ext") for k in SUMMARY_KEYS],
        # The summary set already excludes the ignore set, so intersecting with
        # the whole passage set equals intersecting with (passage - ignore).
        *[C.coverage(F.col(k + "_u"), F.col("p.toks")).alias(f"{k}_ext_unq") for k in SUMMARY_KEYS],
        *arousal,
    )
    return pinned(rows, [], **{c: F.col(c) for c in rows.columns})
