"""Lexicon operators: last-wins dedupe, lemma composition, and token-level
valence/arousal statistics joined on exploded tokens.

Scores are integer thousandths (``v``, ``a``, ``d`` in 0..1000): sums stay
exact and are divided once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewpoint.functions import text as T

# Valence bounds for polar terms and the arousal threshold
# (thousandths of the lexicon's 0..1 scale).
POLAR_LOW, POLAR_HIGH, AROUSING = 350, 650, 650
#: A token is common if it is one in so many occurrences: their table is broadcast.
COMMON = 1 << 20


def dedupe_last(lines: DataFrame) -> DataFrame:
    """One entry per term; a repeated term keeps its last line (``line_no``, of
    any type that orders). With a number as ``line_no`` this is a hash aggregate."""
    return lines.groupBy("term").agg(*[F.max_by(c, "line_no").alias(c) for c in ("v", "a", "d")])


def surface_lookup(lexicon: DataFrame, lemmas: DataFrame | None = None, polar_only: bool = True) -> DataFrame:
    """Surface token -> (v, a) of the lexicon entry of its lemma.

    Tokens with a lemma use the lemma's entry (a miss if the lemma has none);
    other tokens use their own entry. Composing the two small tables once
    replaces a lemma join on every token occurrence. Write the result once
    (:func:`viewpoint.session.materialize`) and pass it to all that use it: the
    planner then knows its bytes and broadcasts it if they are few.
    """
    lex = lexicon.select("term", "v", "a")
    if polar_only:  # non-polar entries never contribute to any statistic
        lex = lex.filter((F.col("v") <= POLAR_LOW) | (F.col("v") >= POLAR_HIGH))
    if lemmas is None:
        return lex.withColumnRenamed("term", "token")
    via_lemma = lemmas.join(lex.withColumnRenamed("term", "lemma"), "lemma").select("token", "v", "a")
    own = lex.join(lemmas.select(F.col("token").alias("term")), "term", "left_anti").withColumnRenamed("term", "token")
    return via_lemma.unionByName(own)


def polar(v: Column, strict: bool) -> Column:
    if strict:  # scorer form: v > 0.65 or v < 0.35
        return (v > POLAR_HIGH) | (v < POLAR_LOW)
    return (v >= POLAR_HIGH) | (v <= POLAR_LOW)  # notebook form


def common_tokens(counts: DataFrame, lookup: DataFrame, share: int = COMMON) -> DataFrame:
    """(token, v, a): the tokens of ``counts`` (token, n) that are at least one in ``share``
    of all occurrences, at most ``share`` tokens whatever the texts, with what ``lookup``
    has for them (NULL for a miss)."""
    least = counts.agg((F.sum("n") / share).alias("_least"))
    common = counts.join(F.broadcast(least), F.col("n") >= F.col("_least")).select("token")
    return common.join(lookup.select("token", "v", "a"), "token", "left")


def token_stats(df: DataFrame, keys: list[str], text_col: str, lookup: DataFrame, strict: bool, common: DataFrame | None = None) -> DataFrame:
    """Per row of ``df`` (identified by ``keys``): number of polar token
    occurrences, of arousing ones among them, and the sum of their arousal.

    ``explode_outer`` the tokens (rows without tokens survive), left join the
    lookup, aggregate by ``keys``: no join back. The planner picks the join by
    the lookup's bytes; where it has to shuffle tokens, the skew join splits the
    frequent ones, and rows without a token carry a key of their own that matches
    nothing instead of meeting in one partition.

    With ``common`` (:func:`common_tokens` of the same lookup), these are looked up by
    broadcast and added up where their texts are read: one row a key, and one for each of
    its other tokens with their number, goes on to the lookup. Same result, but no
    frequent token is shuffled or sorted, whatever the lookup's size.
    """
    occ = explode_lexicon_tokens(df, keys, text_col, outer=True)
    nothing = F.concat(F.lit("\u0000"), F.xxhash64(*keys).cast("string"))

    def pol() -> Column:
        return F.col("v").isNotNull() & polar(F.col("v"), strict)

    def sums(n: Column) -> list[Column]:
        return [
            F.coalesce(F.sum(F.when(pol(), n)), F.lit(0)).alias("num_pol"),
            F.coalesce(F.sum(F.when(pol() & (F.col("a") > AROUSING), n)), F.lit(0)).alias("num_arous"),
            F.coalesce(F.sum(F.when(pol(), n * F.col("a"))), F.lit(0)).cast("bigint").alias("sum_a"),
        ]

    if common is None:
        occ = occ.withColumn("token", F.coalesce("token", nothing))
        return occ.join(lookup, "token", "left").groupBy(*keys).agg(*sums(F.lit(1).cast("bigint")))
    known = F.broadcast(common.select("token", "v", "a", F.lit(True).alias("_known")))
    other = F.when(F.col("_known").isNull(), F.col("token"))
    part = occ.join(known, "token", "left").groupBy(*keys, other.alias("_other")).agg(F.count(F.lit(1)).alias("_n"), *sums(F.lit(1).cast("bigint")))
    names = ["num_pol", "num_arous", "sum_a"]
    part = part.select(*keys, F.coalesce("_other", nothing).alias("token"), "_n", *[F.col(c).alias(f"_{c}") for c in names])
    rest = part.join(lookup.select("token", "v", "a"), "token", "left").groupBy(*keys).agg(*sums(F.col("_n")), *[F.sum(f"_{c}").alias(f"_{c}") for c in names])
    return rest.select(*keys, *[(F.col(c) + F.col(f"_{c}")).alias(c) for c in names])


def explode_lexicon_tokens(df: DataFrame, keep: list[str], text_col: str, outer: bool = False) -> DataFrame:
    """(keep..., token): one row per lexicon token occurrence, in source order.

    Two plain explodes - whitespace tokens, then contraction pieces - keep
    the per-token work in generated code (no per-token lambda)."""
    gen = F.explode_outer if outer else F.explode
    text = F.replace(F.col(text_col), F.lit("U.S."), F.lit("USA"))
    raw = df.select(*keep, gen(T.raw_tokens(text)).alias("_raw"))
    pieces = F.when(F.col("_raw").isNull(), F.array(F.lit(None).cast("string"))).otherwise(T.contraction_parts("_raw"))
    return raw.select(*keep, F.explode(pieces).alias("token"))


def mean_arousal(num_pol: Column, sum_a: Column) -> Column:
    """Mean arousal of polar tokens on the 0..1 scale, 0 when there are none."""
    return F.when(num_pol > 0, sum_a / (num_pol * F.lit(1000.0))).otherwise(F.lit(0.0))


def intensity(df: DataFrame, keys: list[str], text_col: str, lookup: DataFrame, out: str = "intensity", common: DataFrame | None = None) -> DataFrame:
    """Scorer intensity: mean arousal over strictly polar tokens (0 if none)."""
    s = token_stats(df, keys, text_col, lookup, strict=True, common=common)
    return s.select(*keys, mean_arousal(F.col("num_pol"), F.col("sum_a")).alias(out))


def intensity_gap(long: DataFrame, sources: DataFrame, lookup: DataFrame, first_sentence: bool = True, common: DataFrame | None = None) -> DataFrame:
    """(model, row_id, exp, pred_int, src_int, intens): the squared difference of
    the intensity of ``long`` (model, row_id, exp, pred) and that of ``sources``
    (row_id, text), which is worked out once per topic, not once per experiment."""
    text = T.first_sentence("pred") if first_sentence else F.col("pred")
    pred = intensity(long.select("model", "row_id", "exp", text.alias("text")), ["model", "row_id", "exp"], "text", lookup, out="pred_int", common=common)
    src = intensity(sources.select("row_id", "text"), ["row_id"], "text", lookup, out="src_int", common=common)
    return pred.join(src, "row_id", "left").withColumn("intens", F.pow(F.col("pred_int") - F.col("src_int"), 2))
