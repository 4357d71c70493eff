"""Named queries: each takes (spark, sf_dir) and returns a DataFrame.

Every query reads the given parquet tables (through the derivations in
:mod:`viewpoint.sources.fixtures`) over whole tables and whole texts.
Queries that only look at single rows shuffle nothing.
Doubles are rounded to 6 decimals as ``round(x * 1e6) / 1e6`` (the oracle does
the same) so order-dependent float sums compare equal; integers are BIGINT.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from viewpoint.functions import rouge as RG
from viewpoint.functions import text as T
from viewpoint.functions import vectors as V
from viewpoint.operators import bins as B
from viewpoint.operators import experiments as X
from viewpoint.operators import external as E
from viewpoint.operators import lexicon as LX
from viewpoint.operators import passages as P
from viewpoint.operators import prompts as PR
from viewpoint.operators import reports as RP
from viewpoint.schemas import PRED_COLS as EXPS
from viewpoint.schemas import ROUGE_METRICS, SRC_COLS
from viewpoint.session import materialize, materialize_once, shared_path
from viewpoint.sources import fixtures as FX
from viewpoint.sources import io, runs


def r6(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c * F.lit(1000000.0)) / F.lit(1000000.0)


def _round_doubles(df: DataFrame) -> DataFrame:
    return df.select(*[r6(f.name).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema.fields])


def _bigints(df: DataFrame) -> DataFrame:
    return df.select(
        *[F.col(f.name).cast("bigint").alias(f.name) if f.dataType.typeName() == "integer" else F.col(f.name) for f in df.schema.fields]
    )


def _out(df: DataFrame) -> DataFrame:
    return _round_doubles(_bigints(df))


# --- shared building blocks ----------------------------------------------------


def all_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token sets of the models' summaries and of the 'ref' pseudo-model's: reference summaries in place of predictions."""
    return P.summary_sets(FX.predictions_and_reference(spark, sf_dir))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary with its numbers, written once a session."""
    return materialize_once(spark, "vocab", sf_dir, lambda: FX.token_counts(spark, sf_dir))


def lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surface-token lookup of the fixture lexicon and lemmas, written once a session. The
    vocabulary feeds both and the lemma self-join, so it is written, too."""

    def build() -> DataFrame:
        vocab = counts(spark, sf_dir).select("token")
        return LX.surface_lookup(FX.lexicon(vocab), FX.lemmas(vocab))

    return materialize_once(spark, "lookup", sf_dir, build)


def common(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lookup's part of the common tokens, written once a session."""
    return materialize_once(spark, "common", sf_dir, lambda: LX.common_tokens(counts(spark, sf_dir), lookup(spark, sf_dir)))


def facts(spark: SparkSession, sf_dir: str, unique_mode: str = "as_coded", with_lexicon: bool = False) -> DataFrame:
    lk = lookup(spark, sf_dir) if with_lexicon else None
    few = common(spark, sf_dir) if with_lexicon else None
    return P.extraction_facts(FX.sources(spark, sf_dir), all_summaries(spark, sf_dir), lk, unique_mode, few)


def long_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.unpivot(FX.predictions(spark, sf_dir))


# --- passages and coverage -----------------------------------------------------


def passage_explode(spark, sf_dir):
    p = P.explode_passages(FX.topics(spark, sf_dir))
    return _out(p.select("row_id", "pos", "length", F.length("op").alias("n_chars")))


def first_sentence(spark, sf_dir):
    p = FX.predictions(spark, sf_dir)
    return p.select(
        "model",
        "row_id",
        *[T.first_sentence(c).alias(c) for c in EXPS],
        T.first_sentence("alt_op").alias("doc_first"),
    )


def first_sentence_tables(spark, sf_dir):
    """The document's first sentence is worked out once a topic."""
    t = FX.topics(spark, sf_dir)
    p = FX.predictions_of(P.pinned(t, t.columns, alt_first=T.first_sentence_by_tables("alt_op")))
    return p.select("model", "row_id", *[T.first_sentence_by_tables(c).alias(c) for c in EXPS], F.col("alt_first").alias("alt_op"))


def passage_side(spark, sf_dir):
    t = P.topic_passages(FX.topics(spark, sf_dir))
    p = t.select("row_id", "lead_side", F.posexplode("_info").alias("pos", "p"))
    return _out(p.select("row_id", "pos", F.col("p.side").alias("side"), "lead_side"))


def passage_coverage(spark, sf_dir):
    f = facts(spark, sf_dir)
    return _out(f.select("model", "row_id", "pos", "spl_ext", "spr_ext", "mpl_ext", "mpr_ext"))


def _unique(spark, sf_dir, mode):
    f = facts(spark, sf_dir, unique_mode=mode)
    return _out(f.select("model", "row_id", "pos", "spl_ext_unq", "spr_ext_unq", "mpl_ext_unq", "mpr_ext_unq"))


def coverage_unique_as_coded(spark, sf_dir):
    return _unique(spark, sf_dir, "as_coded")


def coverage_unique_shared(spark, sf_dir):
    return _unique(spark, sf_dir, "shared")


def position_report(spark, sf_dir):
    return _out(RP.position_report(facts(spark, sf_dir)))


def side_report(spark, sf_dir):
    return _out(RP.side_report(facts(spark, sf_dir)))


def doc_coverage_by_model(spark, sf_dir):
    preds = FX.predictions_and_reference(spark, sf_dir).select("model", "row_id", "mp_left_pred", "mp_right_pred")
    return _out(RP.doc_coverage(preds, FX.sources(spark, sf_dir)))


def summary_length_by_model(spark, sf_dir):
    return _out(RP.summary_length(FX.predictions_and_reference(spark, sf_dir)))


def summary_length_tokens(spark, sf_dir):
    """As above with token counts that come as columns (a subword for every four
    characters begun)."""
    p = FX.predictions_and_reference(spark, sf_dir).withColumns({f"{c}_tokens": F.ceil(F.length(c) / 4) for c in ("mp_left_pred", "mp_right_pred")})
    return _out(RP.summary_length(p, F.col("mp_left_pred_tokens"), F.col("mp_right_pred_tokens")))


# --- bins ----------------------------------------------------------------------


def length_bins(spark, sf_dir):
    f = facts(spark, sf_dir, with_lexicon=True)
    return _out(B.binned_report(f, "length", 10, "length_bin", RP.FACT_NUMERIC))


def arousal_bins(spark, sf_dir):
    f = facts(spark, sf_dir, with_lexicon=True)
    return _out(B.binned_report(f, "arous_score", 20, "arous_bin", RP.FACT_NUMERIC, with_ci=False))


def density_bins(spark, sf_dir):
    f = facts(spark, sf_dir, with_lexicon=True)
    return _out(B.binned_report(f, "perc_arous", 10, "parous_bin", RP.FACT_NUMERIC))


# --- lexicon -------------------------------------------------------------------


def arousal_features(spark, sf_dir):
    p = P.explode_passages(FX.topics(spark, sf_dir))
    return _out(P.arousal_by_passage(p, lookup(spark, sf_dir), common=common(spark, sf_dir)))


def intensity(spark, sf_dir):
    t = FX.topics(spark, sf_dir)
    texts = t.select(
        "row_id",
        F.explode(F.array(*[F.struct(F.lit(c).alias("src"), F.col(c).alias("text")) for c in ("alt_op", "left_sum", "right_sum")])).alias("x"),
    ).select("row_id", "x.src", "x.text")
    return _out(LX.intensity(texts, ["row_id", "src"], "text", lookup(spark, sf_dir), common=common(spark, sf_dir)).drop("text"))


def intensity_gap(spark, sf_dir):
    """(pred first-sentence intensity - alt_op intensity)^2 per prediction."""
    sources = FX.topics(spark, sf_dir).select("row_id", F.col("alt_op").alias("text"))
    return _out(LX.intensity_gap(long_predictions(spark, sf_dir), sources, lookup(spark, sf_dir), common=common(spark, sf_dir)))


def lexicon_dedupe(spark, sf_dir):
    return _out(LX.dedupe_last(FX.lexicon_lines(spark, sf_dir)))


# --- ROUGE ---------------------------------------------------------------------


def _pair_tokens(spark, sf_dir):
    return FX.rouge_pairs(spark, sf_dir).select(
        "conv_id", "turn", T.rouge_tokens("pred").alias("pt"), T.rouge_tokens("ref").alias("rt")
    )


def _rouge_pairs(spark, sf_dir, metric):
    p = RG.add_rouge(_pair_tokens(spark, sf_dir), "pt", "rt", metrics=(metric,))
    return _out(p.select("conv_id", "turn", metric))


def rouge1(spark, sf_dir):
    return _rouge_pairs(spark, sf_dir, "rouge1")


def rouge2(spark, sf_dir):
    return _rouge_pairs(spark, sf_dir, "rouge2")


def rougeL(spark, sf_dir):
    return _rouge_pairs(spark, sf_dir, "rougeL")


def experiment_scores(spark, sf_dir):
    s = X.score_rouge(long_predictions(spark, sf_dir))
    return _out(s.select("model", "row_id", "exp", *ROUGE_METRICS))


def rouge_missing_text(spark, sf_dir):
    """ROUGE-1 of whole predictions, every ninth topic without one, in the three
    ways of scoring a missing text; mixed experiments only."""
    p = X.unpivot(FX.predictions(spark, sf_dir), exps=["mp_left_pred", "mp_right_pred"])
    p = p.withColumn("pred", F.when(F.col("row_id") % 9 != 0, F.col("pred"))).select("model", "row_id", "exp", "pred", "ref")
    for missing in ("null", "sentinel", "nan_text"):
        p = X.score_rouge(p, first_sentence=False, missing=missing, metrics=["rouge1"]).withColumnRenamed("rouge1", missing)
    return _out(p.drop("pred", "ref"))


def _base_rows(spark, sf_dir):
    long = long_predictions(spark, sf_dir)
    s = X.score_rouge(long).select("model", "row_id", "exp", *ROUGE_METRICS)
    return E.attach_scores(s, FX.external_scores(spark, sf_dir, FX.prediction_keys(spark, sf_dir)), ["bleurt"])


def base_summary(spark, sf_dir):
    return _out(RP.metric_summary(_base_rows(spark, sf_dir), X.resolve_metrics(["rouge", "bleurt"])))


def score_checks(spark, sf_dir):
    keys = FX.prediction_keys(spark, sf_dir)
    return _out(E.score_checks(FX.external_scores(spark, sf_dir, keys), keys))


# --- sources and sinks ---------------------------------------------------------------


def topics_csv(spark, sf_dir):
    """The topics written as CSV files, their texts with line breaks in quotes, and read back."""
    path = shared_path(spark, "topics_csv")
    io.write_csv(FX.topics(spark, sf_dir), path)
    return _out(io.read_topics_csv(spark, path))


def experiment_runs(spark, sf_dir):
    """Predictions published in two runs, the second replacing one experiment, and read back."""
    path, by = shared_path(spark, "experiment_runs"), ["model", "exp"]
    long = long_predictions(spark, sf_dir).select("model", "row_id", "exp", "pred")
    again = F.col("exp") == "mp_left_pred"
    runs.write_run(long.withColumn("pred", F.when(again, F.lit("first try")).otherwise(F.col("pred"))), path, by)
    runs.write_run(long.where(again), path, by)
    return _out(runs.read_runs(spark, path, by))


def summary_sinks(spark, sf_dir):
    """Row metrics through their sink, and the summary of what was read through its own."""
    path, metrics = shared_path(spark, "summary_sinks"), X.resolve_metrics(["rouge", "bleurt"])
    io.write_row_metrics(_base_rows(spark, sf_dir), f"{path}/rows")
    io.write_summary(RP.metric_summary(io.read_row_metrics(spark, f"{path}/rows"), metrics), f"{path}/summary")
    return _out(io.read_summary(spark, f"{path}/summary", metrics))


# --- model-output tables ---------------------------------------------------------


def _stance(spark, sf_dir):
    return E.stance_pairs(FX.stance_logits(spark, sf_dir))


def stance_gap(spark, sf_dir):
    return _out(_stance(spark, sf_dir).select("pair_id", "label", "stance", "rmse", F.get("p_ref", 0).alias("p_ref_pro")))


def stance_summary(spark, sf_dir):
    """Base metrics and stance per (model, exp); the CI of stance counts every
    prediction, with a stance or without."""
    rows = _base_rows(spark, sf_dir).join(FX.stance_scores(_stance(spark, sf_dir)), E.KEYS, "left")
    return _out(RP.metric_summary(rows, X.resolve_metrics(["rouge", "bleurt", "stance"])))


def _targets(spark, sf_dir):
    return E.keyphrase_target(*FX.phrase_vectors(spark, sf_dir), dict(zip(EXPS, SRC_COLS)))


def keyphrase_target(spark, sf_dir):
    return _out(_targets(spark, sf_dir))


def perspective_rows(spark, sf_dir):
    """Stance, intensity gap and key-phrase score of every prediction."""
    sources = FX.topics(spark, sf_dir).select("row_id", F.col("alt_op").alias("text"))
    rows = LX.intensity_gap(long_predictions(spark, sf_dir), sources, lookup(spark, sf_dir), common=common(spark, sf_dir)).select(*E.KEYS, "intens")
    rows = rows.join(FX.stance_scores(_stance(spark, sf_dir)), E.KEYS, "left").join(_targets(spark, sf_dir), E.KEYS, "left")
    return _out(rows.select(*E.KEYS, "stance", "intens", "target"))


def greedy_match_f1(spark, sf_dir):
    return _out(E.greedy_match(FX.token_vectors(spark, sf_dir)))


def matrix_reduce(spark, sf_dir):
    return _out(E.matrix_reduce(FX.sentence_matrix(spark, sf_dir)))


def prompt_table(spark, sf_dir):
    """Model inputs per topic, experiment and family: the API request body, the
    local template wrapped for mistral, vicuna and llama, and the error for a
    family that is not known."""
    rows = PR.prompt_rows(FX.topics(spark, sf_dir))
    local = F.array(*[F.lit(x) for x in ("mistral-7b", "vicuna-7b", "Meta-Llama-3", "falcon-7b")])
    names = F.when(F.col("template") == "api", F.array(F.lit("summarizer"))).otherwise(local)
    r = rows.select("row_id", "exp", "prompt", "template", F.explode(names).alias("name"))
    r = r.withColumn("family", F.when(F.col("template") == "api", F.lit("api")).otherwise(PR.family_of(F.col("name"))))
    body = F.when(F.col("family") == "api", PR.request_payload(F.col("name"), F.col("prompt"), F.col("exp"))).otherwise(
        PR.wrap_for_family(F.col("family"))
    )
    return _out(r.select("row_id", "exp", "name", "family", body.alias("model_input"), PR.family_error(F.col("family"), F.col("name")).alias("error")))


def prediction_table(spark, sf_dir):
    """The prediction of every request from its responses, good and broken ones."""
    long = long_predictions(spark, sf_dir)
    return _out(PR.assemble_predictions(FX.requests(long), FX.responses(long)).drop("name"))


def response_parse(spark, sf_dir):
    """Text of each API response; bodies and faults as in the prediction table."""
    r = FX.responses(long_predictions(spark, sf_dir).where("model = 'm0'"))
    raw = F.col("raw")
    return _out(r.select("row_id", "exp", "received", PR.response_text(raw).alias("text"), PR.response_content(raw).isNull().alias("is_error")))


def raw_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded local-model outputs per family: m0/m1 echo the family's chat
    markers around the title and summary, m2 returns bare text."""
    p = X.unpivot(FX.predictions(spark, sf_dir), keys=("model", "row_id", "title"))
    fam = F.explode(F.array(*[F.lit(x) for x in ("mistral", "vicuna", "llama", "mixtral")])).alias("family")
    p = p.select("model", "row_id", "exp", "pred", "title", fam)
    bare = F.col("model") == "m2"
    f = F.col("family")
    raw = (
        F.when(bare, F.col("pred"))
        .when(f == "mistral", F.concat(F.lit("[INST] "), F.col("title"), F.lit(" [/INST]\n"), F.col("pred")))
        .when(f == "vicuna", F.concat(F.lit("USER: "), F.col("title"), F.lit("\nASSISTANT: "), F.col("pred"), F.lit("</s>")))
        .when(f == "llama", F.concat(F.lit("Here is the summary: "), F.col("pred")))
        .otherwise(F.col("pred"))
    )
    return p.select("model", "row_id", "exp", "family", raw.alias("raw"))


def output_cleanup(spark, sf_dir):
    r = raw_outputs(spark, sf_dir)
    return _out(
        r.select(
            "model",
            "row_id",
            "exp",
            "family",
            PR.clean_output(F.col("raw"), F.col("family")).alias("clean"),
            PR.clean_output(F.col("raw"), F.col("family"), parity=True).alias("clean_parity"),
        )
    )


def pad_segments(spark, sf_dir):
    """Stance-model inputs: pair text, segment ids padded to 256, and an id
    sequence (token lengths stand in for vocabulary ids) padded/truncated to
    16 in all four pre/post combinations."""
    p = FX.predictions(spark, sf_dir).select("model", "row_id", "title", T.first_sentence("mp_left_pred").alias("text"))
    ids = F.transform(T.word_tokens("text"), lambda t: F.length(t).cast("bigint"))
    asp = F.transform(T.word_tokens("title"), lambda t: F.length(t).cast("bigint"))
    p = p.select("model", "row_id", "title", "text", ids.alias("ids"), asp.alias("asp"))
    cols = [
        T.pair_text(F.col("text"), F.col("title")).alias("pair_text"),
        F.array_join(V.segment_ids(V.nonzero_count(F.col("ids")), V.nonzero_count(F.col("asp")), 256), ",").alias("segments"),
    ]
    for pad in ("post", "pre"):
        for trunc in ("post", "pre"):
            cols.append(F.array_join(V.pad_truncate(F.col("ids"), 16, pad, trunc), ",").alias(f"ids_{pad}_{trunc}"))
    return p.select("model", "row_id", *cols)


def plot_series(spark, sf_dir):
    """Figure data: means and confidence bands by position, by length percentile
    (plain and unique coverage) and by density percentile, with labels and order."""
    f = materialize(facts(spark, sf_dir, with_lexicon=True), "facts")
    by_length = B.binned_report(f, "length", 10, "length_bin", ["mpl_ext", "mpr_ext", "mpl_ext_unq", "mpr_ext_unq"])
    by_density = B.binned_report(f, "perc_arous", 10, "parous_bin", ["mpl_ext", "mpr_ext"])
    length, density = RP.percentile_axis("length_bin"), RP.percentile_axis("parous_bin")
    s = RP.plot_points(RP.position_report(f), "position", F.col("pos"), sides=("avg",))
    s = s.unionByName(RP.plot_points(by_length, "length", length, sides=("avg",)))
    s = s.unionByName(RP.plot_points(by_length, "length_unq", length, suffix="_unq"))
    s = s.unionByName(RP.plot_points(by_density, "density", density))
    labels = {"m0": "Model 0", "m1": "Model 1", "m2": "Model 2", "ref": "Reference"}
    # presentation order (the reference's groupby output is key-sorted)
    return _out(RP.display_names(s, labels)).orderBy("ord", "series", "side", "x")


def _length_ratio_factory():
    def score(pred: pd.Series, ref: pd.Series) -> pd.Series:
        return pred.str.len() / ref.str.len().where(ref.str.len() > 0)

    return score


def scorer_hook(spark, sf_dir):
    s = E.apply_scorer(long_predictions(spark, sf_dir), _length_ratio_factory, ["pred", "ref"], "len_ratio")
    return _out(s.select("model", "row_id", "exp", "len_ratio"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "passage_explode": passage_explode,
    "first_sentence": first_sentence,
    "first_sentence_tables": first_sentence_tables,
    "passage_side": passage_side,
    "passage_coverage": passage_coverage,
    "coverage_unique_as_coded": coverage_unique_as_coded,
    "coverage_unique_shared": coverage_unique_shared,
    "position_report": position_report,
    "side_report": side_report,
    "doc_coverage_by_model": doc_coverage_by_model,
    "summary_length_by_model": summary_length_by_model,
    "summary_length_tokens": summary_length_tokens,
    "length_bins": length_bins,
    "arousal_bins": arousal_bins,
    "density_bins": density_bins,
    "arousal_features": arousal_features,
    "intensity": intensity,
    "intensity_gap": intensity_gap,
    "lexicon_dedupe": lexicon_dedupe,
    "rouge1": rouge1,
    "rouge2": rouge2,
    "rougeL": rougeL,
    "experiment_scores": experiment_scores,
    "rouge_missing_text": rouge_missing_text,
    "base_summary": base_summary,
    "score_checks": score_checks,
    "topics_csv": topics_csv,
    "experiment_runs": experiment_runs,
    "summary_sinks": summary_sinks,
    "stance_gap": stance_gap,
    "stance_summary": stance_summary,
    "keyphrase_target": keyphrase_target,
    "perspective_rows": perspective_rows,
    "greedy_match_f1": greedy_match_f1,
    "matrix_reduce": matrix_reduce,
    "prompt_table": prompt_table,
    "prediction_table": prediction_table,
    "response_parse": response_parse,
    "output_cleanup": output_cleanup,
    "pad_segments": pad_segments,
    "plot_series": plot_series,
    "scorer_hook": scorer_hook,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)
