"""Evaluation tables derived from the given parquet tables.

The reference's own dataset is access restricted; these derivations give the
same shapes from ``documents``, ``conversations``, ``embeddings`` and ``labels``
over whole texts and whole vectors. Every derivation is a deterministic
DataFrame expression, mirrored in SQL by :mod:`viewpoint.plans.oracle`. Topics
and predictions are row-local: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from viewpoint.functions import text as T
from viewpoint.operators.lexicon import explode_lexicon_tokens
from viewpoint.operators.passages import pinned
from viewpoint.schemas import PRED_COLS

# Fixture model ids.
N_MODELS = 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _side_lines(lines, parity: int):
    return F.array_join(F.filter(lines, lambda x, i: (i % 5 != 4) & (i % 2 == parity)), "\n")


def _head_words(text, n: int):
    return F.array_join(F.slice(F.split(text, T.WS_RUN, n + 1), 1, n), " ")


def spread_words(words: Column, n) -> Column:
    """At most ``n`` words, evenly spread over the whole text: every k-th one."""
    size = F.size(words)
    step = F.greatest(F.lit(1), F.ceil(size / n).cast("int"))
    return F.array_join(F.transform(F.sequence(F.lit(0), size - 1, step), lambda i: F.get(words, i)), " ")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The topics without their summaries: every line of a document is a passage of
    ``alt_op``; lines 0,2,6,8,... form ``left_op``, 1,3,5,7,... ``right_op`` (every
    fifth line is on no side)."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "text")
    lines = F.split(F.col("text"), "\n")
    return pinned(
        docs,
        ["row_id"],
        title=_head_words(F.col("text"), 4),
        alt_op=F.col("text"),
        left_op=_side_lines(lines, 0),
        right_op=_side_lines(lines, 1),
    )


def _topic_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`topics` with the words of both sides, ``_L`` and ``_R``, which the summaries are made of."""
    base = sources(spark, sf_dir)
    words = pinned(base, base.columns, _L=T.split_ws("left_op"), _R=T.split_ws("right_op"))
    sums = {c: F.concat(spread_words(F.col(w), 20), F.lit(".")) for w, c in (("_L", "left_sum"), ("_R", "right_sum"))}
    return pinned(words, words.columns, **sums)


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One topic per document: its :func:`sources`, and reference summaries of 20
    words spread over each side."""
    return _topic_words(spark, sf_dir).drop("_L", "_R")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of three fixture models per topic, in the reference's wide
    layout (topic columns + four prediction columns + ``model``), made of words
    spread over the sides."""
    return _predictions(_topic_words(spark, sf_dir))


def predictions_of(t: DataFrame) -> DataFrame:
    """:func:`predictions` of a topic table; columns added to it stay."""
    return _predictions(t.select("*", T.split_ws("left_op").alias("_L"), T.split_ws("right_op").alias("_R")))


def predictions_and_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`predictions` and, as those of a model 'ref', the reference summaries, in one pass over the topics."""
    return _predictions(_topic_words(spark, sf_dir), reference=True)


def _predictions(words: DataFrame, reference: bool = False) -> DataFrame:
    m, given = F.col("m"), F.col("m") < N_MODELS
    left, right = F.col("_L"), F.col("_R")
    tail = F.lit(". Tail here.")
    # Word arrays once per topic, texts once per model, whatever expressions use them.
    rows = words.select("*", F.explode(F.sequence(F.lit(0), F.lit(N_MODELS - 1 + reference))).alias("m"))
    model = F.concat(F.lit("m"), m.cast("string"))
    texts = {
        "sp_left_pred": F.concat(F.lit("The left "), spread_words(left, 8 + m), tail),
        "sp_right_pred": F.concat(F.lit("The right "), spread_words(right, 8 + m), tail),
        "mp_left_pred": F.concat(F.lit("The left "), spread_words(left, 6 + 2 * m), F.lit(" "), spread_words(right, 6 - 2 * m), tail),
        "mp_right_pred": F.concat(F.lit("The right "), spread_words(right, 6 + 2 * m), F.lit(" "), spread_words(left, 6 - 2 * m), tail),
    }
    if reference:
        model = F.when(given, model).otherwise(F.lit("ref"))
        texts = {c: F.when(given, x).otherwise(F.col("left_sum" if "left" in c else "right_sum")) for c, x in texts.items()}
    return pinned(rows.select(model.alias("model"), "*"), ["model", *[c for c in words.columns if c not in ("_L", "_R")]], **texts)


def prediction_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, row_id, exp) of every prediction, without its texts."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"))
    rows = docs.select("row_id", F.explode(F.sequence(F.lit(0), F.lit(N_MODELS - 1))).alias("m"))
    exps = F.explode(F.array(*[F.lit(e) for e in PRED_COLS])).alias("exp")
    return rows.select(F.concat(F.lit("m"), F.col("m").cast("string")).alias("model"), "row_id", exps)


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(token, n): the lexicon-normalised tokens of all documents (whole texts) and their occurrences."""
    tokens = explode_lexicon_tokens(table(spark, sf_dir, "documents").select("text"), [], "text")
    return tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct lexicon-normalised tokens of all documents (whole texts)."""
    return token_counts(spark, sf_dir).select("token")


def _hex_int(md5col, start: int):
    return F.conv(F.substring(md5col, start, 4), 16, 10).cast("int") % 1001


def lexicon(vocab: DataFrame) -> DataFrame:
    """Valence/arousal/dominance lexicon in integer thousandths, derived from
    the vocabulary by md5 (about 6 of 16 tokens are kept)."""
    h = F.md5(F.col("token"))
    return vocab.filter(F.substring(h, 9, 1).isin("0", "1", "2", "3", "4", "5")).select(
        F.col("token").alias("term"), _hex_int(h, 1).alias("v"), _hex_int(h, 5).alias("a"), _hex_int(h, 13).alias("d")
    )


def lemmas(vocab: DataFrame) -> DataFrame:
    """(token, lemma): '-ing' (longer than 5) and '-ed' (longer than 4) forms
    whose stem is itself in the vocabulary. One step, no chaining."""
    tok = F.col("token")
    n = F.length(tok)
    cand = vocab.select(
        "token",
        F.when(tok.endswith("ing") & (n > 5), F.expr("substring(token, 1, length(token) - 3)"))
        .when(tok.endswith("ed") & (n > 4), F.expr("substring(token, 1, length(token) - 2)"))
        .alias("lemma"),
    ).filter(F.col("lemma").isNotNull())
    return cand.join(vocab.select(F.col("token").alias("lemma")), "lemma", "left_semi").select("token", "lemma")


def lexicon_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw lexicon lines with repeats: every token occurrence in the documents
    is a line whose scores hash (token, doc); lines are ordered by (doc, position)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    occ = docs.select("doc_id", F.posexplode(T.lexicon_tokens("text")).alias("i", "term"))
    h = F.md5(F.concat(F.col("term"), F.lit(":"), F.col("doc_id").cast("string")))
    line = F.col("doc_id").cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col("i").cast("decimal(10,0)")
    return occ.select("term", line.alias("line_no"), *[_hex_int(h, s).alias(n) for n, s in (("v", 1), ("a", 5), ("d", 13))])


def rouge_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation turn (prediction) against the previous turn (reference)."""
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    prev = conv.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("ref"))
    return conv.join(prev, ["conv_id", "turn"]).select("conv_id", "turn", F.col("text").alias("pred"), "ref")


def token_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pair_id, side, vec): ten consecutive vectors form a pair, even ids are
    prediction tokens (side 0), odd ids reference tokens (side 1)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.floor(F.col("vec_id") / 10).cast("bigint").alias("pair_id"),
        (F.col("vec_id") % 2).cast("int").alias("side"),
        F.col("vec_id").alias("tok_id"),
        F.col("embedding").cast("array<double>").alias("vec"),
    )


def _prediction_of(k: Column) -> list[Column]:
    """Key of the k-th prediction: topics in order, then models, then experiments."""
    exps = F.array(*[F.lit(e) for e in PRED_COLS])
    per = N_MODELS * len(PRED_COLS)
    return [
        F.concat(F.lit("m"), (F.floor(k / len(PRED_COLS)) % N_MODELS).cast("string")).alias("model"),
        F.floor(k / per).cast("bigint").alias("row_id"),
        F.get(exps, (k % len(PRED_COLS)).cast("int")).alias("exp"),
    ]


def stance_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pair_id, is_ref, logits): pro/con/neutral logits, each the sum of every
    third vector entry; even ids score the prediction, odd ids the reference."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    third = lambda k: F.aggregate(F.filter("v", lambda x, i: i % 3 == k), F.lit(0.0), lambda a, x: a + x)
    return e.select(
        F.floor(F.col("vec_id") / 2).cast("bigint").alias("pair_id"),
        (F.col("vec_id") % 2 == 1).alias("is_ref"),
        F.array(third(0), third(1), third(2)).alias("logits"),
    )


def stance_scores(stance: DataFrame) -> DataFrame:
    """(model, row_id, exp, stance): pair k is the k-th prediction; later
    predictions have no stance."""
    return stance.select(*_prediction_of(F.col("pair_id")), "stance")


def phrase_vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Key phrases as token vectors: of predictions (model, row_id, exp, vec), the
    even vectors of pair k for the k-th one; of sources (row_id, src, vec), the odd
    vectors of pair k for side k % 2 of topic k div 2."""
    v = token_vectors(spark, sf_dir)
    pred = v.where("side = 0").select(*_prediction_of(F.col("pair_id")), "vec")
    side = F.when(F.col("pair_id") % 2 == 0, F.lit("left_op")).otherwise(F.lit("right_op"))
    return pred, v.where("side = 1").select(F.floor(F.col("pair_id") / 2).cast("bigint").alias("row_id"), side.alias("src"), "vec")


def sentence_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pair_id, src_sent, claim_sent, score): cosines of the five vectors of one
    side of a pair, the source's sentences, with the five of the other, the claim's."""
    v = token_vectors(spark, sf_dir)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    v = v.select("pair_id", "side", F.floor(F.col("tok_id") % 10 / 2).cast("int").alias("sent"), "vec", F.sqrt(dot("vec", "vec")).alias("norm"))
    src = v.where("side = 0").select("pair_id", F.col("sent").alias("src_sent"), F.col("vec").alias("a"), F.col("norm").alias("na"))
    claim = v.where("side = 1").select("pair_id", F.col("sent").alias("claim_sent"), F.col("vec").alias("b"), F.col("norm").alias("nb"))
    both = src.join(claim, "pair_id")
    return both.select("pair_id", "src_sent", "claim_sent", F.try_divide(dot("a", "b"), F.col("na") * F.col("nb")).alias("score"))


def external_scores(spark: SparkSession, sf_dir: str, keys: DataFrame) -> DataFrame:
    """Long external score table (model, row_id, exp, metric, score, ingest_order):
    a 'bleurt' score per prediction (``keys``: model, row_id, exp) of every labelled document, from its quality
    label; unlabelled documents have none. It has every fault that a score table
    can have: repeated, NULL and out-of-range scores, scores of an unknown metric
    and of a model without predictions."""
    labels = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("row_id")).agg(F.max("quality").alias("quality"))
    r, m = F.col("row_id"), F.substring("model", 2, 10).cast("int")
    score = (F.col("quality") * 50 + (r * 31 + m * 7) % 51) / 100.0
    score = F.when(r % 29 == 0, F.lit(None).cast("double")).when(r % 23 == 0, F.lit(1.5)).otherwise(score)
    row = lambda model, metric, x, order: F.struct(
        model.alias("model"), F.lit(metric).alias("metric"), x.alias("score"), F.lit(order).alias("ingest_order")
    )
    rows = F.array(
        row(F.col("model"), "bleurt", score, 1),
        F.when(r % 11 == 0, row(F.col("model"), "bleurt", F.lit(0.25), 2)),
        F.when(r % 31 == 0, row(F.col("model"), "menli", F.lit(0.5), 1)),
        F.when(r % 19 == 0, row(F.lit("m9"), "bleurt", F.lit(0.5), 1)),
    )
    labelled = keys.select("model", "row_id", "exp").join(labels, "row_id")
    return labelled.select("row_id", "exp", F.explode(F.array_compact(rows)).alias("x")).select("x.model", "row_id", "exp", "x.metric", "x.score", "x.ingest_order")


# Names of the fixture models; those without a name are API models.
MODEL_NAMES = {"m1": "mistralai/Mistral-instruct-mistral-7b", "m2": "Meta-Llama-3-8B", "m3": "falcon-7b"}


def requests(long: DataFrame) -> DataFrame:
    """(model, row_id, exp, name): a request per prediction, and per topic one to
    a model of a family that is not known."""
    names = F.create_map(*[F.lit(x) for kv in MODEL_NAMES.items() for x in kv])
    some = long.select("model", "row_id", "exp")
    lost = some.where("model = 'm0' and exp = 'mp_left_pred'").withColumn("model", F.lit("m3"))
    return some.unionByName(lost).withColumn("name", F.try_element_at(names, F.col("model")))


def responses(long: DataFrame) -> DataFrame:
    """(model, row_id, exp, raw, received): API bodies of model m0, decoded output
    with chat marks of m1, bare output of m2. By topic, responses are missing
    (every 13th), truncated (7th), followed by other text (5th), without text
    (17th) or sent twice, the first one broken (11th)."""
    r = F.col("row_id")
    message = F.struct(F.struct(F.col("pred").alias("content")).alias("message"))
    rows = long.where(r % 13 != 0).select("model", "row_id", "exp", "pred", F.to_json(F.struct(F.array(message).alias("choices"))).alias("body"))
    body = (
        F.when(r % 7 == 0, F.expr("substring(body, 1, length(body) - 3)"))
        .when(r % 5 == 0, F.concat(F.col("body"), F.lit(" and more")))
        .when(r % 17 == 0, F.lit('{"choices":[{"message":{"content":null}}]}'))
        .otherwise(F.col("body"))
    )
    raw = F.when(F.col("model") == "m0", body).when(F.col("model") == "m1", F.concat(F.lit("[INST] x [/INST]\n"), F.col("pred"))).otherwise(
        F.concat(F.lit("Here it is: "), F.col("pred"))
    )
    sent = lambda x, at: F.struct(x.alias("raw"), F.lit(at).cast("bigint").alias("received"))
    sent = F.array_compact(F.array(sent(raw, 2), F.when(r % 11 == 0, sent(F.lit("oops"), 1))))
    return rows.select("model", "row_id", "exp", F.explode(sent).alias("x")).select("model", "row_id", "exp", "x.*")
