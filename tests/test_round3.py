"""Forms of the text operators that keep their cost in step with the input."""

import random
import time

from pyspark.sql import functions as F

from viewpoint.functions import moments as M
from viewpoint.functions import text as T
from viewpoint.operators import lexicon as LX
from viewpoint.operators import passages as P
from viewpoint.operators import reports as RP


def _facts(spark, **options):
    topics = spark.createDataFrame([(1, "a b\nc d a", "a b", "c d"), (1, "b", "b", ""), (None, "a", "a", "")], "row_id long, alt_op string, left_op string, right_op string")
    rows = [("m", 1, "A c.", "b.", "cannot.", None), ("m", None, "a.", "", "", ""), ("n", 1, "x y", "d a", "c c", "a")]
    preds = spark.createDataFrame(rows, "model string, row_id long, sp_left_pred string, sp_right_pred string, mp_left_pred string, mp_right_pred string")
    return P.extraction_facts(topics, P.summary_sets(preds), **options)


def test_facts_by_hand(spark):
    """Tokens of the sets: A, B of passage 0, C, D, A of passage 1; 'a' and 'b' are single characters of passage 0."""
    got = {(r["model"], r["pos"], r["length"]): r for r in _facts(spark).collect()}
    assert set(got) == {("m", 0, 2), ("m", 1, 3), ("m", 0, 1), ("n", 0, 2), ("n", 1, 3), ("n", 0, 1)}
    m0, m1 = got["m", 0, 2], got["m", 1, 3]
    assert (m0["spl_ext"], m0["spr_ext"], m0["mpl_ext"], m0["mpr_ext"]) == (0.5, 1.0, 0.0, 0.0) and (m1["spl_ext"], m1["spr_ext"]) == (1.0, 0.0)
    # All tokens of m's left summary are ignored, 'd a' of n keeps none, 'x y' both, which no passage has.
    assert m0["spl_ext_unq"] == m1["spl_ext_unq"] == got["n", 1, 3]["spr_ext_unq"] == got["n", 0, 2]["spl_ext_unq"] == 0.0
    shared = {(r["model"], r["pos"], r["length"]): r for r in _facts(spark, unique_mode="shared").collect()}
    assert shared["m", 1, 3]["spl_ext_unq"] == 1.0 and shared["m", 0, 2]["spl_ext_unq"] == 0.0  # 'a' is in both passages


def test_coverage_is_worked_out_once_whatever_uses_it(spark):
    f = _facts(spark)
    sums = [x for c in RP.EXT_COLS for x in (*M.sum_columns(F.when(F.col("pos") < 4, F.col(c)), c), M.spread_column(F.when(F.col("pos") < 4, F.col(c))).alias(c))]
    plan = f.groupBy("model", "length").agg(*sums)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_intersect(") <= len(RP.EXT_COLS) + 1


def test_common_tokens_are_looked_up_by_broadcast_with_the_same_sums(spark):
    rng = random.Random(1)
    words = ["the", "of", "war", "cannot", "U.S.", "rare", "odd", "peace", ""]
    rows = [(i % 35 or None, " ".join(rng.choices(words, [50, 40, 9, 5, 5, 1, 1, 9, 3], k=rng.randrange(0, 30)))) for i in range(60)] + [(90, None), (91, "")]
    df = spark.createDataFrame(rows, "k long, t string")
    lookup = spark.createDataFrame([("the", 900, 700), ("war", 100, 900), ("rare", 900, 651), ("odd", 350, 900), ("usa", 650, 10), ("can", 700, 300)], "token string, v int, a int")
    counts = LX.explode_lexicon_tokens(df, [], "t").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    for share in (1, 8, 1 << 20):
        common = LX.common_tokens(counts, lookup, share)
        assert common.count() <= share
        for strict in (False, True):
            want, got = (sorted(map(tuple, LX.token_stats(df, ["k"], "t", lookup, strict, c).collect()), key=repr) for c in (None, common))
            assert got == want and len(got) == 37 and sum(r[3] for r in got) > 0


def test_first_sentence_by_tables_equals_the_walk_over_words(spark):
    rng = random.Random(2)
    pieces = ["Dr.", "e.g.", "U.S.", "The", "the", "end.", "what?!", "...", ".", "(Mr.", "word", "J.", " ", "\n", "  ", "etc.\"", "It", "No."]
    texts = ["".join(x + rng.choice(["", " ", "\t"]) for x in rng.choices(pieces, k=rng.randrange(0, 9))) for _ in range(300)]

    def held(body):
        initials = body and all(len(p) == 1 and p.isupper() for p in body.split("."))
        return body.lower() in T.ABBREVIATIONS or initials

    def walk(text):
        words, text = text.split(), text.strip()
        at = 0
        for i, w in enumerate(words):
            at = text.index(w, at) + len(w)
            after = words[i + 1] if i + 1 < len(words) else ""
            if w[-1] not in ".!?":
                continue
            body = w.lstrip("(.\"")[:-1] if w[-1] == "." else ""
            body = "" if body.endswith((".", "!", "?")) else body
            open_ = held(body) and after and "".join(c for c in after if c.isalpha()).lower() not in T.STARTERS
            if not open_:
                return text[:at]
        return text

    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = {r["i"]: r["s"] for r in df.select("i", T.first_sentence_by_tables("t").alias("s")).collect()}
    assert got == {i: walk(t) for i, t in enumerate(texts)}


def test_first_sentence_by_tables_does_not_look_at_every_word(spark):
    """Two million words, one of ten with a full stop; looking at each took over 20 seconds."""
    df = spark.range(1).select(F.repeat(F.lit("Dr. " + "word " * 9), 200_000).alias("t"))
    T_ = T.first_sentence_by_tables
    df.select(F.length(T_(F.lit("One. Two.")))).collect()
    start = time.time()
    assert df.select(F.length(T_("t"))).first()[0] == 200_000 * 49 - 1
    assert time.time() - start < 12
