import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from viewpoint.functions import vectors as V
from viewpoint.operators import external as E
from viewpoint.operators import lexicon as LX
from viewpoint.operators import prompts as PR


def _lex(spark):
    lex = spark.createDataFrame(
        [("war", 200, 800, 500), ("peace", 900, 300, 500), ("calm", 500, 100, 500), ("angry", 650, 700, 400), ("low", 350, 660, 1)],
        "term string, v int, a int, d int",
    )
    lem = spark.createDataFrame([("wars", "war"), ("angrying", "nothere")], "token string, lemma string")
    return LX.surface_lookup(lex, lem)


def test_token_stats_inclusive_vs_strict(spark):
    df = spark.createDataFrame([(1, "War wars, peace calm angry low!"), (2, ""), (3, "angrying")], "k long, t string")
    lk = _lex(spark)
    inc = {r["k"]: r for r in LX.token_stats(df, ["k"], "t", lk, strict=False).collect()}
    st = {r["k"]: r for r in LX.token_stats(df, ["k"], "t", lk, strict=True).collect()}
    # inclusive: war, wars(->war), peace, angry (v=650), low (v=350) are polar; calm is not
    assert inc[1]["num_pol"] == 5 and inc[1]["num_arous"] == 4 and inc[1]["sum_a"] == 800 + 800 + 300 + 700 + 660
    # strict: the boundary values 650 and 350 are not polar
    assert st[1]["num_pol"] == 3 and st[1]["sum_a"] == 800 + 800 + 300
    assert inc[2]["num_pol"] == 0 and inc[3]["num_pol"] == 0  # lemma without entry is a miss


def test_intensity_zero_without_hits(spark):
    df = spark.createDataFrame([(1, "nothing here"), (2, "war peace")], "k long, t string")
    got = {r["k"]: r["intensity"] for r in LX.intensity(df, ["k"], "t", _lex(spark)).collect()}
    assert got == {1: 0.0, 2: pytest.approx((800 + 300) / 2000)}


def test_dedupe_last_line_wins(spark):
    lines = spark.createDataFrame([("a", 1, 1, 1, 1), ("a", 5, 2, 2, 2), ("b", 3, 9, 9, 9), ("a", 4, 3, 3, 3)], "term string, line_no long, v int, a int, d int")
    got = {r["term"]: r["v"] for r in LX.dedupe_last(lines).collect()}
    assert got == {"a": 2, "b": 9}


def test_softmax_argmax_stance_gap(spark):
    logits = [[1.0, 2.0, 0.5], [-3.0, -1.0, -1.0], [0.0, 0.0, 0.0]]
    df = spark.createDataFrame([(l, list(reversed(l))) for l in logits], "p array<double>, r array<double>")
    rows = df.select(V.softmax(F.col("p")).alias("sp"), V.softmax(F.col("r")).alias("sr")).select(
        "sp", "sr", V.argmax1(F.col("sr")).alias("k"), V.stance_gap(F.col("sp"), F.col("sr")).alias("g")
    ).collect()
    for row, l in zip(rows, logits):
        e = np.exp(np.array(l) - max(l))
        sp = e / e.sum()
        r = list(reversed(l))
        er = np.exp(np.array(r) - max(r))
        sr = er / er.sum()
        k = int(np.argmax(sr))
        assert np.allclose(row["sp"], sp) and row["k"] == k + 1
        assert row["g"] == pytest.approx(abs(sp[k] - sr[k]))


@pytest.mark.parametrize(
    "padding, truncating, short, long",
    [
        ("post", "post", [1, 2, 3, 0, 0], [11, 12, 13, 14, 15]),
        ("pre", "post", [0, 0, 1, 2, 3], [11, 12, 13, 14, 15]),
        ("post", "pre", [1, 2, 3, 0, 0], [13, 14, 15, 16, 17]),
        ("pre", "pre", [0, 0, 1, 2, 3], [13, 14, 15, 16, 17]),
    ],
)
def test_pad_truncate_by_hand(spark, padding, truncating, short, long):
    df = spark.createDataFrame([([1, 2, 3],), ([11, 12, 13, 14, 15, 16, 17],), ([5, 6, 7, 8, 9],)], "s array<bigint>")
    got = [r[0] for r in df.select(V.pad_truncate(F.col("s"), 5, padding, truncating)).collect()]
    assert got == [short, long, [5, 6, 7, 8, 9]]


def test_segment_ids(spark):
    df = spark.createDataFrame([(3, 2)], "t int, a int")
    assert df.select(V.segment_ids(F.col("t"), F.col("a"), 10)).first()[0] == [0, 0, 0, 0, 0, 1, 1, 1, 0, 0]


def test_rmse_arrays(spark):
    df = spark.createDataFrame([([1.0, 2.0], [2.0, 4.0])], "a array<double>, b array<double>")
    assert df.select(V.rmse(F.col("a"), F.col("b"))).first()[0] == pytest.approx(math.sqrt(2.5))


def test_response_text_and_cleanup(spark):
    good = json.dumps({"choices": [{"message": {"content": "The left wants x."}}]})
    df = spark.createDataFrame([(good,), ("oops",), ('{"choices": []}',)], "raw string")
    assert [r[0] for r in df.select(PR.response_text(F.col("raw"))).collect()] == ["The left wants x.", "Error", "Error"]
    cases = spark.createDataFrame(
        [
            ("<s>[INST] hi [/INST]\nThe left.", "mistral"),
            ("no marker here at all", "mistral"),
            ("USER: x\nASSISTANT: The right.</s>", "vicuna"),
            ("Here is it: The left.", "llama"),
            ("here", "llama"),
            ("The left.", "mixtral"),
        ],
        "t string, f string",
    )
    got = [r[0] for r in cases.select(PR.clean_output(F.col("t"), F.col("f"))).collect()]
    assert got == ["The left.", "no marker here at all", "The right.<", " The left.", "here", "The left."]  # vicuna drops 3 chars
    parity = [r[0] for r in cases.select(PR.clean_output(F.col("t"), F.col("f"), parity=True)).collect()]
    assert parity[1] == "no marker here at all"[7:]


def test_only_a_whole_json_text_is_a_response(spark):
    good = json.dumps({"choices": [{"message": {"content": "x"}}]})
    raws = [good, f" {good}\n", good[:-1], good[:-3], good + " garbage", good + "]", good + "}", good + ", 1", good + ', "y": 1', f"[{good}", "", "oops", None]
    raws += ['{"choices":[{"message":{"content":null}}]}', '{"choices":[]}', "[]", "3", '{"choices":[{"message":{"content":""}}]}']
    df = spark.createDataFrame([(r,) for r in raws], "raw string")

    def python(raw):
        try:
            return json.loads(raw)["choices"][0]["message"]["content"]
        except Exception:
            return None

    assert [r[0] for r in df.select(PR.response_content(F.col("raw"))).collect()] == [python(r) for r in raws]


def test_families_of_prompts_and_of_cleanup(spark):
    names = ["mistralai/mistral-7b", "lmsys/vicuna-7b", "Mixtral-8x22b", "Meta-Llama-3", "llama-v3", "Mistral-7B", "gpt4-o"]
    df = spark.createDataFrame([(n,) for n in names], "m string")
    got = df.select(PR.family_of(F.col("m")), PR.cleanup_family_of(F.col("m")), PR.family_error(PR.family_of(F.col("m")), F.col("m"))).collect()
    assert [r[0] for r in got] == ["mistral", "vicuna", "mixtral", "llama", "llama", None, None]
    assert [r[1] for r in got] == ["mistral", "vicuna", None, None, "llama", None, None]
    assert [r[2] for r in got] == [None] * 5 + ["unknown model family: Mistral-7B", "unknown model family: gpt4-o"]


def test_capitalised_llama_output_is_left_alone(spark):
    df = spark.createDataFrame([("Here: The left.", "Meta-Llama-3-8B"), ("Here: The left.", "llama-3")], "t string, m string")
    got = [r[0] for r in df.select(PR.clean_output(F.col("t"), PR.cleanup_family_of(F.col("m")), parity=True)).collect()]
    assert got == ["Here: The left.", " The left."]


def test_tokenless_rows_and_frequent_tokens_without_a_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.createDataFrame([(i, "war " * (i % 3)) for i in range(30)], "k long, t string")
        got = {r["k"]: r["num_pol"] for r in LX.token_stats(df, ["k"], "t", _lex(spark), strict=True).collect()}
        assert got == {i: i % 3 for i in range(30)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_last_line_by_two_columns(spark):
    lines = spark.createDataFrame([("a", 1, 2_000_000, 1, 1, 1), ("a", 2, 0, 2, 2, 2), ("a", 2, -1, 3, 3, 3)], "term string, doc long, i long, v int, a int, d int")
    out = LX.dedupe_last(lines.withColumn("line_no", F.struct("doc", "i"))).first()
    assert (out["v"], out["a"], out["d"]) == (2, 2, 2)


def test_zero_vectors(spark):
    df = spark.createDataFrame([(0, 0, [0.0, 0.0]), (0, 1, [1.0, 0.0]), (1, 0, [1.0, 0.0]), (1, 1, [1.0, 0.0])], "pair_id long, side int, vec array<double>")
    assert {r["pair_id"]: r["f1"] for r in E.greedy_match(df).collect()} == {0: 0.0, 1: 1.0}


def _matrix_f1(cand, ref):
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (cand, ref))
    sim = a @ b.T
    p, r = sim.max(axis=1).mean(), sim.max(axis=0).mean()
    return p, r, 2 * p * r / (p + r)


def test_texts_of_any_length_equal_the_whole_matrix(spark):
    rng = np.random.default_rng(1)
    cand, ref = rng.normal(size=(5000, 4)), rng.normal(size=(3000, 4))
    rows = [(0, 0, v.tolist()) for v in cand] + [(0, 1, v.tolist()) for v in ref] + [(1, 0, v.tolist()) for v in cand[:7]] + [(1, 1, v.tolist()) for v in ref[:3]]
    got = {r["pair_id"]: tuple(r)[1:] for r in E.greedy_match(spark.createDataFrame(rows, "pair_id long, side int, vec array<double>")).collect()}
    assert got[0] == pytest.approx(_matrix_f1(cand, ref), abs=1e-12) and got[1] == pytest.approx(_matrix_f1(cand[:7], ref[:3]), abs=1e-12)


@pytest.mark.parametrize("tile", [1, 2, 3])
def test_tiles_change_nothing(spark, tile):
    rng = np.random.default_rng(tile)
    phrases = {i: rng.normal(size=(rng.integers(1, 8), 3)) for i in range(6)}
    source = rng.normal(size=(5, 3))
    pred = spark.createDataFrame([("m", 0, f"e{i}", v.tolist()) for i, p in phrases.items() for v in p], "model string, row_id long, exp string, vec array<double>")
    src = spark.createDataFrame([(0, "s", v.tolist()) for v in source], "row_id long, src string, vec array<double>")
    of = {f"e{i}": "s" for i in range(5)} | {"e5": "none"}
    got = {r["exp"]: r["target"] for r in E.keyphrase_target(pred, src, of, tile=tile).collect()}
    assert got.pop("e5") is None and len(got) == 5
    assert all(got[f"e{i}"] == pytest.approx(_matrix_f1(phrases[i], source)[2], abs=1e-12) for i in range(5))


def test_keyphrase_target_shares_the_source_phrase(spark):
    pred = spark.createDataFrame([("m", 1, "a", [1.0, 0.0]), ("m", 1, "b", [0.0, 1.0]), ("m", 2, "a", [1.0, 0.0])], "model string, row_id long, exp string, vec array<double>")
    src = spark.createDataFrame([(1, "s", [1.0, 0.0])], "row_id long, src string, vec array<double>")
    got = {(r["row_id"], r["exp"]): r["target"] for r in E.keyphrase_target(pred, src, {"a": "s", "b": "s"}).collect()}
    assert got == {(1, "a"): 1.0, (1, "b"): 0.0, (2, "a"): None}


def _scores(spark, rows, order=True):
    return spark.createDataFrame(rows, "model string, row_id long, exp string, metric string, score double" + ", ingest_order int" * order)


def test_score_checks_count_every_fault(spark):
    preds = spark.createDataFrame([("m", i, "e") for i in range(4)], "model string, row_id long, exp string")
    scores = _scores(spark, [("m", 0, "e", "bleurt", 0.5), ("m", 0, "e", "bleurt", 0.6), ("m", 1, "e", "bleurt", None), ("m", 1, "e", "menli", 0.5),
                             ("m", 2, "e", "align", 7.0), ("x", 2, "e", "align", 0.1), ("m", 9, "e", "bert", float("nan"))], order=False)
    got = {r["check"]: r["n"] for r in E.score_checks(scores, preds).collect()}
    assert got == {"duplicates": 1, "unknown_keys": 2, "unknown_metrics": 1, "out_of_range": 2, "null_scores": 1, "rows": 7, "without_score": 1}


def test_several_scores_need_an_order(spark):
    preds = spark.createDataFrame([("m", 0, "e"), ("m", 1, "e")], "model string, row_id long, exp string")
    rows = [("m", 0, "e", "bleurt", 0.9, 1), ("m", 0, "e", "bleurt", 0.2, 2)]
    got = {r["row_id"]: r["bleurt"] for r in E.attach_scores(preds, _scores(spark, rows), ["bleurt"]).collect()}
    assert got == {0: 0.2, 1: None}
    with pytest.raises(Exception, match="several bleurt scores"):
        E.attach_scores(preds, _scores(spark, [r[:5] for r in rows], order=False), ["bleurt"]).collect()


def test_greedy_match_and_matrix_reduce(spark):
    rnd = np.random.default_rng(0)
    vecs = [(0, s, rnd.normal(size=4).tolist()) for s in (0, 0, 1, 1, 1)]
    df = spark.createDataFrame(vecs, "pair_id long, side int, vec array<double>")
    r = E.greedy_match(df).first()
    a = np.array([v for _, s, v in vecs if s == 0])
    b = np.array([v for _, s, v in vecs if s == 1])
    sim = (a / np.linalg.norm(a, axis=1, keepdims=True)) @ (b / np.linalg.norm(b, axis=1, keepdims=True)).T
    p, rr = sim.max(1).mean(), sim.max(0).mean()
    assert r["precision"] == pytest.approx(p) and r["recall"] == pytest.approx(rr) and r["f1"] == pytest.approx(2 * p * rr / (p + rr))
    m = spark.createDataFrame([(0, 0, 0, 0.1), (0, 1, 0, 0.9), (0, 0, 1, 0.4), (0, 1, 1, 0.2)], "pair_id long, src_sent int, claim_sent int, score double")
    assert E.matrix_reduce(m).first()["score"] == pytest.approx((0.9 + 0.4) / 2)


def test_apply_scorer_hook(spark):

    def factory():
        return lambda a, b: a.str.len() / b.str.len()

    df = spark.createDataFrame([("ab", "abcd")], "p string, r string")
    assert E.apply_scorer(df, factory, ["p", "r"], "s").first()["s"] == 0.5


def test_prediction_table_has_one_row_per_request(spark):
    good = json.dumps({"choices": [{"message": {"content": "The left."}}]})
    requests = spark.createDataFrame(
        [("api", i, "e", None) for i in range(1, 6)] + [("loc", 1, "e", "mistral-7b"), ("loc", 2, "e", "mistral-7b"), ("odd", 1, "e", "falcon")],
        "model string, row_id long, exp string, name string",
    )
    responses = spark.createDataFrame(
        [("api", 1, "e", "oops", 1), ("api", 1, "e", good, 2), ("api", 2, "e", good, 1), ("api", 2, "e", "oops", 2), ("api", 3, "e", good + " tail", 1),
         ("api", 5, "e", good, 1), ("api", 5, "e", good, 1), ("loc", 1, "e", "[INST] q [/INST] The right.", 1), ("odd", 1, "e", "text", 1), ("gone", 1, "e", good, 1)],
        "model string, row_id long, exp string, raw string, received long",
    )
    got = {(r["model"], r["row_id"]): (r["pred"], r["is_error"], r["error"]) for r in PR.assemble_predictions(requests, responses).collect()}
    assert got == {
        ("api", 1): ("The left.", False, None),
        ("api", 2): ("Error", True, "unparseable response"),
        ("api", 3): ("Error", True, "unparseable response"),
        ("api", 4): ("Error", True, "no response"),
        ("api", 5): ("The left.", False, None),
        ("loc", 1): ("The right.", False, None),
        ("loc", 2): ("Error", True, "no response"),
        ("odd", 1): ("Error", True, "unknown model family: falcon"),
    }
    with pytest.raises(ValueError, match="received"):
        PR.assemble_predictions(requests, responses.drop("received"))
