import re

from pyspark.sql import functions as F

from tests import pyref
from viewpoint.functions import coverage as C
from viewpoint.functions import text as T

# Edge rows: empty, one space, no sentence end, abbreviation, accents, ½,
# Arabic digits, no-break space, punctuation only, contractions.
EDGE = [
    "",
    " ",
    "no sentence end here",
    "Dr. Who is.",
    "Café ½ ٣٤ a b, naïve!",
    "?!...",
    "I cannot go, gonna wanna gotta.",
    "  lead and trail  ",
    "tab\tsep\nline para\x85end",
    "U.S. policy",
]


def _rows(spark, col):
    return [r[0] for r in spark.createDataFrame([(s,) for s in EDGE], "s string").select(col).collect()]


def test_normalize_matches_python(spark):
    assert _rows(spark, T.normalize("s")) == [pyref.normalize(s) for s in EDGE]


def test_word_tokens_match_python(spark):
    assert _rows(spark, T.word_tokens("s")) == [pyref.word_tokens(s) for s in EDGE]


def test_passage_length_matches_re_split(spark):
    assert _rows(spark, T.passage_length("s")) == [len(re.split(r"\s+", s)) for s in EDGE]


def test_first_sentence_rule(spark):
    got = dict(zip(EDGE, _rows(spark, T.first_sentence("s"))))
    assert got[""] == ""
    assert got[" "] == ""
    assert got["no sentence end here"] == "no sentence end here"
    assert got["Dr. Who is."] == "Dr."  # documented deviation: abbreviations end a sentence
    assert got["?!..."] == "?!..."
    assert got["  lead and trail  "] == "lead and trail"


def test_side_of_empty_passage_is_left(spark):
    df = spark.createDataFrame([("", "abc", "xyz"), ("XYZ!", "abc", "xyz"), ("q", "abc", "xyz")], "op string, l string, r string")
    got = [r[0] for r in df.select(T.side_of("op", T.normalize("l"), T.normalize("r"))).collect()]
    assert got == ["left", "right", "neither"]


def test_side_prefix_cut_before_punctuation_removal(spark):
    op = "a" * 29 + ",bcd"
    df = spark.createDataFrame([(op, "a" * 29, "zzz")], "op string, l string, r string")
    assert df.select(T.side_of("op", T.normalize("l"), T.normalize("r"))).first()[0] == "left"


def test_ext_cov_matches_python(spark):
    pairs = [("a b c d", "a x"), ("", "a"), ("a b", ""), ("Café naïve", "café tea"), ("x", "x x x")]
    df = spark.createDataFrame(pairs, "src string, pred string")
    got = [r[0] for r in df.select(C.ext_cov(F.col("src"), F.col("pred"))).collect()]
    assert got == [pyref.coverage(s, p) for s, p in pairs] == [0.5, 0.0, 0.0, 0.5, 1.0]


def test_rouge_tokens_ascii_only(spark):
    df = spark.createDataFrame([("Héllo, WORLD 42!",), ("",)], "s string")
    got = [r[0] for r in df.select(T.rouge_tokens("s")).collect()]
    assert got == [pyref.rouge_tokens("Héllo, WORLD 42!"), []]


SENTENCES = {
    "Dr. Smith met U.S. officials. They left.": "Dr. Smith met U.S. officials.",
    "He lives in the U.S. They do not.": "He lives in the U.S.",
    "J. R. Jones spoke (e.g. on tax). Then he left.": "J. R. Jones spoke (e.g. on tax).",
    "It began at 9 a.m. The end came.": "It began at 9 a.m.",
    " No stop at\tall ": "No stop at\tall",
    "Ask Mr.": "Ask Mr.",
    "Really?! Dr. No said so.": "Really?!",
    "Is it no. 5? Yes.": "Is it no. 5?",
    "a  b\n c. D": "a  b\n c.",
    "Wait... Mr. X": "Wait...",
    "": "",
    None: "",
}


def test_first_sentence_by_tables_and_its_oracle(spark):
    import duckdb

    from viewpoint.plans import sqltext

    texts = list(SENTENCES) + EDGE
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(T.first_sentence_by_tables("t")).collect()]
    assert got[: len(SENTENCES)] == list(SENTENCES.values())
    rows = ", ".join(f"({i}, {'NULL' if t is None else sqltext.q(t)})" for i, t in enumerate(texts))
    sql = f"SELECT {sqltext.first_sentence_by_tables('t')} FROM (VALUES {rows}) AS v(i, t) ORDER BY i"
    assert got == [r[0] for r in duckdb.sql(sql).fetchall()]


def test_without_tables_the_first_sentence_is_the_plain_rule(spark):
    df = spark.createDataFrame([(t,) for t in [*SENTENCES, *EDGE]], "t string")
    plain, by_tables = T.first_sentence("t"), T.first_sentence_by_tables("t", [], [], initials=False)
    assert [r for r in df.select(plain, by_tables).collect() if r[0] != r[1]] == []


def test_heads_are_found_one_by_one_as_by_windows(monkeypatch):
    heads = ["", "ab", "b c", "xyz", "\u00e9a", "ab", "c" * 30]
    for text in ("ab c\u00e9a", "", None, "c" * 31, "xy zab"):
        few = T.contained(heads, text).tolist()
        monkeypatch.setattr(T, "SEARCHED", -1)
        assert few == T.contained(heads, text).tolist() == [text is not None and h in text for h in heads]
        monkeypatch.undo()
