import random

from tests.llm.helpers import rows
from viewpoint.llm import lines

OUT = ("doc_id", "text", "n_lines", "n_removed")


def brute(docs):
    first, out = {}, []
    order = sorted(docs, key=lambda d: d[0])
    split = {i: (None if s is None else s.split("\n")) for i, s in order}
    for i, ls in split.items():
        for p in range(len(ls or ()) - 2):
            first.setdefault(tuple(ls[p : p + 3]), (i, p))
    for i, ls in split.items():
        gone = {p + d for p in range(len(ls or ()) - 2) if first[tuple(ls[p : p + 3])] != (i, p) for d in range(3)}
        kept = None if ls is None else "\n".join(x for p, x in enumerate(ls) if p not in gone)
        out.append((i, kept, len(ls or ()), len(gone)))
    return sorted(out, key=repr)


def run(spark, docs):
    return rows(lines.dedup_lines(spark.createDataFrame(docs, "doc_id bigint, text string")), *OUT)


def test_equals_brute_force_on_few_distinct_lines(spark):
    rng = random.Random(1)
    docs = [(i, "\n".join(rng.choice("abcdefg") for _ in range(rng.randrange(0, 25)))) for i in range(80)]
    assert run(spark, docs) == brute(docs)


def test_footers_go_and_the_first_stays(spark):
    docs = [(i, f"own {i}\nx {i}\nshare\nimprint\nprivacy") for i in range(5)]
    assert run(spark, docs) == [(0, docs[0][1], 5, 0)] + [(i, f"own {i}\nx {i}", 5, 3) for i in range(1, 5)]


def test_runs_within_one_document_overlap(spark):
    docs = [(1, "a\n" * 9 + "a"), (2, "a\na\na"), (3, "a\na")]
    assert run(spark, docs) == brute(docs)


def test_null_empty_short_long_and_line_ends(spark):
    docs = [(1, None), (2, ""), (3, "\n\n"), (4, "\n\n\n"), (5, "a\r\nb\nc"), (6, "a\nb\nc"), (7, "a\r\nb\nc\n"), (8, "\n".join(str(i % 5000) for i in range(20_000)))]
    assert run(spark, docs) == brute(docs)


def test_repeated_rows_null_ids_and_extra_columns(spark):
    t = "a\nb\nc\nd"
    data = [(1, t, 7, "k"), (1, t, 7, "k"), (2, t + "\ne", 7, "k"), (None, t, 7, "k")]
    out = lines.dedup_lines(spark.createDataFrame(data, "doc_id bigint, text string, n_removed int, pos string"))
    assert out.columns == ["doc_id", "text", "pos", "n_lines", "n_removed"]
    got = rows(out, "doc_id", "text", "n_removed")
    assert got == sorted([(1, "", 4), (1, "", 4), (2, "e", 4), (None, t, 0)], key=repr)


def test_rows_that_repeat_without_another_copy_lose_nothing(spark):
    assert rows(lines.dedup_lines(spark.createDataFrame([(1, "a\nb\nc"), (1, "a\nb\nc")], "doc_id bigint, text string")), "n_removed") == [(0,), (0,)]


def test_empty_table(spark):
    assert run(spark, []) == []


def test_rows_of_one_id_with_other_texts_lose_only_their_own_repeats(spark):
    data = [(0, "s1\ns2\ns3\ns4"), (1, "u1\nu2\nu3\nu4\nu5"), (1, "s1\ns2\ns3\ns4"), (1, "x\ns2\ns3\ns4\ny")]
    df = spark.createDataFrame([(*d, 1, 2, 3) for d in data], "doc_id long, text string, _dup int, _lines int, _kept int")
    got = lines.dedup_lines(df)
    assert got.columns == ["doc_id", "text", "_dup", "_lines", "_kept", "n_lines", "n_removed"]
    want = [(0, "s1\ns2\ns3\ns4", 4, 0), (1, "u1\nu2\nu3\nu4\nu5", 5, 0), (1, "", 4, 4), (1, "x\ny", 5, 3)]
    assert sorted(map(tuple, got.drop("_dup", "_lines", "_kept").collect())) == sorted(want)
    assert got.where("_dup = 1 and _lines = 2 and _kept = 3").count() == 4
