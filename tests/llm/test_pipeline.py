import random

import duckdb
import pytest

import corpus_pipeline
from tests.llm import test_bpe, test_lines, test_minhash
from tests.llm.helpers import rows, text
from viewpoint.llm import mixing, quality

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def made():
    rng = random.Random(1)
    docs = [(i, text(rng, rng.randrange(20, 120)), "en", rng.choice(["web", "web", "book"])) for i in range(40)]
    docs += [(100 + i, docs[i][1], "en", "web") for i in range(5)]  # copies
    docs += [(200 + i, f"{text(rng, 30)}\nshare this\nimprint\nprivacy", "en", "web") for i in range(5)]
    docs += [(300, None, None, None), (301, "", "en", "web"), (302, text(rng, 20_000), "en", "book"), (303, "p " * 40, "en", "web")]
    return [(*d, len(d[1] or "")) for d in docs]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(made(), COLUMNS).write.parquet(f"{d}/documents.parquet")
    labels = [(i, int(i % 4 > 0), int(i % 7 == 0)) for i in range(40)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def test_run_equals_the_stages_done_by_hand(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    verdict = {r["doc_id"]: r["kept"] for r in quality.classify(docs, labels).collect()}
    left = [(d[0], d[1]) for d in made() if verdict[d[0]]]
    left = [(i, s) for i, s, _, _ in test_lines.brute(left)]
    kept = {r[0] for r in test_minhash.brute(left) if r[3]}
    want = sorted((i, len(test_bpe.expected(s)[0])) for i, s in left if i in kept)
    assert rows(corpus_pipeline.run(spark, sf_dir), "doc_id", "n_tokens") == sorted(want, key=repr)


def test_stages_keep_the_columns_and_do_what_they_decide(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "minhash_dedup", "mix_sources", "bpe"]
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes), name
    lines = {r["doc_id"]: r for r in corpus_pipeline.line_dedup(spark, docs, sf_dir).collect()}
    assert len(lines) == docs.count() and "privacy" in lines[200]["text"] and "privacy" not in lines[201]["text"]
    assert lines[201]["n_chars"] == len(lines[201]["text"])
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, sf_dir).collect()} == {d[0] for d in made()} - set(range(100, 105))
    mixed = corpus_pipeline.mix_sources(spark, docs, sf_dir)
    assert sorted(r["doc_id"] for r in mixed.collect()) == sorted(d[0] for d in made())


@pytest.mark.parametrize("k", range(5))
def test_every_stage_takes_an_empty_table(spark, sf_dir, k):
    empty = spark.createDataFrame([], COLUMNS)
    assert corpus_pipeline.STAGES[k][1](spark, empty, sf_dir).collect() == []


def test_pipeline_over_the_smallest_tables(spark, small_dir):
    got = corpus_pipeline.run(spark, small_dir)
    con = duckdb.connect()
    every = dict(con.execute(f"SELECT doc_id, text FROM read_parquet('{small_dir}/documents.parquet')").fetchall())
    ids = [r["doc_id"] for r in got.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and set(ids) <= set(every) and len(ids) > len(every) / 3


def test_the_mix_survives_a_reread_of_several_files(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    order = ("slot", "slot_order", "doc_id")
    want = [tuple(r) for r in mixing.mix(docs).orderBy(*order).select(*order).collect()]
    corpus_pipeline.mix_sources(spark, docs, sf_dir).repartition(5, "n_chars").write.parquet(f"{tmp_path}/mixed")
    out = corpus_pipeline.encode(spark, spark.read.parquet(f"{tmp_path}/mixed"), sf_dir)
    assert [tuple(r) for r in out.orderBy(*order).select(*order).collect()] == want and len(want) == len(made())


def test_stages_keep_columns_that_bear_the_operators_names(spark, sf_dir):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = ("slot", "n_lines", "n_removed", "block", "release", "deadline", "slot_order", "kept", "component_id", "_dup")
    docs = docs.withColumns({c: F.lit(90 + i) for i, c in enumerate(names)})
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        assert [tuple(r) for r in out.select(*names).distinct().collect()] == [tuple(range(90, 100))], name


PLACE = ("block", "slot", "release", "deadline", "slot_order")


def through(spark, sf_dir, out, replaced=None):
    """The stages, each written to ``out`` in several files and read again, and what came in at the last two."""
    docs, seen = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = docs
        done = (replaced or {}).get(name, stage)(spark, docs, sf_dir)
        done.repartition(3).write.parquet(f"{out}/{name}")
        docs = spark.read.parquet(f"{out}/{name}")
    return docs, seen


def test_the_whole_mix_of_its_stage_reaches_the_result(spark, sf_dir, tmp_path):
    got, seen = through(spark, sf_dir, tmp_path)
    want = mixing.mix(seen["mix_sources"]).select("doc_id", *PLACE)
    assert rows(got, "doc_id", *PLACE) == rows(want, "doc_id", *PLACE) and got.count() > 20
    assert rows(seen["bpe"], "doc_id", "text") == rows(seen["mix_sources"], "doc_id", "text")
    assert rows(corpus_pipeline.run(spark, sf_dir), "doc_id", *PLACE) == rows(want, "doc_id", *PLACE)


def test_the_result_has_the_mix_of_its_stage_and_no_other(spark, sf_dir, tmp_path):
    got, _ = through(spark, sf_dir, tmp_path, {"mix_sources": lambda spark, docs, sf_dir: docs})
    assert got.count() > 20 and {tuple(r) for r in got.select(*PLACE).distinct().collect()} == {(None,) * 5}
