"""The registered queries: their SQL, their columns and the contracts of those without SQL."""

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from tests.llm import test_alignment, test_bpe, test_suffix
from tests.llm.helpers import rows
from viewpoint.llm import queries

TABLES = ("documents", "embeddings", "conversations", "labels")


@pytest.fixture(scope="module")
def duck(small_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small_dir}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, duck, small_dir, name):
    df = queries.QUERIES[name](spark, small_dir)
    cur = duck.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df, *columns) == sorted(cur.fetchall(), key=repr)


def documents(duck):
    return duck.execute("SELECT doc_id, text FROM documents").fetchall()


def test_op7_matches_brute_force_on_the_table(spark, duck, small_dir):
    assert rows(queries.op7_suffix_dedup(spark, small_dir), *test_suffix.OUT) == test_suffix.brute(documents(duck))


def test_op9_matches_the_library_on_the_table(spark, duck, small_dir):
    want = []
    for i, s in documents(duck):
        ids, decoded = test_bpe.expected(s)
        want.append((i, len(ids), test_bpe.digest(np.array(ids, dtype="<u4").tobytes()), test_bpe.digest(decoded.encode())))
    got = rows(queries.op9_bpe(spark, small_dir), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert got == sorted(want, key=repr)


def test_op11_matches_the_library_on_the_table(spark, duck, small_dir):
    want = [(i, len((s or "").encode()), n := len(test_bpe.expected(s)[0]), n > 512) for i, s in documents(duck)]
    assert rows(queries.op11_token_counts(spark, small_dir), "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=repr)


def test_op13_matches_brute_force_on_short_texts_of_the_table(spark, duck, small_dir):
    """Brute force compares all token pairs of a text, so texts of up to 3,000 bytes take part."""
    data = [(i, s) for i, s in documents(duck) if len((s or "").encode()) <= 3000]
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    assert rows(test_alignment.alignment.align_tokenizers(df, test_alignment.A, test_alignment.B), *test_alignment.NAMES) == test_alignment.brute(data)


def test_one_query_for_each_operator_and_the_pipeline():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14))
    assert "pipeline" in entry.queries() and set(queries.ORACLE_SQL) <= set(entry.oracle_sql())
