import os

import pytest

from viewpoint import session


class _Context:
    master, applicationId = "yarn", "app"

    def getConf(self):
        return {}

    def getCheckpointDir(self):
        return None


class _Session:
    sparkContext, conf = _Context(), {}


def test_a_cluster_without_a_shared_folder_is_refused():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(_Session())


def test_a_folder_that_is_set_is_used(tmp_path):
    configured, chosen = _Session(), _Session()
    configured.conf = {"spark.checkpoint.dir": "/shared/configured"}
    chosen.sparkContext = _Context()
    chosen.sparkContext.getCheckpointDir = lambda: "/shared/chosen"
    assert session.ensure_checkpoint_dir(configured) == "/shared/configured"
    assert session.ensure_checkpoint_dir(chosen) == "/shared/chosen"


def test_written_tables_are_read_back_and_can_be_dropped(spark):
    df = session.materialize(spark.range(5), "numbers")
    folder = os.path.join(session.ensure_checkpoint_dir(spark), "tables", spark.sparkContext.applicationId)
    assert df.count() == 5 and any(x.startswith("numbers-") for x in os.listdir(folder))
    assert session.drop_tables(spark) and not os.path.exists(folder)


def test_a_table_kept_for_the_session_is_built_once(spark):
    built = []

    def build(n):
        built.append(n)
        return spark.range(n)

    kept = [session.materialize_once(spark, "kept", s, lambda n=n: build(n)).count() for s, n in (("a", 3), ("a", 4), ("b", 5))]
    assert kept == [3, 3, 5] and built == [3, 5]
    session.drop_tables(spark)
    assert session.materialize_once(spark, "kept", "a", lambda: build(6)).count() == 6


def test_a_written_table_leaves_no_shuffle_files(spark):
    def files():
        every = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
        return {f for f in every.split("\n") if "shuffle_" in f}

    old = spark.conf.get(session.SHUFFLE_CLEANUP, None)
    before = files()
    df = session.materialize(spark.range(1000).selectExpr("id % 7 as k").groupBy("k").count(), "counts")
    assert sorted(r[0] for r in df.collect()) == list(range(7))
    assert files() <= before and spark.conf.get(session.SHUFFLE_CLEANUP, None) == old
