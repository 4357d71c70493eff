import pytest

from viewpoint.sources import runs

BY = ["model", "exp"]


def _df(spark, rows):
    return spark.createDataFrame(rows, "model string, row_id long, exp string, pred string")


def _read(spark, path):
    return sorted(map(tuple, runs.read_runs(spark, path, BY).select("model", "exp", "row_id", "pred").collect()), key=repr)


def test_a_run_replaces_its_partitions_and_no_others(spark, tmp_path):
    path = str(tmp_path / "t")
    assert runs.committed(spark, path, BY).collect() == []
    runs.write_run(_df(spark, [("007", 1, "a", "x"), ("007", 2, "a", "y"), ("m", 1, "b", "z"), (None, 1, "b", "n")]), path, BY)
    runs.write_run(_df(spark, [("007", 1, "a", "new"), ("m", 1, "c", "w")]), path, BY)
    assert _read(spark, path) == sorted([("007", "a", 1, "new"), ("m", "b", 1, "z"), ("m", "c", 1, "w"), (None, "b", 1, "n")], key=repr)


@pytest.mark.parametrize("where", ["_publish", "write"])
def test_a_writer_that_dies_leaves_the_old_rows(spark, tmp_path, monkeypatch, where):
    path = str(tmp_path / "t")
    runs.write_run(_df(spark, [("m", 1, "a", "old")]), path, BY)
    new = _df(spark, [("m", 1, "a", "new"), ("m", 1, "b", "new")])
    if where == "_publish":  # all files are there, the manifest is not
        monkeypatch.setattr(runs, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            runs.write_run(new, path, BY)
        monkeypatch.undo()
    else:  # some files are there
        new.limit(1).write.partitionBy(*BY).parquet(f"{path}/data/run=99999999999999999999-dead")
    assert _read(spark, path) == [("m", "a", 1, "old")]
    assert [tuple(r) for r in runs.pending(new, path, BY).select(*BY).collect()] == [("m", "b")]
    runs.write_run(runs.pending(new, path, BY), path, BY)
    assert _read(spark, path) == [("m", "a", 1, "old"), ("m", "b", 1, "new")]
    assert runs.pending(new, path, BY).count() == 0


def test_two_writers_of_different_experiments_both_survive(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    path = str(tmp_path / "t")
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda e: runs.write_run(_df(spark, [("m", i, e, e) for i in range(3)]), path, BY), ["a", "b"]))
    assert _read(spark, path) == [("m", e, i, e) for e in "ab" for i in range(3)]


def test_columns_of_the_latest_run_and_an_empty_run(spark, tmp_path):
    path = str(tmp_path / "t")
    runs.write_run(spark.createDataFrame([("m", 1, "a")], "model string, row_id long, exp string"), path, BY)
    runs.write_run(_df(spark, [("m", 1, "b", "x")]), path, BY)
    runs.write_run(_df(spark, []), path, BY)
    assert _read(spark, path) == [("m", "a", 1, None), ("m", "b", 1, "x")]
