import csv
import io as stdio
import random

import pandas as pd
import pytest

from viewpoint.sources import csvparts, io

SPLIT = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")


@pytest.fixture
def blocks_of(spark, monkeypatch):
    """Sets the bytes of a block, so that files are cut at any place. Written tables
    would be read in such blocks, too, so they are kept as rows here."""
    old = {k: spark.conf.get(k) for k in SPLIT}
    monkeypatch.setattr(csvparts, "materialize", lambda df, name: spark.createDataFrame(df.collect(), df.schema).coalesce(1))

    def set_(n):
        spark.conf.set(SPLIT[0], str(n))
        spark.conf.set(SPLIT[1], "1")

    yield set_
    for k, v in old.items():
        spark.conf.set(k, v)


def _field(rng):
    return rng.choice(["", "a", "plain text", 'say "hi"', "line\nbreak", "\n\n", '"', '""\n"', "comma, comma", "ü中\U0001f600\n", " pad ", "x" * 40])


def _table(rng, n, width):
    return pd.DataFrame({f"c{i}": [_field(rng) for _ in range(n)] for i in range(width)})


def _rows(spark, path):
    cells, width = csvparts.csv_cells(csvparts.csv_records(spark, path)[0])
    got = {}
    for r in cells.collect():
        got.setdefault(r["file"].rsplit("/", 1)[-1], {})[r["at"]] = r["cells"]
    return {f: [rows[i] for i in range(len(rows))] for f, rows in got.items()}, width


def _want(text):
    rows = [r for r in csv.reader(stdio.StringIO(text.replace("\r\n", "\n"), newline="")) if r]
    return [[c or None for c in r] for r in rows[1:]]


@pytest.mark.parametrize("size", [5, 64, 1 << 20])
def test_a_file_cut_at_any_byte_gives_the_same_rows(spark, blocks_of, tmp_path, size):
    rng = random.Random(size)
    texts = {}
    for name, end in (("unix.csv", "\n"), ("dos.csv", "\r\n")):
        text = _table(rng, 4 if size < 7 else 25, 3).to_csv(index=False, lineterminator=end)
        texts[name] = text + end * 2 if end == "\n" else text
        (tmp_path / name).write_bytes(texts[name].encode())
    blocks_of(size)
    got, width = _rows(spark, str(tmp_path))
    assert width == 3
    assert got == {name: _want(text) for name, text in texts.items()}


@pytest.mark.parametrize("limit", [0, 1 << 18])
def test_states_by_join_and_by_broadcast_give_the_same_records(spark, blocks_of, tmp_path, limit):
    text = _table(random.Random(5), 20, 2).to_csv(index=False)
    (tmp_path / "t.csv").write_text(text)
    blocks_of(40)
    records, files = csvparts.csv_records(spark, str(tmp_path), broadcast_blocks=limit)
    got = [r["text"] for r in records.orderBy("record").collect()]
    assert files.first()["n"] == len(got) == 21
    assert [[c or None for c in next(csv.reader(stdio.StringIO(t, newline="")))] for t in got[1:]] == _want(text)


def test_two_hundred_columns_keep_their_last_one(spark, tmp_path):
    names = [f"x{i}" for i in range(199)] + ["alt_op"]
    pd.DataFrame([[f"{n} {i}" for n in names] for i in range(3)], columns=names).to_csv(tmp_path / "t.csv", index=False)
    got = io.read_topics_csv(spark, str(tmp_path / "t.csv")).orderBy("row_id").collect()
    assert [r["alt_op"] for r in got] == ["alt_op 0", "alt_op 1", "alt_op 2"]


def test_row_ids_do_not_depend_on_the_blocks(spark, blocks_of, tmp_path):
    rng = random.Random(9)
    for m in ("a", "b"):
        (tmp_path / m).mkdir()
        pd.DataFrame({"title": [f"{m}{i}" for i in range(12)], "mp_left_pred": [_field(rng) + "." for _ in range(12)]}).to_csv(tmp_path / m / "preds.csv", index=False)
    seen = []
    for size in (40, 1 << 20):
        blocks_of(size)
        seen.append(sorted((r["model"], r["row_id"], r["title"], r["mp_left_pred"]) for r in io.read_model_files(spark, str(tmp_path)).collect()))
    assert seen[0] == seen[1] and [r[1:3] for r in seen[0][:12]] == [(i, f"a{i}") for i in range(12)]


def test_empty_files_headers_only_and_a_quote_that_never_closes(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "header.csv").write_text("a,b\n")
    assert _rows(spark, str(tmp_path)) == ({}, 2)
    (tmp_path / "open.csv").write_text('a,b\n1,2\n3,"x\ny,z\n')
    assert _rows(spark, str(tmp_path))[0]["open.csv"][0] == ["1", "2"]
    assert len(_rows(spark, str(tmp_path))[0]["open.csv"]) == 2
