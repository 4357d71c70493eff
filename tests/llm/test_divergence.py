import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from viewpoint.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(data, least=10, top=10):
    """The contract, densely: every pair of sources over every kept term."""
    docs = [(text or "", lang or "", source or "") for text, lang, source in data]
    out = []
    for lang in {d[1] for d in docs}:
        df, whole, of = Counter(), Counter(), defaultdict(Counter)
        for text, _, source in (d for d in docs if d[1] == lang):
            terms = TERM.findall(text.translate(LOWER))
            df.update(set(terms))
            whole.update(terms)
            of[source].update(terms)
        kept = [t for t in df if df[t] >= least]
        v = len(kept)

        def p(counts):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // (n + 2 * v) for t in kept}

        q, ps = p(whole), {s: p(c) for s, c in of.items()}
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in of:
            pairs = [(sum(f(ps[s][t], ps[o][t]) for t in kept), o) for o in of if o != s]
            terms = [(f(ps[s][t], q[t]), t) for t in kept if of[s][t] and ps[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                items = sorted(items, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, i, x, r) for r, (x, i) in enumerate(items if part == "pair" else items[:top], 1)]
    return sorted(out)


def table(rng, n=160):
    words = ["the", "The", "of", "naïve", "ÉTÉ", "été", "x1y", "中文", "a-b", "don't", "\x00z", "w w", "tie", "eit"]
    data = []
    for _ in range(n):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(0, 30)))
        data.append((text, rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "c", None, "é"])))
    copy = ("the hot text of of of", "en", "a")
    return data + [copy] * 90 + [("the hot text of of of", "en", "b")] * 7 + [(None, "en", "none"), ("", "xx", "only"), (None, None, None), ("123 456", "yy", "p"), ("1", "yy", "q")]


def result(spark, data, **options):
    df = spark.createDataFrame([(i % 7, *d, 1, "x") for i, d in enumerate(data)], "doc_id bigint, text string, lang string, source string, n int, term string").repartition(5)
    got = divergence.source_divergence(df, **options)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(map(tuple, got.collect()))


@pytest.mark.parametrize("least", [1, 10])
def test_same_as_brute_force(spark, least):
    data = table(random.Random(3))
    assert result(spark, data, least=least, top=3) == brute(data, least, 3)


def test_small_tables_of_a_task_change_nothing(spark, monkeypatch):
    data = table(random.Random(4))
    monkeypatch.setattr(divergence, "TEXT_BYTES", 100)
    monkeypatch.setattr(divergence, "ENTRIES", 5)
    assert result(spark, data) == brute(data)


def test_same_as_the_sql(spark):
    data = table(random.Random(5))
    with duckdb.connect() as con:
        con.execute("CREATE TABLE documents (text VARCHAR, lang VARCHAR, source VARCHAR)")
        con.executemany("INSERT INTO documents VALUES (?, ?, ?)", data)
        want = con.execute(f"SELECT lang, source, part, item, value, rank FROM ({divergence.ORACLE_SQL})").fetchall()
    assert result(spark, data) == sorted(want)


def test_large_counts_stay_exact(spark):
    """Counts far beyond 64 bits times 10 ** 9 go through decimals."""
    row = spark.createDataFrame([(9_000_000_000_000, 50_000_000_000_001, 12345)], "n bigint, total bigint, kept bigint")
    want = 1 + 10**9 * (9_000_000_000_000 + 2) // (50_000_000_000_001 + 2 * 12345)
    assert row.select(divergence._share("n", "total")).first()[0] == want


def test_empty_table_and_a_very_long_text(spark):
    assert result(spark, []) == []
    rng = random.Random(6)
    data = [(" ".join(rng.choice(["long", "words", "ü"]) for _ in range(300_000)), "en", "a"), ("long", "en", "b")]
    assert result(spark, data, least=1) == brute(data, 1)
