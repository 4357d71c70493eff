import math
import random
from collections import Counter

from viewpoint.llm import quality

GOOD = [f"river{i}" for i in range(200)]
BAD = [f"junk{i}" for i in range(200)]


def made(seed, n, labelled):
    """Documents of two vocabularies with an overlap, a part of them labelled."""
    rng = random.Random(seed)
    docs, labels, good = [], [], {}
    for i in range(n):
        good[i] = rng.random() < 0.7
        own, other = (GOOD, BAD) if good[i] else (BAD, GOOD)
        docs.append((i, " ".join(rng.choice(own if rng.random() < 0.9 else other) for _ in range(rng.randrange(30, 300)))))
        if i < labelled:
            labels.append((i, int(good[i] or i % 2), int(not good[i] and i % 2)))  # bad ones are poor or toxic
    return docs, labels, good


def run(spark, docs, labels, **more):
    return quality.classify(
        spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), **more
    ).collect()


def test_held_out_accuracy(spark):
    docs, labels, good = made(1, 1200, 300)
    kept = {r["doc_id"]: r["kept"] for r in run(spark, docs, labels)}
    held_out = [i for i in good if i >= 300]
    assert sum(kept[i] for i in held_out if good[i]) >= 0.95 * sum(good[i] for i in held_out)
    assert sum(kept[i] for i in held_out if not good[i]) <= 0.1 * sum(not good[i] for i in held_out)


def test_the_sample_is_the_gumbel_top_k(spark):
    docs, labels, _ = made(2, 300, 100)
    got = run(spark, docs, labels)
    order = sorted(got, key=lambda r: (-r["key"], r["doc_id"]))
    k = sum(r["kept"] for r in got)
    assert 0 < k < 300 and [r["kept"] for r in order] == [True] * k + [False] * (300 - k)
    assert run(spark, docs, labels) and {r["doc_id"] for r in run(spark, docs, labels) if r["kept"]} == {r["doc_id"] for r in got if r["kept"]}


def test_kth_largest_equals_sorting(spark):
    rng = random.Random(3)
    data = [(i, rng.choice([0.5, rng.gauss(0, 20), float(rng.randrange(-3, 3))])) for i in range(400)] + [(None, 0.5)]
    order = sorted(data, key=lambda r: (-r[1], -(1 << 62) if r[0] is None else r[0]))
    df = spark.createDataFrame(data, "doc_id bigint, key double")
    for k in (1, 2, 57, 200, 401):
        at, who = quality.kth_largest(df, k)
        assert (at, who) == (order[k - 1][1], -(1 << 62) if order[k - 1][0] is None else order[k - 1][0])
    assert quality.kth_largest(df, 402) is None


def test_nulls_empty_long_texts_repeated_rows_and_no_labels(spark):
    docs, labels, _ = made(4, 200, 100)
    extra = [(1000, None), (1001, ""), (1002, " \n"), (None, "river1 river2"), (3, docs[3][1]), (1003, "river5 river9 " * 50_000)]
    got = run(spark, docs + extra, labels + [(None, 1, 0), (5, None, 0), (7, 1, None), (999_999, 1, 0)])
    assert len(got) == len(docs) + len(extra)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add((r["log_weight"], r["kept"]))
    assert all(len(v) == 1 for v in by.values())  # repeated rows get one verdict
    assert [next(iter(by[i]))[0] for i in (1000, 1001, 1002)] == [0.0] * 3
    assert all(r["kept"] for r in run(spark, docs, []))
    assert all(r["kept"] for r in run(spark, docs, [(1, 0, 0), (2, 1, 1)]))  # no target row
    assert run(spark, [], labels) == []


def test_the_fit_on_a_bounded_sample_of_labels(spark):
    _, labels, _ = made(5, 50, 50)
    df = spark.createDataFrame(labels + labels, "doc_id bigint, quality int, toxic int")
    assert quality.labelled_rows(df, 20).count() == 20
    assert quality.labelled_rows(df).count() == 50


def test_clashing_columns(spark):
    docs, labels, _ = made(6, 60, 60)
    df = spark.createDataFrame([(*d, 1.0, "x", True) for d in docs], "doc_id bigint, text string, key double, log_weight string, kept boolean")
    out = quality.classify(df, spark.createDataFrame([(*x, "t") for x in labels], "doc_id bigint, quality int, toxic int, target string"))
    assert out.columns == ["doc_id", "log_weight", "key", "kept"] and out.count() == 60


def by_hand(docs, labels):
    """Log weights from dictionaries of n-grams, window by window."""
    grams = {i: [(w, p) for w, p in zip(t.split(), [*zip(t.split(), t.split()[1:]), None], strict=True)] for i, t in docs}
    flat = {i: [x for g in gs for x in g if x is not None] for i, gs in grams.items()}
    target = {i for i, q, x in labels if q == 1 and x == 0}
    raw, good = Counter(x for f in flat.values() for x in f), Counter(x for i in target for x in flat[i])
    share = sum(good.values()) / sum(raw.values())
    ratio = {x: math.log((good[x] + quality.PRIOR) / (n * share + quality.PRIOR)) for x, n in raw.items()}
    ratio = {x: v if v < quality.NOISE else 0.0 for x, v in ratio.items()} | {None: 0.0}
    out = {}
    for i, gs in grams.items():
        value = [ratio[w] + ratio[p] for w, p in gs]
        if len(value) <= quality.WINDOW:
            out[i] = quality.SCALE * sum(value) / max(len(flat[i]), quality.LEAST)
        else:
            worst = min(sum(value[a : a + quality.WINDOW]) for a in range(len(value) - quality.WINDOW + 1))
            out[i] = quality.SCALE * worst / max(2 * quality.WINDOW, quality.LEAST)
    return out


def test_weights_equal_those_by_hand(spark):
    # Few words, so that no two n-grams share a bucket.
    rng = random.Random(7)
    docs = [(i, " ".join(rng.choice((GOOD if i % 3 else BAD)[:12]) for _ in range(rng.choice([1, 40, 200, 511, 512, 513, 900])))) for i in range(60)]
    labels = [(i, int(i % 3 > 0), 0) for i in range(30)]
    want = by_hand(docs, labels)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(7)
    got = quality.classify(df, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()
    assert min(want.values()) < -5 and all(math.isclose(r["log_weight"], want[r["doc_id"]], rel_tol=1e-5, abs_tol=1e-6) for r in got)


def test_the_length_of_a_text_hides_no_bad_passage(spark):
    rng = random.Random(9)
    docs = [(i, " ".join(rng.choice(GOOD if i % 3 else BAD) for _ in range(rng.randrange(30, 300)))) for i in range(1200)]
    labels = [(i, int(i % 3 > 0), 0) for i in range(600)]
    for k, n in enumerate((300, 3_000, 20_000)):
        for j in range(15):
            words = [rng.choice(GOOD) for _ in range(n)]
            at = rng.randrange(n)
            words[at:at] = [rng.choice(BAD) for _ in range(40)]
            docs.append((10_000 + 100 * k + j, " ".join(words)))
            docs += [(20_000 + 100 * k + 2 * j + x, " ".join(rng.choice(GOOD) for _ in range(n))) for x in (0, 1)]  # two thirds are clean, as among the labelled
    kept = {r["doc_id"]: r["kept"] for r in run(spark, docs, labels)}
    for k in range(3):
        assert not any(kept[10_000 + 100 * k + j] for j in range(15))
        assert sum(kept[20_000 + 100 * k + j] for j in range(30)) >= 28
