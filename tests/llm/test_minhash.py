import random
import re

import pytest

from tests.llm.helpers import components, rows, text
from viewpoint.llm import minhash
from viewpoint.llm.common import components as spark_components

OUT = ("doc_id", "n_shingles", "component_id", "kept")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(s):
    words = re.findall(r"[^\x20\x09-\x0D]+", (s or "").translate(LOWER))
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute(docs):
    sets = {}
    for i, s in docs:
        sets.setdefault(i, []).append(shingles(s))
    ids = sorted(sets)
    near = lambda x, y: x and y and 100 * len(x & y) >= 75 * len(x | y)
    links = [(a, b) for a in ids for b in ids if a < b and any(near(x, y) for x in sets[a] for y in sets[b])]
    comp = components(ids, links)
    return sorted(((i, max(map(len, sets[i])), comp[i], comp[i] == i) for i in ids), key=repr)


def run(spark, docs):
    return rows(minhash.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string")), *OUT)


def random_docs(seed):
    rng = random.Random(seed)
    bases = [text(rng, rng.choice([3, 5, 8, 30, 60, 150])) for _ in range(25)]
    docs = []
    for i in range(140):
        words = rng.choice(bases).split(" ")
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            words[rng.randrange(len(words))] = rng.choice(["x", "y", "z"])
        docs.append((i, " ".join(words)))
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force_on_mutated_copies(spark, seed):
    docs = random_docs(seed)
    assert run(spark, docs) == brute(docs)


def test_the_threshold_itself_is_a_link_and_the_next_value_is_not(spark):
    # 104 words make 100 shingles; dropping words at the end keeps the set inside.
    words = [f"a{i}" for i in range(104)]
    docs = [(1, " ".join(words)), (2, " ".join(words[:79])), (3, " ".join(words[:78]))]
    got = {r[0]: r for r in run(spark, docs)}
    assert got[2][2] == 1 and got == {r[0]: r for r in brute(docs)}
    assert {r[0]: r[2] for r in run(spark, [docs[0], docs[2]])} == {1: 1, 3: 3}


def test_nulls_empty_and_short_texts_case_and_white_space(spark):
    docs = [
        (1, None), (2, ""), (3, " \t\n\x0b\x0c\r"), (4, "one two"), (5, "ONE  two\n"), (6, "one two three four five six"),
        (7, "One\tTWO three four five six"), (8, "one two"), (9, "Été a b c d"), (10, "été a b c d"), (11, "one two"), (11, "one two"),
    ]
    assert run(spark, docs) == brute(docs)


def test_long_text_repeated_ids_null_ids_and_clashing_columns(spark):
    rng = random.Random(3)
    long = text(rng, 60_000)
    docs = [(5, long), (6, long + " end"), (7, "a b c d e f g"), (7, long), (9, "a b c d e f g"), (None, long)]
    df = spark.createDataFrame([(*d, 1, 2, 3) for d in docs], "doc_id bigint, text string, n_shingles int, component_id int, kept int")
    assert rows(minhash.near_duplicates(df), *OUT) == brute([d for d in docs if d[0] is not None])


def test_empty_table(spark):
    df = minhash.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string"))
    assert df.collect() == [] and tuple(df.columns) == OUT


def test_large_group_of_near_copies_is_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)
    docs = random_docs(9)
    assert run(spark, docs) == brute(docs)


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(0, 60)]
    star = [(100, i) for i in range(101, 160)]
    got = {r["node"]: r["component_id"] for r in spark_components(spark.createDataFrame(chain + star, "src bigint, dst bigint")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)}


def test_long_words_of_one_polynomial_hash_are_told_apart(spark):
    """abbabaab... and its complement agree in every polynomial modulo 2 ** 64."""
    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a
    df = spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df).collect()}
    assert got == {1: 1, 2: 2, 3: 1}
