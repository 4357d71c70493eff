import hashlib
import random

from tests.llm.helpers import rows, text
from viewpoint.llm import suffix

OUT = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def brute(docs, length=100):
    first, out = {}, []
    data = sorted((i, (s or "").encode()) for i, s in docs)
    for i, b in data:
        for at in range(len(b) - length + 1):
            first.setdefault(b[at : at + length], (i, at))
    for i, b in data:
        gone = bytearray(len(b))
        for at in range(len(b) - length + 1):
            if first[b[at : at + length]] != (i, at):
                gone[at : at + length] = b"\1" * length
        spans = sum(1 for p in range(len(gone)) if gone[p] and (p == 0 or not gone[p - 1]))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def run(spark, docs):
    return rows(suffix.dedup_bytes(spark.createDataFrame(docs, "doc_id bigint, text string")), *OUT)


def test_equals_brute_force_on_shared_passages(spark):
    rng = random.Random(1)
    shared = [text(rng, 40) for _ in range(6)]
    docs = []
    for i in range(60):
        parts = [text(rng, rng.randrange(0, 40)) for _ in range(3)]
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(shared)
            a = rng.randrange(0, 40)
            parts.insert(rng.randrange(len(parts)), p[a : len(p) - rng.randrange(0, 40)])
        docs.append((i, " ".join(parts)))
    assert run(spark, docs) == brute(docs)


def test_lengths_around_the_threshold_runs_and_overlaps(spark):
    rng = random.Random(2)
    a, b = text(rng, 60), text(rng, 60)
    docs = [
        (1, a[:99]), (2, a[:99]), (3, a[:100]), (4, "x" + a[:100]), (5, a[:101] + b), (6, b + a),
        (7, "z" * 99), (8, "z" * 100), (9, "z" * 350), (10, "ab" * 200), (11, "ab" * 51), (12, a + b + a + b),
    ]
    assert run(spark, docs) == brute(docs)


def test_few_letters(spark):
    rng = random.Random(3)
    docs = [(i, "".join(rng.choice("ab") for _ in range(30)) * rng.randrange(1, 12)) for i in range(25)]
    assert run(spark, docs) == brute(docs)


def test_null_empty_multibyte_and_copies(spark):
    p = "é中\U0001f600 " * 40
    docs = [(1, None), (2, ""), (3, p), (4, "q" + p), (5, p), (6, None), (7, "short")]
    assert run(spark, docs) == brute(docs)


def test_common_grams_take_the_aggregated_way(spark, monkeypatch):
    monkeypatch.setattr(suffix, "COMMON", 2)
    rng = random.Random(4)
    core = text(rng, 12)
    docs = [(i, text(rng, 20) + " " + core + " " + text(rng, 20) + core * 3) for i in range(30)]
    assert run(spark, docs) == brute(docs)


def test_repeated_rows_null_ids_kept_text_and_clashing_columns(spark):
    p = text(random.Random(5), 50)
    data = [(1, p, 9, b"x"), (1, p, 9, b"x"), (2, p + "!", 9, b"x"), (None, p, 9, b"x")]
    df = spark.createDataFrame(data, "doc_id bigint, text string, n_bytes int, kept binary")
    got = sorted(((r["doc_id"], bytes(r["kept"]).decode(), r["n_removed"]) for r in suffix.dedup_bytes(df, with_text=True).collect()), key=repr)
    assert got == [(1, p, 0), (1, p, 0), (2, "!", len(p)), (None, p, 0)]


def test_empty_table(spark):
    assert run(spark, []) == []


def test_one_long_text_in_pieces(spark):
    rng = random.Random(6)
    body = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(9_000_000))
    (got,) = run(spark, [(1, body + body[1_000:1_500])])
    assert got[1:4] == (9_000_500, 500, 1)
