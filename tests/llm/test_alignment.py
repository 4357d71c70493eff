import hashlib
import random
from collections import Counter, defaultdict

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")

from viewpoint.llm import alignment  # noqa: E402
from viewpoint.llm.bpe import byte_symbols  # noqa: E402

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def brute(data):
    """The contract, token by token, with the two libraries."""
    ta = tokenizers.Tokenizer.from_file(A)
    ta.no_truncation()
    ta.no_padding()
    ta.encode_special_tokens = True
    tb = sentencepiece.SentencePieceProcessor(model_file=B)
    of = {s: bytes([b]) for b, s in enumerate(byte_symbols())}

    def bytes_b(i):
        return bytes([int(tb.id_to_piece(i)[3:5], 16)]) if tb.is_byte(i) else tb.id_to_piece(i).replace("▁", " ").encode()

    rows, links = [], []
    for doc_id, text in data:
        a = ta.encode(" " + text, add_special_tokens=False).ids if text else []
        b = tb.encode(text) if text else []
        pa, pb = [b"".join(of[c] for c in ta.id_to_token(i)) for i in a], [bytes_b(i) for i in b]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(pa) != whole or b"".join(pb) != whole:
            a, b, pa, pb = [], [], [], []

        def ends(pieces):
            out, n = [], 0
            for p in pieces:
                n += len(p)
                out.append(n)
            return out

        ea, eb = ends(pa), ends(pb)
        cuts = sorted(set(ea) & set(eb))
        groups, lo = [], 0
        for c in cuts:
            groups.append((",".join(str(i) for i, e in zip(a, ea) if lo < e <= c), ",".join(str(i) for i, e in zip(b, eb) if lo < e <= c)))
            lo = c
        pairs = [(i, j) for i, p, e in zip(a, pa, ea) for j, q, f in zip(b, pb, eb) if e - len(p) < f and f - len(q) < e]
        links.append(pairs)
        text_ = ";".join(f"{x}|{y}" for x, y in groups)
        rows.append([doc_id, len(a), len(b), len(groups), len(pairs), hashlib.sha256(text_.encode()).hexdigest() if a else ""])
    counts = Counter(p for x in links for p in x)
    most = defaultdict(int)
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    return sorted((tuple(r[:5]) + (sum(counts[p] == most[p[1]] for p in x), sum(counts[p] for p in x), r[5]) for r, x in zip(rows, links)), key=repr)


def texts(rng):
    words = ["wörter", "and", "12345", "naïve,", "\n", "  ", "<|endoftext|>", "<s>", "<0x41>", "don't", "中文字", "x" * 40, "\t", "\U0001f600", "tion", "anti", "ﷺ"]
    fixed = ["", None, " ", "a", "a  b", " a ", "a▁b", "▁", "\x00\x01", "the the the", "the the the", "a b " * 60, "中文" * 50, "   x   ", "é" * 9]
    return fixed + ["".join(rng.choice([w, w + " ", " " + w]) for w in (rng.choice(words) for _ in range(rng.randrange(1, 60)))) for _ in range(60)]


@pytest.mark.parametrize(("step", "block"), [(1 << 17, 1 << 20), (20, 50)])
def test_same_as_brute_force(spark, step, block):
    data = list(enumerate(texts(random.Random(5)))) + [(3, "again"), (None, "no id"), (None, None)]
    df = spark.createDataFrame([(*d, 1, "x") for d in data], "doc_id bigint, text string, n_a int, pairs string").repartition(3)
    got = alignment.align_tokenizers(df, A, B, step=step, block=block)
    assert got.columns == NAMES
    assert sorted(map(tuple, got.collect()), key=repr) == brute(data)


def test_long_text_in_parts_equals_the_whole(spark):
    rng = random.Random(6)
    text = "".join(rng.choice(["word ", "naïve  ", "中文", "\n", " ▁"[0] * 3, "x" * 30 + " "]) for _ in range(4000))
    df = spark.createDataFrame([(1, text), (2, text)], "doc_id bigint, text string")
    whole = alignment.align_tokenizers(df, A, B, step=1 << 20).collect()
    assert alignment.align_tokenizers(df, A, B, step=64, block=10).orderBy("doc_id").collect() == sorted(whole)


def test_tables_without_tokens(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert alignment.align_tokenizers(empty, A, B).collect() == []
    df = spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")
    assert sorted(map(tuple, alignment.align_tokenizers(df, A, B).collect())) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_refuses_other_kinds():
    with pytest.raises(ValueError):
        alignment.Aligner(B, A)
    with pytest.raises(ValueError):
        alignment.Aligner(public_tokenizers.path("word_bpe_49k.json"), B)


def test_no_row_on_the_way_holds_more_than_a_document(spark):
    """Spark's readers, writers and batches count rows, so rows that grow with a block take an executor's memory."""
    data = [(i, f"a b c d{i % 50} e f{i % 7}") for i in range(400)]
    df = spark.createDataFrame(data, "doc_id bigint, text string").coalesce(1)
    for name, kind in (blocks := alignment.aligned_blocks(df, A, B)).dtypes:
        if kind.startswith("array"):
            assert max(len(r[0] or ()) for r in blocks.select(name).collect()) <= 40, name
    assert blocks.select("block").distinct().count() == 1
    assert sorted(map(tuple, alignment.align_tokenizers(df, A, B).collect()), key=repr) == brute(data)
