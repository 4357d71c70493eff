import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")

from viewpoint.llm import token_counts  # noqa: E402
from viewpoint.llm.encoders import encoder  # noqa: E402

JSON, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
WORDS = ["wörter", "and", "12345", "naïve,", "\n", "  ", "<|endoftext|>", "don't", "中文字", "x" * 40, " \t ", "'re", "▁a", "é", "\U0001f600"]


def library(path):
    if path.endswith(".model"):
        return sentencepiece.SentencePieceProcessor(model_file=path).encode
    tok = tokenizers.Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return lambda t: tok.encode(t, add_special_tokens=False).ids


def texts():
    rng = random.Random(1)
    out = ["", None, "a", "a" * 3000, " " * 2500, "中文" * 1500, "<|endoftext|>" * 300, "ab " * 1500, "x " * 33, "a" * 700 + " b" * 300]
    out += ["".join(rng.choice(WORDS) for _ in range(2000)), " ".join(rng.choice(WORDS) for _ in range(2000))]
    out += ["".join(rng.choice(["a", " ", "'", "s", "\n", "<|endoftext|>", "1", "<|endof"]) for _ in range(rng.randrange(30, 900))) for _ in range(80)]
    return out + out[3:6]


@pytest.mark.parametrize("path", [JSON, MODEL])
@pytest.mark.parametrize(("chunk", "overlap"), [(64, 16), (100, 100), (16, 3)])
def test_same_counts_as_the_library(spark, path, chunk, overlap):
    """Chunks far shorter than words make most seams fail, so overlaps are widened up to the whole text."""
    data = list(enumerate(texts())) + [(5, "x y z" * 20), (None, "no id " * 30)]
    df = spark.createDataFrame([(*d, 7, "c") for d in data], "doc_id bigint, text string, n_tokens int, k1 string")
    got = token_counts.token_counts(df, path, limit=50, chunk=chunk, overlap=overlap)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    count = library(path)
    want = [(i, len((t or "").encode()), n := len(count(t or "")), n > 50) for i, t in data]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("path", [JSON, MODEL])
def test_ids_of_whole_texts_are_the_library_s(path):
    some = [t or "" for t in texts()]
    assert [list(x) for x in encoder(path).encode(some)] == [list(library(path)(t)) for t in some]


@pytest.mark.parametrize("path", [JSON, MODEL])
def test_boundaries_hold_in_any_surroundings(path):
    """Tokens between two proven boundaries of a part are those of the whole text."""
    rng, enc = random.Random(3), encoder(path)
    for text in texts()[10:40]:
        a = rng.randrange(len(text))
        at, before, _ = enc.boundaries(text, False)
        part_at, part_before, _ = enc.boundaries(text[a : a + 400], a + 400 < len(text))
        whole = dict(zip(at.tolist(), before.tolist(), strict=True))
        both = [(whole[p + a], n) for p, n in zip(part_at.tolist(), part_before.tolist(), strict=True) if p + a in whole]
        assert len({x - n for x, n in both}) <= 1


def test_empty_table_and_bad_settings(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert token_counts.token_counts(empty, JSON).collect() == []
    with pytest.raises(ValueError):
        token_counts.token_counts(empty, JSON, chunk=10, overlap=11)
    with pytest.raises(ValueError):
        encoder(public_tokenizers.path("word_bpe_49k.json"))
