import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from viewpoint.llm import bpe  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = tokenizers.Tokenizer.from_file(PATH)
LIBRARY.no_truncation()
LIBRARY.no_padding()
TEXTS = [
    "", " ", "\n\n \t x", "Hello world, it's 2024!", "don't WE'LL they've I'm", "é中文\U0001f600\U0001f1e9\U0001f1ea", "a" * 5000, " " * 700,
    "x<|endoftext|>y <|endoftext|>", "<|endoftext|", "   ​ mixed\r\nlines", "\x00\x01\x7f", "١٢٣ ½ Ⅷ", "नमस्ते", "ﷺ é",
]


def expected(s):
    ids = LIBRARY.encode(s or "", add_special_tokens=False).ids
    return ids, LIBRARY.decode(ids, skip_special_tokens=False)


def digest(b):
    return hashlib.sha256(b).hexdigest()


@pytest.mark.parametrize("s", TEXTS)
def test_same_ids_and_text_as_the_library(s):
    c = bpe.codec(PATH)
    ids, decoded = expected(s)
    assert c.encode(s).tolist() == ids
    assert c.decode(np.array(ids, dtype="<u4")) == decoded == s


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_same_on_any_text(s):
    c = bpe.codec(PATH)
    assert c.encode(s).tolist() == expected(s)[0]
    assert c.decode(c.encode(s)) == s


def test_broken_sequences_decode_as_the_library_does():
    c, rng = bpe.codec(PATH), random.Random(1)
    ids = LIBRARY.encode("é中文\U0001f600 नमस्ते ﷺ" * 5, add_special_tokens=False).ids
    for _ in range(200):
        some = [i for i in ids if rng.random() < 0.7]
        assert c.decode(np.array(some, dtype="<u4")) == LIBRARY.decode(some, skip_special_tokens=False)


def test_a_small_memory_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 3)
    c = bpe.BytePairCodec(PATH)
    s = "one two three four five six one two three seven eight nine one " * 20
    assert c.encode(s).tolist() == expected(s)[0]


def test_table_with_nulls_long_texts_repeated_rows_and_clashing_columns(spark):
    rng = random.Random(2)
    long = " ".join(rng.choice(["wörter", "and", "12345", "naïve,", "\n"]) + str(rng.randrange(10**6)) for _ in range(40_000))
    data = [(i, s) for i, s in enumerate(TEXTS)] + [(100, None), (100, None), (None, "x y"), (101, long)]
    df = spark.createDataFrame([(*d, 1, 2) for d in data], "doc_id bigint, text string, ids int, n_tokens int")
    got = bpe.tokenize(df, PATH).collect()
    want = []
    for i, s in data:
        ids, decoded = expected(s)
        want.append((i, len(ids), digest(np.array(ids, dtype="<u4").tobytes()), digest(decoded.encode()), ids, decoded))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_empty_table_and_columns(spark):
    df = bpe.tokenize(spark.createDataFrame([], "doc_id bigint, text string"), PATH, with_ids=False, with_text=False)
    assert df.collect() == [] and df.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_other_kinds_of_files_are_refused(tmp_path):
    import json

    spec = json.load(open(PATH, encoding="utf-8"))
    spec["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "x.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        bpe.BytePairCodec(str(tmp_path / "x.json"))
