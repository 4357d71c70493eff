"""Public tokenizers as the token counts and the token alignment use them.

A tokenizer is read once per Python worker. Both kinds know boundaries that no
later and no earlier text can move, so a text may be encoded in parts.
"""

from __future__ import annotations

import json

import numpy as np
import regex

from viewpoint.llm.bpe import PATTERN, byte_symbols

SPACE = "▁"


class ByteLevel:
    """A ``tokenizers`` JSON file of byte-level BPE without normalizer and prefix
    space. Whole texts go through ``tiktoken`` with the file's own vocabulary,
    which gives the same ids several times faster; parts of a text go through
    ``tokenizers``, which tells the pre-token of each id. Files whose merges are not in the order of
    their ids, and those with added tokens that are more than plain strings, are refused."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre, added = spec["model"], spec["pre_tokenizer"], spec["added_tokens"]
        of = {s: bytes([b]) for b, s in enumerate(byte_symbols())}
        special = {t["content"]: t["id"] for t in added}
        vocab = {s: i for s, i in model["vocab"].items() if s not in special}
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        plain = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in added)
        known = model["type"] == "BPE" and pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and not spec["normalizer"]
        if not (known and plain and merged == list(range(256, 256 + len(merged))) and len(vocab) == 256 + len(merged) and len(special) < 2):
            raise ValueError(f"not a byte-level BPE file of the kind that is read here: {path}")
        ranks = {b"".join(of[c] for c in s): i for s, i in vocab.items()}
        self.path = path
        self.fast = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.size = 1 + max([*vocab.values(), *special.values()])
        self.pieces = [b""] * self.size
        for s, i in ranks.items():
            self.pieces[i] = s
        for s, i in special.items():
            self.pieces[i] = s.encode()
        #: Characters before a part's end in which its end may show.
        self.margin = max([4, *map(len, special)])
        self._slow = None

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of whole texts; strings of added tokens become those tokens."""
        return [self.fast.encode(t, allowed_special="all") for t in texts]

    def encode_plain(self, texts: list[str]) -> list[list[int]]:
        """Ids of whole texts; strings of added tokens are ordinary text."""
        return [self.fast.encode_ordinary(t) for t in texts]

    def boundaries(self, part: str, open_end: bool) -> tuple[np.ndarray, np.ndarray, int]:
        """(characters before, tokens before) each pre-token of ``part``, and its tokens.

        The split into added tokens and pre-tokens reads from left to right and never looks
        back, so two readings that start a pre-token at the same character agree from there on.
        With ``open_end`` (the text goes on), starts that the cut may have made are left out."""
        if self._slow is None:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self.path)
            self._slow.no_truncation()
            self._slow.no_padding()
        e = self._slow.encode(part, add_special_tokens=False)
        before = np.flatnonzero(np.diff(np.array(e.word_ids, dtype=np.int64), prepend=-1))
        offsets = e.offsets
        at = np.array([offsets[i][0] for i in before.tolist()], dtype=np.int64)
        if open_end:
            sure = at <= len(part) - self.margin
            at, before = at[sure], before[sure]
        return at, before, len(offsets)


class Pieces:
    """A ``sentencepiece`` BPE model with byte fallback and no other normalisation than the space
    put in front and written as U+2581. No piece may have U+2581 after another character; other models are refused."""

    margin = 0

    def __init__(self, path: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(self.model.serialized_model_proto())
        norm = spec.normalizer_spec
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        kind = spec.trainer_spec.model_type == 2 and spec.trainer_spec.byte_fallback and norm.name == "identity" and not norm.precompiled_charsmap
        kind = kind and norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces
        if not kind or any(p.type == 4 for p in spec.pieces) or any(SPACE in s.lstrip(SPACE) for s in names):
            raise ValueError(f"not a sentencepiece model of the kind that is read here: {path}")
        self.size = len(names)
        byte = [int(s[3:5], 16) if self.model.is_byte(i) else None for i, s in enumerate(names)]
        self.pieces = [s.replace(SPACE, " ").encode() if b is None else bytes([b]) for s, b in zip(names, byte, strict=True)]
        self.lengths = np.array([len(p) for p in self.pieces], dtype=np.int64)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of whole texts."""
        return self.model.encode(texts, num_threads=1)

    encode_plain = encode

    def boundaries(self, part: str, open_end: bool) -> tuple[np.ndarray, np.ndarray, int]:
        """(characters before, tokens before) each space of ``part`` that follows another
        character, and its tokens. No piece crosses such a place, so the merges on
        either side never depend on each other."""
        ids = np.array(self.model.encode(part), dtype=np.int64)
        flat = part.replace(SPACE, " ")
        at = np.array([m.start() for m in regex.finditer(r"(?<=[^ ]) ", flat)], dtype=np.int64)
        data = np.frombuffer(flat.encode(), dtype=np.uint8)
        starts = np.flatnonzero(data & 0xC0 != 0x80)
        ends = np.cumsum(self.lengths[ids]) - 1  # without the space put in front
        return at, np.searchsorted(ends, starts[at], side="right"), len(ids)


_LOADED: dict[str, ByteLevel | Pieces] = {}


def encoder(path: str) -> ByteLevel | Pieces:
    """The tokenizer of ``path`` (.json or .model), read once per Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Pieces(path) if path.endswith(".model") else ByteLevel(path)
    return _LOADED[path]
