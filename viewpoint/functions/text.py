"""Text expressions (Column -> Column), all built-in Spark functions.

The character classes reproduce Python's Unicode ``\\w`` / ``\\s`` with
classes that the JVM regex engine and RE2 read the same way, so the DuckDB
oracle can use the very same patterns.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Python's str.isspace() set, written as a regex class body.
WS_CLASS = "\\t\\n\\x0B\\f\\r\\x1C-\\x1F\\x{85}\\p{Z}"
# Characters that are neither word characters nor whitespace (Python ``[^\w\s]``).
NON_WORD = "[^\\p{L}\\p{N}_" + WS_CLASS + "]"
WS_RUN = "[" + WS_CLASS + "]+"
# First sentence: shortest text up to a run of terminators followed by space or end.
FIRST_SENTENCE = "(?s)^[" + WS_CLASS + "]*(.*?[.!?]+)(?:[" + WS_CLASS + "]|\\z)"
# A word with one full stop at its end, from its first letter or digit; capitals with stops between them.
STOPPED_WORD = "^[^\\p{L}\\p{N}]*(.*[^.!?])\\.\\z"
# Text up to the end of a word that ends in . ! ?, or the rest; the last and the first word of such a piece.
SENTENCE_PIECE = "(?s).*?[.!?](?![^" + WS_CLASS + "])|.+"
LAST_WORD = "(?<![^" + WS_CLASS + "])[^" + WS_CLASS + "]+\\z"
FIRST_WORD = "[^" + WS_CLASS + "]+"
INITIALS = "^(?:\\p{Lu}\\.)*\\p{Lu}\\z"
# Default tables of sentence ends: words whose full stop is part of them, words that start a sentence after one.
ABBREVIATIONS = (
    "dr mr mrs ms prof rev hon gen col lt sgt capt sen rep gov pres st jr sr no vs etc e.g i.e a.m p.m inc corp co ltd dept est "
    "jan feb mar apr jun jul aug sep sept oct nov dec"
).split()
STARTERS = "the he she it they we i this that these those but a an in however there if when what why how".split()
EDGE_WS = "^[" + WS_CLASS + "]+|[" + WS_CLASS + "]+\\z"
# ROUGE tokeniser: lower case, anything but [a-z0-9] separates tokens.
ROUGE_NON_ALNUM = "[^a-z0-9]+"
# Word-tokenizer contractions that split after the third letter.
CONTRACTIONS = ["cannot", "gimme", "gonna", "gotta", "lemme", "wanna"]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize(text) -> Column:
    """``re.sub(r'[^\\w\\s]', '', text.lower())``."""
    return F.regexp_replace(F.lower(_c(text)), NON_WORD, "")


def split_ws(text) -> Column:
    """``re.split(r'\\s+', text)``: keeps leading/trailing empty strings."""
    return F.split(_c(text), WS_RUN)


def word_tokens_of_normalized(norm) -> Column:
    """Word tokens of already-normalised text (only word characters and
    whitespace remain): a native whitespace split without empty strings, then
    the treebank contraction splits ('cannot' -> 'can', 'not', ...)."""
    toks = F.array_remove(F.split(_c(norm), WS_RUN), "")
    return F.flatten(
        F.transform(
            toks,
            lambda t: F.when(t.isin(*CONTRACTIONS), F.array(F.substring(t, 1, 3), F.substring(t, 4, 1 << 20))).otherwise(F.array(t)),
        )
    )


def raw_tokens(text) -> Column:
    """Whitespace tokens of normalised text, before contraction splits."""
    return F.array_remove(F.split(normalize(text), WS_RUN), "")


def contraction_parts(tok) -> Column:
    """One token -> its treebank pieces (two for a contraction, else itself)."""
    t = _c(tok)
    return F.when(t.isin(*CONTRACTIONS), F.array(F.substring(t, 1, 3), F.substring(t, 4, 1 << 20))).otherwise(F.array(t))


def word_tokens(text) -> Column:
    """Tokens of ``word_tokenize(normalize(text))``."""
    return word_tokens_of_normalized(normalize(text))


def token_set(text) -> Column:
    return F.array_distinct(word_tokens(text))


def passage_length(text) -> Column:
    """``len(re.split(r'\\s+', op))`` (empty text has length 1)."""
    return F.size(split_ws(text))


def strip_ws(text) -> Column:
    return F.regexp_replace(_c(text), EDGE_WS, "")


def first_sentence(text) -> Column:
    """First sentence by rule: up to the first run of . ! ? followed by
    whitespace or the end; the stripped whole text when there is none; '' for
    empty text (the reference raises there)."""
    t = F.coalesce(_c(text), F.lit(""))
    hit = F.regexp_extract(t, FIRST_SENTENCE, 1)
    return F.when(hit != F.lit(""), hit).otherwise(strip_ws(t))


def first_sentence_by_tables(text, abbreviations: list[str] = ABBREVIATIONS, starters: list[str] = STARTERS, initials: bool = True) -> Column:
    """First sentence by rule and tables: up to the first word that ends in a run
    of . ! ? and is not held open. Held open is a word with one full stop at its
    end that is an abbreviation (``abbreviations``, lower case, without that stop)
    or, with ``initials``, capital letters with stops between them, unless the next
    word is one that mostly starts a sentence (``starters``, lower case) or there
    is none. Without such an end, the stripped whole text; '' for NULL.

    With empty tables and no initials it is :func:`first_sentence`. The text is cut
    behind every word that ends in . ! or ?, and only these words and their
    successors are looked at, so the cost is linear in the text."""
    t = strip_ws(F.coalesce(_c(text), F.lit("")))
    pieces = F.regexp_extract_all(t, F.lit(SENTENCE_PIECE), F.lit(0))

    def ends(piece: Column, after: Column) -> Column:
        body = F.regexp_extract(F.regexp_extract(piece, LAST_WORD, 0), STOPPED_WORD, 1)
        held = F.lower(body).isin(abbreviations) if abbreviations else F.lit(False)
        held = held | body.rlike(INITIALS) if initials else held
        goes_on = after != F.lit("")
        if starters:
            goes_on = goes_on & ~F.lower(F.regexp_replace(after, "[^\\p{L}]", "")).isin(starters)
        return piece.rlike("[.!?]\\z") & ~(held & goes_on)

    def first(pieces: Column) -> Column:
        following = F.slice(pieces, 2, F.greatest(F.size(pieces), F.lit(1)))
        verdicts = F.zip_with(pieces, following, lambda p, q: ends(p, F.regexp_extract(F.coalesce(q, F.lit("")), FIRST_WORD, 0)))
        n = F.array_position(verdicts, True).cast("int")
        return F.when(n > 0, F.array_join(F.slice(pieces, 1, n), "")).otherwise(F.array_join(pieces, ""))

    # The lambda's variable holds the pieces, so that they are cut once.
    return F.get(F.transform(F.array(pieces), first), 0)


def head_of(passage, prefix_chars: int = 30) -> Column:
    """The normalised head of the lower-cased passage."""
    return F.regexp_replace(F.substring(F.lower(_c(passage)), 1, prefix_chars), NON_WORD, "")


def contained(heads: list[str], text: str | None) -> np.ndarray:
    """Which of ``heads`` lie in ``text``: all windows of the text are hashed, one length
    of heads at a time, and the windows whose hash some head has are compared with
    the heads as strings. Linear in the text for every length, however many heads there are.
    Up to SEARCHED characters in all, one search per head costs less than the arrays."""
    if text is not None and len(heads) * len(text) <= SEARCHED:
        return np.array([h in text for h in heads], dtype=bool)
    out = np.array([text is not None and h == "" for h in heads], dtype=bool)
    lengths: dict[int, dict[str, list[int]]] = {}
    for i, h in enumerate(heads if text else []):
        lengths.setdefault(len(h), {}).setdefault(h, []).append(i)
    lengths.pop(0, None)
    base = np.uint64(_WINDOW_BASE)
    chars = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    windows, length = np.zeros(len(chars) + 1, dtype=np.uint64), 0
    for n, rows_of in sorted(lengths.items()):
        if n > len(chars):
            break
        for k in range(length, n):  # windows[i] becomes the hash of the k + 1 characters from i on
            windows = windows[: len(chars) - k] * base + chars[k:]
        length = n
        hashes = np.unique(np.array([_window_hash(h) for h in rows_of], dtype=np.uint64))
        at = np.minimum(np.searchsorted(hashes, windows), len(hashes) - 1)
        found = {text[i : i + n] for i in np.flatnonzero(hashes[at] == windows).tolist()}
        for h, rows in rows_of.items():
            out[rows] = h in found
    return out


#: Heads times characters up to which heads are searched one by one.
SEARCHED = 1 << 18
_WINDOW_BASE = 0x9E3779B97F4A7C15


def _window_hash(head: str) -> int:
    h = 0
    for c in head:
        h = (h * _WINDOW_BASE + ord(c)) % (1 << 64)
    return h


@F.pandas_udf(ArrayType(StringType()))
def sides_of(heads: pd.Series, norm_left: pd.Series, norm_right: pd.Series) -> pd.Series:
    """:func:`side_of` for all passages of a topic at once, given their :func:`head_of`."""

    def sides(hs, left, right):
        hs = list(hs)
        return np.where(contained(hs, left), "left", np.where(contained(hs, right), "right", "neither")).tolist()

    return pd.Series([sides(*x) for x in zip(heads, norm_left, norm_right)], dtype=object)


def side_of(passage, norm_left, norm_right, prefix_chars: int = 30) -> Column:
    """'left' / 'right' / 'neither': is the normalised head of the lower-cased
    passage contained in the normalised left (tested first) or right source. For one
    passage; :func:`sides_of` takes all passages of a topic."""
    head = head_of(passage, prefix_chars)
    return (
        F.when(F.contains(_c(norm_left), head), F.lit("left"))
        .when(F.contains(_c(norm_right), head), F.lit("right"))
        .otherwise(F.lit("neither"))
    )


def char_set(norm) -> Column:
    """Set of characters of a string (``set(s)``)."""
    return F.array_distinct(F.filter(F.split(_c(norm), ""), lambda c: c != F.lit("")))


def rouge_tokens(text) -> Column:
    """rouge-score default tokenizer, no stemming: lower, non [a-z0-9] runs to
    one space, split, no empty tokens (lambda-free)."""
    spaced = F.regexp_replace(F.lower(F.coalesce(_c(text), F.lit(""))), ROUGE_NON_ALNUM, " ")
    return F.array_remove(F.split(spaced, " "), "")


def lexicon_tokens(text) -> Column:
    """Tokens before lemmatisation for lexicon lookup: 'U.S.' -> 'USA', then
    lower, normalise and tokenize."""
    return word_tokens(F.replace(_c(text), F.lit("U.S."), F.lit("USA")))


def pair_text(text, aspect) -> Column:
    """'[CLS] ' + text + ' [SEP] ' + aspect + ' [SEP]'."""
    return F.concat(F.lit("[CLS] "), _c(text), F.lit(" [SEP] "), _c(aspect), F.lit(" [SEP]"))


def word_count(text) -> Column:
    """Summary length in word tokens (the stand-in for subword counts)."""
    return F.size(word_tokens(text))
