"""Token counts by the whole-token shortcut.

A byte-level BPE splits a text into pre-tokens and merges each one alone. ``prove_whole_tokens`` finds,
once and offline, the vocabulary strings that the library itself encodes as one pre-token and one id. While
counting, a pre-token in that table counts 1 by one hash lookup; only the rest is merged by the library.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.llm.shared import per_worker

#: The pre-token pattern of this tokenizer family, with Unicode White_Space written out. The
#: alternatives start with different characters, so that their order is free: words stand first.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PRE_TOKEN = " ?[{L}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"
#: Merged rests kept by one task; beyond it the memory starts anew.
CACHE_ROWS = 400_000


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte, inverted."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(hidden)}


def prove_whole_tokens(tokenizer_path: str) -> frozenset[str]:
    """Vocabulary strings that encode alone as exactly one pre-token and one id.

    The size is bounded by the vocabulary (50,257 entries here), whatever the corpus.
    """
    from tokenizers import Tokenizer

    tokenizer, letters = Tokenizer.from_file(tokenizer_path), byte_letters()
    special = {x["content"] for x in json.loads(tokenizer.to_str())["added_tokens"]}
    texts = []
    for piece in tokenizer.get_vocab():
        if piece in special or any(c not in letters for c in piece):
            continue
        try:
            texts.append(bytes(letters[c] for c in piece).decode())
        except UnicodeDecodeError:  # part of a character: no text holds it alone
            continue
    encoded = tokenizer.encode_batch(texts, add_special_tokens=False)
    return frozenset(
        text for text, e in zip(texts, encoded, strict=True) if len(e.ids) == 1 and len(tokenizer.pre_tokenizer.pre_tokenize_str(text)) == 1
    )


def pre_token_finders():
    """Two equal finders of pre-tokens: for texts of the basic plane, with the letters and numbers spelt out as
    ranges (twice as fast), and for any text."""
    import regex

    spans = {"L": [], "N": []}
    for kind, codes in groupby(range(0x10000), lambda c: unicodedata.category(chr(c))[0]):
        if kind in spans:
            codes = list(codes)
            spans[kind].append(f"\\u{codes[0]:04x}-\\u{codes[-1]:04x}")
    basic = re.compile(PRE_TOKEN.format(S=SPACE, **{k: "".join(v) for k, v in spans.items()}))
    return basic.findall, regex.compile(PRE_TOKEN.format(S=SPACE, L="\\p{L}", N="\\p{N}")).findall


class _Counts(dict):
    """Ids per pre-token; a missing one is merged by the library and remembered within a bound."""

    def __init__(self, whole: frozenset[str], tokenizer) -> None:
        super().__init__(dict.fromkeys(whole, 1))
        self.merge, self.limit = tokenizer.model.tokenize, len(self) + CACHE_ROWS
        self.letters = {b: c for c, b in byte_letters().items()}

    def __missing__(self, piece: str) -> int:
        n = len(self.merge("".join([self.letters[b] for b in piece.encode()])))
        if len(self) >= self.limit:
            for old in [k for k, _ in zip(reversed(self), range(CACHE_ROWS), strict=False)]:
                del self[old]
        self[piece] = n
        return n


def token_counter(tokenizer_path: str, whole: frozenset[str]):
    """A function from a text to its number of tokens."""
    import regex
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path)
    basic, general = pre_token_finders()
    special = sorted((x["content"] for x in json.loads(tokenizer.to_str())["added_tokens"]), key=len, reverse=True)
    cut = regex.compile("|".join(map(regex.escape, special))) if special else None
    counts = _Counts(whole, tokenizer)

    def count(text: str | None) -> int:
        if not text:
            return 0
        find = basic if text.isascii() or max(text) <= "\uffff" else general
        parts = [text] if cut is None or not any(s in text for s in special) else cut.split(text)
        return sum(sum(map(counts.__getitem__, find(part))) for part in parts) + len(parts) - 1

    return count


def count_tokens(docs: DataFrame, tokenizer_path: str, *, text_col: str = "text", limit: int = 1024, prefix: str = "") -> DataFrame:
    """Adds ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) to ``docs``.

    Null and empty texts count 0 bytes and 0 tokens; repeated rows are counted each; an empty table stays
    empty. Strings of special tokens inside a text count as that one token, as the library does by default.
    Where ``docs`` already has columns of these names, give a ``prefix`` for the new ones: they are replaced otherwise.
    """
    whole = docs.sparkSession.sparkContext.broadcast(prove_whole_tokens(tokenizer_path))

    @F.pandas_udf("long")
    def n_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = per_worker(("token-counts", tokenizer_path), lambda: token_counter(tokenizer_path, whole.value))
        for texts in batches:
            yield pd.Series([count(t) for t in texts], dtype="int64")

    out = docs.withColumns(
        {
            f"{prefix}n_bytes": F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long"),
            f"{prefix}n_tokens": n_tokens(F.col(text_col)),
        }
    )
    return out.withColumn(f"{prefix}over_limit", F.col(f"{prefix}n_tokens") > limit)
