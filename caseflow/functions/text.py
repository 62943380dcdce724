"""Column functions on text: cleaning, content addresses, tokens and names. All are built-in expressions unless a docstring says otherwise."""

from __future__ import annotations

import unicodedata
import uuid

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed value: the namespace of phrase point ids.
POINT_NAMESPACE = uuid.UUID("9a528e10-4f51-4d37-9759-38b71d607f2c")


@F.pandas_udf(StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.str.normalize("NFC")


@F.pandas_udf(StringType())
def _casefold(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t).casefold(), na_action="ignore")


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def strip_long(c: Column) -> Column:
    """``strip`` for long texts: the pattern goes over those alone that begin or end with white space."""
    end = lambda t, at: F.substring(t, at, 1).rlike(r"(?U)\s")
    return F.element_at(F.transform(F.array(c), lambda t: F.when(end(t, 1) | end(t, -1), strip(t)).otherwise(t)), 1)


def nfc_strip(c: Column) -> Column:
    """Stripped and in NFC; plain ASCII never leaves the JVM."""
    return F.when(c.rlike(r"^[\x00-\x7F]*$"), strip(c)).otherwise(_nfc(strip(c)))


def normalize_name(c: Column) -> Column:
    """NFC, case-folded, stripped, white space collapsed."""
    return collapse_spaces(strip(_casefold(c)))


def collapse_spaces(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", " ")


def clean_identifier(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", "")


def content_hash(*parts: Column) -> Column:
    """SHA-256 of the compact JSON array of the parts."""
    return F.sha2(F.to_json(F.array(*parts)), 256)


def point_id(digest: Column) -> Column:
    """UUIDv5 of a content hash in the phrase namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(POINT_NAMESPACE.hex)), F.encode(digest, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def canonical_hash(**fields: Column) -> Column:
    """SHA-256 of compact JSON with sorted keys; null fields are left out."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)])), 256)


def max_page_number(html: Column, *, pattern: str = r"movePage\((\d+)\)") -> Column:
    """The largest number of a page's links, 1 if there is none."""
    pages = F.transform(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)), lambda p: p.cast("int"))
    return F.coalesce(F.array_max(pages), F.lit(1))


def split_full_name(c: Column) -> Column:
    """(surname, given): first token and the rest; a single token is the given name."""
    parts = F.split(strip(c), r"(?U)\s+")
    several = F.size(parts) > 1
    return F.struct(F.when(several, parts[0]).otherwise("").alias("surname"), F.when(several, F.array_join(F.slice(parts, 2, 1000), " ")).otherwise(parts[0]).alias("given"))


def parse_iso_date(c: Column) -> Column:
    """A strict YYYY-MM-DD date, null otherwise."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd"))


def compact_text(c: Column) -> Column:
    """Letters and numbers only, in small letters."""
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))


def tokens_present(text: Column, tokens: Column) -> Column:
    """Whether every token occurs in the text."""
    return F.forall(tokens, lambda t: F.contains(text, t))


def sanitize_text(c: Column) -> Column:
    """Prompt-injection patterns become a blank; runs of blank lines and blanks collapse."""
    #: The pattern families.
    patterns = [
        r"```[\s\S]*?```",
        r"(?i)\[INST\][\s\S]*?\[/INST\]",
        r"(?i)<<SYS>>[\s\S]*?<</SYS>>",
        r"(?m)^\s*---+\s*$",
        r"(?im)(?:^|\n)\s*(?:SYSTEM|ASSISTANT|USER|HUMAN|AI)\s*[:\|>]",
        r"(?i)ignore\s+(?:all\s+)?(?:previous|above|prior)\s+(?:instructions?|context|prompt)",
    ]
    for pattern in patterns:
        c = F.regexp_replace(c, pattern, " ")
    return strip(F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), r"[ \t]{2,}", " "))


def public_status(c: Column) -> Column:
    """The status shown outside: known ones but IN_PROGRESS as they are, all else DRAFT."""
    shown = ["DRAFT", "NEEDS_INFO", "READY_FOR_REVIEW", "APPROVED", "WAITING_WORKER", "WAITING_EXTERNAL", "COMPLETED", "CANCELLED"]
    return F.when(c.isin(*shown), c).otherwise("DRAFT")
