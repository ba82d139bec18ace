"""Text forms: folding, keys and tokens, as Column builders; Arrow UDFs only where the text isn't ASCII."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SPACE = "[\\s\\p{Z}\\x{85}]"
TRIMMED = f"^{SPACE}+|{SPACE}+$"
STOP_WORDS = ("the", "and", "for", "with", "that", "this", "from", "was", "were", "are", "has", "have", "had", "its", "but", "not", "per", "into", "onto", "than", "then", "when", "which", "while", "been", "being", "their")
INNATE_TYPES = ("person", "organization", "place", "event", "object", "concept")
INNATE_RELATIONS = ("partof", "locatedin", "memberof", "relatedto")


def fold_value(s: str | None) -> str | None:
    """NFKC, which also composes jamo and narrows full-width forms."""
    return None if s is None else unicodedata.normalize("NFKC", s)


def jamo(s: str) -> str:
    """Hangul syllables taken apart; everything else as it is."""
    return "".join(unicodedata.normalize("NFD", c) if "가" <= c <= "힣" else c for c in s)


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(fold_value)


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def _ascii(c: Column) -> Column:
    return c.rlike("^[\\x00-\\x7F]*$")


def fold(c: Column) -> Column:
    """The compatibility form; ASCII stays on the JVM (the UDF sees null for it)."""
    return F.coalesce(_nfkc(F.when(~_ascii(c), c)), c)


def canonical(c: Column) -> Column:
    return F.coalesce(_nfc(F.when(~_ascii(c), c)), c)


def trimmed(c: Column) -> Column:
    """Unicode white space off both ends."""
    return F.regexp_replace(c, TRIMMED, "")


def compare_key(c: Column, folded: bool = True) -> Column:
    """The form in which values are compared and blocked; null where nothing is left."""
    x = F.upper(trimmed(fold(c) if folded else c))
    return F.when(x != "", x)


def joined_key(*keys: Column) -> Column:
    """Keys joined by U+001F; null if any is null."""
    missing = keys[0].isNull()
    for k in keys[1:]:
        missing = missing | k.isNull()
    return F.when(~missing, F.concat_ws("\u001f", *keys))


def name_key(c: Column, folded: bool = True) -> Column:
    """Letters and digits alone, lower case: the lenient sameness of type and relation names."""
    return F.lower(F.regexp_replace(fold(c) if folded else c, "[^\\p{L}\\p{Nd}]", ""))


def denotation_text(c: Column) -> Column:
    """Trimmed, runs of white space as one blank, upper case."""
    return F.upper(F.trim(F.regexp_replace(c, f"{SPACE}+", " ")))


def tokens(c: Column) -> Column:
    """Runs of letters, decimal digits and marks, repeats kept."""
    return F.regexp_extract_all(c, F.lit("[\\p{L}\\p{Nd}\\p{Mn}\\p{Mc}]+"), F.lit(0))


def overlap_tokens(c: Column, folded: bool = True) -> Column:
    """Words that carry meaning: three letters or more and no stop word; stretches of CJK letters as their bigrams."""
    text = F.lower(fold(c) if folded else c)
    cjk = "[\\p{IsHan}\\p{IsHangul}\\p{IsHiragana}\\p{IsKatakana}]"
    runs = F.regexp_extract_all(text, F.lit(f"{cjk}+|(?:(?!{cjk})[\\p{{L}}\\p{{Mn}}\\p{{Nd}}])+"), F.lit(0))

    def parts(w: Column) -> Column:
        n = F.length(w)
        bigrams = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(w, i, F.lit(2)))
        word = F.when((n >= 3) & ~w.isin(*STOP_WORDS), F.array(w)).otherwise(F.array().cast("array<string>"))
        return F.when(w.rlike(f"^{cjk}"), F.when(n == 1, F.array(w)).otherwise(bigrams)).otherwise(word)

    return F.flatten(F.transform(runs, parts))


def value_like(c: Column) -> Column:
    """date, number, long or name: whether a name reads like a value."""
    date = c.rlike("^\\d{4}[-/.]\\d{1,2}[-/.]\\d{1,2}$")
    number = c.rlike("^[-+]?\\d+([.,]\\d+)?\\s?[^\\d\\s]{0,4}$") & ~c.rlike("^\\d{5,}$")
    return F.when(date, "date").when(number, "number").when(F.size(F.split(F.trim(c), " +")) >= 6, "long").otherwise("name")


def fingerprint(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 8)


def innate(c: Column, relation: bool = False) -> Column:
    """Whether a type or relation belongs to the built-in vocabulary."""
    return F.when(name_key(c).isin(*(INNATE_RELATIONS if relation else INNATE_TYPES)), "Innate").otherwise("Acquired")


@F.pandas_udf(StringType())
def local_name(s: pd.Series) -> pd.Series:
    """A name as the local part of an IRI: letters, digits, _ and - stay, the rest percent-encoded as UTF-8."""

    def one(x):
        return None if x is None else "".join(c if c.isalnum() or c in "_-" else "".join(f"%{b:02X}" for b in c.encode()) for c in x)

    return s.map(one)
