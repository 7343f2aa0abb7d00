"""Problem 4: one canonical form for text that looks alike but differs in characters.

Only *unstable* segments are touched.  A segment is a run of suspect characters
together with the character before it (the base a combining mark may compose
with).  The Unicode quick check (``unicodedata.is_normalized``)
and a class of invisible, wide, ligature and foreign characters tell whether it
is unstable; only such segments are normalised and spliced back between the
untouched stretches of the text.

Kept as they are: ordinal indicators, section signs, fractions, ellipses,
typographic quotes and dashes, the not sign, and words wholly in another script.

Defined results: null stays null, empty and blank texts stay as they are.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

# Letters of other scripts that look like a Latin letter.
CYRILLIC_AND_GREEK = {
    "а": "a", "в": "b", "е": "e", "з": "3", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p",
    "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ѵ": "v",
    "А": "A", "В": "B", "Е": "E", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P",
    "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "Ԛ": "Q", "Ԝ": "W",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X",
}

#: A superset of what may be unstable: everything but ASCII, precomposed Latin
#: letters, Latin-1 signs and general punctuation that shows itself.  Evaluated in the JVM.
SUSPECT = r"[^\x00-\x7F¡-¬®-ıĴ-ľŁ-ňŊ-žƀ-ǃǍ-ǰǴ-ɏ‐-‧‰-⁞₠-₿]"

_SEGMENT = re.compile(f".?{SUSPECT}+", re.S)
_FOREIGN = re.compile("[Ͱ-ԯ]")
_WORD = re.compile(r"[^\W_][^\W_\u0300-\u036f]*(?:[\u0300-\u036f]+[^\W_]*)*")
#: Everything ``_one`` may change; combining marks alone are left to the quick check.
_FOLDABLE = re.compile("[^\x00-\x7f\u00a1-\u00ac\u00ae-\u036f\u0370-\u05ff\u0900-\u10ff]")
_FOLDED_TAGS = ("<wide>", "<narrow>", "<noBreak>", "<font>", "<small>", "<initial>", "<medial>", "<final>", "<isolated>")
_JOINERS = "‌‍"


def _one(ch: str, before: str, after: str) -> str:
    """The plain form of one non-ASCII character."""
    kind = unicodedata.category(ch)
    if kind == "Cf":
        # a joiner between pictographs belongs to the picture
        if ch in _JOINERS and before and after and unicodedata.category(before) == "So" and unicodedata.category(after) == "So":
            return ch
        return ""
    if kind in ("Zs", "Zl", "Zp"):
        return " "
    if "︀" <= ch <= "️" or ch == "͏" or ch == "ㅤ" or ch == "ﾠ":
        return ch if before and unicodedata.category(before) == "So" else ""
    form = unicodedata.decomposition(ch)
    if form.startswith(_FOLDED_TAGS) or "ﬀ" <= ch <= "ﬆ":
        return unicodedata.normalize("NFKC", ch)
    return ch


def _segment(match: re.Match) -> str:
    segment = match.group()
    if not _FOLDABLE.search(segment) and unicodedata.is_normalized("NFC", segment):
        return segment
    text, start = match.string, match.start()
    out = []
    for k, ch in enumerate(segment, start):
        out.append(ch if ch < "\x80" else _one(ch, text[k - 1] if k else "", text[k + 1] if k + 1 < len(text) else ""))
    joined = "".join(out)
    return joined if unicodedata.is_normalized("NFC", joined) else unicodedata.normalize("NFC", joined)


def _latin(ch: str) -> bool:
    return ch < "ɐ" and ch.isalpha()


def _word(match: re.Match) -> str:
    word = match.group()
    if word.isascii() or not any(ch in CYRILLIC_AND_GREEK for ch in word) or not any(map(_latin, word)):
        return word
    return "".join(CYRILLIC_AND_GREEK.get(ch, ch) for ch in word)


def canonical(text: str) -> str:
    """Canonical form of one text; see the module's description."""
    if text.isascii():
        return text
    text = _SEGMENT.sub(_segment, text)
    if _FOREIGN.search(text):
        text = _WORD.sub(_word, text)
    # a sign taken away or changed may leave a letter before a mark
    return text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)


@F.pandas_udf(StringType())
def _canonical_udf(texts: pd.Series) -> pd.Series:
    return texts.map(canonical, na_action="ignore")


def canonical_column(text: Column | str) -> Column:
    """Canonical form as a column: only texts holding a suspect character cross to Python."""
    column = F.col(text) if isinstance(text, str) else text
    return F.coalesce(_canonical_udf(F.when(column.rlike(SUSPECT), column)), column)


def lookalikes(df: DataFrame, kind: str, id_column: str, text_column: str) -> DataFrame:
    """(record_kind, record_id, canonical_text) of the records whose text changes, one row an id."""
    found = (
        df.select(F.col(id_column).cast("bigint").alias("record_id"), F.col(text_column).alias("_t"))
        .where(F.col("_t").rlike(SUSPECT))
        .withColumn("canonical_text", _canonical_udf("_t"))
        .where(F.col("canonical_text") != F.col("_t"))
    )
    return found.groupBy(F.lit(kind).alias("record_kind"), "record_id").agg(F.min("canonical_text").alias("canonical_text"))
