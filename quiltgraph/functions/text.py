"""Text, token and name expressions. Everything here is a Column built from Spark functions."""

from __future__ import annotations

import html
import html.entities
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The whitespace set, the characters a name keeps, and the digit
# characters that make a name "only digits" (decimal digits plus digit forms).
WS = r"[\x09-\x0D\x1C-\x20\x85\p{Z}]"
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
NAME_DROP = r"[^a-z0-9ıſ\x09-\x0D\x1C-\x20\x85\p{Z}-]"
ONLY_DIGITS = r"^[\p{Nd}¹²³⁰⁴-⁹₀-₉①-⑨⑴-⑼⒈-⒐⓪⓵-⓽⓿❶-❾➀-➈➊-➒፩-፱]+$"
NO_DESCRIPTION = ("文本中无可用描述。", "No description available in the text.")


def strip(c: Column) -> Column:
    """Trim every Unicode space, not only the space character."""
    return F.btrim(c, F.lit(WS_CHARS))


# The same set, with a comparison before it that settles most letters.
GAP = rf"[\x09-\x20\x80-\uFFFF&&{WS}]+"


def words(c: Column) -> Column:
    """Default tokens: maximal runs without whitespace."""
    return F.array_remove(F.split(c, GAP), "")


@dataclass(frozen=True)
class Words:
    """Tokens are runs without white space; a window joins them by one space."""

    def tokens(self, c: Column) -> Column:
        return words(c)

    def joined(self, tokens: Column) -> Column:
        return F.array_join(tokens, " ")


# Scripts that are written without spaces between words.
UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"


@dataclass(frozen=True)
class ScriptTokens:
    """Like ``Words``, but every character of a script without spaces is a token of its own.

    A token keeps the white space before it, so a window is a piece of the text as it stands.
    """

    def tokens(self, c: Column) -> Column:
        space = WS[1:-1]
        pattern = f"[{space}]*(?:[{UNSPACED}]|[^{space}{UNSPACED}]+)"
        return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))

    def joined(self, tokens: Column) -> Column:
        return strip(F.array_join(tokens, ""))


def word_count(c: Column) -> Column:
    return F.size(words(c))


def truncate_words(c: Column, limit: int) -> Column:
    """First ``limit`` tokens joined by one space, only when there are more."""
    w = words(c)
    return F.when(F.size(w) > limit, F.array_join(F.slice(w, 1, limit), " ")).otherwise(c)


def normalize_name(c: Column) -> Column:
    kept = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), NAME_DROP, "")
    return F.trim(F.regexp_replace(kept, f"{WS}+", " "))


def only_digits(c: Column) -> Column:
    return strip(c).rlike(ONLY_DIGITS)


def clean_description(c: Column) -> Column:
    d = strip(F.coalesce(c, F.lit("")))
    return F.when(d.isin(*NO_DESCRIPTION), "").otherwise(d)


def file_stem(c: Column) -> Column:
    """Last path segment without its last suffix; a leading dot is not a suffix."""
    name = F.regexp_extract(F.regexp_replace(c, "/+$", ""), "[^/]*$", 0)
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")


def safe_file_name(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit(" "), F.lit("_")), r'[\\/*?:"<>|]', "")


def name_from_file(c: Column, prefix: str, suffix: str) -> Column:
    """Document name inside a log file name, underscores read as spaces."""
    pattern = f"{prefix}(.*){suffix}"
    return F.translate(F.regexp_extract(c, pattern, 1), "_", " ")


def sorted_join(values: Column, sep: str = " | ") -> Column:
    """Sorted distinct non-empty strings of an array, joined."""
    kept = F.filter(values, lambda x: x.isNotNull() & (x != ""))
    return F.array_join(F.array_sort(F.array_distinct(kept)), sep)


def quoted_list(names: Column) -> Column:
    """``['a', 'b']``; names hold no quotes after normalisation."""
    return F.concat(F.lit("["), F.array_join(F.transform(names, lambda n: F.concat(F.lit("'"), n, F.lit("'"))), ", "), F.lit("]"))


@F.pandas_udf(StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


#: A character reference with its semicolon.
CLOSED_REFERENCE = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|([A-Za-z0-9]+));")


@F.pandas_udf(StringType())
def _unescape_closed(s: pd.Series) -> pd.Series:
    known = html.entities.html5
    one = lambda m: m[0] if m[1] and f"{m[1]};" not in known else html.unescape(m[0])
    return s.map(lambda text: CLOSED_REFERENCE.sub(one, text), na_action="ignore")


def unescape_html(df: DataFrame, *columns: str, closed: bool = False) -> DataFrame:
    """Full HTML character references. Only rows holding ``&`` cross into Python.

    ``closed`` resolves references that end in a semicolon only: a text cut inside one keeps what is left of it.
    """
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.col(c), F.lit("&")), F.lit(False))
    plain = df.filter(~hit)
    escaped = df.filter(hit)
    for c in columns:
        escaped = escaped.withColumn(c, _unescape_closed(c) if closed else _unescape(c))
    return plain.unionByName(escaped)
