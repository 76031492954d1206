"""Normalisation of titles and artists for comparison.

Everything is a Column expression but one step: NFKC and full case folding have no Spark
function, so ``with_normalized`` sends rows with characters beyond ASCII through an Arrow
UDF and keeps all others in code generation. The two kinds are split by a filter, because
a UDF under ``when`` would run for every row.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words and phrases that tell versions of a recording apart.
VERSION_TERMS = (
    "album version", "radio edit", "radio mix", "single version", "original mix", "extended mix", "extended edit", "club mix", "dub mix",
    "lp version", "single edit", "remaster", "remastered", "reissue", "re-recorded", "re-recording", "rework", "remix", "clean", "explicit",
    "live", "extended", "edit", "mix", "version", "acoustic", "unplugged", "instrumental", "karaoke", "reprise", "demo", "intro", "outro",
    "deluxe", "bonus", "radio", "orchestral", "12 inch", "7 inch",
)
# Typographic characters and what they are compared as.
QUOTES = {"’": "'", "‘": "'", "‚": "'", "´": "'", "“": '"', "”": '"', "&": " and "}
DASHES = "–—-"

TERM_PATTERN = r"\b(?:" + "|".join(re.escape(t).replace("\\ ", " ") for t in VERSION_TERMS) + r")\b"
# Fixed value: what introduces a guest.
FEAT_PATTERN = r"\b(?:feat(?:uring)?(?:\.|\b)|ft(?:\.|\b))"
ASCII_PATTERN = r"^[\x00-\x7f]*$"


def stripped(c: Column) -> Column:
    """Without leading and trailing white space."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def collapsed(c: Column) -> Column:
    """Runs of white space made one space, then stripped."""
    return F.trim(F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", " "))


def normalize(c: Column) -> Column:
    """Lower case, plain quotes, '&' spelt out, other punctuation as spaces. Exact for ASCII
    text; accented letters are kept but neither composed nor fully folded."""
    s = F.lower(F.coalesce(c, F.lit("")))
    for old, new in QUOTES.items():
        s = F.replace(s, F.lit(old), F.lit(new))
    return collapsed(F.regexp_replace(s, r"[^\p{L}\p{N}_\s']", " "))


def normalize_text(s: str | None) -> str:
    """The same for any text, with NFKC and case folding."""
    s = unicodedata.normalize("NFKC", s or "").casefold()
    s = s.translate({ord(k): v for k, v in QUOTES.items()})
    return " ".join(re.sub(r"[^\w\s']", " ", s).split())


@F.pandas_udf(T.StringType())
def _normalize_any(s: pd.Series) -> pd.Series:
    return s.map(normalize_text, na_action=None)


def with_normalized(df: DataFrame, raw: tuple[Column, ...] | None = None, **columns: Column) -> DataFrame:
    """``df`` with a normalised column for each name. ``raw``: what they are made of, looked at for
    characters beyond ASCII in their place where making them takes long."""
    plain = F.lit(True)
    for c in raw or columns.values():
        plain = plain & F.coalesce(c, F.lit("")).rlike(ASCII_PATTERN)
    native = df.where(plain).withColumns({k: normalize(c) for k, c in columns.items()})
    other = df.where(~plain).withColumns({k: _normalize_any(c) for k, c in columns.items()})
    return native.unionByName(other)


def split_feat(c: Column) -> Column:
    """struct(before, after) of the first guest marker; (text, '') without one."""
    s = F.coalesce(c, F.lit(""))
    found = s.rlike(FEAT_PATTERN)
    before = stripped(F.regexp_extract(s, rf"(?s)^(.*?){FEAT_PATTERN}", 1))
    after = F.regexp_replace(F.regexp_extract(s, rf"(?s)^.*?{FEAT_PATTERN}(.*)$", 1), rf"^[ .,()\[\]{DASHES}]+|[ .,()\[\]{DASHES}]+$", "")
    return F.struct(F.when(found, before).otherwise(stripped(s)).alias("before"), F.when(found, after).otherwise("").alias("after"))


def version_terms(normalized: Column) -> Column:
    """Distinct version terms of a normalised text, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(normalized, F.lit("")), F.lit(TERM_PATTERN), F.lit(0))))


def core_of(normalized: Column) -> Column:
    """A normalised text without guest clause and version terms."""
    return collapsed(F.regexp_replace(split_feat(normalized)["before"], TERM_PATTERN, " "))


def core_or_whole(normalized: Column) -> Column:
    core = core_of(normalized)
    return F.when(core == "", normalized).otherwise(core)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def suffix(path: Column) -> Column:
    """Lower-cased last suffix with its dot, or ''."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+?(\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    name = file_name(path)
    return F.when(name.rlike(r"^.+\.[^.]+$"), F.regexp_extract(name, r"^(.+)\.[^.]+$", 1)).otherwise(name)


def guess_from_stem(c: Column) -> Column:
    """struct(artist, title) guessed from 'NN - Artist - Title'; nulls where unsure."""
    parts = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), rf"(?U)\s+[{DASHES}]\s+"), stripped), lambda x: x != "")
    numbered = F.coalesce(F.get(parts, F.lit(0)).rlike(r"^\p{Nd}{1,3}[._\-]?\p{Nd}*$"), F.lit(False))
    parts = F.when(numbered, F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    n = F.size(parts)
    artist = F.when(n >= 2, F.get(parts, F.lit(0)))
    title = F.when(n == 1, F.get(parts, F.lit(0))).when(n >= 2, F.array_join(F.slice(parts, F.lit(2), F.greatest(n - 1, F.lit(0))), " "))
    return F.struct(artist.alias("artist"), title.alias("title"))
