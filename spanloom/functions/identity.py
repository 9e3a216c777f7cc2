"""Structural identity: where a text stands (site key), what it says (content hash), what it repeats (dup key)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SPACES = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"


@F.pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Unicode normal form C. Spark has no function for it; sources that are known to be in it need not call this."""
    return texts.map(lambda t: t if t is None else unicodedata.normalize("NFC", t))


def collapsed(text: Column) -> Column:
    """White space in runs becomes one space, none at the ends; case stays."""
    return F.regexp_replace(F.regexp_replace(text, SPACES, " "), "^ | $", "")


def site_key(file: Column, path: Column) -> Column:
    return F.concat(file, F.lit("#"), path)


def short_id(prefix: str, key: Column, digits: int = 12) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha1(key), 1, digits))


def content_hash(text: Column) -> Column:
    return F.substring(F.sha1(text), 1, 8)


def dup_hash(text: Column) -> Column:
    """What tells equal texts; the whole digest, as a short one would join unrelated texts of a large corpus."""
    return F.sha1(collapsed(text))


def dup_key(text: Column) -> Column:
    """The short form of ``dup_hash``, for show."""
    return F.substring(dup_hash(text), 1, 6)


def pointer_segment(key: Column) -> Column:
    return F.replace(F.replace(key, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def fingerprint(*cols: Column) -> Column:
    return F.concat_ws("\x00", *(F.coalesce(c.cast("string"), F.lit("")) for c in cols))
