"""Slugs. Spark has no Unicode normal form, so that one step is a vectorised Python function."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from leafloom import constants as K


@F.pandas_udf(StringType())
def _ascii_fold(text: pd.Series) -> pd.Series:
    return text.map(
        lambda t: None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode("ascii")
    )


def slugify(text: Column) -> Column:
    """Lower-case ASCII words joined by hyphens, 60 characters at most, ``untitled`` when empty."""
    folded = F.lower(_ascii_fold(F.coalesce(text, F.lit(""))))
    words = F.trim(F.regexp_replace(folded, "[^a-z0-9]+", "-"), F.lit("-"))
    short = F.rtrim(F.substring(words, 1, K.SLUG_MAX_CHARS), F.lit("-"))
    return F.when(F.length(short) == 0, F.lit("untitled")).otherwise(short)


def path_segment(order: Column, slug: Column) -> Column:
    """Two-digit order and slug, as used in node paths."""
    return F.concat(F.format_string("%02d", order.cast("int")), F.lit("-"), slug)
