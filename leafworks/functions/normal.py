"""Unicode normal forms. Spark has none, so Python is asked, in Arrow batches; ASCII is its own normal
form, so a column without other characters stays in the JVM (see ``only_where_needed``)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else x if x.isascii() else unicodedata.normalize("NFC", x))


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else x if x.isascii() else unicodedata.normalize("NFKC", x))


def plain(text: Column) -> Column:
    """Whether a text is ASCII, and so its own normal form."""
    return ~text.rlike(r"[^\x00-\x7F]")
