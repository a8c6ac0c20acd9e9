"""Unicode forms that have no built-in function, as Arrow-based UDFs."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import functions as F


def _each(function):
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(function, na_action="ignore")

    return run


def nfkc(col):
    """G10."""
    return _each(lambda t: unicodedata.normalize("NFKC", t))(col)


def casefold(col):
    """X19: 'ß' becomes 'ss'."""
    return _each(str.casefold)(col)


def ascii_fold(col):
    """Accents go."""
    return _each(lambda t: unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode())(col)


def html_unescape(col):
    """G8."""
    return _each(html.unescape)(col)
