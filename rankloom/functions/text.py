"""Tokens of texts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The closed-class words that tokens leave out.
ENGLISH = (
    "a an the and or but if of at by for with about against between into through during to from in "
    "on is are was were be been being have has had do does did will would should can could this that "
    "these those it its as so than too not no he she they we you his her their our your i him"
).split()
DANISH = (
    "og i jeg det at en den til er som på de med han af for ikke der var mig sig men et "
    "har om vi min havde ham hun nu over da fra du ud sin dem os op man hans hvor eller hvad "
    "skal selv her alle vil blev kunne ind når være"
).split()
STOPWORDS = sorted({*ENGLISH, *DANISH})
LETTERS = r"[\p{L}\p{Nl}\p{No}]+"


def concat_nullsafe(*columns: str) -> Column:
    """Columns joined by single spaces, nulls as empty strings, so a space at either end can stay."""
    parts: list[Column] = []
    for c in columns:
        parts += [F.lit(" "), F.coalesce(F.col(c), F.lit(""))]
    return F.concat(*parts[1:])


def raw_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(LETTERS), F.lit(0))


def is_term(token: Column) -> Column:
    """Neither a stopword nor a single letter; the words are a hash set in the plan."""
    return (F.length(token) > 1) & ~token.isin(STOPWORDS)


def tokens(text: Column, stopwords: bool = True) -> Column:
    """Letter runs of a text (see ``normalised``) in lower case, without stopwords and single letters."""
    found = raw_tokens(text)
    return F.filter(found, is_term) if stopwords else found


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility composition, which no built-in function does; the only row function in Python here."""
    import unicodedata

    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


#: Texts of these characters alone are their own compatibility composition: ASCII and Latin letters without ligatures and digraphs.
STABLE = r"^[\x00-\x7F\x{C0}-\x{131}\x{134}-\x{13E}\x{141}-\x{148}\x{14A}-\x{17E}]*$"


def normalised(df: DataFrame, column: str) -> DataFrame:
    """``df`` with NFKC texts. Only rows that hold any other character than ``STABLE`` ones go through Python."""
    plain = F.coalesce(F.col(column), F.lit("")).rlike(STABLE)
    return df.filter(plain).unionByName(df.filter(~plain).withColumn(column, nfkc(F.col(column))))
