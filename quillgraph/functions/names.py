"""Names: folding, similarity and the same-person test. Python in Arrow batches, as Spark has no such built-ins."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from .texts import company_name, name_parts


def fold(text: str) -> str:
    """Lower-case text without marks, white space collapsed."""
    bare = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return " ".join(bare.lower().split())


@F.pandas_udf(StringType())
def folded(names: pd.Series) -> pd.Series:
    """Folded name; null stays null."""
    return names.map(fold, na_action="ignore")


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching characters of two folded names; 0 where either is null or empty."""
    return pd.Series([SequenceMatcher(None, fold(x), fold(y)).ratio() if x and y else 0.0 for x, y in zip(a, b, strict=True)])


def profile_url(url: Column) -> Column:
    """Profile address without scheme, www, query and trailing slash."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(url)), r"^https?://(www\.)?", ""), r"[?#].*$", "")
    return F.rtrim(bare, F.lit("/"))


def same_person(a: Column, b: Column, least: float = 0.88) -> Column:
    """Whether two structs (url, email, name, company) name one person; the first rule that can tell decides.

    Two addresses decide alone, then two mails; after them first and last name with the company,
    then a similar name in the same company. ``operators.matching`` has all six rules, as joins.
    """
    url, mail = (lambda x: profile_url(x["url"])), (lambda x: F.lower(F.trim(x["email"])))
    parts = lambda x: name_parts(x["name"])
    firm = lambda x: F.lower(company_name(x["company"]))
    same_firm = F.coalesce(firm(a) == firm(b), F.lit(False))
    full = (F.lower(parts(a)["first"]) == F.lower(parts(b)["first"])) & (F.lower(parts(a)["last"]) == F.lower(parts(b)["last"])) & (parts(a)["last"] != "")
    return (
        F.when(url(a).isNotNull() & url(b).isNotNull(), url(a) == url(b))
        .when(mail(a).isNotNull() & mail(b).isNotNull(), mail(a) == mail(b))
        .when(F.coalesce(full, F.lit(False)) & same_firm, True)
        .when(same_firm & (similarity(a["name"], b["name"]) >= least), True)
        .otherwise(False)
    )
