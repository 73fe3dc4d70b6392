"""Records of people from several sources: which name one person, and the person's fields.

Six ordered rules tell whether two records are one person: equal addresses (two different ones say no), equal accounts,
equal mail (two different ones say no), equal reference, equal name parts, or names of a ratio of ``least`` or more at one company. A rule is a
blocking key, so pairs are never compared across blocks; within a block, each record is linked to a few
representatives instead of to every other one. Joins merge sorted sides, so that nothing passes through the driver. What a representative must be follows from the rules that can say no: a record
without an address can't be refused by addresses, so every record of a block of equal accounts or mail matches the
smallest one without an address, and those with equal addresses are linked anyway. Where mail can refuse too, the kinds "neither",
"address only" and "mail only" have a representative each. The components of these links are those of all matching pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.components import components
from quillgraph.operators.similar import LEAST, similar_names
from quillgraph.operators.stored import stored

KEYS = ("url", "account", "email", "reference", "company", "names", "first")


def _given(c: Column) -> Column:
    return F.when(F.trim(c) != "", F.trim(c))


def keyed(records: DataFrame) -> DataFrame:
    """(id, *KEYS) of records (id, url, account, email, reference, first, last, company): normalised, null where empty."""
    words = F.filter(F.split(F.lower(F.concat_ws(" ", "first", "last")), r"\s+"), lambda w: w != "")
    return records.select(
        "id",
        _given(F.lower(F.rtrim(F.trim("url"), F.lit("/")))).alias("url"),
        F.when(F.col("account") != "", F.col("account")).alias("account"),
        F.when(F.contains("email", F.lit("@")), F.lower(F.trim("email"))).alias("email"),
        F.when(F.col("reference") != "", F.col("reference")).alias("reference"),
        F.when(F.col("company") != "", F.lower("company")).alias("company"),
        F.array_join(F.array_sort(words), " ").alias("names"),
        F.when(F.col("first") != "", F.col("first")).alias("first"),
    )


def _least_of(when: Column) -> Column:
    return F.min(F.when(when, F.col("id")))


def _to_one(rows: DataFrame, key: str, when: Column) -> DataFrame:
    """Links from every row of a block to the block's smallest row of a kind."""
    rows = rows.filter(F.col(key).isNotNull())
    return rows.join(rows.groupBy(key).agg(_least_of(when).alias("b")).filter("b IS NOT NULL").hint("merge"), key).select(F.col("id").alias("a"), "b")


def _to_kinds(rows: DataFrame, keys: Sequence[str], pairs: DataFrame | None = None) -> DataFrame:
    """Links where address and mail can refuse: to the representatives of the own block and of those paired with it.

    ``pairs`` has the block's keys with the last one as ``name`` and the other block's as ``other``.
    """
    url, mail = F.col("url").isNotNull(), F.col("email").isNotNull()
    kinds = {"neither": ~url & ~mail, "url_only": url & ~mail, "mail_only": ~url & mail}
    least = rows.groupBy(*keys).agg(*(_least_of(when).alias(kind) for kind, when in kinds.items()))
    if pairs is not None:
        other = least.withColumnRenamed(keys[-1], "other")
        near = pairs.unionByName(pairs.select(*keys[:-1], F.col("other").alias("name"), F.col("name").alias("other"))).distinct()
        least = least.unionByName(near.join(other.hint("merge"), [*keys[:-1], "other"]).drop("other").withColumnRenamed("name", keys[-1]).select(least.columns))
    met = rows.join(least.hint("merge"), list(keys))
    to = F.array(F.col("neither"), F.when(kinds["url_only"], F.col("mail_only")), F.when(kinds["mail_only"], F.col("url_only")))
    return met.select(F.col("id").alias("a"), F.explode(F.array_compact(to)).alias("b"))


def match_links(records: DataFrame, least: float = LEAST) -> DataFrame:
    """Links (a, b) of record ids whose components are those of all pairs that the rules match."""
    rows = stored(keyed(records))
    at_company = rows.filter("company IS NOT NULL AND first IS NOT NULL AND names <> ''")
    names = at_company.select("company", F.col("names").alias("name")).distinct()
    close = similar_names(names, names, ["company"], least).filter("name < other").select("company", "name", "other")
    parts = [
        _to_one(rows, "url", F.lit(True)),
        _to_one(rows, "account", F.col("url").isNull()),
        _to_one(rows, "email", F.col("url").isNull()),
        _to_kinds(rows.filter("reference IS NOT NULL"), ["reference"]),
        _to_kinds(at_company, ["company", "names"], close),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter("a <> b").distinct()


def resolve(records: DataFrame, least: float = LEAST) -> DataFrame:
    """``records`` with ``person_id``, the smallest id of the records that name the same person."""
    labels = components(match_links(records, least)).select(F.col("node").alias("id"), F.col("label").alias("person_id"))
    return records.join(labels.hint("merge"), "id", "left").withColumn("person_id", F.coalesce("person_id", "id"))


def merged(resolved: DataFrame, fields: Sequence[str], priority: str = "priority", spellings: Sequence[str] = ()) -> DataFrame:
    """One row a person: each field from the source of highest priority that fills it (ties to the smallest id), and the number of records.

    ``spellings`` are collected as arrays without regard to case, the spelling of the highest priority standing for each.
    """
    first = [F.min_by(F.when(F.col(f).cast("string") != "", F.col(f)), F.when(F.col(f).cast("string") != "", F.struct(-F.col(priority), F.col("id")))).alias(f) for f in fields]
    one = resolved.groupBy("person_id").agg(F.count("*").alias("records"), *first)
    for s in spellings:
        spelled = resolved.filter(F.col(s) != "").groupBy("person_id", F.lower(s).alias("_k")).agg(F.min_by(s, F.struct(-F.col(priority), F.col("id"))).alias("_s"))
        one = one.join(spelled.groupBy("person_id").agg(F.array_sort(F.collect_list("_s")).alias(f"{s}_variants")).hint("merge"), "person_id", "left")
    return one
