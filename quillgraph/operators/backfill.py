"""From prospects to companies, persons and stints: one chain of grouped merges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgraph.functions.dates import role_years
from quillgraph.functions.texts import EARLIER_DOMAIN_RULES, EARLIER_SENIORITY_RULES, company_key, first_hit
from quillgraph.operators.components import components
from quillgraph.operators.stored import stored


class Backfill:
    """Tables made of ``prospects`` (id, name, company, role, url, past array of names) and ``careers`` (id, company, title, years).

    * ``companies`` (company, variant): every key that a present or past employer's name has, and the first other spelling of it (by prospect, then name).
    * ``persons`` (person_id, source_id, name, variant, url, company, title, seniority, domain): prospects of one address, or of one name and present company, are one
      person, the smallest id's row standing for it (title and url are the first that are given).
    * ``stints`` (person_id, company, title, is_current, start_year, end_year): one present stint for a person and company, and past ones from careers or, for a prospect
      without any, from the past names. Past stints at the present employer don't count; a stint of the same title fills missing years, and one without a title
      folds into the first title that the person has there.

    Names without a key have no company; null names are empty ones. All steps group by keys; equal names of any number give links in proportion.
    """

    def __init__(self, prospects: DataFrame, careers: DataFrame):
        self.rows = stored(prospects.select("id", F.coalesce("name", F.lit("")).alias("raw"), company_key(F.col("name")).alias("name"), F.col("company").alias("firm"), F.nullif(company_key(F.col("company")), F.lit("")).alias("company"), "role", "url", "past"))
        told = careers.select("id", F.col("company").alias("firm"), F.nullif(company_key(F.col("company")), F.lit("")).alias("company"), F.nullif("title", F.lit("")).alias("title"), role_years(F.col("years")).alias("y"))
        plain = self.rows.join(told.select("id").distinct(), "id", "left_anti").select("id", F.explode("past").alias("firm"))
        plain = plain.select("id", "firm", F.nullif(company_key(F.col("firm")), F.lit("")).alias("company"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("int").alias("start_year"), F.lit(None).cast("int").alias("end_year"))
        told = told.select("id", "firm", "company", "title", F.col("y.start").alias("start_year"), F.col("y.end").alias("end_year"))
        self.roles = stored(told.unionByName(plain).filter("company IS NOT NULL"))
        self.persons_of = stored(self._persons_of())

    def companies(self) -> DataFrame:
        """Companies to insert."""
        names = self.rows.filter("company IS NOT NULL").select("id", "firm", "company").unionByName(self.roles.select("id", "firm", "company"))
        other = F.col("firm") != F.col("company")
        return names.groupBy("company").agg(F.min_by(F.when(other, F.col("firm")), F.when(other, F.struct("id", "firm"))).alias("variant"))

    def _persons_of(self) -> DataFrame:
        keys = {"url": F.nullif("url", F.lit("")), "pair": F.when(F.col("company").isNotNull(), F.struct("name", "company"))}
        links = None
        for key in keys.values():
            own = self.rows.select("id", key.alias("k")).filter("k IS NOT NULL")
            part = own.join(own.groupBy("k").agg(F.min("id").alias("b")), "k").select(F.col("id").alias("a"), "b")
            links = part if links is None else links.unionByName(part)
        labels = components(links).select(F.col("node").alias("id"), F.col("label").alias("person_id"))
        return self.rows.join(labels, "id", "left").withColumn("person_id", F.coalesce("person_id", "id"))

    def persons(self) -> DataFrame:
        """Persons to insert."""
        first = lambda c: F.min_by(c, F.when(F.coalesce(c, F.lit("")) != "", F.col("id"))).alias(c)
        one = self.persons_of.groupBy("person_id").agg(F.min("id").alias("source_id"), F.min_by(F.struct("raw", "name", "company"), "id").alias("m"), first("url"), first("role"))
        title = F.col("role")
        return one.select(
            "person_id", "source_id", "m.name", F.when((F.col("m.raw") != F.col("m.name")) & (F.col("m.raw") != ""), F.col("m.raw")).alias("variant"), "url", "m.company", title.alias("title"),
            first_hit(title, EARLIER_SENIORITY_RULES).cast("int").alias("seniority"), first_hit(title, EARLIER_DOMAIN_RULES).alias("domain"),
        )

    def stints(self) -> DataFrame:
        """Stints to insert."""
        at = ["person_id", "company"]
        now = self.persons_of.filter("company IS NOT NULL").groupBy(*at).agg(F.min_by("role", "id").alias("title"))
        present = now.select(*at, F.nullif("title", F.lit("")).alias("title"), F.lit(True).alias("is_current"), F.lit(None).cast("int").alias("start_year"), F.lit(None).cast("int").alias("end_year"))
        own = self.persons_of.select("id", "person_id", F.col("company").alias("employer"))
        past = self.roles.join(own, "id").filter("employer IS NULL OR employer <> company")
        years = [F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("id", c))).alias(c) for c in ("start_year", "end_year")]
        first = F.min("title").over(W.partitionBy(*at))
        folded = past.withColumn("title", F.coalesce("title", first)).groupBy(*at, "title").agg(*years)
        return present.unionByName(folded.select(*at, "title", F.lit(False).alias("is_current"), "start_year", "end_year"))
