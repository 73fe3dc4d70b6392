"""Vendor records as JSON, shaped to the rows that the engine stores; what isn't of the expected type becomes empty, and records without a name go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Address of a patent's page, kinds, sources and confidences of company signals.
PATENT_PAGE = "https://patents.google.com/patent/US{}/"
EXECUTIVE, PRESS = ("executive_profile", "firecrawl_leadership", 0.85), ("press_release", "firecrawl_press", 0.90)


def _kind(path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get("v", path, "variant"))


def _text(*paths: str) -> Column:
    """The first of the paths that holds a non-empty text."""
    one = [F.when(_kind(p) == "STRING", F.nullif(F.try_variant_get("v", p, "string"), F.lit(""))) for p in paths]
    return F.coalesce(*one)


def _number(path: str, digits: bool = True) -> Column:
    """A whole number, or with ``digits`` text of digits, as an int; null otherwise."""
    text = F.trim(F.try_variant_get("v", path, "string"))
    ok = (_kind(path) == "BIGINT") | (F.lit(digits) & (_kind(path) == "STRING") & text.rlike("^[0-9]+$"))
    return F.when(ok, text.try_cast("int"))


def _opened(rows: DataFrame, column: str) -> tuple[DataFrame, list[str]]:
    rest = [c for c in rows.columns if c != column]
    return rows.select(*rest, F.try_parse_json(column).alias("v")).filter(F.schema_of_variant("v").startswith("OBJECT")), rest


def recognitions(rows: DataFrame, column: str = "payload") -> DataFrame:
    """Entries of recognition lists: name, year elected, citation, company (or main affiliation), location; blank texts are null."""
    opened, rest = _opened(rows, column)
    said = lambda *paths: F.coalesce(*[F.when(F.trim(_text(p)) != "", _text(p)) for p in paths])
    return opened.select(
        *rest, said("$.name").alias("name"), _number("$.year_elected").alias("year_elected"), said("$.citation").alias("citation"), said("$.company", "$.primary_affiliation").alias("company"), said("$.location").alias("location")
    ).filter("name IS NOT NULL")


def patents(rows: DataFrame, column: str = "payload") -> DataFrame:
    """Patents of either naming: number, title, dates, first assignee and page."""
    opened, rest = _opened(rows, column)
    number = _text("$.patent_id", "$.patent_number", "$.number")
    page = F.format_string(PATENT_PAGE.replace("{}", "%s"), F.replace(number, F.lit(","), F.lit("")))
    empty = lambda *paths: F.coalesce(_text(*paths), F.lit(""))
    return opened.select(
        *rest, number.alias("patent_number"), empty("$.patent_title", "$.title").alias("patent_title"), empty("$.patent_filing_date", "$.filing_date").alias("filing_date"), _text("$.patent_date", "$.grant_date").alias("grant_date"),
        empty("$.assignees[0].assignee_organization", "$.assignees[0].organization").alias("assignee"), page.alias("uspto_url"),
    ).filter("patent_number IS NOT NULL")


def papers(rows: DataFrame, column: str = "payload") -> DataFrame:
    """Papers with a title or an id: venue, year and citations (0 if unknown), DOI, number of authors."""
    opened, rest = _opened(rows, column)
    empty = lambda path: F.coalesce(_text(path), F.lit(""))
    authors = F.coalesce(F.size(F.try_variant_get("v", "$.authors", "array<variant>")), F.lit(0))
    return opened.select(
        *rest, empty("$.title").alias("paper_title"), empty("$.venue").alias("venue"), F.coalesce(_number("$.year"), F.lit(0)).alias("year"), F.coalesce(_number("$.citationCount", digits=False), F.lit(0)).alias("citation_count"),
        empty("$.paperId").alias("semantic_scholar_id"), _text("$.externalIds.DOI", "$.externalIds.doi").alias("doi"), F.greatest(F.lit(0), authors).alias("author_count"),
    ).filter("paper_title <> '' OR semantic_scholar_id <> ''")


def company_signals(pages: DataFrame, now: Column) -> DataFrame:
    """A row to append for each executive and each press release of pages (company_id, page_url, executives, press_releases): kind, source, value as JSON, confidence, time.

    ``executives`` is an array of (name, title, bio, image_url), ``press_releases`` of (headline, published_at, url, summary, mentioned_executives,
    reporting_phrases).
    """
    out = None
    for column, (kind, source, confidence) in (("executives", EXECUTIVE), ("press_releases", PRESS)):
        fields = [f"e.{f.name}" for f in pages.schema[column].dataType.elementType.fields]
        rows = pages.select("company_id", "page_url", F.explode(column).alias("e"))
        value = F.to_json(F.struct(*fields, "page_url"))
        part = rows.select("company_id", F.lit(kind).alias("signal_type"), F.lit(source).alias("source"), value.alias("value"), F.lit(confidence).alias("confidence"), now.alias("fetched_at"))
        out = part if out is None else out.unionByName(part)
    return out
