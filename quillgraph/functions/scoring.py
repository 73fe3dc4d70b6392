"""Score columns: normalisation, strength, seniority tiers, gaps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STRENGTH_CAP = 0.99
FREQUENCY_COEFFICIENT, CORROBORATION_COEFFICIENT = 0.15, 0.10

# Base strength and yearly decay of each kind of connection.
STRENGTHS = {
    "patent_co_inventor": (0.95, 0.01),
    "same_phd_advisor": (0.92, 0.01),
    "co_board_member": (0.90, 0.02),
    "academic_co_author_multi": (0.90, 0.02),
    "academic_co_author_single": (0.85, 0.02),
    "career_overlap_same_team": (0.88, 0.04),
    "standards_committee_peer": (0.82, 0.03),
    "conference_co_presenter": (0.80, 0.05),
    "co_investor": (0.78, 0.04),
    "career_overlap_same_domain": (0.72, 0.05),
    "career_overlap_general": (0.60, 0.06),
    "alumni_network": (0.25, 0.08),
    "conference_co_attendee": (0.20, 0.20),
    "same_mba_cohort": (0.85, 0.02),
    "same_phd_program": (0.78, 0.02),
    "executive_education": (0.70, 0.03),
    "same_undergrad_cohort": (0.62, 0.04),
}

# How each kind of connection is told.
TOLD_AS = {
    "patent_co_inventor": "co-invented a patent",
    "academic_co_author_multi": "co-authored multiple papers",
    "academic_co_author_single": "co-authored a paper",
    "career_overlap_same_team": "worked on the same team",
    "career_overlap_same_domain": "worked in the same functional domain",
    "career_overlap_general": "shared career history",
    "conference_co_presenter": "co-presented at a conference",
    "standards_committee_peer": "served on a standards committee together",
    "same_phd_advisor": "shared a PhD advisor",
    "co_board_member": "served on the same board",
    "co_investor": "co-invested in a company",
    "alumni_network": "shared an alma mater",
    "conference_co_attendee": "co-attended a conference",
}

# Confidence of a source's signals, by kind where the source has several; the last one holds for other kinds.
SOURCE_CONFIDENCES = {
    "uspto": ({}, 0.95),
    "career": ({"career_overlap_same_team": 0.88, "career_overlap_same_domain": 0.72, "career_overlap_general": 0.60}, 0.60),
    "parallel": ({"conference_co_presenter": 0.80, "conference_co_attendee": 0.20, "standards_committee_peer": 0.82}, 0.5),
    "education": ({"same_mba_cohort": 0.85, "same_phd_program": 0.78, "executive_education": 0.70, "same_undergrad_cohort": 0.62, "alumni_network": 0.25}, 0.5),
    "conference": ({"conference_co_presenter": 0.80, "conference_co_attendee": 0.20}, 0.4),
    "standards": ({}, 0.82),
}
#: Kind that a signal of a source counts as if it names none.
SOURCE_KINDS = {"career": "career_overlap_general", "parallel": "conference_co_attendee", "education": "alumni_network", "conference": "conference_co_attendee"}
FEW_AUTHORS, FEW_CONFIDENCE, MANY_CONFIDENCE, UNKNOWN_SOURCE = 5, 0.90, 0.75, 0.5

# Reports a manager of each tier can have.
SPAN_LIMITS = {"c_suite": 8, "svp": 7, "vp": 8, "director": 10, "manager": 12}


def json_scalar(value: Column) -> Column:
    """A JSON scalar as a double: numbers, numeric strings, booleans, ``{"value": number}``; else 0."""
    text = F.trim(value)
    bare = F.regexp_replace(text, r'^"(.*)"$', "$1")
    inner = F.get_json_object(text, "$.value")
    return (
        F.when(text == "true", 1.0)
        .when(text == "false", 0.0)
        .when(text.startswith("{"), F.coalesce(inner.try_cast("double"), F.lit(0.0)))
        .otherwise(F.coalesce(bare.try_cast("double"), F.lit(0.0)))
    )


def normalize(n: Column) -> Column:
    """100 * (1 - exp(-n / 15)), clamped to 0..100."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 * (1 - F.exp(-n / 15))))


def or_one(x: Column) -> Column:
    """Null and zero count as 1."""
    return F.when(x.isNull() | (x == 0), 1.0).otherwise(x)


def strength(base: Column, decay: Column, years: Column, corroborations: Column, sources: Column) -> Column:
    """Connection strength after decay and corroboration, capped."""
    frequency = 1 + F.log(corroborations) * FREQUENCY_COEFFICIENT
    return F.least(F.lit(STRENGTH_CAP), base * F.exp(-decay * years) * frequency * (1 + sources * CORROBORATION_COEFFICIENT))


def seniority_tier(score: Column) -> Column:
    """Tier of a seniority score."""
    return (
        F.when(score >= 85, "c_suite").when(score >= 75, "svp").when(score >= 65, "vp").when(score >= 55, "director").otherwise("manager")
    )


def span_limit(tier: Column) -> Column:
    """Most reports of a tier."""
    out = F.lit(None).cast("int")
    for name, limit in SPAN_LIMITS.items():
        out = F.when(tier == name, limit).otherwise(out)
    return out


def gap_score(gap: Column) -> Column:
    """Plausibility of a seniority gap between manager and report."""
    return F.when(gap.between(8, 15), 0.30).when((gap >= 5) & (gap < 8), 0.18).when((gap > 15) & (gap <= 25), 0.12).otherwise(0.0)


def patent_score(shared: Column) -> Column:
    """0.05 for each shared patent, at most 0.15."""
    return F.least(F.lit(0.15), F.lit(0.15) * shared / 3)


def told_as(kind: Column) -> Column:
    """How a kind of connection is told; unknown kinds with spaces, none at all as a shared connection."""
    text = F.replace(kind, F.lit("_"), F.lit(" "))
    for name, words in TOLD_AS.items():
        text = F.when(kind == name, words).otherwise(text)
    return F.when(F.coalesce(kind, F.lit("")) == "", "shared a connection").otherwise(text)


def source_confidence(source: Column, kind: Column, authors: Column, given: Column) -> Column:
    """Confidence of a signal by its source: for papers by the number of authors (5 if unknown), for studies the one given, else by kind."""
    out = F.lit(UNKNOWN_SOURCE)
    for name, (kinds, other) in SOURCE_CONFIDENCES.items():
        own = F.lit(other)
        for k, c in kinds.items():
            own = F.when(F.coalesce(kind, F.lit(SOURCE_KINDS.get(name))) == k, c).otherwise(own)
        own = F.coalesce(given, own) if name == "education" else own
        out = F.when(source == name, own).otherwise(out)
    return F.when(source == "scholar", F.when(F.coalesce(authors, F.lit(FEW_AUTHORS)) <= FEW_AUTHORS, FEW_CONFIDENCE).otherwise(MANY_CONFIDENCE)).otherwise(out)
