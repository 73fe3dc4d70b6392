"""Schools, people and memberships found in texts, payloads and rosters."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.stored import stored

# Degree that a kind of institution stands for, the shortest alias, the confidence of a mined signal.
DEGREES = {"mba": "MBA", "phd": "PhD", "undergrad": "BS", "exec_ed": "Executive Education"}
SHORTEST_ALIAS = 3
MINED_CONFIDENCE = 0.50

# Keys under which payloads hold people, and words that no person's name has.
NAME_KEYS = ("name", "person_name", "executive_name", "full_name", "exec")
TITLE_KEYS = ("title", "role", "position", "job_title", "exec_title")
COMPANY_KEYS = ("company", "company_name", "employer", "organization", "issuer")
PEOPLE_KEYS = ("people", "executives", "mentions", "appointees", "leaders", "executive_profiles")
NOT_NAMES = (
    "inc", "llc", "corp", "corporation", "ltd", "company", "co", "press", "release", "update", "news", "announcement",
    "ceo", "cfo", "cto", "coo", "cro", "cmo", "vp", "svp", "evp", "officer", "executive", "appointment",
)

# How rosters and programs are written.
PERSON = r"(?P<name>[A-Z][A-Za-z\.\-\']{1,40}(?:\s+[A-Z][A-Za-z\.\-\']{1,40}){1,3})"
COMMITTEE_HEADER = r"^(?:#{1,4}\s+|(?:\*\*|__))(?P<name>[^\n#*_]{4,120})(?:\*\*|__)?\s*$"
MEMBER_LINE = rf"^(?:[\*\-]\s+)?{PERSON}" r"(?:\s*[—\-–]\s*|\s*\(|,\s*)?(?P<company>[A-Z][\w\s\.,&\-\(\)]{2,80})?\s*\)?$"
YEARS = r"\((?P<start>\d{4})\s*[-–—]\s*(?P<end>\d{4})\)|since\s+(?P<since>\d{4})|\b(?P<single>\d{4})\b"
YEARS_WINDOW = 200
SESSION_HEADER = r"^(?:#{2,4}\s+)(?P<title>[^\n#]{1,200})\s*$"
SPEAKER_LINES = (
    r"\*\*(?:Speaker|Presenter|Keynote|Panelist|Chair)s?:?\*\*\s+" rf"{PERSON}" r"(?:\s*[—\-,]\s*(?P<rest>[^\n]+))?",
    rf"^\d+\.\s+{PERSON}" r"(?:\s*\((?P<company>[^\)]{2,80})\))?",
    rf"^[\*\-]\s+{PERSON}" r"(?:\s*[,—\-]\s*(?P<rest>[^\n]+))?",
)
ROLES = ((r"\bkeynote\b", "keynote"), (r"\bsession\s+chair\b|\bchair\b", "session_chair"), (r"\bpanelist\b|\bpanel\b", "panelist"), (r"\bspeaker\b|\bpresenter\b", "speaker"))

#: Characters of aliases in one automaton; more aliases make further automata, and the texts are read once for each.
AUTOMATON_CHARACTERS = 1 << 23


def alias_signals(texts: DataFrame, institutions: DataFrame, most: int = AUTOMATON_CHARACTERS) -> DataFrame:
    """(id, school, degree, confidence): an education signal for each institution that a text (id, text) names by any alias.

    ``institutions`` is (canonical, kind, alias), rows of any number; a canonical name is an alias of itself. Aliases count
    without case and surrounding space, from three characters on, where neither neighbour is a letter or digit. Kinds without a
    degree give no signal. All aliases are compiled to one Aho-Corasick automaton, so a text is walked once whatever their
    number; it is broadcast after its size is known, and beyond ``most`` characters the aliases are dealt over several.
    """
    every = institutions.select("canonical", "kind", "alias").unionByName(institutions.select("canonical", "kind", F.col("canonical").alias("alias")))
    known = F.element_at(F.create_map(*[F.lit(x) for pair in DEGREES.items() for x in pair]), F.col("kind"))
    clean = every.filter("canonical <> ''").select("canonical", known.alias("degree"), F.lower(F.trim("alias")).alias("alias"))
    clean = stored(clean.filter((F.length("alias") >= SHORTEST_ALIAS) & F.col("degree").isNotNull()).distinct())
    size = clean.agg(F.coalesce(F.sum(F.length("alias") + F.length("canonical")), F.lit(0)).alias("n")).first()["n"]
    parts = max(1, math.ceil(size / most))
    out = None
    for part in range(parts):
        owners: dict[str, list[tuple[str, str]]] = {}
        for r in clean.filter(F.pmod(F.xxhash64("alias"), F.lit(parts)) == part).collect():  # at most about ``most`` characters
            owners.setdefault(r["alias"], []).append((r["canonical"], r["degree"]))
        found = texts.select("id", "text").filter("text <> ''").mapInArrow(_walk(texts, owners), f"id {texts.schema['id'].dataType.simpleString()}, school string, degree string")
        out = found if out is None else out.unionByName(found)
    return out.distinct().withColumn("confidence", F.lit(MINED_CONFIDENCE))


def _walk(texts: DataFrame, owners: dict[str, list[tuple[str, str]]]):
    automaton = ahocorasick.Automaton()
    for alias, own in owners.items():
        automaton.add_word(alias, (len(alias), own))
    automaton.make_automaton()
    held = texts.sparkSession.sparkContext.broadcast(automaton)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = held.value
        for batch in batches:
            rows, schools, degrees = [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                low, hits = text.lower(), set()
                for end, (n, own) in automaton.iter(low) if len(automaton) else ():
                    first = end - n + 1
                    if (first == 0 or not low[first - 1].isalnum()) and (end + 1 == len(low) or not low[end + 1].isalnum()):
                        hits.update(own)
                rows += [i] * len(hits)
                schools += [h[0] for h in hits]
                degrees += [h[1] for h in hits]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows, pa.int64())), pa.array(schools, pa.string()), pa.array(degrees, pa.string())], ["id", "school", "degree"])

    return walk


def _text_of(v: Column) -> Column:
    """A scalar variant as stripped text; null for others and for empty text."""
    kind, text = F.schema_of_variant(v), F.try_variant_get(v, "$", "string")
    scalar = kind.rlike("^(STRING|BIGINT|DOUBLE|FLOAT|DECIMAL)")
    said = F.when(scalar, F.regexp_replace(text, r"(?U)^\s+|\s+$", "")).when(kind == "BOOLEAN", F.initcap(text))
    return F.nullif(said, F.lit(""))


def _first_of(v: Column, keys: tuple[str, ...]) -> Column:
    return F.coalesce(*[_text_of(F.try_variant_get(v, f"$.{k}", "variant")) for k in keys])


def looks_like_name(name: Column) -> Column:
    """Whether a text has two or more words, one of them a capitalised one, and none that only companies and titles have."""
    words = F.filter(F.split(name, r"(?U)\s+"), lambda w: w != "")
    plain = F.transform(words, lambda w: F.regexp_replace(F.lower(w), r"^[.,]+|[.,]+$", ""))
    return (F.length(name) >= 3) & (F.size(words) >= 2) & F.exists(words, lambda w: w.rlike(r"^[A-Z][a-zA-Z\-']+$")) & ~F.exists(plain, lambda w: w.isin(*NOT_NAMES))


def payload_mentions(payloads: DataFrame) -> DataFrame:
    """(id, name, title, company) of the people that JSON payloads (id, payload) mention.

    A payload is an object that names a person, holds people in an array under a known key (they take the object's company where they
    have none), or both; or an array of such payloads, nested to any depth, whose items may be JSON as text. What isn't JSON
    mentions nobody. Payloads become variants; a round unnests the arrays of one depth, and rounds end when no array is left.
    """
    level = payloads.select("id", F.try_parse_json("payload").alias("v")).filter("v IS NOT NULL")
    found = None
    while True:
        level = stored(level.select("id", F.to_json("v").alias("payload"), F.schema_of_variant("v").alias("kind")))
        items = level.select("id", "kind", F.parse_json("payload").alias("v"))
        objects = items.filter(F.col("kind").startswith("OBJECT"))
        own = objects.select("id", *(_first_of(F.col("v"), keys).alias(c) for c, keys in (("name", NAME_KEYS), ("title", TITLE_KEYS), ("company", COMPANY_KEYS))))
        people = F.flatten(F.array(*[F.coalesce(F.try_variant_get("v", f"$.{k}", "array<variant>"), F.array().cast("array<variant>")) for k in PEOPLE_KEYS]))
        person = objects.select("id", _first_of(F.col("v"), COMPANY_KEYS).alias("c"), F.explode(people).alias("p")).filter(F.schema_of_variant("p").startswith("OBJECT"))
        inner = person.select("id", _first_of(F.col("p"), NAME_KEYS).alias("name"), _first_of(F.col("p"), TITLE_KEYS).alias("title"), F.coalesce(_first_of(F.col("p"), COMPANY_KEYS), F.col("c")).alias("company"))
        now = own.unionByName(inner).filter(looks_like_name(F.col("name")))
        found = now if found is None else found.unionByName(now)
        arrays = items.filter(F.col("kind").startswith("ARRAY"))
        if arrays.isEmpty():
            return found
        item = F.col("value")
        text = F.schema_of_variant(item) == "STRING"
        level = arrays.lateralJoin(arrays.sparkSession.tvf.variant_explode(F.col("v").outer())).select("id", F.when(text, F.try_parse_json(F.try_variant_get(item, "$", "string"))).otherwise(item).alias("v")).filter("v IS NOT NULL")


def _spoken(text: str) -> str:
    m = re.search(YEARS, text, re.IGNORECASE)
    if m is None:
        return "unknown"
    return f"{m['start']}-{m['end']}" if m["start"] else f"{m['since']}-present" if m["since"] else m["single"]


def _is_name(name: str) -> bool:
    words = name.split()
    return len(words) >= 2 and all(len(w) >= 2 for w in words)


class _Headers:
    """Places and texts of the headers of a page; ``above(i)`` is the last one that begins at i or before."""

    def __init__(self, text: str, pattern: str, group: str):
        hits = [(m.start(), m[group].strip()) for m in re.finditer(pattern, text, re.MULTILINE)]
        self.at, self.names = [p for p, _ in hits], [n for _, n in hits]
        self.places = set(self.at)

    def above(self, i: int, default: str | None) -> str | None:
        k = bisect_right(self.at, i)
        return self.names[k - 1] if k else default


@F.udtf(returnType="committee string, member string, years string")
class RosterRows:
    """A row for each member line of a roster: its nearest header before (else ``body``) and the first years within 200 characters of it."""

    def eval(self, markdown: str, body: str):
        headers = _Headers(markdown or "", COMMITTEE_HEADER, "name")
        for m in re.finditer(MEMBER_LINE, markdown or "", re.MULTILINE):
            name, at = m["name"].strip(), m.start()
            if _is_name(name) and at not in headers.places:
                yield headers.above(at, body), name, _spoken(markdown[max(0, at - YEARS_WINDOW) : at + YEARS_WINDOW])


@F.udtf(returnType="session string, speaker string, role string")
class ProgramRows:
    """A row for each speaker line of a program: its nearest header before (null: none) and the role that the rest of the line tells."""

    def eval(self, markdown: str):
        headers, seen = _Headers(markdown or "", SESSION_HEADER, "title"), set()
        for pattern in SPEAKER_LINES:
            for m in re.finditer(pattern, markdown or "", re.MULTILINE):
                name, at = m["name"].strip(), m.start()
                if at in seen or not _is_name(name) or at in headers.places:
                    continue
                seen.add(at)
                rest = m.groupdict().get("rest") or ""
                yield headers.above(at, None), name, next((role for p, role in ROLES if re.search(p, rest, re.IGNORECASE)), "speaker")


def roster_members(pages: DataFrame) -> DataFrame:
    """(id, committee, member, years) of rosters (id, body, markdown)."""
    return pages.lateralJoin(RosterRows(F.col("markdown").outer(), F.col("body").outer())).select("id", "committee", "member", "years")


def program_speakers(pages: DataFrame) -> DataFrame:
    """(id, session, speaker, role) of programs (id, markdown)."""
    return pages.lateralJoin(ProgramRows(F.col("markdown").outer())).select("id", "session", "speaker", "role")


def name_index(persons: DataFrame) -> DataFrame:
    """(folded, person_id) of persons (person_id, folded): a folded name that several have is the last one's, by id."""
    return persons.filter("folded <> ''").groupBy("folded").agg(F.max("person_id").alias("person_id"))


def year_span(years: Column, first: int = 1950, last: int = 2100) -> Column:
    """Struct (start, end) of a roster's years: a range, an open range or a single year; null beyond the limits."""
    said = F.trim(F.coalesce(years, F.lit("")))
    year = lambda pattern, i: F.regexp_extract(said, pattern, i).try_cast("int")
    held = lambda y: F.when(y.between(first, last), y)
    return F.struct(held(year(r"^(\d{4})", 1)).alias("start"), held(year(r"^\d{4}\s*[-–—]\s*(\d{4})$", 1)).alias("end"))


def memberships(members: DataFrame, persons: DataFrame) -> DataFrame:
    """(person_id, organization, committee, start_year, end_year) of roster rows (organization, committee, folded, years) whose name is known.

    One row for a person, organization, committee and start year (none counts as 0), the earliest end staying.
    """
    rows = members.join(name_index(persons), "folded").select("person_id", "organization", "committee", year_span(F.col("years")).alias("y"))
    rows = rows.select("person_id", "organization", "committee", F.coalesce("y.start", F.lit(0)).alias("s"), "y.end")
    return rows.groupBy("person_id", "organization", "committee", "s").agg(F.min("end").alias("end_year")).select(
        "person_id", "organization", "committee", F.nullif("s", F.lit(0)).alias("start_year"), "end_year"
    )
