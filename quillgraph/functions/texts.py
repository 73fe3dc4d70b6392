"""Text columns: titles, names, companies, years, phrases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ordered rules from title words to functional domain (first hit wins).
DOMAIN_RULES = [
    (r"\bresearch\b|\bscientist\b|\badvanced development\b|\bpathfinding\b", "research"),
    (r"\bchief technology officer\b|\bchief information officer\b|\bchief information security officer\b|\bchief security officer\b", "software_engineering"),
    (r"\bchief financial officer\b", "finance_legal"),
    (r"\bchief marketing officer\b|\bchief revenue officer\b|\bchief sales officer\b|\bchief commercial officer\b|\bchief growth officer\b", "sales_marketing"),
    (r"\bchief people officer\b|\bchief human resources officer\b|\bchief talent officer\b|\bchief diversity officer\b", "people_ops"),
    (r"\bchief product officer\b", "product_management"),
    (r"\bchief operating officer\b|\bchief executive officer\b|\bchief of staff\b", "general_management"),
    (r"\bgeneral manager\b|\bp&l\b|\bbusiness unit\b|\bpresident\b|\bGM,\b|\bCEO\b|\bCOO\b|\bco[- ]?founder\b|\bfounder\b", "general_management"),
    (r"\bCTO\b|\bCIO\b|\bCISO\b|\bCSO\b", "software_engineering"),
    (r"\bCMO\b|\bCRO\b|\bCCO\b", "sales_marketing"),
    (r"\b(?:chip|silicon|RTL|verification|physical design|analog|mixed[- ]signal|memory design|SoC|microarchitecture|fabric|hardware engineer|hardware design|ASIC|FPGA)\b", "hardware_engineering"),
    (r"\b(?:manufacturing|operations|supply chain|yield|process engineer|fab|foundry|quality|reliability|inventory control|team lead(?:er)?|chef d['’]?équipe|operaio|ingenier[oa] en manufactura|ingénieur (?:de )?production|production engineer|maintenance planner)\b", "manufacturing_ops"),
    (r"\b(?:software engineer|firmware|embedded|SDK|driver|BSP|developer|programmer|backend|frontend|fullstack|full stack|AI compiler|ML compiler|compiler engineer|machine learning engineer|infrastructure engineer|platform engineer|member of (?:the )?technical staff|MTS)\b", "software_engineering"),
    (r"\b(?:product manager|product management|TPM|technical program manager|program manager|roadmap|principal pm|product lead)\b", "product_management"),
    (r"\b(?:sales|marketing|business development|BD lead|GTM|go-to-market|account manager|partnerships|partner manager)\b", "sales_marketing"),
    (r"\b(?:finance|legal|compliance|accounting|tax|controller|CFO|general counsel)\b", "finance_legal"),
    (r"\b(?:HR|human resources|recruiting|people operations|talent|culture lead)\b", "people_ops"),
    (r"\b(?:engineer|architect|engineering)\b", "hardware_engineering"),
]

# Ordered rules from title words to seniority (first hit wins).
SENIORITY_RULES = [
    (r"\bchair(?:man|woman|person)?\b(?:[\s,].*\bof the board\b)?", 95),
    (r"\bCEO\b|\bchief executive officer\b", 100),
    (r"\bpresident\b", 95),
    (r"\bCOO\b|\bCTO\b|\bCFO\b|\bCPO\b|\bCRO\b|\bCMO\b|\bCIO\b|\bCISO\b|\bCSO\b|\bCCO\b", 90),
    (r"\bchief\s+\w+\s+officer\b", 88),
    (r"\bEVP\b|\bexecutive vice president\b", 82),
    (r"\bSVP\b|\bsenior vice president\b", 80),
    (r"\bgroup VP\b|\bgroup vice president\b", 72),
    (r"\bVP\b|\bvice president\b", 70),
    (r"\bhead of\b", 65),
    (r"\bprincipal director\b", 63),
    (r"\bsenior director\b", 62),
    (r"\bdirector\b", 60),
    (r"\bdistinguished engineer\b", 55),
    (r"\bgroup manager\b|\bsenior manager\b", 52),
    (r"\bengineering manager\b|\bmanager\b", 50),
    (r"\bprincipal engineer\b", 48),
    (r"\bprincipal\b", 48),
    (r"\bstaff engineer\b", 45),
    (r"\bsenior engineer\b|\bsenior software engineer\b|\bsenior hardware engineer\b", 40),
    (r"\bsenior\b", 40),
    (r"\bmember of technical staff\b|\bMTS\b", 40),
    (r"\bengineer\b|\bdeveloper\b|\bdesigner\b", 35),
]

# The earlier, shorter rules of seniority and domain (first hit wins).
EARLIER_SENIORITY_RULES = [
    (r"\bceo\b|chief executive officer", 100),
    (r"\bc(t|o|f|p|r)o\b|chief (technology|operating|financial|product|revenue) officer", 89),
    (r"\bevp\b|executive vice president", 82),
    (r"\bsvp\b|senior vice president", 80),
    (r"group vp", 72),
    (r"\bvp\b|vice president", 70),
    (r"\bpresident\b", 95),
    (r"principal director", 63),
    (r"senior director", 62),
    (r"\bdirector\b", 60),
    (r"distinguished engineer", 55),
    (r"senior manager|group manager", 52),
    (r"engineering manager|\bmanager\b", 50),
    (r"principal engineer", 48),
    (r"staff engineer", 45),
    (r"\bsenior\s+(?:[\w-]+\s+){0,3}engineer\b", 40),
    (r"\bengineer\b|\barchitect\b", 35),
]
EARLIER_DOMAIN_RULES = [
    (r"\b(rtl|verification|physical design|analog|mixed signal|memory design|soc|chip|silicon|hardware|fpga|asic)\b", "hardware_engineering"),
    (r"\b(software|firmware|embedded|sdk|driver|bsp|backend|frontend|full[- ]?stack|devops|sre|platform)\b", "software_engineering"),
    (r"\b(product manager|program manager|tpm|product owner|roadmap)\b", "product_management"),
    (r"\b(human resources|recruiting|people operations|culture|\bhr\b)\b", "people_ops"),
    (r"\b(manufacturing|operations|supply chain|yield|process|fab|foundry|quality|reliability)\b", "manufacturing_ops"),
    (r"\b(sales|marketing|gtm|account management|partnerships|business development|\bbd\b)\b", "sales_marketing"),
    (r"\b(research|advanced development|pathfinding|exploratory|scientist)\b", "research"),
    (r"\b(finance|legal|compliance|accounting|tax|controller)\b", "finance_legal"),
    (r"\bgeneral manager\b|\bgm\b|business unit|p&l", "general_management"),
]

# Phrases that name a manager, with the confidence of each.
REPORTING_RULES = [
    (r"reports\s+(?:directly\s+)?to\s+(?:the\s+)?([A-Z][^,.]+(?:Officer|President|Director|VP|Head|Manager|Lead))", 0.88),
    (r"reporting\s+line\s+to\s+([A-Z][^,.]+)", 0.85),
    (r"will\s+work\s+(?:closely\s+)?(?:with|under)\s+([A-Z][^,.]+)\s*,\s*(?:the\s+)?(?:VP|SVP|Director|Head)", 0.75),
    (r"dotted\s+line\s+to\s+([A-Z][^,.]+)", 0.70),
    (r"(?:direct|indirect)\s+report\s+to\s+([A-Z][^,.]+)", 0.82),
    (r"management\s+chain.*?(?:VP|SVP|Director|Head)\s+of\s+([^,.]+)", 0.65),
]

# Words dropped from a company key, roles that speak at an event.
COMPANY_KEY_WORDS = r"\b(corp\.?|corporation|inc\.?|incorporated|limited|ltd\.?|llc|plc|technologies|technology|semiconductor|semiconductors?|systems?)\b"
SPEAKING_ROLES = ["presenter", "panelist", "session_chair", "keynote", "speaker"]

# Titles of the parallel individual track, and words of a manager's title.
IC_TITLES = (
    r"\b(distinguished engineer|principal engineer|staff engineer|chief architect|principal architect"
    r"|principal scientist|distinguished scientist|fellow|distinguished researcher)\b"
)
MANAGER_TITLES = r"\b(manager|director|VP|head of|lead)\b"

# Degrees to the kind of cohort (first hit wins; anything else is undergraduate).
DEGREE_RULES = [
    (r"\b(mba|m\.b\.a|master of business)\b", "same_mba_cohort"),
    (r"\b(ph\.?d|d\.phil|doctorate|doctoral)\b", "same_phd_program"),
    (r"\b(exec(utive)?\s+ed(ucation)?|certificate|executive\s+program|pgp)\b", "executive_education"),
]

# Affixes of personal names and companies.
NAME_PREFIX = r"^(?:Dr\.?|Mr\.?|Mrs\.?|Ms\.?|Prof\.?)\s+"
NAME_SUFFIX = r"\s*,?\s*(?:Jr\.?|Sr\.?|II|III|IV|V|Ph\.?D\.?|Ed\.?D\.?|M\.?D\.?|Esq\.?|CFA|CPA)\s*$"
MIDDLE_INITIAL = r"\s+[A-Z]\.?\s+"
COMPANY_SUFFIX = r"\s*[,.]?\s*(?:Inc\.?|Incorporated|Corp\.?|Corporation|LLC|L\.L\.C\.|Limited|Ltd\.?|Co\.?|Company|plc|PLC|GmbH|S\.A\.?|NV|N\.V\.|AG|SE|SA)\s*$"


def first_hit(text: Column, rules: list[tuple[str, object]], default=None) -> Column:
    """Value of the first rule whose pattern is found, ignoring case."""
    out = F.lit(default)
    for pattern, value in reversed(rules):
        out = F.when(text.rlike(f"(?iU){pattern}"), F.lit(value)).otherwise(out)
    return F.when(text.isNotNull() & (text != ""), out).otherwise(F.lit(default))


def domain_from_title(title: Column) -> Column:
    """Functional domain of a job title, or null."""
    return first_hit(title, DOMAIN_RULES)


def seniority_from_title(title: Column) -> Column:
    """Seniority score of a job title, or null."""
    return first_hit(title, SENIORITY_RULES).cast("int")


def is_ic_track(title: Column) -> Column:
    """Whether a title is on the individual track."""
    return F.coalesce(title.rlike(f"(?iU){IC_TITLES}"), F.lit(False))


def is_manager_title(title: Column) -> Column:
    """Whether a title reads like a manager's."""
    return F.coalesce(title.rlike(f"(?iU){MANAGER_TITLES}"), F.lit(False))


def degree_kind(degree: Column) -> Column:
    """Kind of cohort that a degree makes."""
    return first_hit(degree, DEGREE_RULES, "same_undergrad_cohort")


def name_parts(name: Column) -> Column:
    """Struct (first, last) without prefix, suffix and middle initials; empty for a single word."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(name), NAME_PREFIX, ""), f"(?i){NAME_SUFFIX}", "")
    clean = F.trim(F.regexp_replace(F.regexp_replace(bare, MIDDLE_INITIAL, " "), r"\s+", " "))
    parts = F.split(clean, " ")
    ok = F.size(parts) >= 2
    return F.struct(F.when(ok, parts[0]).otherwise("").alias("first"), F.when(ok, F.element_at(parts, -1)).otherwise("").alias("last"))


def company_name(name: Column) -> Column:
    """Company name without its legal suffix."""
    stripped = F.trim(F.regexp_replace(F.trim(name), f"(?i){COMPANY_SUFFIX}", ""))
    return F.when(stripped == "", F.trim(name)).otherwise(stripped)


def year_range(text: Column) -> Column:
    """Struct (start, end) of a text like 2018-2022, 2018-present or 1993."""
    years = F.regexp_extract_all(text, F.lit(r"\b((?:19|20)\d{2})\b"), F.lit(1))
    at = lambda i: F.try_element_at(years, F.lit(i)).cast("int")
    return F.struct(at(1).alias("start"), at(2).alias("end"))


def slug(text: Column) -> Column:
    """Lower-case words joined by dashes."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def company_key(name: Column) -> Column:
    """Lower-case company name without legal and generic words and punctuation; empty for null."""
    bare = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), f"(?U){COMPANY_KEY_WORDS}", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?U)[^\w\s]+", " "), r"\s+", " "))


def company_node_key(name: Column) -> Column:
    """Key of a company's node: generic words gone, then anything but letters and digits one space; empty for null."""
    bare = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), f"(?U){COMPANY_KEY_WORDS}", "")
    return F.trim(F.regexp_replace(bare, r"[^\p{L}\p{N}]+", " "))


# What a role and an event are freed of.
ROLE_COMPANY = r"\s+at\s+.+$"
ROLE_REST = r"(?:\s+[|·/]\s+|\s+[—–-]\s+).*$"
EVENT_YEAR = r"\b(19|20)\d{2}\b"
EVENT_END = r"[\s,.;:!?\-_/\\]+$"


def role_text(raw: Column, longest: int = 28) -> Column:
    """A role without its company and what follows a separator, cut to ``longest`` characters."""
    bare = F.regexp_replace(F.trim(F.coalesce(raw, F.lit(""))), f"(?i){ROLE_COMPANY}", "")
    bare = F.regexp_replace(bare, ROLE_REST, "")
    bare = F.trim(F.regexp_replace(F.regexp_replace(bare, r"\s+", " "), r"[,;:.]+$", ""))
    return F.when(F.length(bare) > longest, F.concat(F.rtrim(F.substring(bare, 1, longest - 1)), F.lit("…"))).otherwise(bare)


def event_name(event: Column) -> Column:
    """Lower-case event name without years and trailing punctuation; empty for null."""
    bare = F.regexp_replace(F.lower(F.trim(F.coalesce(event, F.lit("")))), EVENT_YEAR, " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, EVENT_END, ""), r"\s+", " "))


def event_year(text: Column, first: int = 1990, last: int = 2030) -> Column:
    """The first year in a text, null outside the range."""
    year = F.regexp_extract(text, r"(19|20)\d{2}", 0).try_cast("int")
    return F.when(year.between(first, last), year)


def clamped(value: Column) -> Column:
    """A number out of text, between 0 and 1; 0 where there is none."""
    number = F.coalesce(value.try_cast("double"), F.lit(0.0))  # before the limits, as least and greatest pass over nulls
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), number))


def appearance_kind(a: Column, b: Column) -> Column:
    """Kind of link between two roles at one event: presenters only if both speak."""
    speaks = lambda c: F.lower(F.trim(c)).isin(SPEAKING_ROLES)
    return F.when(speaks(a) & speaks(b), "conference_co_presenter").otherwise("conference_co_attendee")


# Kinds of study by what a degree holds (first hit wins), in two wordings, and legal forms of employers.
STUDY_RULES = [
    (r"mba|master of business administration", "mba"),
    (r"phd|ph\.d|ph\. d|doctor of philosophy|doctorate", "phd"),
    (r"executive", "exec_ed"),
    (r"bachelor|undergraduate|b\.s\.|b\.a\.|\bb\.?s\b|\bb\.?a\b", "undergrad"),
    (r"master|m\.s\.|m\.a\.|ms\.|\bm\.?s\b|\bm\.?a\b", "masters"),
]
LISTED_STUDY_RULES = [
    (r"executive|(^|\s)amp(\s|$)", "exec_ed"),
    (r"emba", "emba"),
    (r"mba|master of business", "mba"),
    (r"phd|doctorate|doctor of philosophy", "phd"),
    (r"ms( |$)|master of science| ms", "ms"),
    (r"bs( |$)|bachelor| ba( |$)", "bs"),
]
EMPLOYER_FORM = r"[\s,]+(?:inc|llc|ltd|limited|corp|corporation|co|company|plc|gmbh|ag|sa|s\.a\.|nv|n\.v\.|bv|b\.v\.|kk|kgaa)\.?$"


def _without_ends(name: Column, form: str | None = None) -> Column:
    """Lower-case name without a leading article, one ending ``form`` and trailing punctuation; empty for null."""
    bare = F.regexp_replace(F.lower(F.trim(F.coalesce(name, F.lit("")))), "^the ", "")
    bare = bare if form is None else F.regexp_replace(bare, form, "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, EVENT_END, ""), r"\s+", " "))


def school_key(name: Column) -> Column:
    """Key under which a school's names are one, before its aliases."""
    return _without_ends(name)


def employer_key(name: Column) -> Column:
    """Key under which an employer's names are one, without its legal form and before its aliases."""
    return _without_ends(name, EMPLOYER_FORM)


def study_kind(degree: Column) -> Column:
    """mba, phd, exec_ed, undergrad or masters by the wording of a degree, else null."""
    return first_hit(F.trim(degree), STUDY_RULES)


def listed_study_kind(degrees: Column, school_default: Column) -> Column:
    """Kind of study of a list of degrees: that of the school if it has one, else by their joint wording; null if neither tells."""
    joint = F.lower(F.array_join(F.filter(degrees, lambda d: d.isNotNull()), " "))
    return F.coalesce(school_default, first_hit(joint, LISTED_STUDY_RULES))


# Kinds of companies by words of the industry and of the name (first hit wins).
COMPANY_TIERS = [
    ("defense", r"defense", r"lockheed|raytheon|northrop|boeing|northrop grumman|general dynamics|saic|leidos|booz allen|palantir|anduril"),
    ("aerospace", r"aerospace", r"spacex|airbus|blue origin|sierra space|maxar|rocket lab"),
    ("research_lab", r"research", r"lanl|llnl|sandia|ornl|nasa|argonne|brookhaven|nist|csail|deepmind|openai|anthropic"),
    ("semiconductor", r"semiconductor|chip", r"intel|amd|nvidia|tsmc|micron|qualcomm|broadcom|synopsys|cadence|asml|samsung electronics|stmicroelectronics|on semiconductor|onsemi|gf|globalfoundries|marvell|analog devices|texas instruments"),
]


def company_tier(industry: Column, name: Column) -> Column:
    """Tier of a company by its industry or whole words of its name, else ``other``."""
    i, n, out = F.lower(F.coalesce(industry, F.lit(""))), F.lower(F.coalesce(name, F.lit(""))), F.lit("other")
    for tier, trade, names in reversed(COMPANY_TIERS):
        out = F.when(i.rlike(trade) | n.rlike(rf"\b({names})\b"), tier).otherwise(out)
    return out


# Ordered patterns of press categories (first hit wins).
PRESS_RULES = [
    (r"\b(earnings|q[1-4]\s*(fy)?\s*(20)?\d{2}|(first|second|third|fourth)\s+quarter|fiscal\s+(year|quarter)|financial\s+results|quarterly\s+results|annual\s+results|reports\s+(first|second|third|fourth|q[1-4]|fy|fiscal|full[- ]year|quarterly|annual)|fy\s*(20)?\d{2}\s+results|full[- ]year\s+results)\b", "earnings"),
    (r"\b(partner(s|ed|ing)?\s+with|partnership|collaborat(e|es|ed|ing|ion)|joint\s+venture|alliance|teams?\s+up\s+with|join\s+forces|strategic\s+(deal|agreement|relationship)|expand(s|ed|ing)?\s+(its\s+)?(strategic\s+)?partnership)\b", "partnership"),
    (r"\b(unveil(s|ed|ing)?|launch(es|ed|ing)?|introduc(e|es|ed|ing)|announc(e|es|ed|ing)\s+(the\s+)?(availability|general\s+availability|release)|now\s+shipping|general\s+availability|releas(e|es|ed|ing)|debut(s|ed|ing)?|rolls?\s+out)\b", "product_launch"),
    (r"\b(research|publish(es|ed|ing)?|white\s*paper|benchmark(s|ed|ing)?|mlperf|academic|paper\s+accepted|stud(y|ies)|peer[- ]reviewed|conference\s+paper)\b", "research"),
]
EXECUTIVES_TOLD = 2


def press_kind(payload: Column) -> Column:
    """Category of a press payload (JSON text) by its headline, else ``co_mention_signal`` with two named executives or more, else ``general``.

    ``mentioned_executives`` holds names or objects with a ``name``; blank ones don't count.
    """
    v = F.try_parse_json(payload)
    is_a = lambda x, kind: F.schema_of_variant(x).startswith(kind)
    text = lambda x, path: F.when(is_a(F.try_variant_get(x, path, "variant"), "STRING"), F.try_variant_get(x, path, "string"))
    listed = F.try_variant_get(v, "$.mentioned_executives", "array<variant>")
    named = F.size(F.filter(listed, lambda x: F.trim(F.coalesce(text(x, "$"), text(x, "$.name"), F.lit(""))) != ""))
    by_headline = first_hit(F.lower(text(v, "$.headline")), PRESS_RULES)
    return F.coalesce(by_headline, F.when(named >= EXECUTIVES_TOLD, "co_mention_signal"), F.lit("general"))


# Where a title ends, wordings of titles in order, and lengths that suggest one.
TITLE_END = r"(?is)(\s*[|\u2013\u2014\-:;,]\s*|\s+at\s+).*$"
TITLE_WORDINGS = [(r"(?i)^vice president( of)?", "VP of"), (r"(?i)^sr\.?\s+director", "Senior Director"), (r"(?i)^sr\.?\s+vp", "SVP"), (r"(?i)^vp\s+(?!of\b)", "VP of ")]
TITLE_LENGTHS = (6, 70)


def canonical_title(raw: Column) -> Column:
    """Head of a title in one wording with capital initials; null for null and for heads shorter than 6 or longer than 70 characters."""
    head = F.regexp_replace(F.trim(F.regexp_replace(raw, TITLE_END, "")), r"\s+", " ")
    for pattern, wording in TITLE_WORDINGS:
        head = F.regexp_replace(head, pattern, wording)
    capital = F.transform(F.split(head, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 100)))
    return F.when(F.length(head).between(*TITLE_LENGTHS), F.array_join(capital, " "))
