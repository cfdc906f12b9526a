"""Column functions over text, numbers and years."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def first_of(*values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values))


def contains_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(w) for w in words)) if words else F.lit(False)


def normalise(text: Column) -> Column:
    """Lower case, trimmed, plain quotes, single spaces."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(text), r"^\s+|\s+$", ""), "[’‘“”]", "'"), r"\s+", " ")


def normalise_tag(tag: Column) -> Column:
    return F.translate(F.lower(tag), ":_ ", "")


def humanise_tag(tag: Column) -> Column:
    """A tag without its prefix, its words apart, in lower case."""
    name = F.regexp_replace(tag, "^[^:]*:", "")
    return F.trim(F.lower(F.regexp_replace(name, "(?<!^)(?=[A-Z])", " ")))


def aliases(humanised: Column) -> Column:
    """Other names of a humanised tag; an empty array without any."""
    known = F.create_map(*(F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for pair in L.ALIASES.items() for x in pair))
    return F.coalesce(known[humanised], F.array().cast("array<string>"))


def parse_numeric(text: Column) -> Column:
    """A cell's number: (x) is negative; $, commas, spaces and a final % are dropped; else null."""
    s = F.trim(text)
    negative = s.rlike(r"^\(.*\)$")
    bare = F.regexp_replace(F.regexp_replace(F.when(negative, F.substring(s, 2, 1 << 30)).otherwise(s), r"\)$", ""), r"[$,\s]", "")
    bare = F.regexp_replace(bare, "%+$", "")
    value = F.when(bare.rlike(NUMBER), bare.try_cast("double"))
    return F.when(negative, -value).otherwise(value)


def query_year(text: Column) -> Column:
    """FY and four digits, from the first year pattern that matches; null without one."""
    return norm_year(normalise(text))


def norm_year(norm: Column) -> Column:
    """query_year of a text that is normalised already."""
    years = F.filter(F.array(*(F.regexp_extract(norm, p, 1) for p in L.FISCAL_YEARS)), lambda y: y != "")
    return F.get(F.transform(years, lambda y: F.concat(F.when(F.length(y) == 2, "FY20").otherwise("FY"), y)), 0)


def answer_year(text: Column) -> Column:
    year = first_of(*(F.regexp_extract(text, f"(?i)FY\\s*(20\\d{{2}})|fiscal\\s*(?:year\\s*)?(20\\d{{2}})|(20\\d{{2}})", k) for k in (1, 2, 3)))
    return F.concat(F.lit("FY"), year)


def query_unit(text: Column) -> Column:
    out = None
    for name, p in L.UNITS.items():
        hit = text.rlike("(?i)" + p)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("units")


def metric_place(norm: Column) -> Column:
    """The place, from 1 on, of the first metric whose pattern the normalised question matches; 0 without one."""
    return F.array_position(F.array(*(norm.rlike("(?i)" + p) for p in L.METRICS.values())), F.lit(True)).cast("int")


def metric(norm: Column, place: Column | None = None) -> Column:
    """The name of that metric; null without one. place: metric_place, where it is known."""
    return F.get(F.array(*map(F.lit, L.METRICS)), (metric_place(norm) if place is None else place) - 1)


def metric_text(norm: Column, place: Column | None = None) -> Column:
    """What that pattern matched, normalised."""
    pattern = F.get(F.array(*(F.lit("(?i)" + p) for p in L.METRICS.values())), (metric_place(norm) if place is None else place) - 1)
    return normalise(F.regexp_substr(norm, pattern))


def numbers(text: Column, pattern: str = r"\$?([\d,]+(?:\.\d+)?)", cap: int | None = 10, positive: bool = True) -> Column:
    """Numbers written in a text, in order, up to cap."""
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double"))
    found = F.filter(found, lambda x: x.isNotNull() & ((x > 0) if positive else F.lit(True)))
    return found if cap is None else F.slice(found, 1, cap)


def first_digit(value: Column) -> Column:
    """The first significant digit of a number other than zero."""
    a = F.abs(value)
    d = F.substring(F.regexp_replace(F.format_string("%.9e", a), "[^0-9]", ""), 1, 1).cast("int")
    return F.when((a > 0) & d.between(1, 9), d)


def core_answer(answer: Column) -> Column:
    """An answer's bare claim: without brackets, up to the first . ! or ?, its first number or 100 characters."""
    core = F.trim(F.element_at(F.split(F.regexp_replace(answer, r"\[.*?\]", ""), "[.!?]"), 1))
    number = F.regexp_replace(F.regexp_extract(core, r"\$?[\d,]+(?:\.\d+)?", 0), "[$,]", "")
    has = core.rlike(r"[\d,]")
    return F.when(has, number).otherwise(F.trim(F.lower(F.substring(core, 1, 100))))


def relative_gap(a: Column, b: Column) -> Column:
    """|a - b| over the larger magnitude: 0 if both are zero, 1 if one is."""
    return F.when((a == 0) & (b == 0), 0.0).when((a == 0) | (b == 0), 1.0).otherwise(F.abs(a - b) / F.greatest(F.abs(a), F.abs(b)))


def answers_agree(a: Column, b: Column) -> Column:
    """Core answers: numbers within 1 %, else equal first 50 characters; empty ones never agree."""
    x, y = (F.when(v.rlike(NUMBER), v.try_cast("double")) for v in (a, b))
    text = F.trim(F.lower(F.substring(a, 1, 50))) == F.trim(F.lower(F.substring(b, 1, 50)))
    return F.when((F.length(a) == 0) | (F.length(b) == 0) | a.isNull() | b.isNull(), False).when(x.isNotNull() & y.isNotNull(), relative_gap(x, y) < 0.01).otherwise(text)


def primary_number(text: Column) -> Column:
    return F.element_at(F.concat(numbers(text, positive=False), F.array(F.lit(None).cast("double"))), 1)


def answers_agree_loose(a: Column, b: Column) -> Column:
    """Whole answers: first numbers within 5 %, else 60 % of the shorter one's words in common."""
    x, y = primary_number(a), primary_number(b)
    stops = F.array(*map(F.lit, L.ANSWER_STOPS))
    u, v = (F.array_except(F.filter(F.split(F.trim(F.lower(t)), r"\s+"), lambda w: w != ""), stops) for t in (a, b))
    shorter = F.least(F.size(u), F.size(v))
    words = F.when(shorter > 0, F.size(F.array_intersect(u, v)) / shorter >= 0.6).otherwise(False)
    return F.when(x.isNotNull() & y.isNotNull(), relative_gap(x, y) <= 0.05).otherwise(words)


def long_words(text: Column) -> Column:
    """Different lower-case words of more than three letters or digits."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), F.lit(0)), lambda w: F.length(w) > 3))


def word_overlap(answer: Column, context: Column) -> Column:
    """The share of an answer's long words that its context has."""
    a = long_words(answer)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, long_words(context))), F.size(a)), F.lit(0.0))


def jaccard_words(a: Column, b: Column) -> Column:
    x, y = (F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit(r"(?U)\w+"), F.lit(0))) for t in (a, b))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.lit(0.0))


def ratio(a: Column, b: Column) -> Column:
    """a / b to six places; null where b is zero."""
    return F.round(F.try_divide(a, b), 6)


def role(speaker: Column) -> Column:
    s = F.lower(speaker)
    pairs = [("CEO", ["ceo", "chief executive"]), ("CFO", ["cfo", "chief financial"]), ("COO", ["coo", "chief operating"]), ("Analyst", ["analyst"]), ("Operator", ["operator"])]
    out = None
    for name, words in pairs:
        hit = contains_any(s, words)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("Executive")


def cache_key(api: Column, params: Column) -> Column:
    """32 hexadecimal digits of a request's name and its parameters as sorted JSON."""
    return F.substring(F.sha2(F.concat(api, F.lit(":"), params), 256), 1, 32)


def freshness_by_age(seconds: Column) -> Column:
    return F.when(seconds.isNull(), "UNVERIFIED").when(seconds <= L.LIVE, "LIVE_VERIFIED").when(seconds <= L.RECENT, "RECENT_24H").when(seconds <= L.STALE, "STALE_7D").otherwise("OLD")


def ttl(kind: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in L.TTL.items() for x in pair))
    return F.coalesce(known[kind], F.lit(L.TTL["default"]))


def freshness_by_ttl(kind: Column) -> Column:
    return freshness_by_age(ttl(kind))


def doc_metadata(text: Column) -> dict[str, Column]:
    """company, doc_type, fiscal_year from a filing's first pages."""
    flat = F.replace(F.replace(F.upper(F.substring(text, 1, 3000)), F.lit("-"), F.lit("")), F.lit(" "), F.lit(""))
    kind = None
    for d in L.DOC_TYPES:
        hit = flat.contains(d.replace("-", ""))
        kind = F.when(hit, d) if kind is None else kind.when(hit, d)
    year = first_of(*(F.regexp_extract(F.substring(text, 1, 5000), p, 1) for p in L.FILING_YEARS))
    return {
        "company": F.trim(F.regexp_extract(F.substring(text, 1, 2000), L.COMPANY, 1)),
        "doc_type": kind.otherwise("UNKNOWN"),
        "fiscal_year": F.coalesce(F.concat(F.lit("FY"), year), F.lit("")),
    }


def section_type(name: Column) -> Column:
    low, out = F.lower(name), None
    for word, kind in L.SECTIONS.items():
        hit = low.contains(word)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("Other")


def answer_format(value: Column, numeric: Column, unit: Column, citation: Column) -> Column:
    """value [unit] [citation]; negative numbers get a minus for their parentheses."""
    shown = F.when((numeric < 0) & ~value.startswith("-"), F.concat(F.lit("-"), F.regexp_replace(value, r"^[()]+|[()]+$", ""))).otherwise(value)
    names = F.create_map(*(F.lit(x) for pair in L.UNIT_NAMES.items() for x in pair))
    friendly = F.coalesce(names[unit], unit, F.lit(""))
    return F.concat(shown, F.when(~friendly.isin("", "units"), F.concat(F.lit(" "), friendly)).otherwise(""), F.lit(" ["), citation, F.lit("]"))
