"""Text, headings and facts of HTML filings: one pass over each page's markup, column expressions over what it gives."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import markup

# Font sizes of heading levels, the size of bold runs, and characters on a page.
SIZES = {1: 20.0, 2: 18.0, 3: 16.0, 4: 14.0, 5: 13.0, 6: 13.0}
BOLD, PAGE = 13.5, 5000
# Names of scales of inline facts.
SCALES = {"-2": "%", "-3": "thousand", "-6": "million", "-9": "billion"}


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, text, elements, facts, cells of pages (page_id, html), in one pass over each page (see markup).

    The text has a line for each piece, without scripts, styles, comments and tags. Null is an
    empty page. What is parsed already stays as it is, so that several readers can share one
    pass over a written table.
    """
    if "elements" in pages.columns:
        return pages
    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "html").mapInArrow(markup.read_batches, f"page_id {kind}, text string, elements {markup.ELEMENT}, facts {markup.FACT}, cells {markup.CELL}")


def _words(text: Column) -> Column:
    return F.size(F.split(text, r"\s+"))


def _listed(kept: Column, level: Callable, size: Callable, bold: Callable) -> Column:
    """Elements as headings, with the page that their first 30 characters stand on."""
    row = lambda e, i: F.struct(level(e).alias("level"), i.alias("pos"), e["text"].alias("text"), size(e).alias("font_size"), bold(e).alias("is_bold"), page_number(F.col("text"), F.substring(e["text"], 1, 30)).alias("page"))
    return F.transform(kept, row)


def _levels() -> Column:
    sizes = F.create_map(*(F.lit(x) for k in SIZES for x in (f"h{k}", SIZES[k])))
    kept = F.filter("elements", lambda e: e["tag"].rlike("^h[1-6]$") & F.length(e["text"]).between(3, 200))
    return _listed(kept, lambda e: F.substring(e["tag"], 2, 1).cast("int"), lambda e: sizes[e["tag"]], lambda e: F.lit(True))


def _bolds() -> Column:
    kept = F.filter("elements", lambda e: e["tag"].isin("b", "strong") & F.length(e["text"]).between(3, 120) & (_words(e["text"]) <= 12) & ~e["text"].rlike(r"^[\d\s,.\-$()]+$"))
    return _listed(kept, lambda e: F.lit(7), lambda e: F.lit(BOLD), lambda e: F.lit(True))


def _points(e: Column) -> Column:
    return F.regexp_extract(F.lower(e["style"]), r"font-size\s*:\s*([\d.]+)\s*pt", 1).try_cast("double")


def _weighty(e: Column) -> Column:
    weight = F.regexp_extract(F.lower(e["style"]), r"font-weight\s*:\s*(\w+)", 1)
    return F.coalesce(weight.isin("bold", "bolder") | F.coalesce(weight.try_cast("int") >= 600, F.lit(False)), F.lit(False))


def _styled() -> Column:
    def fits(e: Column) -> Column:
        text, words = e["text"], _words(e["text"])
        low = (text == F.lower(text)) & text.rlike("[a-z]") & (words > 3)
        return e["tag"].isin("span", "div", "p", "td") & F.coalesce((_points(e) >= 11) & (_weighty(e) | (_points(e) >= 14)), F.lit(False)) & F.length(text).between(3, 200) & (words <= 25) & ~text.rlike(r"^[\d\s,.\-$()%\\]+$") & ~low

    return _listed(F.filter("elements", fits), lambda e: F.lit(9), _points, _weighty)


def _markers() -> Column:
    kept = F.filter("elements", lambda e: e["tag"].isin("span", "div", "p", "a", "td") & (F.length(e["text"]) <= 30) & e["text"].rlike(r"(?i)^(?:PART\s+(?:I|II|III|IV|V|VI|VII|VIII|IX|X)|Item\s+\d{1,2}[A-Z]?\.)\s*$"))
    return _listed(kept, lambda e: F.lit(10), lambda e: F.lit(14.0), lambda e: F.lit(True))


def headings(pages: DataFrame, *kinds: Callable) -> DataFrame:
    """page_id, level, pos (order within a kind), text, font_size, is_bold, page of the kinds of headings, in one pass."""
    rows = F.concat(*(k() for k in kinds or (_levels, _bolds, _styled, _markers)))
    return parsed(pages).select("page_id", F.explode(rows).alias("h")).select("page_id", "h.*")


def level_headings(pages: DataFrame) -> DataFrame:
    """h1 to h6 of 3 to 200 characters."""
    return headings(pages, _levels)


def bold_headings(pages: DataFrame) -> DataFrame:
    """b and strong of 3 to 120 characters and up to 12 words, not just numbers; level 7."""
    return headings(pages, _bolds)


def page_headings(pages: DataFrame) -> DataFrame:
    """level_headings and bold_headings together."""
    return headings(pages, _levels, _bolds)


def styled_headings(pages: DataFrame) -> DataFrame:
    """Elements whose inline style is large and bold: 11pt and weight 600, or 14pt; level 9."""
    return headings(pages, _styled)


def section_markers(pages: DataFrame) -> DataFrame:
    """PART and Item markers of up to 30 characters, the first of equal ones; level 10."""
    one = headings(pages, _markers).groupBy("page_id", F.lower("text").alias("__k")).agg(F.min(F.struct("pos", "level", "text", "font_size", "is_bold", "page")).alias("f"))
    return one.select("page_id", "f.level", "f.pos", "f.text", "f.font_size", "f.is_bold", "f.page")


def ordered(headings: DataFrame) -> DataFrame:
    """headings with ord, their order by level and position."""
    return headings.withColumn("ord", F.row_number().over(Window.partitionBy("page_id").orderBy("level", "pos", "text")))


def dedupe_headings(headings: DataFrame, cap: int | None = None) -> DataFrame:
    """The first of headings that are equal in lower case; at most cap, where given."""
    w = Window.partitionBy("page_id", F.lower(F.trim("text"))).orderBy("ord")
    out = headings.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
    if cap is None:
        return out
    return out.withColumn("__n", F.row_number().over(Window.partitionBy("page_id").orderBy("ord"))).where(F.col("__n") <= cap).drop("__n")


def page_number(text: Column, snippet: Column) -> Column:
    """The page on which a snippet first stands, 5000 characters to a page; 1 if it does not."""
    at = F.instr(text, snippet)
    return F.greatest(F.lit(1), F.floor((at - 1) / PAGE).cast("int") + 1)


def _facts(pages: DataFrame, kind: str) -> DataFrame:
    kept = F.filter("facts", lambda f: f["kind"] == kind)
    return parsed(pages).select("page_id", F.posexplode(kept).alias("pos", "f")).select("page_id", "pos", "f.*").where("name <> '' and text <> ''")


def facts(pages: DataFrame) -> DataFrame:
    """page_id, pos, name, context, value, unit, scaled of inline numeric facts (ix:nonFraction) with a name and a value."""
    scale = F.col("scale")
    unit = F.when(scale.isin("", "0"), F.col("unit"))
    for k, name in SCALES.items():
        unit = unit.when(scale == k, name)
    unit = unit.otherwise(F.concat(F.lit("x10^"), scale))
    number = F.regexp_replace("text", "[,$ ]", "").try_cast("double")
    scaled = number * F.pow(F.lit(10.0), F.coalesce(scale.try_cast("double"), F.lit(0.0)))
    return _facts(pages, "number").select("page_id", "pos", "name", "context", F.col("text").alias("value"), unit.alias("unit"), scaled.alias("scaled"))


def text_facts(pages: DataFrame) -> DataFrame:
    """page_id, pos, name, value (200 characters) of inline text facts (ix:nonNumeric) with a name and a value."""
    return _facts(pages, "text").select("page_id", "pos", "name", F.col("text").alias("value"))


def fact_metadata(texts: DataFrame) -> DataFrame:
    """page_id, company, doc_type, fiscal_year: the first filled fact of each kind."""
    first = lambda end: F.min_by(F.when(F.col("name").endswith(end) & (F.trim("value") != ""), F.trim("value")), F.when(F.col("name").endswith(end) & (F.trim("value") != ""), F.col("pos")))
    year = F.regexp_extract(first("FiscalYearFocus"), r"^(\d{4})$", 1)
    return texts.groupBy("page_id").agg(first("EntityRegistrantName").alias("company"), first("DocumentType").alias("doc_type"), F.when(~year.isin("", "0000"), F.concat(F.lit("FY"), year)).alias("fiscal_year"))


def table_cells(pages: DataFrame) -> DataFrame:
    """page_id, table_number, row, i, row_header, col_header, value of HTML tables of two rows or more.

    The header is the first row with th, else the first; rows below it give cells; empty
    values and lone marks (— - $ ( )) are left out.
    """
    return parsed(pages).select("page_id", F.explode("cells").alias("c")).select("page_id", "c.*")
