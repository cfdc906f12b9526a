"""Sections and chunks of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Sizes that make a heading a section's, and lengths of chunks in characters.
LARGE, MEDIUM, LAST_PAGES = 16.0, 13.0, 50
CHUNK, OVERLAP, LEAST, TITLE = 1600, 100, 50, 60
SECTION_CHARS, CAP = 50_000, 5000


def clean_headings(headings: DataFrame) -> DataFrame:
    """Headings of 3 to 200 characters that are not just numbers, with their depth (1 or 2)."""
    kept = headings.where((F.length("text") >= 3) & (F.length("text") <= 200) & ~F.col("text").rlike(r"^[\d\s.\-]+$"))
    top = (F.col("font_size") >= LARGE) | ((F.col("font_size") >= MEDIUM) & F.col("is_bold"))
    return kept.withColumn("depth", F.when(top, 1).otherwise(2))


def page_ranges(headings: DataFrame, key: str) -> DataFrame:
    """headings with end_page: where the next one starts, or LAST_PAGES on."""
    return headings.withColumn("end_page", F.coalesce(F.lead("page").over(Window.partitionBy(key).orderBy("ord")), F.col("page") + LAST_PAGES))


def section_tree(headings: DataFrame, key: str) -> DataFrame:
    """headings with parent: the ord of the last section above a subsection; null for sections."""
    w = Window.partitionBy(key).orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return headings.withColumn("parent", F.when(F.col("depth") == 2, F.last(F.when(F.col("depth") == 1, F.col("ord")), ignorenulls=True).over(w)))


def section_text(headings: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """key, ord, text: from a heading's first place in its document up to the next heading's place after it."""
    w = Window.partitionBy(key).orderBy("ord")
    return _between(headings.withColumn("__next", F.lead("text").over(w)), texts, key)


def _between(headings: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """key, ord, text from a heading up to __next."""
    d = headings.join(texts.select(key, F.col("text").alias("__all")), key)
    name = F.lower(F.substring("text", 1, 30))
    low = F.lower("__all")
    d = d.withColumn("__at", F.position(name, low)).where(F.col("__at") > 0)
    after = F.col("__at") + F.length("text")
    end = F.when(F.col("__next").isNotNull(), F.position(F.lower(F.substring("__next", 1, 30)), low, after)).otherwise(0)
    stop = F.when(end > 0, end).otherwise(F.col("__at") + SECTION_CHARS)
    return d.select(key, "ord", F.trim(F.substr("__all", F.col("__at"), stop - F.col("__at"))).alias("text"))


def paragraphs(docs: DataFrame, key: str, least: int = LEAST) -> DataFrame:
    """key, ord, section, text of paragraphs of least characters or more.

    A shorter one of up to five words and sixty characters names the section of those
    below it.
    """
    p = docs.select(key, F.posexplode(F.split("text", r"\n\s*\n")).alias("ord", "raw")).withColumn("text", F.regexp_replace("raw", r"^\s+|\s+$", ""))
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    title = (F.length("text") < least) & words.between(1, 5) & (F.length("text") <= TITLE)
    w = Window.partitionBy(key).orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    section = F.coalesce(F.last(F.when(title, F.substring("text", 1, 50)), ignorenulls=True).over(w), F.lit("DOCUMENT"))
    return p.withColumn("section", section).where(F.length("text") >= least).select(key, "ord", "section", "text")


def packed_sentences(text: Column, size: int = CHUNK, overlap: int = OVERLAP, least: int = LEAST) -> Column:
    """A text's sentences folded into chunks of up to size characters that overlap.

    One sentence is never cut. Chunks shorter than least are left out.
    """
    text = F.regexp_replace(text, r"^\s+|\s+$", "")
    start = F.struct(F.lit("").alias("cur"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, sent: Column) -> Column:
        full = (F.length(acc["cur"]) + F.length(sent) > size) & (acc["cur"] != "")
        done = F.when(full & (F.length(acc["cur"]) >= least), F.concat(acc["out"], F.array(acc["cur"]))).otherwise(acc["out"])
        tail = F.when(F.length(acc["cur"]) > overlap, F.right(acc["cur"], F.lit(overlap))).otherwise(acc["cur"])
        cur = F.when(full, F.concat(tail, F.lit(" "), sent)).otherwise(F.trim(F.concat(acc["cur"], F.lit(" "), sent)))
        return F.struct(cur.alias("cur"), done.alias("out"))

    def finish(acc: Column) -> Column:
        return F.when(F.length(acc["cur"]) >= least, F.concat(acc["out"], F.array(acc["cur"]))).otherwise(acc["out"])

    folded = F.aggregate(F.split(text, r"(?<=[.!?])\s+"), start, step, finish)
    short = F.when(F.length(text) >= least, F.array(text)).otherwise(F.array().cast("array<string>"))
    return F.when(F.length(text) <= size, short).otherwise(folded)


def section_chunks(headings: DataFrame, texts: DataFrame, key: str, least: int = LEAST) -> DataFrame:
    """key, ord, section, part, text: each section's and subsection's text, long ones packed by sentence.

    headings: key, ord, text, and parent from section_tree. A section reaches to the next
    section, a subsection to the next of its section or else to the next section.
    """
    top = section_text(headings.where("parent is null"), texts, key)
    below = headings.where("parent is not null").select(key, "ord", F.col("parent").alias("__parent"), "text")
    nexts = headings.where("parent is null").withColumn("__then", F.lead("text").over(Window.partitionBy(key).orderBy("ord"))).select(key, F.col("ord").alias("__parent"), "__then")
    inner = F.lead("text").over(Window.partitionBy(key, "__parent").orderBy("ord"))
    child = below.join(nexts, [key, "__parent"]).withColumn("__next", F.coalesce(inner, "__then"))
    both = top.unionByName(_between(child, texts, key)).where(F.length("text") >= least)
    named = both.join(headings.select(key, "ord", F.col("text").alias("section")), [key, "ord"])
    return named.select(key, "ord", "section", F.posexplode(packed_sentences(F.col("text"), least=least)).alias("part", "text"))


def chunk_documents(docs: DataFrame, key: str, headings: DataFrame | None = None, cap: int | None = CAP) -> DataFrame:
    """key, chunk_id, section, text of docs (key, text), up to cap chunks a document.

    By sections where headings give any (see section_chunks); other documents by paragraphs,
    long ones packed by sentence; those without any as a whole.
    """
    texts, every, left = docs.select(key, "text"), None, docs.select(key, "text")
    if headings is not None:
        every = section_chunks(headings, texts, key).select(key, "ord", "section", "part", "text")
        left = left.join(every.select(key).distinct(), key, "left_anti")
    para = paragraphs(left, key).select(key, "ord", "section", F.posexplode(packed_sentences(F.col("text"))).alias("part", "text"))
    whole = left.join(para.select(key).distinct(), key, "left_anti").select(key, F.lit(0).alias("ord"), F.lit("DOCUMENT").alias("section"), F.posexplode(packed_sentences(F.col("text"), least=1)).alias("part", "text"))
    rest = para.unionByName(whole)
    every = rest if every is None else every.unionByName(rest)
    out = every.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy("ord", "part")))
    if cap is not None:
        out = out.where(F.col("__n") <= cap)
    return out.select(key, F.concat(F.lit("chunk_"), F.lpad((F.col("__n") - 1).cast("string"), 4, "0")).alias("chunk_id"), "section", "text")


def summaries(sections: DataFrame, key: str, summarise, most: int = 20, chars: int = 500, longest: int = 300) -> DataFrame:
    """key, ord, summary: the first sentence that summarise (a pandas UDF of text) gives for the start of each of the first sections; empty text gives none."""
    n = F.row_number().over(Window.partitionBy(key).orderBy("ord"))
    some = sections.where(F.trim("text") != "").withColumn("__n", n).where(F.col("__n") <= most)
    said = some.select(key, "ord", summarise(F.substring("text", 1, chars)).alias("said"))
    return said.select(key, "ord", F.substring(F.split(F.trim("said"), r"(?<=[.!?])\s+")[0], 1, longest).alias("summary"))


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """chunks with char_count, token_estimate and prefixed_text (company / doc_type / fiscal_year / section / page)."""
    prefix = F.concat_ws(" / ", "company", "doc_type", "fiscal_year", "section", F.col("page").cast("string"))
    return chunks.withColumn("char_count", F.length("text")).withColumn("token_estimate", F.floor(F.length("text") / 4).cast("int")).withColumn("prefixed_text", F.concat(prefix, F.lit("\n"), "text"))


def prefix_violations(chunks: DataFrame) -> DataFrame:
    """Chunks that lack one of the five fields, with its name."""
    names = ["company", "doc_type", "fiscal_year", "section", "page"]
    lacking = F.array_compact(F.array(*(F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "", c) for c in names)))
    return chunks.select("*", F.explode(lacking).alias("lacks"))


def section_kind(headings: DataFrame) -> DataFrame:
    return headings.withColumn("sec_type", T.section_type(F.col("text")))
