"""Ranked lookup of table cells for metric questions, over many documents at once.

cells: doc_id, ord, row_header, col_header, value, unit, page, section, company,
doc_type, fiscal_year. questions: question_id, doc_id, question. ord is a document's
cell order; it decides ties.
"""

from __future__ import annotations

import math

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from .written import written

#: Derived metrics: what they need, and their value from the needed cells' numbers.
DERIVED: dict[str, tuple[list[str], Callable[..., Column]]] = {"free_cash_flow": (["operating_cash_flow", "capex"], lambda flow, spent: flow - F.abs(spent))}


def register_metric(name: str, needs: list[str], value: Callable[..., Column]) -> None:
    DERIVED[name] = (needs, value)


def _map(pairs: dict[str, Column]) -> Column:
    return F.create_map(*(x if isinstance(x, Column) else F.lit(x) for pair in pairs.items() for x in pair))


def _words(words: list[str]) -> Column:
    return F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")


def unpivot_table(table: DataFrame, ids: list[str]) -> DataFrame:
    """Wide rows to cells: every other column becomes row_header, its text value; empty ones go."""
    names = [c for c in table.columns if c not in ids]
    long = table.select(*ids, *(F.col(f"`{c}`").cast("string").alias(c) for c in names)).unpivot(ids, names, "row_header", "value")
    return long.where("value is not null and trim(value) <> ''")


def backfill(cells: DataFrame, documents: DataFrame) -> DataFrame:
    """Company, kind and year of cells without one, from their document (doc_id and the three)."""
    names = ["company", "doc_type", "fiscal_year"]
    d = documents.select("doc_id", *(F.col(c).alias(f"__{c}") for c in names))
    out = cells.join(d, "doc_id", "left")
    for c in names:
        out = out.withColumn(c, F.when(F.coalesce(F.col(c), F.lit("")).isin("", "UNKNOWN"), F.coalesce(f"__{c}", c)).otherwise(F.col(c)))
    return out.select(*cells.columns)


def with_keys(cells: DataFrame) -> DataFrame:
    """cells with tag (normalised) and keys: all names a cell can be found by; as they are if they have them."""
    if {"tag", "keys"} <= set(cells.columns):
        return cells
    human = T.humanise_tag(F.col("row_header"))
    keys = F.array_distinct(F.concat(F.array(T.normalise(F.col("row_header")), human), T.aliases(human)))
    return cells.withColumn("tag", T.normalise_tag(F.col("row_header"))).withColumn("keys", keys)


def key_table(cells: DataFrame) -> DataFrame:
    """doc_id, ord, key: the inverted index of cells."""
    return with_keys(cells).select("doc_id", "ord", F.explode("keys").alias("key"))


def contexts(cells: DataFrame) -> DataFrame:
    """doc_id, primary, balance: the contexts that stand for a filing's own year.

    Only where half the column headers are contexts. Primary has the most different row
    headers, ties to the smaller name; balance is the next one that holds a total of the
    balance sheet.
    """
    is_ctx = F.col("col_header").rlike(r"^c-\d+$")
    filled = cells.where("col_header <> ''")
    share = filled.groupBy("doc_id").agg(F.avg(is_ctx.cast("int")).alias("share")).where("share >= 0.5")
    anchors = [t for m in ("total_assets", "total_liabilities", "shareholders_equity") for t in L.TAGS[m]]
    sized = filled.where(is_ctx).groupBy("doc_id", "col_header").agg(F.countDistinct("row_header").alias("n"), F.max(T.normalise_tag(F.col("row_header")).isin(anchors)).alias("anchored"))
    ranked = sized.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "col_header")))
    picked = ranked.groupBy("doc_id").agg(F.max(F.when(F.col("r") == 1, F.col("col_header"))).alias("primary"), F.min_by(F.col("col_header"), F.when((F.col("r") > 1) & F.col("anchored"), F.col("r"))).alias("balance"))
    return picked.join(share.select("doc_id"), "doc_id")


def parsed(questions: DataFrame) -> DataFrame:
    """questions with norm, metric, phrase, asked_year, asked_unit."""
    q = questions.withColumn("norm", T.normalise(F.col("question"))).withColumn("__place", T.metric_place(F.col("norm")))
    q = q.withColumn("metric", T.metric(F.col("norm"), F.col("__place"))).withColumn("phrase", T.metric_text(F.col("norm"), F.col("__place"))).drop("__place")
    return q.withColumn("asked_year", T.norm_year(F.col("norm"))).withColumn("asked_unit", T.query_unit(F.col("question")))


def _tagged() -> Column:
    tags = _map({m: _words(t) for m, t in L.TAGS.items()})[F.col("metric")]
    return F.coalesce(F.when(F.col("metric").isin(L.STRICT), F.array_contains(tags, F.col("tag"))).otherwise(F.exists(tags, lambda t: F.col("tag").contains(t))), F.lit(False))


def candidates(questions: DataFrame, cells: DataFrame) -> DataFrame:
    """Each question's cells of the first way of finding that finds any: 0 tag, 1 name, 2 start of a name, 3 a name's word."""
    word = F.element_at(F.split("phrase", " "), 1)
    way = (
        F.when(_tagged(), 0)
        .when(F.array_contains("keys", F.col("phrase")), 1)
        .when(F.exists("keys", lambda k: k.startswith(F.col("phrase"))), 2)
        .when((F.length(word) >= 4) & F.exists("keys", lambda k: k.contains(word)), 3)
    )
    asked = questions if "phrase" in questions.columns else parsed(questions)
    met = asked.where("metric is not null").join(with_keys(cells), "doc_id").withColumn("way", way).where("way is not null")
    return met.withColumn("__way", F.min("way").over(Window.partitionBy("question_id"))).where("way = __way").drop("__way")


def in_context(found: DataFrame, ctx: DataFrame) -> DataFrame:
    """found with ctx, the context that the metric asks for; other contexts go if any cell has it."""
    own = F.when(F.col("metric").isin(L.BALANCE_SHEET), F.coalesce("balance", "primary")).otherwise(F.col("primary"))
    met = found.join(ctx, "doc_id", "left").withColumn("ctx", own).drop("primary", "balance").withColumn("same", F.coalesce(F.col("col_header") == F.col("ctx"), F.lit(False)))
    return met.withColumn("__any", F.max("same").over(Window.partitionBy("question_id"))).where("same or not __any").drop("__any")


def scored(found: DataFrame) -> DataFrame:
    """found with numeric and confidence."""
    has = lambda k: F.coalesce(F.exists(_map({m: _words(p[k]) for m, p in L.PREFER.items()})[F.col("metric")], lambda t: F.col("tag").contains(t)), F.lit(False))
    base = F.when(F.col("way") < 2, L.EXACT).when(F.col("way") == 2, L.PREFIX).otherwise(L.CONTAINS)
    far = F.col("asked_year").isNotNull() & F.col("ctx").isNull() & ~F.coalesce("fiscal_year", F.lit("")).isin("", "UNKNOWN") & ~F.col("fiscal_year").contains(F.col("asked_year")) & ~F.col("asked_year").contains(F.col("fiscal_year"))
    # Each step adds to the confidence within bounds. They are folded over an array, so that none is written out within the next.
    step = lambda add, low=-math.inf, high=math.inf: F.struct(F.lit(float(add)).alias("add"), F.lit(float(low)).alias("low"), F.lit(float(high)).alias("high"))
    none = step(0)
    steps = F.array(
        F.when(F.col("same"), step(L.CONTEXT_BONUS, high=1)).otherwise(none),
        F.when(has(0), step(L.PREFER_BONUS, high=1)).when(has(1), step(-L.AVOID_COST, low=0)).otherwise(none),
        F.when((F.col("asked_unit") != "units") & (F.col("asked_unit") == F.coalesce("unit", F.lit(""))), step(L.UNIT_BONUS, high=1)).otherwise(none),
        F.when(far, step(-L.YEAR_COST)).otherwise(none),
        F.when(F.trim(F.coalesce("value", F.lit(""))).isin("", "—", "-", "N/A"), step(-L.EMPTY_COST)).otherwise(none),
    )
    total = F.aggregate(steps, base.cast("double"), lambda c, s: F.greatest(s["low"], F.least(c + s["add"], s["high"])))
    return found.withColumn("numeric", T.parse_numeric(F.col("value"))).withColumn("confidence", F.round(total, 4))


def best(found: DataFrame) -> DataFrame:
    """Each question's cell of highest confidence, then magnitude, then order."""
    w = Window.partitionBy("question_id").orderBy(F.desc("confidence"), F.desc(F.abs(F.coalesce("numeric", F.lit(0.0)))), "ord")
    return found.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def citation() -> Column:
    return F.concat_ws("/", "company", "doc_type", "fiscal_year", "section", F.col("page").cast("string"))


def derived(questions: DataFrame, cells: DataFrame, ctx: DataFrame | None = None) -> DataFrame:
    """question_id, metric, value, citation of questions for derived metrics whose needs all hit.

    All needs of all derived metrics are looked up in one pass, as questions of their own.
    """
    q = questions if "phrase" in questions.columns else parsed(questions)
    needs = _map({name: F.array(*map(F.lit, n)) for name, (n, _) in DERIVED.items()})
    asked = q.where(F.col("metric").isin(*DERIVED)).select("question_id", "doc_id", "asked_year", "asked_unit", "metric")
    wants = asked.select("question_id", "doc_id", "asked_year", "asked_unit", F.explode(needs[F.col("metric")]).alias("metric"))
    wants = wants.select(F.struct("question_id", F.col("metric").alias("need")).alias("question_id"), "doc_id", "asked_year", "asked_unit", "metric", F.lit("").alias("phrase"))
    met = wants.join(with_keys(cells), "doc_id").where(_tagged()).withColumn("way", F.lit(0))
    got = best(scored(in_context(met, contexts(cells) if ctx is None else ctx))).where(F.col("confidence") >= L.HIT)
    every = sorted({n for needs_of, _ in DERIVED.values() for n in needs_of})
    found = got.select("question_id.question_id", F.col("question_id.need").alias("need"), "numeric", citation().alias("cite"))
    wide = found.groupBy("question_id").agg(*(F.max(F.when(F.col("need") == n, F.struct("numeric", "cite"))).alias(f"n_{n}") for n in every))
    value, cite = F.lit(None).cast("double"), F.lit(None).cast("string")
    for name, (needs_of, of) in DERIVED.items():
        value = F.when(F.col("metric") == name, of(*(F.col(f"n_{n}.numeric") for n in needs_of))).otherwise(value)
        cite = F.when(F.col("metric") == name, F.col(f"n_{needs_of[0]}.cite")).otherwise(cite)
    return asked.join(wide, "question_id").select("question_id", "metric", value.alias("value"), cite.alias("citation")).where("value is not null")


def lookup(questions: DataFrame, cells: DataFrame) -> DataFrame:
    """question_id, metric, hit, answer, value, unit, confidence, citation for every question.

    Derived metrics come first; a question without a metric or cell is a miss of confidence 0.
    """
    cells, asked = written(with_keys(cells)), written(parsed(questions))  # read by every way of looking below
    ctx = written(contexts(cells))
    plain = best(scored(in_context(candidates(asked, cells), ctx)))
    hit = F.col("confidence") >= L.HIT
    rows = plain.select("question_id", hit.alias("hit"), F.when(hit, T.answer_format(F.col("value"), F.col("numeric"), F.col("unit"), citation())).otherwise("").alias("answer"), "value", "unit", "confidence", citation().alias("citation"))
    made = derived(asked, cells, ctx).select("question_id", F.col("value").alias("made"), F.col("citation").alias("made_from"))
    shown = F.when(F.col("made") < 0, F.concat(F.lit("-"), F.format_number(F.abs("made"), 0))).otherwise(F.format_number("made", 0))
    every = asked.select("question_id", "metric").join(rows, "question_id", "left").join(made, "question_id", "left")
    is_made = F.col("made").isNotNull()
    return every.select(
        "question_id",
        "metric",
        (is_made | F.coalesce("hit", F.lit(False))).alias("hit"),
        F.when(is_made, F.concat(shown, F.lit(" ["), F.col("made_from"), F.lit("]"))).otherwise(F.coalesce("answer", F.lit(""))).alias("answer"),
        F.when(is_made, shown).otherwise(F.col("value")).alias("value"),
        F.when(~is_made, F.col("unit")).alias("unit"),
        F.when(is_made, L.HIT).otherwise(F.coalesce("confidence", F.lit(0.0))).alias("confidence"),
        F.when(is_made, F.col("made_from")).otherwise(F.col("citation")).alias("citation"),
    )
