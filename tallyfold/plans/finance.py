"""Queries over cells, figures and questions that are derived from the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from ..operators import cells as C
from ..operators import quality as Q
from ..operators import statistics as S
from ..operators.written import written

#: Row header, column header, page and value in cents of a filing's cells, in order; both dialects read the expressions.
LINES = [
    ("us-gaap:Revenues", "c-1", 10, "gross"),
    ("us-gaap:CostOfRevenue", "c-1", 10, "gross - net"),
    ("us-gaap:GrossProfit", "c-1", 10, "net"),
    ("us-gaap:IncomeTaxExpenseBenefit", "c-1", 11, "tax"),
    ("us-gaap:NetIncomeLoss", "c-1", 11, "net - gross + tax"),
    ("us-gaap:NetCashProvidedByUsedInOperatingActivities", "c-1", 12, "net + tax"),
    ("us-gaap:PaymentsToAcquireProductiveAssets", "c-1", 12, "gross - net + tax"),
    ("us-gaap:Assets", "c-2", 13, "gross * 3"),
    ("us-gaap:AssetsCurrent", "c-2", 13, "gross + tax"),
    ("us-gaap:Liabilities", "c-2", 13, "gross + net"),
    ("us-gaap:LiabilitiesAndStockholdersEquity", "c-2", 13, "gross * 3"),
    ("us-gaap:StockholdersEquity", "c-2", 13, "gross - net"),
    ("us-gaap:DeferredRevenue", "c-2", 14, "tax * 2"),
    ("us-gaap:Revenues ", "c-3", 15, "net"),
    ("Inventory held", "c-2", 14, "units * 100000"),
    ("Research and development", "", 16, "tax"),
]
PHRASES = ["total revenue", "cost of revenue", "gross profit", "income tax expense", "net income", "operating cash flow", "capital expenditures", "total assets", "current assets", "total liabilities", "shareholders equity", "deferred revenue", "inventory", "free cash flow", "goodwill", "research and development cost", "the weather"]


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def facts(spark: SparkSession, sf: str) -> DataFrame:
    """company, year, gross, net, tax (cents), units: a filing for each market segment and year."""
    o = _t(spark, sf, "orders").join(_t(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    li = _t(spark, sf, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    cents = lambda e: F.sum(F.round(F.expr(e) * 100).cast("long"))
    return li.groupBy(F.col("c_mktsegment").alias("company"), F.year("o_orderdate").alias("year")).agg(
        cents("l_extendedprice").alias("gross"), cents("l_extendedprice * (1 - l_discount)").alias("net"), cents("l_extendedprice * l_tax").alias("tax"), F.sum(F.col("l_quantity").cast("long")).alias("units")
    )


FACTS = """facts AS (SELECT c_mktsegment AS company, year(o_orderdate)::INT AS year, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS gross,
 sum(round(l_extendedprice * (1 - l_discount) * 100)::BIGINT)::BIGINT AS net, sum(round(l_extendedprice * l_tax * 100)::BIGINT)::BIGINT AS tax, sum(l_quantity::BIGINT)::BIGINT AS units
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""


def cells(spark: SparkSession, sf: str, of: DataFrame | None = None) -> DataFrame:
    """The filings' cells, in thousands; of: facts() where they are at hand."""
    amount = lambda e: F.floor(F.expr(e) / 100000).cast("long")
    text = lambda v: F.when(v < 0, F.concat(F.lit("("), F.format_number(-v, 0), F.lit(")"))).otherwise(F.format_number(v, 0))
    rows = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(r).alias("row_header"), F.lit(c).alias("col_header"), text(amount(e)).alias("value"), F.lit(p).alias("page")) for i, (r, c, p, e) in enumerate(LINES, 1)))
    d = (of or facts(spark, sf)).select(F.concat_ws("-", "company", F.col("year").cast("string")).alias("doc_id"), "company", F.concat(F.lit("FY"), F.col("year").cast("string")).alias("fiscal_year"), F.inline(rows))
    return d.select("doc_id", "ord", "row_header", "col_header", "value", F.lit("x10^3").alias("unit"), "page", F.lit("STATEMENTS").alias("section"), "company", F.lit("10-K").alias("doc_type"), "fiscal_year")


_ROWS = ", ".join(f"({i}, '{r}', '{c}', {p})" for i, (r, c, p, _) in enumerate(LINES, 1))
_AMOUNT = "CASE ord " + " ".join(f"WHEN {i} THEN {e}" for i, (_, _, _, e) in enumerate(LINES, 1)) + " END"
CELLS = f"""{FACTS}, amounts AS (SELECT company, year, ord, row_header, col_header, page, floor(({_AMOUNT}) / 100000)::BIGINT AS amount FROM facts, (VALUES {_ROWS}) l(ord, row_header, col_header, page)),
cells AS (SELECT company || '-' || year AS doc_id, ord, row_header, col_header, CASE WHEN amount < 0 THEN '(' || format('{{:,}}', -amount) || ')' ELSE format('{{:,}}', amount) END AS value,
 'x10^3' AS unit, page, 'STATEMENTS' AS section, company, '10-K' AS doc_type, 'FY' || year AS fiscal_year FROM amounts)"""


def questions(spark: SparkSession, sf: str, of: DataFrame | None = None) -> DataFrame:
    d = (of or facts(spark, sf)).select("company", "year", F.posexplode(F.array(*map(F.lit, PHRASES))).alias("k", "phrase"))
    text = F.concat(F.lit("What was "), "phrase", F.lit(" for "), "company", F.when(F.col("k") % 2 == 0, F.concat(F.lit(" in FY"), F.col("year").cast("string"))).otherwise(F.concat(F.lit(" in "), F.col("year").cast("string"), F.lit(", in millions"))), F.lit("?"))
    doc = F.concat_ws("-", "company", F.col("year").cast("string"))
    return d.select(F.concat(doc, F.lit("#"), F.col("k").cast("string")).alias("question_id"), doc.alias("doc_id"), text.alias("question"))


_LIST = "[" + ", ".join(f"'{p}'" for p in PHRASES) + "]"
QUESTIONS = f"""questions AS (SELECT company || '-' || year || '#' || k AS question_id, company || '-' || year AS doc_id,
 'What was ' || {_LIST}[k + 1] || ' for ' || company || CASE WHEN k % 2 = 0 THEN ' in FY' || year ELSE ' in ' || year || ', in millions' END || '?' AS question
 FROM facts, range({len(PHRASES)}) r(k))"""


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def case_match(col: str, patterns: dict[str, str], then=q, default: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({col}, {q('(?i)' + p)}) THEN {then(n)}" for n, p in patterns.items()) + f" ELSE {default} END"


NORM = r"regexp_replace(regexp_replace(regexp_replace(lower({0}), '^\s+|\s+$', '', 'g'), '[’‘“”]', '''', 'g'), '\s+', ' ', 'g')"
YEAR = lambda c: "('FY' || (SELECT CASE WHEN length(y) = 2 THEN '20' || y ELSE y END FROM (SELECT coalesce(" + ", ".join(f"nullif(regexp_extract({NORM.format(c)}, {q(p)}, 1), '')" for p in L.FISCAL_YEARS) + ") AS y)))"
PARSED = f"""parsed AS (SELECT *, {case_match('norm', L.METRICS)} AS metric,
 {NORM.format('CASE ' + ' '.join(f"WHEN regexp_matches(norm, {q('(?i)' + p)}) THEN regexp_extract(norm, {q('(?i)' + p)})" for p in L.METRICS.values()) + ' END')} AS phrase,
 {YEAR('question')} AS asked_year, {case_match('question', L.UNITS, default="'units'")} AS asked_unit FROM (SELECT *, {NORM.format('question')} AS norm FROM questions))"""
HUMAN = r"trim(lower(regexp_replace(regexp_replace({0}, '^[^:]*:', ''), '([A-Z])', ' \1', 'g')))"
_ALIAS = "CASE human " + " ".join(f"WHEN {q(k)} THEN [{', '.join(map(q, v))}]" for k, v in L.ALIASES.items()) + " ELSE [] END"
KEYED = f"""keyed AS (SELECT * EXCLUDE (human), list_distinct([{NORM.format('row_header')}, human] || {_ALIAS}) AS keys FROM
 (SELECT *, translate(lower(row_header), ':_ ', '') AS tag, {HUMAN.format('row_header')} AS human FROM cells))"""
_LISTS = lambda d: "CASE metric " + " ".join(f"WHEN {q(m)} THEN [{', '.join(map(q, t))}]::VARCHAR[]" for m, t in d.items()) + " ELSE []::VARCHAR[] END"
_IN = lambda names: "(" + ", ".join(map(q, names)) + ")"
TAGGED = f"(CASE WHEN metric IN {_IN(L.STRICT)} THEN list_contains({_LISTS(L.TAGS)}, tag) ELSE len(list_filter({_LISTS(L.TAGS)}, lambda t: contains(tag, t))) > 0 END)"
FOUND = f"""ways AS (SELECT *, CASE WHEN {TAGGED} THEN 0 WHEN list_contains(keys, phrase) THEN 1 WHEN len(list_filter(keys, lambda k: starts_with(k, phrase))) > 0 THEN 2
 WHEN length(split_part(phrase, ' ', 1)) >= 4 AND len(list_filter(keys, lambda k: contains(k, split_part(phrase, ' ', 1)))) > 0 THEN 3 END AS way FROM parsed JOIN keyed USING (doc_id) WHERE metric IS NOT NULL),
found AS (SELECT * FROM ways WHERE way IS NOT NULL QUALIFY way = min(way) OVER (PARTITION BY question_id))"""
_ANCHORS = _IN([t for m in ("total_assets", "total_liabilities", "shareholders_equity") for t in L.TAGS[m]])
CONTEXTS = f"""sized AS (SELECT doc_id, col_header, count(DISTINCT row_header) AS n, max((translate(lower(row_header), ':_ ', '') IN {_ANCHORS})::INT) AS anchored FROM cells WHERE regexp_matches(col_header, '^c-\\d+$') GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, col_header) AS r FROM sized),
contexts AS (SELECT doc_id, max(col_header) FILTER (r = 1) AS "primary", arg_min(col_header, r) FILTER (r > 1 AND anchored = 1) AS balance FROM ranked
 WHERE doc_id IN (SELECT doc_id FROM cells WHERE col_header <> '' GROUP BY doc_id HAVING avg(regexp_matches(col_header, '^c-\\d+$')::INT) >= 0.5) GROUP BY doc_id)"""


def in_ctx(source: str) -> str:
    return f"""(SELECT * FROM (SELECT *, coalesce(col_header = ctx, false) AS same FROM (SELECT f.*, CASE WHEN metric IN {_IN(L.BALANCE_SHEET)} THEN coalesce(balance, "primary") ELSE "primary" END AS ctx FROM {source} f LEFT JOIN contexts USING (doc_id)))
 QUALIFY same OR NOT bool_or(same) OVER (PARTITION BY question_id))"""


NUMBER = r"""(SELECT CASE WHEN neg THEN -v ELSE v END FROM (SELECT neg, CASE WHEN regexp_matches(b, '^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$') THEN try_cast(b AS DOUBLE) END AS v FROM
 (SELECT regexp_matches(trim({0}), '^\(.*\)$') AS neg, regexp_replace(regexp_replace(CASE WHEN regexp_matches(trim({0}), '^\(.*\)$') THEN trim({0})[2:-2] ELSE trim({0}) END, '[$,\s]', '', 'g'), '%+$', '') AS b)))"""
_HAS = lambda k: f"len(list_filter({_LISTS({m: p[k] for m, p in L.PREFER.items()})}, lambda t: contains(tag, t))) > 0"


def scored_sql(source: str) -> str:
    c = f"CASE WHEN way < 2 THEN {L.EXACT} WHEN way = 2 THEN {L.PREFIX} ELSE {L.CONTAINS} END::DOUBLE"
    steps = [
        f"CASE WHEN same THEN least({{c}} + {L.CONTEXT_BONUS}::DOUBLE, 1.0) ELSE {{c}} END",
        f"CASE WHEN {_HAS(0)} THEN least({{c}} + {L.PREFER_BONUS}::DOUBLE, 1.0) WHEN {_HAS(1)} THEN greatest({{c}} - {L.AVOID_COST}::DOUBLE, 0.0) ELSE {{c}} END",
        f"CASE WHEN asked_unit <> 'units' AND asked_unit = coalesce(unit, '') THEN least({{c}} + {L.UNIT_BONUS}::DOUBLE, 1.0) ELSE {{c}} END",
        f"CASE WHEN asked_year IS NOT NULL AND ctx IS NULL AND coalesce(fiscal_year, '') NOT IN ('', 'UNKNOWN') AND NOT contains(fiscal_year, asked_year) AND NOT contains(asked_year, fiscal_year) THEN {{c}} - {L.YEAR_COST}::DOUBLE ELSE {{c}} END",
        f"CASE WHEN trim(coalesce(value, '')) IN ('', '—', '-', 'N/A') THEN {{c}} - {L.EMPTY_COST}::DOUBLE ELSE {{c}} END",
    ]
    out = f"(SELECT *, {c} AS c0 FROM {source})"
    for i, s in enumerate(steps):
        out = f"(SELECT * EXCLUDE (c{i}), {s.format(c=f'c{i}')} AS c{i + 1} FROM {out})"
    return f"(SELECT * EXCLUDE (c{len(steps)}), {NUMBER.format('value')} AS numeric, round(c{len(steps)}, 4) AS confidence FROM {out})"


def best_sql(source: str) -> str:
    return f"(SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY confidence DESC, abs(coalesce(numeric, 0)) DESC, ord) = 1)"


CITE = "concat_ws('/', company, doc_type, fiscal_year, section, page)"
WITH = f"WITH {CELLS}, {QUESTIONS}, {PARSED}, {KEYED}, {FOUND}, {CONTEXTS}"
BEST = f"best AS {best_sql(scored_sql(in_ctx('found')))}"


def _primitive_sql(name: str) -> str:
    asked = f"(SELECT p.question_id, p.doc_id, p.asked_year, p.asked_unit, {q(name)} AS metric, k.* EXCLUDE (doc_id), 0 AS way FROM parsed p JOIN keyed k USING (doc_id) WHERE p.metric = 'free_cash_flow')"
    return f"(SELECT question_id, numeric, {CITE} AS citation FROM {best_sql(scored_sql(in_ctx(f'(SELECT * FROM {asked} WHERE {TAGGED})')))} WHERE confidence >= {L.HIT})"


MADE = f"made AS (SELECT a.question_id, 'free_cash_flow' AS metric, a.numeric - abs(b.numeric) AS value, a.citation FROM {_primitive_sql('operating_cash_flow')} a JOIN {_primitive_sql('capex')} b USING (question_id))"
UNIT_CASE = "CASE unit " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in L.UNIT_NAMES.items()) + " ELSE coalesce(unit, '') END"
SHOWN = "CASE WHEN numeric < 0 AND NOT starts_with(value, '-') THEN '-' || trim(value, '()') ELSE value END"
ANSWER = f"{SHOWN} || CASE WHEN {UNIT_CASE} NOT IN ('', 'units') THEN ' ' || {UNIT_CASE} ELSE '' END || ' [' || {CITE} || ']'"


# queries


def sniper_lookup(spark, sf):
    """Flagship: every metric question of every filing answered from its cells, with a citation."""
    of = written(facts(spark, sf))
    return C.lookup(questions(spark, sf, of), cells(spark, sf, of))


def cells_unpivot(spark, sf):
    wide = facts(spark, sf).select(F.concat_ws("-", "company", F.col("year").cast("string")).alias("doc_id"), "gross", "net", "tax", "units")
    return C.unpivot_table(wide, ["doc_id"])


def cell_keys(spark, sf):
    return C.key_table(cells(spark, sf))


def canonical_context(spark, sf):
    return C.contexts(cells(spark, sf))


def metric_identify(spark, sf):
    return C.parsed(questions(spark, sf)).select("question_id", "metric", "phrase")


def query_fy(spark, sf):
    return C.parsed(questions(spark, sf)).select("question_id", "asked_year")


def query_unit(spark, sf):
    return C.parsed(questions(spark, sf)).select("question_id", "asked_unit")


def normalise(spark, sf):
    """Of every customer segment's questions and of part names."""
    return _t(spark, sf, "part").select("p_partkey", T.normalise(F.concat(F.lit("  "), F.upper("p_name"), F.lit("’s   "), "p_brand", F.lit(" "))).alias("norm"))


def humanise(spark, sf):
    return cells(spark, sf).select("doc_id", "ord", T.humanise_tag(F.col("row_header")).alias("human"), T.normalise_tag(F.col("row_header")).alias("tag"))


def parse_numeric(spark, sf):
    """Part prices in the ways that filings write numbers."""
    p = F.format_number("p_retailprice", 2)
    text = F.element_at(F.array(p, F.concat(F.lit("("), p, F.lit(")")), F.concat(F.lit("$ "), p), F.concat(p, F.lit("%")), F.lit("N/A"), F.concat(F.lit("-"), p), F.concat(p, F.lit("x"))), (F.col("p_partkey") % 7 + 1).cast("int"))
    return _t(spark, sf, "part").select("p_partkey", text.alias("text")).select("p_partkey", "text", T.parse_numeric(F.col("text")).alias("number"))


def _way(n: int):
    def run(spark, sf):
        met = C.parsed(questions(spark, sf)).where("metric is not null").join(C.with_keys(cells(spark, sf)), "doc_id")
        word = F.element_at(F.split("phrase", " "), 1)
        test = [C._tagged(), F.array_contains("keys", F.col("phrase")), F.exists("keys", lambda k: k.startswith(F.col("phrase"))), (F.length(word) >= 4) & F.exists("keys", lambda k: k.contains(word))][n]
        return met.where(test).select("question_id", "ord", "row_header")

    return run


_WAYS = [TAGGED, "list_contains(keys, phrase)", "len(list_filter(keys, lambda k: starts_with(k, phrase))) > 0", "length(split_part(phrase, ' ', 1)) >= 4 AND len(list_filter(keys, lambda k: contains(k, split_part(phrase, ' ', 1)))) > 0"]


def cascade(spark, sf):
    return C.candidates(questions(spark, sf), cells(spark, sf)).select("question_id", "ord", "way")


def ctx_filter(spark, sf):
    c = cells(spark, sf)
    return C.in_context(C.candidates(questions(spark, sf), c), C.contexts(c)).select("question_id", "ord", "ctx", "same")


def score_candidates(spark, sf):
    c = cells(spark, sf)
    return C.scored(C.in_context(C.candidates(questions(spark, sf), c), C.contexts(c))).select("question_id", "ord", "numeric", "confidence")


def synthetic_fcf(spark, sf):
    return C.derived(questions(spark, sf), cells(spark, sf))


def answer_format(spark, sf):
    c = cells(spark, sf)
    return c.select("doc_id", "ord", T.answer_format(F.col("value"), T.parse_numeric(F.col("value")), F.col("unit"), C.citation()).alias("answer"))


def cell_backfill(spark, sf):
    """Every third cell has lost its company, every fourth its year."""
    c = cells(spark, sf)
    holed = c.withColumn("company", F.when(F.col("ord") % 3 != 0, F.col("company")).otherwise("UNKNOWN")).withColumn("fiscal_year", F.when(F.col("ord") % 4 != 0, F.col("fiscal_year")))
    docs = c.groupBy("doc_id").agg(F.max("company").alias("company"), F.max("doc_type").alias("doc_type"), F.max("fiscal_year").alias("fiscal_year"))
    return C.backfill(holed, docs).select("doc_id", "ord", "company", "doc_type", "fiscal_year")


def cells_union(spark, sf):
    """Cells of statements and of part prices, one below the other."""
    a = cells(spark, sf).select("doc_id", F.col("row_header"), "value")
    b = _t(spark, sf, "part").select(F.col("p_brand").alias("doc_id"), F.col("p_name").alias("row_header"), F.format_number("p_retailprice", 2).alias("value"))
    return a.unionByName(b)


def _orders(spark, sf):
    return _t(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("id"))


def _series(spark, sf):
    """Monthly order totals of each priority, in cents."""
    o = _t(spark, sf, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("k"), F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg((F.sum(F.round(F.col("o_totalprice") * 100).cast("long")) / 100).alias("value"))


_SERIES = "series AS (SELECT o_orderpriority AS k, strftime(o_orderdate, '%Y-%m') AS month, sum(round(o_totalprice * 100)::BIGINT)::BIGINT / 100.0::DOUBLE AS value FROM orders GROUP BY ALL), rets AS (SELECT *, CASE WHEN lag(value) OVER w <> 0 THEN (value - lag(value) OVER w) / abs(lag(value) OVER w) END AS ret FROM series WINDOW w AS (PARTITION BY k ORDER BY month))"


def returns(spark, sf):
    return S.returns(_series(spark, sf), "k", "month").select("k", "month", F.round("ret", 9).alias("ret"))


def var(spark, sf):
    return S.value_at_risk(S.returns(_series(spark, sf), "k", "month"), "k")


def garch_fallback(spark, sf):
    return S.volatility(S.returns(_series(spark, sf), "k", "month"), "k")


def garch(spark, sf):
    return S.garch(S.returns(_series(spark, sf), "k", "month"), "k", "month", "string")


def monte_carlo(spark, sf):
    last = _series(spark, sf).groupBy("k").agg(F.max_by("value", "month").alias("base"))
    return S.monte_carlo(last, "k")


def _by_segment(spark, sf):
    o = _t(spark, sf, "orders").join(_t(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.select(F.col("c_mktsegment").alias("k"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value"))


_SEGMENT = "vals AS (SELECT c_mktsegment AS k, o_orderkey AS id, o_totalprice AS value FROM orders JOIN customer ON o_custkey = c_custkey)"
_DIGIT = "substr(regexp_replace(printf('%.9e', abs(value)), '[^0-9]', '', 'g'), 1, 1)::INT"
_COUNTS = f"digits AS (SELECT k, {_DIGIT} AS d FROM vals WHERE value <> 0), counts AS (SELECT k, count(*) AS n, " + ", ".join(f"count(*) FILTER (d = {i}) AS d{i}" for i in range(1, 10)) + " FROM digits GROUP BY k HAVING count(*) >= 10)"
_CHI = " + ".join(f"pow(d{i} - n * log10(1 + 1 / {i}::DOUBLE), 2) / (n * log10(1 + 1 / {i}::DOUBLE))" for i in range(1, 10))
_TAIL = "exp(-{0} / 2) * (1 + {0} / 2 + pow({0} / 2, 2) / 2 + pow({0} / 2, 3) / 6)"
_BENFORD = f"{_SEGMENT}, {_COUNTS}, chi AS (SELECT k, n, {_CHI} AS x FROM counts), benford AS (SELECT k, n, round(x, 6) AS chi2, round({_TAIL.format('x')}, 6) AS p_value, {_TAIL.format('x')} < 0.05 AS anomaly FROM chi)"


def first_digit(spark, sf):
    return _t(spark, sf, "orders").select("o_orderkey", T.first_digit(F.col("o_totalprice")).alias("digit"))


def benford(spark, sf):
    return S.benford(_by_segment(spark, sf), "k")


def benford_alt(spark, sf):
    return S.benford_contingency(_by_segment(spark, sf), "k")


_SEEN = [f"greatest(d{i}::DOUBLE, 0.5)" for i in range(1, 10)]
_DUE = [f"greatest(n * log10(1 + 1 / {i}::DOUBLE), 0.5)" for i in range(1, 10)]
_ALT = " + ".join(f"pow({a} - s * ({a} + {b}) / (s + d), 2) / (s * ({a} + {b}) / (s + d)) + pow({b} - d * ({a} + {b}) / (s + d), 2) / (d * ({a} + {b}) / (s + d))" for a, b in zip(_SEEN, _DUE, strict=True))


def ratio_consistency(spark, sf):
    return S.ratio_consistency(_by_segment(spark, sf).withColumn("value", F.floor(F.col("value") / 10) * 10.0), "k")


def risk_score(spark, sf):
    """Of every customer: balance as digit statistic, nation as share, account as volatility."""
    c = _t(spark, sf, "customer")
    s = F.round(S.risk_score(F.abs("c_acctbal") / 100, F.col("c_nationkey") / 100, F.abs("c_acctbal") / 20000), 6)
    return c.select("c_custkey", s.alias("score"), S.severity(s).alias("severity"), S.severity(s, "alt").alias("severity_alt"))


def forensics(spark, sf):
    rets = S.returns(_series_by_segment(spark, sf), "k", "month")
    return S.forensics(_by_segment(spark, sf), rets, "k")


def _series_by_segment(spark, sf):
    o = _t(spark, sf, "orders").join(_t(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy(F.col("c_mktsegment").alias("k"), F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg((F.sum(F.round(F.col("o_totalprice") * 100).cast("long")) / 100).alias("value"))


def isolation(spark, sf):
    return S.isolation_forest(_by_segment(spark, sf), "k", "string")


def ratio(spark, sf):
    return facts(spark, sf).select("company", "year", T.ratio(F.col("net"), F.col("gross")).alias("margin"), T.ratio(F.col("tax"), F.col("units") * 0).alias("none"))


def outlier_ref(spark, sf):
    """Line prices more than a fifth off their part's retail price times quantity."""
    m = _t(spark, sf, "lineitem").join(_t(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    ref = F.col("p_retailprice") * F.col("l_quantity")
    return m.select("l_orderkey", "l_linenumber", "l_partkey", Q.far_off(F.col("l_extendedprice"), ref).alias("outlier"))


def source_conflict(spark, sf):
    """Suppliers' average prices for one part, pairwise, where they differ by more than 5 %."""
    price = (F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")) / F.sum(F.col("l_quantity").cast("long"))).alias("value")
    return Q.conflicts(_t(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("source")).agg(price), "part")


def quant_pod(spark, sf):
    """Returns, risk and simulation of each series together."""
    rets = S.returns(_series(spark, sf), "k", "month")
    return S.value_at_risk(rets, "k").join(S.volatility(rets, "k"), "k").join(monte_carlo(spark, sf).select("k", "mean", "p5", "p95"), "k")


QUERIES = {
    "sniper_lookup": sniper_lookup, "cells_unpivot": cells_unpivot, "cell_keys": cell_keys, "canonical_context": canonical_context, "metric_identify": metric_identify, "query_fy": query_fy, "query_unit": query_unit,
    "normalise": normalise, "humanise": humanise, "parse_numeric": parse_numeric, "cell_tags": _way(0), "cell_exact": _way(1), "cell_prefix": _way(2), "cell_contains": _way(3), "cascade": cascade, "ctx_filter": ctx_filter,
    "score_candidates": score_candidates, "synthetic_fcf": synthetic_fcf, "answer_format": answer_format, "cell_backfill": cell_backfill, "cells_union": cells_union, "returns": returns, "var": var, "garch_fallback": garch_fallback,
    "garch": garch, "monte_carlo": monte_carlo, "first_digit": first_digit, "benford": benford, "benford_alt": benford_alt, "ratio_consistency": ratio_consistency, "risk_score": risk_score, "forensics": forensics, "isolation": isolation,
    "ratio": ratio, "outlier_ref": outlier_ref, "source_conflict": source_conflict, "quant_pod": quant_pod,
}

_RISK = "least(least(({c}) / 50.0, 1.0) * 40.0 + least(({s}) * 5.0, 1.0) * 35.0 + least(({v}) / 0.30, 1.0) * 25.0, 100.0)::DOUBLE"
_SEV = "CASE WHEN {s} >= {a} THEN 'high' WHEN {s} >= {b} THEN 'medium' ELSE 'low' END"

ORACLES = {
    "sniper_lookup": f"""{WITH}, {BEST}, {MADE} SELECT p.question_id, p.metric, (m.value IS NOT NULL OR coalesce(b.confidence >= {L.HIT}, false)) AS hit,
        CASE WHEN m.value IS NOT NULL THEN CASE WHEN m.value < 0 THEN '-' ELSE '' END || format('{{:,}}', abs(m.value)::BIGINT) || ' [' || m.citation || ']' WHEN b.confidence >= {L.HIT} THEN b.answer ELSE '' END AS answer,
        CASE WHEN m.value IS NOT NULL THEN CASE WHEN m.value < 0 THEN '-' ELSE '' END || format('{{:,}}', abs(m.value)::BIGINT) ELSE b.value END AS value,
        CASE WHEN m.value IS NULL THEN b.unit END AS unit, CASE WHEN m.value IS NOT NULL THEN {L.HIT}::DOUBLE ELSE coalesce(b.confidence, 0.0)::DOUBLE END AS confidence, coalesce(m.citation, b.citation) AS citation
        FROM parsed p LEFT JOIN (SELECT *, {ANSWER} AS answer, {CITE} AS citation FROM best) b USING (question_id) LEFT JOIN made m USING (question_id)""",
    "cells_unpivot": f"WITH {FACTS}, w AS (SELECT company || '-' || year AS doc_id, gross::VARCHAR AS gross, net::VARCHAR AS net, tax::VARCHAR AS tax, units::VARCHAR AS units FROM facts) UNPIVOT w ON gross, net, tax, units INTO NAME row_header VALUE value",
    "cell_keys": f"WITH {CELLS}, {KEYED} SELECT doc_id, ord, unnest(keys) AS key FROM keyed",
    "canonical_context": f"WITH {CELLS}, {CONTEXTS} SELECT * FROM contexts",
    "metric_identify": f"WITH {FACTS}, {QUESTIONS}, {PARSED} SELECT question_id, metric, phrase FROM parsed",
    "query_fy": f"WITH {FACTS}, {QUESTIONS}, {PARSED} SELECT question_id, asked_year FROM parsed",
    "query_unit": f"WITH {FACTS}, {QUESTIONS}, {PARSED} SELECT question_id, asked_unit FROM parsed",
    "normalise": f"SELECT p_partkey, {NORM.format('''('  ' || upper(p_name) || '’s   ' || p_brand || ' ')''')} AS norm FROM part",
    "humanise": f"WITH {CELLS} SELECT doc_id, ord, {HUMAN.format('row_header')} AS human, translate(lower(row_header), ':_ ', '') AS tag FROM cells",
    "parse_numeric": f"WITH t AS (SELECT p_partkey, (SELECT [p, '(' || p || ')', '$ ' || p, p || '%', 'N/A', '-' || p, p || 'x'][p_partkey % 7 + 1] FROM (SELECT format('{{:,.2f}}', p_retailprice) AS p)) AS text FROM part) SELECT p_partkey, text, {NUMBER.format('text')} AS number FROM t",
    **{f"cell_{n}": f"WITH {CELLS}, {QUESTIONS}, {PARSED}, {KEYED} SELECT question_id, ord, row_header FROM parsed JOIN keyed USING (doc_id) WHERE metric IS NOT NULL AND {w}" for n, w in zip(("tags", "exact", "prefix", "contains"), _WAYS, strict=True)},
    "cascade": f"{WITH} SELECT question_id, ord, way FROM found",
    "ctx_filter": f"{WITH} SELECT question_id, ord, ctx, same FROM {in_ctx('found')}",
    "score_candidates": f"{WITH} SELECT question_id, ord, numeric, confidence FROM {scored_sql(in_ctx('found'))}",
    "synthetic_fcf": f"{WITH}, {MADE} SELECT question_id, metric, value, citation FROM made",
    "answer_format": f"WITH {CELLS} SELECT doc_id, ord, {ANSWER} AS answer FROM (SELECT *, {NUMBER.format('value')} AS numeric FROM cells)",
    "cell_backfill": f"WITH {CELLS} SELECT doc_id, ord, company, doc_type, fiscal_year FROM cells",
    "cells_union": f"WITH {CELLS} SELECT doc_id, row_header, value FROM cells UNION ALL SELECT p_brand, p_name, format('{{:,.2f}}', p_retailprice) FROM part",
    "returns": f"WITH {_SERIES} SELECT k, month, round(ret, 9) AS ret FROM rets",
    "var": f"WITH {_SERIES} SELECT k, count(ret) AS n, round(quantile_cont(ret, 0.05), 6) AS var_95, round(quantile_cont(ret, 0.01), 6) AS var_99, round(avg(ret), 6) AS mean_return FROM rets WHERE ret IS NOT NULL GROUP BY k HAVING count(ret) >= 2",
    "garch_fallback": f"WITH {_SERIES} SELECT k, round(stddev_pop(ret), 6) AS volatility FROM rets WHERE ret IS NOT NULL GROUP BY k",
    "first_digit": f"SELECT o_orderkey, CASE WHEN o_totalprice <> 0 THEN {_DIGIT.replace('value', 'o_totalprice')} END AS digit FROM orders",
    "benford": f"WITH {_BENFORD} SELECT * FROM benford",
    "benford_alt": f"WITH {_SEGMENT}, {_COUNTS}, m AS (SELECT *, {' + '.join(_SEEN)} AS s, {' + '.join(_DUE)} AS d FROM counts), x AS (SELECT k, n, {_ALT} AS x FROM m), y AS (SELECT k, n, x, {_TAIL.format('x')} AS p FROM x) SELECT k, n, round(x, 6) AS chi2, round(p, 6) AS p_value, CASE WHEN p < 0.01 THEN 80 WHEN p < 0.05 THEN 50 WHEN p < 0.1 THEN 20 ELSE 0 END AS score FROM y",
    "ratio_consistency": f"WITH {_SEGMENT}, v AS (SELECT k, floor(value / 10) * 10.0::DOUBLE AS value FROM vals), m AS (SELECT k, median(value) AS mid, count(*) AS n, avg((value % 1000 = 0)::INT) AS r FROM v WHERE value > 0 GROUP BY k), e AS (SELECT k, count(*) FILTER (value > 10 * mid OR value < 0.1 * mid) AS extreme FROM v JOIN m USING (k) WHERE value > 0 GROUP BY k) SELECT k, n, round(r, 6) AS round_share, extreme, CASE WHEN r > 0.5 THEN 30 ELSE 0 END + CASE WHEN extreme > 0 THEN 15 ELSE 0 END AS score FROM m JOIN e USING (k)",
    "risk_score": f"WITH s AS (SELECT c_custkey, round({_RISK.format(c='abs(c_acctbal) / 100', s='c_nationkey / 100::DOUBLE', v='abs(c_acctbal) / 20000')}, 6) AS score FROM customer) SELECT c_custkey, score, {_SEV.format(s='score', a=70, b=40)} AS severity, {_SEV.format(s='score', a=60, b=30)} AS severity_alt FROM s",
    "forensics": f"WITH {_BENFORD}, {_SERIES.replace('o_orderpriority AS k', 'c_mktsegment AS k').replace('FROM orders', 'FROM orders JOIN customer ON o_custkey = c_custkey')}, vol AS (SELECT k, round(stddev_pop(ret), 6) AS volatility FROM rets WHERE ret IS NOT NULL GROUP BY k), m AS (SELECT k, coalesce(anomaly, false) AS a, chi2, p_value, coalesce(volatility, 0.0) AS v FROM benford FULL JOIN vol USING (k)), r AS (SELECT *, round({_RISK.format(c='CASE WHEN a THEN chi2 ELSE 0.0 END', s='0.0', v='v')}, 6) AS score FROM m) SELECT k, coalesce(chi2, 0.0) AS chi2, coalesce(p_value, 1.0) AS p_value, v AS volatility, score AS risk_score, {_SEV.format(s='score', a=70, b=40)} AS severity, concat_ws(',', CASE WHEN a THEN 'BENFORD' END, CASE WHEN v > 0.30 THEN 'VOLATILITY' END) AS flags, (score > 0 OR a OR v > 0.30) AS anomaly FROM r",
    "ratio": f"WITH {FACTS} SELECT company, year, CASE WHEN gross <> 0 THEN round(net / gross::DOUBLE, 6) END AS margin, NULL::DOUBLE AS none FROM facts",
    "outlier_ref": "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN p_retailprice * l_quantity = 0 THEN false ELSE abs(l_extendedprice - p_retailprice * l_quantity) / abs(p_retailprice * l_quantity) > 0.20 END AS outlier FROM lineitem JOIN part ON l_partkey = p_partkey",
    "source_conflict": "WITH a AS (SELECT l_partkey AS part, l_suppkey AS source, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT / sum(l_quantity::BIGINT)::DOUBLE AS v FROM lineitem GROUP BY ALL) SELECT a.part, a.source, b.source AS other, CASE WHEN a.v = 0 OR b.v = 0 THEN false ELSE abs(a.v - b.v) / greatest(abs(a.v), abs(b.v)) > 0.05 END AS conflict FROM a JOIN a b ON a.part = b.part AND a.source < b.source",
}
