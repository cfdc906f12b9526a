"""Queries over pages and documents: text, headings, sections, chunks and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from ..operators import block_index as I
from ..operators import quality as Q
from ..operators import retrieval as R
from ..operators import sections as S
from ..operators import vector_index as V
from ..operators.written import scratch_path, written
from ..sources import html as H
from .finance import q


def _t(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _pages(spark, sf):
    return _t(spark, sf, "pages").select("page_id", "html")


def _headings(spark, sf):
    """All headings of pages in order, with the page they are on."""
    return H.dedupe_headings(H.ordered(H.page_headings(_pages(spark, sf))))


def _texts(spark, sf):
    return H.parsed(_pages(spark, sf)).select("page_id", "text")


def html_text(spark, sf):
    return _texts(spark, sf).select("page_id", F.length("text").alias("chars"), F.md5("text").alias("md5"))


def html_headings(spark, sf):
    return H.level_headings(_pages(spark, sf)).drop("page")


def _bolder(spark, sf):
    """Pages with their host as a bold run, and a number that is none."""
    host = F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)
    return _t(spark, sf, "pages").select("page_id", F.concat(F.lit("<p><b>Site "), host, F.lit("</b> and <strong class='x'>Page "), F.col("page_id").cast("string"), F.lit("</strong><b>1,234.5</b></p>"), "html").alias("html"))


def html_bold_headings(spark, sf):
    return H.bold_headings(_bolder(spark, sf)).drop("page")


def heading_dedupe(spark, sf):
    return _headings(spark, sf).select("page_id", "ord", "text", "font_size")


def page_estimate(spark, sf):
    return _headings(spark, sf).select("page_id", "ord", "page")


def clean_headings(spark, sf):
    return S.clean_headings(_headings(spark, sf)).select("page_id", "ord", "text", "depth")


def section_ranges(spark, sf):
    return S.page_ranges(S.clean_headings(_headings(spark, sf)), "page_id").select("page_id", "ord", "page", "end_page")


def section_tree(spark, sf):
    """Bold runs count as plain here, so that pages have two depths."""
    h = _headings(spark, sf).withColumn("is_bold", F.col("level") <= 6)
    return S.section_tree(S.clean_headings(h), "page_id").select("page_id", "ord", "depth", "parent")


def section_count(spark, sf):
    h = _headings(spark, sf).withColumn("is_bold", F.col("level") <= 6)
    return S.section_tree(S.clean_headings(h), "page_id").groupBy("page_id").agg(F.count("*").alias("sections"), F.count_if(F.col("parent").isNotNull()).alias("children"))


def sec_type(spark, sf):
    """Of headings that quote the kinds' words."""
    words = list(L.SECTIONS) + ["other"]
    h = _headings(spark, sf).withColumn("text", F.concat("text", F.lit(" "), F.element_at(F.array(*map(F.lit, words)), (F.col("ord") % len(words) + 1).cast("int"))))
    return S.section_kind(h).select("page_id", "ord", "sec_type")


def section_text(spark, sf):
    h = _headings(spark, sf).where("level <= 6").select("page_id", "ord", "text")
    return S.section_text(h, _texts(spark, sf), "page_id").select("page_id", "ord", F.length("text").alias("chars"), F.md5("text").alias("md5"))


def _docs(spark, sf):
    """Documents with a blank line after each line, as paragraphs have."""
    return _t(spark, sf, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))


def para_chunks(spark, sf):
    return S.paragraphs(_docs(spark, sf), "doc_id").select("doc_id", "ord", "section", F.length("text").alias("chars"), F.md5("text").alias("md5"))


def sentence_chunks(spark, sf):
    return S.chunk_documents(_docs(spark, sf), "doc_id").select("doc_id", "chunk_id", "section", F.length("text").alias("chars"))


def _outlined(spark, sf):
    """Pages' headings as sections and subsections, and pages' texts, from one pass over the pages."""
    pages = written(H.parsed(_pages(spark, sf)).select("page_id", "text", "elements"))
    return written(_tree_of(pages).select("page_id", "ord", "text", "parent")), pages.select("page_id", "text")


def _tree_of(pages):
    """Those of the larger sizes as sections, and bold runs below them."""
    h = H.dedupe_headings(H.ordered(H.page_headings(pages))).withColumn("is_bold", F.col("level") <= 6)
    return S.section_tree(S.clean_headings(h), "page_id")


def section_chunks(spark, sf):
    """Of pages whose texts repeat their headings, so that sections have a body."""
    h, texts = _outlined(spark, sf)
    return S.section_chunks(h, texts, "page_id").select("page_id", "ord", "section", "part", F.length("text").alias("chars"), F.md5("text").alias("md5"))


def fallback_chunks(spark, sf):
    """By sections, then by paragraphs, then as a whole."""
    h, texts = _outlined(spark, sf)
    got = S.chunk_documents(texts, "page_id", h)
    return got.groupBy("page_id").agg(F.count("*").alias("chunks"), F.max("chunk_id").alias("last"), F.sum(F.length("text")).alias("chars"))


def _labelled(spark, sf):
    """Paragraphs with the five fields of a chunk; some lack one."""
    p = S.paragraphs(_docs(spark, sf), "doc_id")
    src = _t(spark, sf, "documents").select("doc_id", F.col("source").alias("company"), F.col("lang").alias("fiscal_year"))
    kind = F.when(F.col("ord") % 5 == 4, "").otherwise("10-K")
    return p.join(src, "doc_id").select("doc_id", "ord", "section", "text", "company", kind.alias("doc_type"), "fiscal_year", (F.col("ord") + 1).cast("int").alias("page"))


def chunk_stats(spark, sf):
    return S.chunk_stats(_labelled(spark, sf)).select("doc_id", "ord", "char_count", "token_estimate", F.md5("prefixed_text").alias("prefixed_md5"))


def prefix_violations(spark, sf):
    return S.prefix_violations(_labelled(spark, sf)).select("doc_id", "ord", "lacks")


def doc_metadata(spark, sf):
    """Of documents that start with a title line made from their source."""
    head = F.concat(F.initcap("source"), F.lit(" Holdings Inc. "), F.element_at(F.array(F.lit("Form 10-K fiscal year ended June 30, 2021 "), F.lit("FORM 8 K FY 2019 "), F.lit("Annual Report 2020 10-Q "), F.lit("letter ")), (F.pmod("doc_id", F.lit(4)) + 1).cast("int")))
    d = _t(spark, sf, "documents").select("doc_id", F.concat(head, "text").alias("text"))
    m = T.doc_metadata(F.col("text"))
    return d.select("doc_id", *(c.alias(n) for n, c in m.items()))


def _questions(spark, sf):
    return _t(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))


def _chunks(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", "text")


def bm25_topk(spark, sf):
    return R.bm25(_questions(spark, sf), _chunks(spark, sf), "doc_id")


def bm25_index_topk(spark, sf):
    """Of an index that was stored in one part and grown by another."""
    d, path = _chunks(spark, sf), scratch_path(spark)
    late = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    I.store_index(d.where(~late), "doc_id", path)
    I.append_index(d.where(late), path)
    return I.search_index(_questions(spark, sf), path)


def term_overlap(spark, sf):
    return R.word_overlap(_questions(spark, sf), _chunks(spark, sf), "doc_id")


def _label_queries(spark, sf):
    """The vector of smallest id of each label."""
    return _t(spark, sf, "embeddings").groupBy(F.col("label").cast("long").alias("question_id")).agg(F.min_by("embedding", "vec_id").alias("embedding"))


def cosine_topk(spark, sf):
    return R.cosine(_label_queries(spark, sf), _t(spark, sf, "embeddings").select("vec_id", "embedding"), "vec_id")


def vector_index_topk(spark, sf):
    path = scratch_path(spark)
    V.store_vectors(_t(spark, sf, "embeddings").select("vec_id", "embedding"), "vec_id", path)
    return V.search_vectors(_label_queries(spark, sf), path)


def rrf_fusion(spark, sf):
    return R.fuse([bm25_topk(spark, sf), term_overlap(spark, sf)], "doc_id")


def rerank_topk(spark, sf):
    return R.rerank(rrf_fusion(spark, sf), None, "doc_id")


def _gated(spark, sf):
    sparse, dense = written(bm25_topk(spark, sf)), written(term_overlap(spark, sf))
    final = R.rerank(R.fuse([sparse, dense], "doc_id"), None, "doc_id")
    return R.gate(_questions(spark, sf), sparse, dense, final), final


def retrieval_gate(spark, sf):
    return _gated(spark, sf)[0]


def early_exit(spark, sf):
    g, final = _gated(spark, sf)
    first = final.where("rank = 1").join(_chunks(spark, sf), "doc_id").select("question_id", "text")
    return R.early_exit(g, first, llm=False)


def retrieval_features(spark, sf):
    """Why documents were retrieved, with their source as company and their language as section."""
    d = _t(spark, sf, "documents").select("doc_id", "text", F.col("source").alias("company"), F.concat(F.lit("FY20"), F.pmod("doc_id", F.lit(30)).cast("string")).alias("fiscal_year"), F.concat(F.element_at(F.array(F.lit("Income Statement "), F.lit("MD&A "), F.lit("Exhibit ")), (F.pmod("doc_id", F.lit(3)) + 1).cast("int")), "lang").alias("section"), F.when(F.col("doc_id") % 4 > 0, F.col("doc_id").cast("string")).otherwise("n/a").alias("page"))
    hits = bm25_topk(spark, sf).select("question_id", "doc_id", "norm").join(term_overlap(spark, sf).select("question_id", "doc_id", F.col("norm").alias("dense")), ["question_id", "doc_id"], "left")
    f = R.retrieval_features(F.col("section"), F.col("page"), F.col("text"), F.col("fiscal_year"), F.col("company"), F.lit("FY2021"), F.lit("SRC1"), F.col("norm"), F.col("dense"))
    return hits.join(d, "doc_id").select("question_id", "doc_id", *(F.round(c, 6).alias(n) for n, c in f.items()))


def quality_filter(spark, sf):
    """Documents of ten characters or more that report no error."""
    d = _chunks(spark, sf).withColumn("text", F.when(F.pmod("doc_id", F.lit(7)) == 0, F.concat(F.lit("Error: "), "text")).otherwise(F.col("text")))
    return Q.useful(d).select("doc_id")


def tag_counts(spark, sf):
    """How often pages use each tag."""
    return _pages(spark, sf).select(F.explode(F.regexp_extract_all("html", F.lit(r"<([a-zA-Z][a-zA-Z0-9]*)"), F.lit(1))).alias("tag")).groupBy(F.lower("tag").alias("tag")).agg(F.count("*").alias("n"))


def ixbrl_facts(spark, sf):
    """Pages' own byte counts, written as inline facts and read back."""
    p = _pages(spark, sf)
    scale = F.element_at(F.array(*map(F.lit, ["0", "-3", "-6", "6", "-2"])), (F.pmod("page_id", F.lit(5)) + 1).cast("int"))
    number = F.format_number(F.length("html"), 0)
    fact = F.concat(F.lit('<div><ix:nonFraction name="us-gaap:Revenues" contextRef="c-'), (F.pmod("page_id", F.lit(3)) + 1).cast("string"), F.lit('" unitRef="USD" scale="'), scale, F.lit("\"><span>$</span> <div>"), F.substring(number, 1, 1), F.lit("</div>"), F.expr("substring(format_number(length(html), 0), 2)"), F.lit("</ix:nonFraction></div><ix:nonFraction name='dei:Title' contextRef='c-0' unitRef=shares>&#49;&nbsp;</ix:nonFraction><ix:nonFraction name='' contextRef='c-0'>5</ix:nonFraction>"))
    return H.facts(p.select("page_id", F.concat("html", fact).alias("html"))).select("page_id", "pos", "name", "context", "value", "unit", F.round("scaled", 9).alias("scaled"))


def html_table_cells(spark, sf):
    """Pages' urls and sizes, written as a table with inner elements and references, and read back."""
    row = lambda a, b, c: F.concat(F.lit("<tr><td>"), a, F.lit("</td><td>"), b, F.lit("</td><td>"), c, F.lit("</td></tr>"))
    p = _t(spark, sf, "pages")
    host = F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)
    inner = F.concat(F.lit("<div>at <div><b>"), host, F.lit("</b></div> now</div>"))
    t = F.concat(F.lit("<table><tr><th>Metric</th><th>FY2023</th><th>FY&#50;022</th></tr>"), row(F.lit("Bytes"), F.length("html").cast("string"), F.lit("&mdash;")), row(F.lit("R&amp;D caf&eacute;"), inner, F.lit("&#36;")), F.lit("<tr><td>Url<td>"), F.col("url"), F.lit("<td>"), F.length("url").cast("string"), F.lit("</table>"))
    return H.table_cells(p.select("page_id", F.concat("html", t).alias("html"))).select("page_id", "row_header", "col_header", "value")


QUERIES = {
    "html_text": html_text, "html_headings": html_headings, "html_bold_headings": html_bold_headings, "heading_dedupe": heading_dedupe, "page_estimate": page_estimate, "clean_headings": clean_headings, "section_ranges": section_ranges,
    "section_tree": section_tree, "section_count": section_count, "sec_type": sec_type, "section_text": section_text, "para_chunks": para_chunks, "sentence_chunks": sentence_chunks, "section_chunks": section_chunks, "fallback_chunks": fallback_chunks, "retrieval_features": retrieval_features, "chunk_stats": chunk_stats, "prefix_violations": prefix_violations,
    "doc_metadata": doc_metadata, "bm25_topk": bm25_topk, "bm25_index_topk": bm25_index_topk, "vector_index_topk": vector_index_topk, "term_overlap": term_overlap, "cosine_topk": cosine_topk, "rrf_fusion": rrf_fusion, "rerank_topk": rerank_topk, "retrieval_gate": retrieval_gate, "early_exit": early_exit,
    "quality_filter": quality_filter, "tag_counts": tag_counts, "ixbrl_facts": ixbrl_facts, "html_table_cells": html_table_cells,
}

_BARE = r"regexp_replace(html, '(?s)<!--.*?-->', '<!>', 'g')"
for _tag in ("script", "style", "noscript"):
    _BARE = rf"regexp_replace({_BARE}, '(?is)<{_tag}[^>]*>.*?</{_tag}>', '<!>', 'g')"
#: The character references that the given pages hold.
_DECODED = "replace({0}, '&copy;', '©')"
for _name, _char in (("&middot;", "·"), ("&quot;", '"'), ("&amp;", "&"), ("&amp", "&")):
    _DECODED = f"replace({_DECODED}, '{_name}', '{_char}')"
_TEXT = rf"regexp_replace(regexp_replace({_DECODED.format(rf"array_to_string(list_filter(regexp_split_to_array({_BARE}, '<[^>]*(>|$)'), lambda x: x <> ''), chr(10))")}, '\n{{3,}}', chr(10) || chr(10), 'g'), '[ \t]+', ' ', 'g')"
_PLAIN = _DECODED.format(r"array_to_string(list_filter(list_transform(regexp_split_to_array({0}, '<[^>]*(>|$)'), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> ''), ' ')")


def _runs(tag: str, close: str) -> str:
    """Elements of a tag up to what closes them, with their place."""
    return rf"SELECT page_id, i, tags[i] AS tag, {_PLAIN.format('r[i]')} AS text FROM (SELECT page_id, tags, r, unnest(range(1, len(r) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '(?is)<({tag})(?:\s[^>]*)?>(.*?)(?:{close}|$)', 1) AS tags, regexp_extract_all(html, '(?is)<({tag})(?:\s[^>]*)?>(.*?)(?:{close}|$)', 2) AS r FROM bare))"


_SIZED = "[" + ", ".join(f"{x}::DOUBLE" for x in H.SIZES.values()) + "]"
_BAREP = f"bare AS (SELECT page_id, {_BARE} AS html FROM pages)"
_LEVELS = rf"{_BAREP}, levels AS (SELECT page_id, tag[2]::INT AS level, (row_number() OVER (PARTITION BY page_id ORDER BY i) - 1)::INT AS pos, text, {_SIZED}[tag[2]::INT] AS font_size, true AS is_bold FROM ({_runs('h[1-6]', '</h[1-6]>')}) WHERE length(text) BETWEEN 3 AND 200)"
#: A bold run ends at its own end or where a paragraph begins or its block ends.
_BOLDS = rf"bolds AS (SELECT page_id, 7 AS level, (row_number() OVER (PARTITION BY page_id ORDER BY i) - 1)::INT AS pos, text, {H.BOLD}::DOUBLE AS font_size, true AS is_bold FROM ({_runs('b|strong', '</b>|</strong>|<p[ >]|</p>|</article>|</body>')}) WHERE length(text) BETWEEN 3 AND 120 AND len(regexp_split_to_array(text, '\s+')) <= 12 AND NOT regexp_matches(text, '^[\d\s,.\-$()]+$'))"
_HEAD = f"""{_LEVELS}, {_BOLDS}, alls AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY level, pos, text)::INT AS ord FROM (SELECT * FROM levels UNION ALL SELECT * FROM bolds)),
heads AS (SELECT * FROM alls QUALIFY row_number() OVER (PARTITION BY page_id, lower(trim(text)) ORDER BY ord) = 1), texts AS (SELECT page_id, {_TEXT} AS body FROM pages),
placed AS (SELECT h.*, greatest(1, floor((instr(body, substr(text, 1, 30)) - 1) / 5000.0)::INT + 1) AS page FROM heads h JOIN texts USING (page_id)),
clean AS (SELECT *, CASE WHEN font_size >= 16 OR (font_size >= 13 AND is_bold) THEN 1 ELSE 2 END AS depth FROM placed WHERE length(text) BETWEEN 3 AND 200 AND NOT regexp_matches(text, '^[\\d\\s.\\-]+$'))"""
_TREE = f"{_HEAD}, two AS (SELECT *, CASE WHEN font_size >= 16 OR (font_size >= 13 AND level <= 6) THEN 1 ELSE 2 END AS dep FROM clean), tree AS (SELECT page_id, ord, dep AS depth, CASE WHEN dep = 2 THEN last_value(CASE WHEN dep = 1 THEN ord END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS parent FROM two)"
#: Each section up to the next, each subsection up to the next of its section or else the next section.
_SECTIONS = f"""{_TREE}, named AS (SELECT t.page_id, t.ord, t.parent, c.text FROM tree t JOIN clean c USING (page_id, ord)),
tops AS (SELECT page_id, ord, text, lead(text) OVER (PARTITION BY page_id ORDER BY ord) AS nxt FROM named WHERE parent IS NULL),
subs AS (SELECT n.page_id, n.ord, n.text, coalesce(lead(n.text) OVER (PARTITION BY n.page_id, n.parent ORDER BY n.ord), p.nxt) AS nxt FROM named n JOIN tops p ON p.page_id = n.page_id AND p.ord = n.parent),
found AS (SELECT h.*, body, instr(lower(body), lower(substr(text, 1, 30))) AS pos0 FROM (SELECT * FROM tops UNION ALL SELECT * FROM subs) h JOIN texts USING (page_id)),
upto AS (SELECT *, CASE WHEN nxt IS NOT NULL THEN instr(substr(lower(body), pos0 + length(text)), lower(substr(nxt, 1, 30))) ELSE 0 END AS off FROM found WHERE pos0 > 0),
whole AS (SELECT page_id, ord, text AS section, trim(substr(body, pos0, CASE WHEN off > 0 THEN length(text) + off - 1 ELSE 50000 END)) AS text FROM upto), bodies AS (SELECT * FROM whole WHERE length(text) >= 50)"""
_KINDS = list(L.SECTIONS) + ["other"]
_PARA = r"""paras AS (SELECT doc_id, (i - 1)::INT AS ord, regexp_replace(p[i], '^\s+|\s+$', '', 'g') AS text FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, regexp_split_to_array(replace(text, chr(10), chr(10) || chr(10)), '\n\s*\n') AS p FROM documents))),
titled AS (SELECT *, length(text) < 50 AND len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) BETWEEN 1 AND 5 AND length(text) <= 60 AS title FROM paras),
chunked AS (SELECT doc_id, ord, coalesce(last_value(CASE WHEN title THEN substr(text, 1, 50) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'DOCUMENT') AS section, text FROM titled QUALIFY length(text) >= 50),
labelled AS (SELECT c.*, source AS company, CASE WHEN ord % 5 = 4 THEN '' ELSE '10-K' END AS doc_type, lang AS fiscal_year, ord + 1 AS page FROM chunked c JOIN documents USING (doc_id))"""


def _packed(source: str, keys: str, least: int = 50) -> str:
    """CTE packs: keys, part, text of source (keys, text), its sentences folded into chunks."""
    return rf"""sents AS MATERIALIZED (SELECT {keys}, t, CASE WHEN length(t) <= 1600 THEN NULL ELSE string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(31), 'g'), chr(31)) END AS ss FROM (SELECT {keys}, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM {source})),
fold AS (SELECT {keys}, ss, 0 AS i, '' AS cur, NULL::VARCHAR AS done FROM sents WHERE ss IS NOT NULL
 UNION ALL SELECT {keys}, ss, i + 1, CASE WHEN length(cur) + length(ss[i + 1]) > 1600 AND cur <> '' THEN CASE WHEN length(cur) > 100 THEN right(cur, 100) ELSE cur END || ' ' || ss[i + 1] ELSE trim(cur || ' ' || ss[i + 1]) END,
  CASE WHEN length(cur) + length(ss[i + 1]) > 1600 AND cur <> '' AND length(cur) >= {least} THEN cur END FROM fold WHERE i < len(ss)),
packs AS (SELECT {keys}, (row_number() OVER (PARTITION BY {keys} ORDER BY i) - 1)::INT AS part, text FROM (SELECT {keys}, 0 AS i, t AS text FROM sents WHERE ss IS NULL AND length(t) >= {least}
 UNION ALL SELECT {keys}, i, done FROM fold WHERE done IS NOT NULL UNION ALL SELECT {keys}, i + 1, cur FROM fold WHERE i = len(ss) AND length(cur) >= {least}))"""


_STOPS = "(" + ", ".join(map(q, L.SEARCH_STOPS)) + ")"
_TOK = r"list_filter(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda w: w NOT IN " + _STOPS.replace("{", "{{") + ")"
_TOP = "SELECT question_id, {k}, score, round(score / CASE WHEN first_value(score) OVER w > 0 THEN first_value(score) OVER w ELSE 1 END, 6) AS norm, (row_number() OVER w)::INT AS rank FROM {s} WINDOW w AS (PARTITION BY question_id ORDER BY score DESC, {k}) QUALIFY row_number() OVER w <= 10"
_BM25 = f"""toks AS MATERIALIZED (SELECT doc_id, {_TOK.format('text')} AS ts FROM documents), post AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf, max(l) AS len FROM (SELECT doc_id, len(ts) AS l, unnest(ts) AS term FROM toks) GROUP BY ALL),
asked AS (SELECT DISTINCT item_id AS question_id, unnest({_TOK.format('text')}) AS term FROM benchmark), st AS (SELECT count(*) AS n, avg(len(ts)) AS a FROM toks),
dfs AS (SELECT term, ln(1 + (n - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM post, st GROUP BY term, n),
bsum AS (SELECT question_id, doc_id, round(sum(idf * tf / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / a))), 6) AS score FROM asked JOIN post USING (term) JOIN dfs USING (term), st GROUP BY ALL HAVING score > 0),
bm AS ({_TOP.format(k='doc_id', s='bsum')})"""
_OVER = rf"""osum AS (SELECT question_id, doc_id, count(*)::DOUBLE AS score FROM (SELECT DISTINCT item_id AS question_id, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')) AS term FROM benchmark)
 JOIN (SELECT DISTINCT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')) AS term FROM documents) USING (term) GROUP BY ALL), ov AS ({_TOP.format(k='doc_id', s='osum')})"""


def _fuse(a: str, b: str, name: str) -> str:
    return f"""{name}_s AS (SELECT question_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min([list, rank]) AS seen FROM (SELECT question_id, doc_id, rank, 0 AS list FROM {a} UNION ALL SELECT question_id, doc_id, rank, 1 FROM {b}) GROUP BY ALL),
{name} AS (SELECT question_id, doc_id, score, round(score / first_value(score) OVER w, 6) AS norm, (row_number() OVER w)::INT AS rank FROM {name}_s WINDOW w AS (PARTITION BY question_id ORDER BY score DESC, seen, doc_id) QUALIFY row_number() OVER w <= 10)"""


_GATE = f"""{_BM25}, {_OVER}, sp AS (SELECT * FROM bm), de AS (SELECT * FROM ov), {_fuse('sp', 'de', 'fu')}, fin AS (SELECT * FROM fu WHERE rank <= 3),
gated AS (SELECT item_id AS question_id, (SELECT count(*) FROM sp WHERE question_id = item_id) AS n_sparse, (SELECT count(*) FROM de WHERE question_id = item_id) AS n_dense, (SELECT count(*) FROM fin WHERE question_id = item_id) AS n_final, round(coalesce((SELECT max(score) FROM fin WHERE question_id = item_id), 0.0), 6) AS best FROM benchmark),
gate AS (SELECT *, NOT (n_sparse + n_dense + n_final = 0 OR (n_sparse = 0 AND n_final > 0 AND best < 0.3)) AS signal FROM gated)"""
_META_HEAD = "upper(source[1]) || substr(source, 2) || ' Holdings Inc. ' || ['Form 10-K fiscal year ended June 30, 2021 ', 'FORM 8 K FY 2019 ', 'Annual Report 2020 10-Q ', 'letter '][doc_id % 4 + 1] || text"
_FLAT = "replace(replace(upper(replace(substr(t, 1, 3000), 'ß', 'SS')), '-', ''), ' ', '')"

ORACLES = {
    "html_text": f"SELECT page_id, length(t)::INT AS chars, md5(t) AS md5 FROM (SELECT page_id, {_TEXT} AS t FROM pages)",
    "html_headings": f"WITH {_LEVELS} SELECT * FROM levels",
    "html_bold_headings": "WITH bare AS (SELECT page_id, '<p><b>Site ' || regexp_extract(url, '^[a-z]+://([^/]+)', 1) || '</b> and <strong class=''x''>Page ' || page_id || '</strong><b>1,234.5</b></p>' || " + _BARE + " AS html FROM pages), " + _BOLDS + " SELECT * FROM bolds",
    "heading_dedupe": f"WITH {_HEAD} SELECT page_id, ord, text, font_size FROM heads",
    "page_estimate": f"WITH {_HEAD} SELECT page_id, ord, page FROM placed",
    "clean_headings": f"WITH {_HEAD} SELECT page_id, ord, text, depth FROM clean",
    "section_ranges": f"WITH {_HEAD} SELECT page_id, ord, page, coalesce(lead(page) OVER (PARTITION BY page_id ORDER BY ord), page + 50)::INT AS end_page FROM clean",
    "section_tree": f"WITH {_TREE} SELECT * FROM tree",
    "section_count": f"WITH {_TREE} SELECT page_id, count(*) AS sections, count(parent) AS children FROM tree GROUP BY page_id",
    "sec_type": f"WITH {_HEAD}, k AS (SELECT page_id, ord, lower(text || ' ' || [{', '.join(map(q, _KINDS))}][ord % {len(_KINDS)} + 1]) AS t FROM placed) SELECT page_id, ord, CASE " + " ".join(f"WHEN contains(t, {q(w)}) THEN {q(k)}" for w, k in L.SECTIONS.items()) + " ELSE 'Other' END AS sec_type FROM k",
    "section_text": f"""WITH {_HEAD}, n AS (SELECT page_id, ord, text, lead(text) OVER (PARTITION BY page_id ORDER BY ord) AS nxt FROM placed WHERE level <= 6), a AS (SELECT n.*, body, instr(lower(body), lower(substr(text, 1, 30))) AS pos0 FROM n JOIN texts USING (page_id)),
        e AS (SELECT *, CASE WHEN nxt IS NOT NULL THEN instr(substr(lower(body), pos0 + length(text)), lower(substr(nxt, 1, 30))) ELSE 0 END AS off FROM a WHERE pos0 > 0),
        x AS (SELECT page_id, ord, trim(substr(body, pos0, CASE WHEN off > 0 THEN length(text) + off - 1 ELSE 50000 END)) AS t FROM e) SELECT page_id, ord, length(t)::INT AS chars, md5(t) AS md5 FROM x""",
    "para_chunks": f"WITH {_PARA} SELECT doc_id, ord, section, length(text)::INT AS chars, md5(text) AS md5 FROM chunked",
    "sentence_chunks": f"""WITH RECURSIVE {_PARA}, src AS (SELECT doc_id, ord, section, text FROM chunked), {_packed('src', 'doc_id, ord, section')},
        w AS (SELECT doc_id, 0 AS ord, 'DOCUMENT' AS section, replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM chunked)), {_packed('w', 'doc_id, ord, section', 1).replace('sents', 'wsents').replace('fold', 'wfold').replace('packs', 'wpacks')},
        c AS (SELECT * FROM packs UNION ALL SELECT * FROM wpacks) SELECT doc_id, 'chunk_' || lpad((row_number() OVER (PARTITION BY doc_id ORDER BY ord, part) - 1)::VARCHAR, 4, '0') AS chunk_id, section, length(text)::INT AS chars FROM c""",
    "section_chunks": f"WITH RECURSIVE {_SECTIONS}, {_packed('bodies', 'page_id, ord, section')} SELECT page_id, ord, section, part, length(text)::INT AS chars, md5(text) AS md5 FROM packs",
    "chunk_stats": f"WITH {_PARA} SELECT doc_id, ord, length(text)::INT AS char_count, (length(text) // 4)::INT AS token_estimate, md5(concat_ws(' / ', company, doc_type, fiscal_year, section, page) || chr(10) || text) AS prefixed_md5 FROM labelled",
    "prefix_violations": f"WITH {_PARA} SELECT doc_id, ord, unnest(list_filter([CASE WHEN trim(company) = '' THEN 'company' END, CASE WHEN trim(doc_type) = '' THEN 'doc_type' END, CASE WHEN trim(fiscal_year) = '' THEN 'fiscal_year' END, CASE WHEN trim(section) = '' THEN 'section' END], lambda x: x IS NOT NULL)) AS lacks FROM labelled",
    "doc_metadata": f"SELECT doc_id, trim(regexp_extract(substr(t, 1, 2000), {q(L.COMPANY)}, 1)) AS company, CASE " + " ".join(f"WHEN contains({_FLAT}, {q(d.replace('-', ''))}) THEN {q(d)}" for d in L.DOC_TYPES) + " ELSE 'UNKNOWN' END AS doc_type, coalesce('FY' || coalesce(" + ", ".join(f"nullif(regexp_extract(substr(t, 1, 5000), {q(p)}, 1), '')" for p in L.FILING_YEARS) + f"), '') AS fiscal_year FROM (SELECT doc_id, {_META_HEAD} AS t FROM documents)",
    "bm25_topk": f"WITH {_BM25} SELECT * FROM bm",
    "term_overlap": f"WITH {_OVER} SELECT * FROM ov",
    "cosine_topk": f"WITH qs AS (SELECT label::BIGINT AS question_id, arg_min(embedding, vec_id)::DOUBLE[] AS q FROM embeddings GROUP BY label), s AS (SELECT question_id, vec_id, round(greatest(0.0, list_dot_product(q, embedding::DOUBLE[]) / (sqrt(list_dot_product(q, q)) * sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])))), 6) AS score FROM qs, embeddings) {_TOP.format(k='vec_id', s='s')}",
    "rrf_fusion": f"WITH {_BM25}, {_OVER}, {_fuse('bm', 'ov', 'fu')} SELECT * FROM fu",
    "rerank_topk": f"WITH {_BM25}, {_OVER}, {_fuse('bm', 'ov', 'fu')} SELECT question_id, doc_id, score, score AS reranker_score, rank FROM fu WHERE rank <= 3",
    "retrieval_gate": f"WITH {_GATE} SELECT * FROM gate",
    "early_exit": f"WITH {_GATE} SELECT g.question_id, CASE WHEN NOT signal THEN 'INSUFFICIENT_DATA' ELSE 'LLM_UNAVAILABLE: ' || substr(coalesce(text, ''), 1, 300) END AS answer, CASE WHEN signal THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END AS confidence FROM gate g LEFT JOIN (SELECT question_id, text FROM fin JOIN documents USING (doc_id) WHERE rank = 1) USING (question_id)",
    "retrieval_features": f"""WITH {_BM25}, {_OVER}, h AS (SELECT b.question_id, b.doc_id, b.norm, o.norm AS dense FROM bm b LEFT JOIN ov o USING (question_id, doc_id))
        SELECT question_id, doc_id, round(norm, 6) AS f_bm25, round(coalesce(dense, 0.5::DOUBLE), 6) AS f_cosine, [1.0::DOUBLE, 0.8::DOUBLE, 0.5::DOUBLE][doc_id % 3 + 1] AS f_section, CASE WHEN doc_id % 4 > 0 THEN round(least(doc_id / 300.0::DOUBLE, 1.0::DOUBLE), 6) ELSE 0.5::DOUBLE END AS f_page,
        round(least(length(text) / 1000.0::DOUBLE, 1.0::DOUBLE), 6) AS f_length, CASE WHEN regexp_matches(text, '[$%|\t]') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS f_table, CASE WHEN doc_id % 30 = 21 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS f_year, CASE WHEN contains(source, 'src1') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS f_company FROM h JOIN documents USING (doc_id)""",
    "quality_filter": "SELECT doc_id FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'Error: ' || text ELSE text END AS t FROM documents) WHERE length(trim(t)) >= 10 AND NOT regexp_matches(lower(t), 'error:|failed:|exception:')",
    "tag_counts": "SELECT lower(t) AS tag, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1)) AS t FROM pages) GROUP BY 1",
    "ixbrl_facts": "SELECT page_id, 0 AS pos, 'us-gaap:Revenues' AS name, 'c-' || (page_id % 3 + 1) AS context, '$' || format('{:,}', length(html)) AS value, ['USD', 'thousand', 'million', 'x10^6', '%'][page_id % 5 + 1] AS unit, round(length(html) * pow(10.0, [0, -3, -6, 6, -2][page_id % 5 + 1]), 9) AS scaled FROM pages UNION ALL SELECT page_id, 1, 'dei:Title', 'c-0', '1', 'shares', 1.0 FROM pages",
    "html_table_cells": "SELECT page_id, unnest(['Bytes', 'R&D café', 'Url', 'Url']) AS row_header, unnest(['FY2023', 'FY2023', 'FY2023', 'FY2022']) AS col_header, unnest([length(html)::VARCHAR, 'at ' || regexp_extract(url, '^[a-z]+://([^/]+)', 1) || ' now', url, length(url)::VARCHAR]) AS value FROM pages",
}
ORACLES |= {"bm25_index_topk": ORACLES["bm25_topk"], "vector_index_topk": ORACLES["cosine_topk"]}
