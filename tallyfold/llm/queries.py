"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import secrets

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom_dedup, bpe_prefix, chat_prefixes, cover_tree_topk, divergence_audit, document_packing, graph_ann, katz_lm, line_dedup, minhash_postings, pii_feistel, quality_nbsvm, spelling_variants

VOCABULARY = "word_bpe_49k.json"
#: A job that wants the same pseudonyms as another sets its key; pseudonyms are only as secret as it is.
PII_KEY = "tallyfold.pii.key"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def vocabulary() -> str:
    return public_tokenizers.path(VOCABULARY)


def pii_key(spark: SparkSession) -> str:
    """The key that is set; else a random one, which this session keeps."""
    if not spark.conf.get(PII_KEY, None):
        spark.conf.set(PII_KEY, secrets.token_hex(32))
    return spark.conf.get(PII_KEY)


def fold(remainder: int) -> str:
    return f"crc32(cast(doc_id as string)) % 5 = {remainder}"


def op1_cover_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree_topk.exact_topk(_read(spark, sf_dir, "embeddings"), "vec_id % 100 = 0", k=10)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = quality_nbsvm.train(docs, _read(spark, sf_dir, "labels"), f"not ({fold(0)})")
    return quality_nbsvm.score(docs, model).select("doc_id", F.expr(fold(0)).alias("held_out"), "score", "predicted")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_prefix.round_trip_digests(_read(spark, sf_dir, "documents"), vocabulary())


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text", "n_chars"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return chat_prefixes.read_back(chat_prefixes.format_conversations(turns.unionByName(more)))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_postings.near_duplicates(_read(spark, sf_dir, "documents"))


def op7_graph_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_ann.approximate_neighbours(_read(spark, sf_dir, "embeddings"), "vec_id % 20 = 0", k=20)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_packing.packed_documents(_read(spark, sf_dir, "documents"), vocabulary())


def op9_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = katz_lm.learn_and_score(_read(spark, sf_dir, "documents").select("doc_id", "text"), f"not ({fold(1)})")
    return scored.select("doc_id", F.expr(fold(1)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_feistel.counted(_read(spark, sf_dir, "documents"), pii_key(spark))


def op11_bloom_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_dedup.copies(_read(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.spelling_variants(_read(spark, sf_dir, "documents"))


def op13_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_audit.divergence_audit(_read(spark, sf_dir, "documents"))


def queries() -> dict:
    ops = (op1_cover_tree_topk, op2_quality, op3_bpe, op4_line_dedup, op5_chat, op6_minhash, op7_graph_ann, op8_packing, op9_katz, op10_pii, op11_bloom_dedup, op12_spelling_variants, op13_divergence_audit)
    return {f.__name__: f for f in ops}


_ESCAPED = r"""replace(replace(replace(replace(replace(replace({}, '\', '\\'), '<|', '<\|'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]')"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_cover_tree_topk": """
            WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
                       WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
            s AS (SELECT q.vec_id AS query_id, r.vec_id, list_dot_product(q.e, r.e)::BIGINT AS score
                  FROM v q, v r WHERE q.vec_id % 100 = 0 AND q.vec_id <> r.vec_id),
            k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
            SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 10""",
        "op5_chat": f"""
            WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                       UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
            n AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS m,
                         sum(length({_ESCAPED.format('role')}) + length(role) - length(replace(role, chr(10), '')) + length({_ESCAPED.format('text')}) + {len(chat_prefixes.START) + len(chat_prefixes.END) + 2}) OVER w AS upto
                  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING))
            SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
                   coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
                   sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
                   (sum(upto) FILTER (role = 'assistant' OR i = m))::BIGINT AS formatted_chars
            FROM n GROUP BY conv_id""",
        "op6_minhash": r"""
            WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
            s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
            n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
            p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
            e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
            r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
            SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, m.c = d.doc_id AS kept
            FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) m ON m.a = d.doc_id""",
        "op11_bloom_dedup": """
            WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS s FROM documents),
            g AS (SELECT *, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size FROM d WINDOW w AS (PARTITION BY s))
            SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, s AS text_sha256 FROM g""",
        "op12_spelling_variants": """
            WITH RECURSIVE crc AS MATERIALIZED (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b)) AS t),
            r AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\u00C0-\u00FF]+')) AS w FROM documents),
            k AS MATERIALIZED (SELECT w, count(*) AS c, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w)) AS x FROM r WHERE length(w) >= 7 GROUP BY ALL),
            h AS MATERIALIZED (SELECT w, c, xor(list_reduce(range(1, length(x), 2), lambda a, i: xor(a // 256, t[xor(a % 256, ('0x' || x[i:i + 1])::BIGINT) + 1]), 4294967295), 4294967295) AS h FROM k, crc),
            v AS MATERIALIZED (SELECT word, sum(c)::BIGINT AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN w[:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS word, c FROM h) WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
            i AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
            gone AS MATERIALIZED (SELECT DISTINCT word, n, word[:i - 1] || word[i + 1:] AS f FROM i),
            star AS MATERIALIZED (SELECT word, n, word[:i - 1] || '*' || word[i + 1:] AS f FROM i),
            near AS (SELECT a.word, b.word AS near, b.n FROM star a JOIN star b ON a.f = b.f AND a.word <> b.word
                     UNION ALL SELECT a.word, b.word, b.n FROM gone a JOIN v b ON a.f = b.word UNION ALL SELECT b.word, a.word, a.n FROM gone a JOIN v b ON a.f = b.word),
            best AS (SELECT word, near, n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY n DESC, near) AS k FROM near),
            o AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN b.n >= 10 * v.n THEN near END AS form, CASE WHEN b.n >= 10 * v.n THEN b.n END AS form_n
                  FROM v LEFT JOIN (SELECT * FROM best WHERE k = 1) b USING (word)),
            chain AS (SELECT word, word AS root FROM o UNION ALL SELECT c.word, o.form FROM chain c JOIN o ON o.word = c.root WHERE o.form IS NOT NULL)
            SELECT o.word, o.form, c.root, o.n, o.n_near, o.form_n FROM o JOIN chain c USING (word) JOIN o z ON z.word = c.root AND z.form IS NULL""",
        "op13_divergence_audit": r"""
            WITH d AS MATERIALIZED (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
            o AS MATERIALIZED (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS item FROM d),
            k AS MATERIALIZED (SELECT lang, item, count(*) AS c FROM o GROUP BY ALL HAVING count(DISTINCT id) >= 30),
            l AS MATERIALIZED (SELECT lang, coalesce(sum(c), 0)::HUGEINT AS n, count(item)::HUGEINT AS v FROM (SELECT DISTINCT lang FROM d) LEFT JOIN k USING (lang) GROUP BY lang),
            g AS MATERIALIZED (SELECT lang, source, coalesce(sum(c), 0)::HUGEINT AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT o.lang, o.source, count(*) AS c FROM o JOIN k USING (lang, item) GROUP BY ALL) USING (lang, source) GROUP BY ALL),
            c AS MATERIALIZED (SELECT o.lang, o.source, o.item, count(*)::HUGEINT AS c FROM o JOIN k USING (lang, item) GROUP BY ALL),
            p AS MATERIALIZED (SELECT g.lang, g.source, k.item, coalesce(c.c, 0) AS c, 1 + 1000000000 * (coalesce(c.c, 0) + 5) // (g.n + 5 * l.v) AS p, 1 + 1000000000 * (k.c::HUGEINT + 5) // (l.n + 5 * l.v) AS q
                  FROM g JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.item = k.item),
            f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.item = b.item AND a.source <> b.source GROUP BY ALL),
            r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
                  UNION ALL SELECT lang, source, 'term', item, (p - q)::BIGINT FROM p WHERE c > 0 AND p > q),
            s AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM r)
            SELECT lang, source, part, item, value, rank FROM s WHERE part = 'pair' OR rank <= 50""",
    }
