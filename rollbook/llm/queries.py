"""The registered queries of the corpus operators, with SQL twins where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (audit, extract, mixing, neighbours, overlap, packing, paragraphs, private, quality, ranking, rules, secrets,
               tokens)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, table: str = "documents", sql: str | None = None):
    def wrap(fn: Callable[[SparkSession, DataFrame, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(spark, spark.read.parquet(f"{sf_dir}/{table}.parquet"), sf_dir)
        if sql is not None:
            SQL[name] = sql
        return fn

    return wrap


def tokenizer_file(name: str) -> str:
    """Where the vocabulary file is; the same place on every machine."""
    import public_tokenizers
    return public_tokenizers.path(name)


def _of(spans: str, *kinds: str) -> Column:
    return F.filter(spans, lambda x: x["kind"].isin(*kinds))


def _said(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def mix_sql(docs: str) -> str:
    """CTEs ending in ``mix``: every column of ``docs`` with size, source_size, target and copies."""
    return rf"""
    sized AS (SELECT *, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM {docs}),
    by_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
    weighed AS (SELECT *, 2.0::DOUBLE * source_size AS cap,
                  [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM by_source),
    filled AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, w, source
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                  / sum(w) OVER (ORDER BY cap / w, w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev
               FROM weighed),
    level AS (SELECT lev FROM filled WHERE cap >= w * lev ORDER BY lev DESC LIMIT 1),
    targets AS (SELECT source, source_size, CASE WHEN source_size = 0 THEN 0.0::DOUBLE
                  ELSE least(cap, w * coalesce((SELECT lev FROM level), 0)) END AS target FROM weighed),
    placed AS (SELECT s.*, t.source_size, t.target,
                 CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS rounds,
                 sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
               FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
    mix AS (SELECT *, rounds + CASE WHEN upto <= target - rounds * source_size THEN 1 ELSE 0 END AS copies FROM placed)"""


@query("op1_mixing", sql=f"""WITH {mix_sql('documents')}
    SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken FROM mix""")
def op1(spark, docs, sf_dir):
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@query("op2_overlap_join")
def op2(spark, docs, sf_dir):
    return overlap.join(docs).select("doc_id", "n_shingles", "component_id")


@query("op3_packing")
def op3(spark, docs, sf_dir):
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


@query("op7_token_counts")
def op7(spark, docs, sf_dir):
    return tokens.count(docs.select("doc_id", "text"), tokenizer_file("piece_bpe_32k.model"))


@query("op8_nearest", table="embeddings")
def op8(spark, vectors, sf_dir):
    return neighbours.search(vectors)


@query("op9_quality_rules")
def op9(spark, docs, sf_dir):
    return rules.check(docs).select("doc_id", *rules.NEW[:5], "base_failed", "kept")


@query("op4_quality")
def op4(spark, docs, sf_dir):
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))
    return quality.score(docs.select("doc_id", "text"), model).withColumn("held_out", held)


@query("op5_repeated_passages")
def op5(spark, docs, sf_dir):
    return paragraphs.repeats(docs)


@query("op6_personal_data")
def op6(spark, docs, sf_dir):
    return private.find(docs.select("doc_id", "text")).select(
        "doc_id", *(F.size(_of("base", k)).cast("long").alias(f"n_{k}") for k in private.KINDS),
        F.sha2(_said(F.col("base")), 256).alias("base_sha256"), _said(F.col("spans")).alias("spans"))


@query("op10_secret_scan")
def op10(spark, docs, sf_dir):
    base = [r.kind for r in secrets.BASE]
    return secrets.scan(docs.select("doc_id", "text")).select(
        "doc_id", *(F.size(_of("found", k)).cast("long").alias(f"n_{k}") for k in base),
        F.sha2(_said(_of("found", *base)), 256).alias("base_sha256"), _said(F.col("found")).alias("spans"))


@query("op11_page_text", table="pages")
def op11(spark, pages, sf_dir):
    model = extract.train(extract.labelled_pages(spark))
    return extract.extract(pages.select("page_id", "url", "html"), model).withColumn("n_chars", F.length("text").cast("long"))


TERMS_SQL = """regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{}')"""


@query("op12_ranked_search", sql=rf"""WITH
    docs AS (SELECT row_number() OVER () AS row, doc_id, {TERMS_SQL.format('text', r'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')} AS terms FROM documents),
    wanted AS (SELECT DISTINCT item_id, unnest({TERMS_SQL.format('text', r'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')}) AS term FROM benchmark),
    totals AS (SELECT count(*) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM docs WHERE len(terms) > 0),
    told AS (SELECT row, unnest(terms) AS term FROM docs),
    held AS (SELECT row, term, count(*) AS tf FROM told WHERE term IN (SELECT term FROM wanted) GROUP BY row, term),
    weights AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
                FROM held, totals GROUP BY term, n_docs),
    long AS (SELECT row, doc_id, 50 + (50 * len(terms) * n_docs) // n_terms AS m FROM docs, totals WHERE len(terms) > 0),
    scored AS (SELECT item_id, row, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
               FROM wanted JOIN held USING (term) JOIN weights USING (term) JOIN long USING (row) GROUP BY item_id, row, doc_id),
    ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank,
                 doc_id, score FROM scored WHERE score > 0)
    SELECT * FROM ranked WHERE rank <= 50""")
def op12(spark, docs, sf_dir):
    return ranking.rank(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query("op13_source_audit", sql=rf"""WITH
    docs AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
               {TERMS_SQL.format('text', r'[^\x00-\x40\x5B-\x60\x7B-\x7F]+')} AS terms FROM documents),
    told AS (SELECT row, lang, source, unnest(terms) AS term FROM docs),
    kept AS (SELECT lang, term, count(*) AS lang_count FROM told GROUP BY lang, term HAVING count(DISTINCT row) >= 30),
    groups AS (SELECT DISTINCT lang, source FROM docs),
    langs AS (SELECT lang, count(*) AS v, CAST(sum(lang_count) AS BIGINT) AS lang_total FROM kept GROUP BY lang),
    held AS (SELECT lang, source, term, count(*) AS n FROM told JOIN kept USING (lang, term) GROUP BY lang, source, term),
    sized AS (SELECT lang, source, v, lang_total, coalesce(total, 0) AS total FROM groups JOIN langs USING (lang)
              LEFT JOIN (SELECT lang, source, CAST(sum(n) AS BIGINT) AS total FROM held GROUP BY lang, source) USING (lang, source)),
    shares AS (SELECT s.lang, s.source, k.term, coalesce(n, 0) AS n,
                 CAST(1 + (1000000000::HUGEINT * (coalesce(n, 0) + 5)) // (total + 5 * v) AS BIGINT) AS p,
                 CAST(1 + (1000000000::HUGEINT * (lang_count + 5)) // (lang_total + 5 * v) AS BIGINT) AS q
               FROM sized s JOIN kept k ON k.lang = s.lang LEFT JOIN held h ON h.lang = s.lang AND h.source = s.source AND h.term = k.term),
    apart AS (SELECT a.lang, a.source, b.source AS item, CAST(sum(abs(a.p - b.p)) AS BIGINT) AS f
              FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term GROUP BY a.lang, a.source, b.source),
    pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f, 0) AS value
              FROM groups a JOIN groups b ON a.lang = b.lang AND a.source != b.source
              LEFT JOIN apart f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
    terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM shares WHERE n > 0 AND p > q),
    ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
               FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
    SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50""")
def op13(spark, docs, sf_dir):
    return audit.audit(docs)
