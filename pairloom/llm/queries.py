"""Registered queries over the corpus operators; each applies its operator to a whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.common import documents, fold
from pairloom.llm.filter_audit import filter_audit
from pairloom.llm.language_id import identify_languages
from pairloom.llm.line_dedup import line_dedup_report
from pairloom.llm.packing import pack_documents
from pairloom.llm.pieces import piece_digests
from pairloom.llm.quality_rules import quality_verdicts
from pairloom.llm.secret_scan import secret_spans
from pairloom.llm.simhash import simhash_groups
from pairloom.llm.sketches import document_fingerprints
from pairloom.llm.token_rollups import change, commit_batch, rank_file_tokens, totals, word_tokens
from pairloom.llm.toxicity import toxicity_scores
from pairloom.llm.url_filters import judge_urls
from pairloom.llm.vector_codes import vector_codes
from pairloom.session import cut_lineage, scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


@query("op1_simhash_bk_trees")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


@query("op6_best_fit_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


@query("op8_sentencepiece")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


@query("op7_secret_scans")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(documents(spark, sf_dir)).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess", "n_weak")


@query("op10_quality_rules")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(documents(spark, sf_dir))


@query("op5_document_fingerprints")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_fingerprints(documents(spark, sf_dir))


#: Lines of all documents compared by their variants in full text, without any of the operator's filters.
LINE_DEDUP_SQL = r"""WITH l AS (SELECT doc_id, unnest(string_split("text", chr(10))) AS line, unnest(range(len(string_split("text", chr(10))))) AS pos FROM documents WHERE "text" IS NOT NULL),
  w AS (SELECT *, regexp_matches(line, '[^\x20\x09-\x0D]') AS has, doc_id::HUGEINT * 1000000000 + pos AS o FROM l),
  f AS (SELECT line, min(o) AS o FROM w WHERE has GROUP BY line),
  ws AS (SELECT line, o, string_split(line, ' ') AS ws FROM f WHERE len(string_split(line, ' ')) >= 8),
  v AS (SELECT line, o, i, md5(array_to_string(list_concat(ws[1:i - 1], ws[i + 1:]), ' ')) AS v FROM (SELECT line, o, ws, unnest(range(1, len(ws) + 1)) AS i FROM ws)),
  replaced AS (SELECT line FROM (SELECT line, o, min(o) OVER (PARTITION BY v, i) AS low FROM v) WHERE low < o),
  cut AS (SELECT a.line AS short, a.o AS so, v.line AS long, v.o AS lo FROM ws a JOIN v ON v.v = md5(a.line)),
  near AS (SELECT line FROM replaced UNION SELECT CASE WHEN so < lo THEN long ELSE short END FROM cut),
  k AS (SELECT w.*, NOT has OR (w.o = f.o AND n.line IS NULL) AS kept FROM w LEFT JOIN f ON f.line = w.line LEFT JOIN near n ON n.line = w.line),
  g AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT kept) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE kept), '') AS "text" FROM k GROUP BY doc_id)
  SELECT d.doc_id, g."text", coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed FROM documents d LEFT JOIN g USING (doc_id)"""


@query("op3_line_dedup", LINE_DEDUP_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup_report(documents(spark, sf_dir))


def held_out(parts: int, part: int) -> Column:
    return fold(F.col("doc_id"), parts) == part


@query("op4_language_id")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(documents(spark, sf_dir), held_out(3, 1)).select("doc_id", "held_out", "lang_pred", "score")


@query("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity_scores(documents(spark, sf_dir), labels, held_out(4, 2))


@query("op2_token_counts")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are inserted, those labelled toxic are revised (their texts in lower case), those of low quality deleted; the last two
    batches are sent twice. The lower-cased texts are counted where they are read and the counts written, so that the join with the labels
    moves narrow rows and no text."""
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    ranks = rank_file_tokens(F.col("text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    versions = {"byte_bpe_50k": ranks, "words": word_tokens(F.col("text"))}
    toxic = labels.where("toxic = 1").select("doc_id").distinct()
    poor = labels.where("quality = 0").select("doc_id").distinct()
    lowered = cut_lineage(change(docs.withColumn("text", F.lower("text")), "revise", versions), "lowered")
    revised = lowered.join(toxic, "doc_id", "left_semi")
    store = scratch_path(spark, "token-totals")
    commit_batch(spark, store, "load", change(docs, "insert", versions))
    for _ in range(2):
        commit_batch(spark, store, "revision", revised)
        commit_batch(spark, store, "removal", change(docs.join(poor, "doc_id", "left_semi"), "delete", versions))
    return totals(spark, store)


#: One step of all orders: the filters before it as ``b``, its own as ``o``.
FILTER_AUDIT_SQL = r"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce("text", '') AS t FROM documents),
  w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
  m AS (SELECT doc_id, part, (CASE WHEN len(ws) < 100 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END)
    + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END) + (CASE WHEN doc_id > least THEN 16 ELSE 0 END) AS mask FROM w),
  l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
  c AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(bad, 0)) AS bad FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
  f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
  orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
  steps AS (SELECT filter_order, step, 1 << (ascii(filter_order[step]) - 65) AS o,
    list_sum([1 << (ascii(filter_order[i]) - 65) FOR i IN range(1, step)]) AS b0 FROM orders, (SELECT unnest(range(1, 6)) AS step)),
  s AS (SELECT filter_order, step, o::BIGINT AS o, coalesce(b0, 0)::BIGINT AS b FROM steps),
  r AS (SELECT part, filter_order, step, o, coalesce(sum(n) FILTER (WHERE mask & (b | o) = 0), 0) AS kept, coalesce(sum(n) FILTER (WHERE mask & o <> 0 AND mask & b = 0), 0) AS removed,
    coalesce(sum(n) FILTER (WHERE mask & o <> 0 AND mask & b <> 0), 0) AS redundant, coalesce(sum(n) FILTER (WHERE mask = o), 0) AS unique_fails,
    coalesce(sum(good) FILTER (WHERE mask & o <> 0 AND mask & b = 0), 0) AS good_lost, coalesce(sum(bad) FILTER (WHERE mask & o <> 0 AND mask & b = 0), 0) AS toxic_lost
    FROM c, s GROUP BY ALL)
  SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
    good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, o))::BIGINT AS shapley FROM r"""


@query("op11_filter_audit", FILTER_AUDIT_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def _address_sql(url: str) -> str:
    return (f"(lower(regexp_replace(regexp_extract({url}, '(?s)^.*?://'), '^(?i)http://$', 'https://')) || regexp_replace(lower(regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1)), ':(80|443)?$', '')"
            f" || CASE WHEN regexp_extract({url}, '(?s)^.*?://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract({url}, '(?s)^.*?://[^/?#]*([^?#]*)', 1) END || regexp_extract({url}, '(?s)^[^?#]*(\\?[^#]*)', 1))")


def _rule_sql(url: str, what: str) -> str:
    host, path = f"lower(regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1))", f"regexp_extract({url}, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
    return f"(SELECT arg_max({what}, length(h || p)) FROM rules WHERE ({host} = h OR ends_with({host}, '.' || h)) AND starts_with({path}, p))"


#: Absolute links whose attributes stand in double quotes; the operator reads all spellings.
URL_RULES_SQL = rf"""WITH RECURSIVE rules(d, h, p) AS (VALUES {', '.join(str(r) for r in URL_RULES)}),
  tags AS (SELECT url, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\b[^>]*>')) AS tag FROM pages WHERE contains(url, '://')),
  ends AS (SELECT url, CASE WHEN regexp_matches(tag, '(?i)rel="canonical"') THEN regexp_extract(tag, '(?i)href="([^"]*)"', 1)
    WHEN regexp_matches(tag, '(?i)http-equiv="refresh"') THEN regexp_extract(tag, '(?i)content="[0-9. ]+; *url=([^"]*)"', 1) END AS target FROM tags),
  one AS (SELECT DISTINCT {_address_sql('url')} AS a, {_address_sql('target')} AS b FROM ends WHERE contains(target, '://')),
  pairs AS (SELECT a, b FROM one UNION SELECT b, a FROM one),
  reach AS (SELECT a, b FROM pairs UNION SELECT r.a, e.b FROM reach r JOIN pairs e ON r.b = e.a),
  near AS (SELECT a, min({_rule_sql('b', 'd')}) AS alias FROM reach GROUP BY a),
  judged AS (SELECT page_id, url, coalesce(lower(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)), '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
    {_rule_sql('url', 'h || p')} AS rule, {_rule_sql('url', 'd')} AS decision FROM pages)
  SELECT page_id, host, path, rule, coalesce(decision, alias, 'allow') AS verdict FROM judged LEFT JOIN near ON a = {_address_sql('url')}"""


@query("op12_url_filters", URL_RULES_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), URL_RULES)


def _lloyd_sql(rounds: int = 6) -> str:
    """Assignments and floored means, one pair of tables a round."""
    def near(books: str) -> str:
        return (f"SELECT vec_id, i, w, arg_min(e, x * 16 + e) AS e, min(x) AS x FROM (SELECT a.*, b.e, list_sum([(w[j] - c[j]) * (w[j] - c[j]) FOR j IN range(1, len(w) + 1)])::HUGEINT AS x"
                f" FROM parts a JOIN {books} b USING (i)) GROUP BY vec_id, i, w")

    text = """WITH kept AS (SELECT vec_id, label, [floor(4096 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
  parts AS MATERIALIZED (SELECT vec_id, i, v[i * len(v) // 8 + 1:(i + 1) * len(v) // 8] AS w FROM kept, (SELECT unnest(range(8)) AS i)),
  ids AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT 16),
  c0 AS MATERIALIZED (SELECT i, e, w AS c FROM parts JOIN ids USING (vec_id))"""
    for r in range(rounds):
        text += f""",
  a{r} AS MATERIALIZED ({near(f'c{r}')}),
  s{r} AS (SELECT i, e, j, sum(w[j]) AS s, count(*) AS n FROM a{r}, (SELECT unnest(range(1, (SELECT max(len(w)) FROM parts) + 1)) AS j) GROUP BY i, e, j),
  m{r} AS (SELECT i, e, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS c FROM s{r} GROUP BY i, e),
  c{r + 1} AS MATERIALIZED (SELECT b.i, b.e, coalesce(m.c, b.c) AS c FROM c{r} b LEFT JOIN m{r} m USING (i, e))"""
    return text + f""",
  last AS ({near(f'c{rounds}')}),
  coded AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY i) AS code, sum(x)::BIGINT AS error FROM last GROUP BY vec_id),
  digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY i, e)) AS codebooks_sha256 FROM c{rounds})
  SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN kept USING (vec_id), digest"""


@query("op13_vector_codes", _lloyd_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
