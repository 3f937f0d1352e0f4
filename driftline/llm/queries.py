"""The queries of this subpackage: each numbered operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm import ann, bpe, chat, leaks, lines, mix, oracles, pivots, repair, simhash, suffixes, toxicity, tries, urls
from driftline.session import durable


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as the log of events that made it, folded, written and read back."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    said = "\\### Assistant: </turn> ok"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.render(chat.fold(durable(chat.logged(chat.numbered(rows.unionByName(probe)))))))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), words=3, seed=42, distance=2)


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"), every=20, k=20)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as captures, each fetched on a day of 2024 that its id gives, against a list whose log is made from the hosts of all pages."""
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    captures = _table(spark, sf_dir, "pages").select("page_id", "url", day(F.col("page_id") * 37 % 365).alias("fetched"))
    hosts = captures.select(urls.host(F.col("url")).alias("host"), "page_id").where("host != ''").groupBy("host").agg(F.min("page_id").alias("m"))
    change = lambda rows, pattern, action, n: rows.select(pattern.alias("pattern"), F.lit(action).alias("action"), day(n).alias("day"))
    m, host = F.col("m"), F.col("host")
    log = change(hosts.where(m % 3 == 0), host, "add", m * 7 % 200)
    log = log.unionByName(change(hosts.where((m % 3 == 0) & (m % 2 == 0)), host, "remove", m * 7 % 200 + 80))
    log = log.unionByName(change(hosts.where((m % 3 == 0) & (m % 4 == 0)), host, "add", m * 7 % 200 + 150))
    log = log.unionByName(change(hosts.where(m % 5 == 1), F.concat(host, F.lit("/en/")), "add", m * 11 % 300))
    return urls.blocked(captures, log).select("page_id", "fetched", "blocked", "matched")


OP4_SQL = """
WITH captures AS (
  SELECT page_id, CAST(DATE '2024-01-01' + CAST(page_id * 37 % 365 AS INTEGER) AS DATE) AS fetched,
         regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/:?#]+)', 1) AS host,
         regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) AS path
  FROM pages),
hosts AS (SELECT host, min(page_id) AS m FROM captures WHERE host <> '' GROUP BY host),
entries AS (
  SELECT host, '' AS path, m * 7 % 200 AS since, CASE WHEN m % 2 = 0 THEN m * 7 % 200 + 80 END AS until FROM hosts WHERE m % 3 = 0
  UNION ALL SELECT host, '', m * 7 % 200 + 150, NULL FROM hosts WHERE m % 3 = 0 AND m % 4 = 0
  UNION ALL SELECT host, '/en/', m * 11 % 300, NULL FROM hosts WHERE m % 5 = 1),
hits AS (
  SELECT c.page_id, e.host || e.path AS pattern
  FROM captures c JOIN entries e
    ON (c.host = e.host OR ends_with(c.host, '.' || e.host)) AND starts_with(c.path, e.path)
   AND datediff('day', DATE '2024-01-01', c.fetched) >= e.since
   AND (e.until IS NULL OR datediff('day', DATE '2024-01-01', c.fetched) < e.until))
SELECT c.page_id, c.fetched, h.pattern IS NOT NULL AS blocked, h.pattern AS matched
FROM captures c LEFT JOIN (
  SELECT page_id, pattern FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY length(pattern) DESC, pattern DESC) AS r FROM hits) WHERE r = 1) h
USING (page_id)
"""


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's text after line dedup, by length and digest, and the runs of lines taken out."""
    out = lines.dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"), modulus=2, grow=True)
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", F.col("removed").cast("long").alias("removed_chunks"), F.char_length(text).cast("long").alias("kept_chars"), F.sha2(text, 256).alias("kept_sha256"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with passages of 50 words or more that other documents have too."""
    return suffixes.passages(_table(spark, sf_dir, "documents"), length=50).select("doc_id", F.size("spans").cast("long").alias("n_spans"), "repeated_words", "spans")


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mix.mix(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    taken = F.coalesce(F.sum(F.when(F.col("shard").isNotNull(), F.col("size"))), F.lit(0)).alias("taken")
    return drawn.groupBy("k", "nth").agg(*(F.first(c).alias(c) for c in ("doc_id", "size", "source_size", "target")), taken).drop("k", "nth")


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.search(_table(spark, sf_dir, "embeddings"), every=50, k=5, scale=256.0)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.scores(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels"), threshold=0.3)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


#: The rank file and the pattern of the registered query; both are parameters of ByteBpe.
VOCABULARY, PATTERN = "byte_bpe_multi_50k.tiktoken", public_tokenizers.PATTERN


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_digests(docs)


def bpe_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text."""
    tok = bpe.ByteBpe(docs.sparkSession, public_tokenizers.path(VOCABULARY), PATTERN)
    made = docs.select("doc_id", tok.round_trip(F.col("text")).alias("r"))
    return made.select("doc_id", F.size("r.ids").cast("long").alias("n_tokens"), "r.ids_sha256", "r.decoded_sha256")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of all rebuilt conversations."""
    turns, convs = tries.rebuilt(_table(spark, sf_dir, "conversations"))
    return tries.trie(turns, convs).drop("prefix_sha256")


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with windows of ten words of the test items."""
    found = leaks.occurrences(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"), length=10)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The damaged conversations, repaired at the least cost."""
    rows = _table(spark, sf_dir, "conversations")
    return repair.report(rows, repair.damaged(rows))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_chat_format, op2_simhash, op3_ann, op4_url_filter, op5_line_dedup, op6_suffix_dedup, op7_mix, op8_exact_topk, op9_toxicity, op10_byte_bpe, op11_prefix_trie, op12_decontaminate, op13_repair)}


def oracle_sql() -> dict[str, str]:
    return {"op4_url_filter": OP4_SQL, "op11_prefix_trie": oracles.OP11, "op12_decontaminate": oracles.OP12, "op13_repair": oracles.OP13}
