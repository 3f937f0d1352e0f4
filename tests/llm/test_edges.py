"""Empty tables, clashing column names and very long texts."""

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from driftline.llm import bpe, chat, lines, mix, simhash, sketches, suffixes, toxicity, urls

DOCS = "doc_id long, text string, source string"
CLASH = ["id", "size", "h", "k", "v", "n", "fp", "sk", "node", "mark", "place", "places", "gone_id", "gone_mark", "removed", "bucket", "draw", "draws", "ids", "n_tokens", "decoded", "score", "predicted", "u", "t", "pattern", "target", "rest"]


def clashing(df):
    for c in CLASH:
        df = df.withColumn(c, F.lit("clash"))
    return df


def outputs(docs):
    spark = docs.sparkSession
    tok = bpe.ByteBpe(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    captures = docs.withColumn("url", F.lit("http://a.example/")).withColumn("fetched", F.lit("2024-01-01").cast("date"))
    log = captures.select(F.lit("a.example").alias("pattern"), F.lit("add").alias("action"), F.col("fetched").alias("day")).limit(1)
    events = docs.select(F.col("doc_id").alias("conv_id"), F.lit(0).alias("seq"), F.lit(0).alias("message"), F.lit("message").alias("kind"), F.lit("user").alias("role"), "text", "k")
    return {
        "chat": chat.digests(chat.render(chat.fold(events))), "simhash": simhash.near_duplicates(docs), "sketches": sketches.near_duplicates(docs), "urls": urls.blocked(captures, log),
        "lines": lines.dedup(docs), "suffixes": suffixes.passages(docs), "mix": mix.mix(docs), "toxicity": toxicity.scores(docs, labels), "bpe": bpe.decode(bpe.encode(docs, tok), tok),
    }


def test_clashing_names_and_a_very_long_text(spark):
    rng = np.random.default_rng(1)
    long = " ".join("".join(rng.choice(list("abcdefghij"), 5)) for _ in range(40_000))
    rows = [(1, long, "a"), (2, long + "\nmore", "b"), (3, None, None), (4, "", "a"), (4, "", "a"), (None, "no id", "a")]
    got = {n: df.collect() for n, df in outputs(clashing(spark.createDataFrame(rows, DOCS))).items()}
    assert {n: len(r) for n, r in got.items() if n not in ("suffixes", "mix", "chat")} == {n: 6 for n in ("simhash", "sketches", "urls", "lines", "toxicity", "bpe")}
    assert {r["doc_id"] for r in got["suffixes"]} == {1, 2} and len({r["component_id"] for r in got["sketches"] if r["doc_id"] in (1, 2)}) == 1
    assert all(r["decoded"] == (r["text"] or "") for r in got["bpe"]) and all(r["blocked"] for r in got["urls"])


def test_empty_tables(spark):
    for name, df in outputs(clashing(spark.createDataFrame([], DOCS))).items():
        assert df.count() == 0, name
