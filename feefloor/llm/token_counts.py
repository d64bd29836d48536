"""Token counts through a digest cache.

Counts are stored under the digest of the content and the digest of the
tokenizer's version. A run joins its documents' digests to the stored counts,
encodes one document for each digest that is missing, appends those counts to the
cache, and reads every document's count from it. Texts are shuffled once, for the
missing digests only; copies, however many, are encoded once.

Content is normalised only as far as no count can change: a null text is the
empty one, which has 0 tokens. Rows that share a doc_id keep a row each. A
second run over the same documents encodes nothing. Columns of the input other
than the id and the text are not read.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feefloor.llm.common import over_batches, table
from feefloor.llm.encoding import KEPT, encoder, version_digest
from feefloor.session import shared_dir

CACHE_SCHEMA = "content binary, tokenizer string, n_tokens long"


def stored_counts(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame:
    """Counts of one tokenizer version; none if nothing was stored yet."""
    try:
        stored = spark.read.schema(CACHE_SCHEMA).parquet(cache)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE_SCHEMA)
    # A lost and repeated append may store a digest twice; its counts are equal.
    return (stored.where(F.col("tokenizer") == tokenizer)
            .groupBy("content").agg(F.max("n_tokens").alias("n_tokens")))


def encode_misses(docs: DataFrame, known: DataFrame, path: str) -> DataFrame:
    """(content, n_tokens) of each digest in ``docs`` that ``known`` lacks."""
    missing = (docs.groupBy("content").agg(F.min("doc_id").alias("doc_id"))
               .join(known.select("content"), "content", "left_anti"))
    # Texts go by content and id together, so the copies of one text go many ways.
    row = F.xxhash64("content", "doc_id").alias("row")
    one = missing.select(row, F.col("content").alias("c"), F.col("doc_id").alias("d"))
    texts = (docs.select("*", row).join(one, "row")
             .where((F.col("content") == F.col("c")) & F.col("doc_id").eqNullSafe(F.col("d")))
             .select("content", "text"))

    def run(batch):
        counter = encoder(path, "count", len)
        yield {"content": batch.column("content"), "n_tokens": pa.array(
            [sum(map(sum, counter.parts(t))) for t in batch.column("text").to_pylist()],
            pa.int64())}

    return (over_batches(texts, run, "content binary, n_tokens long", KEPT)
            .groupBy("content").agg(F.max("n_tokens").alias("n_tokens")))


def token_counts(docs: DataFrame, path: str, cache: str, limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs``.

    ``path`` is the tokenizer's file on every worker, ``cache`` a folder that
    all of them share. Missing counts are appended to it when this is called.
    """
    spark, version = docs.sparkSession, version_digest(path)
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", text.alias("text"),
                        F.unhex(F.sha2(text, 256)).alias("content"))
    (encode_misses(keyed, stored_counts(spark, cache, version), path)
     .select("content", F.lit(version).alias("tokenizer"), "n_tokens")
     .write.mode("append").parquet(cache))
    counted = keyed.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"),
                           "content")
    return (counted.join(stored_counts(spark, cache, version), "content")
            .select("doc_id", "n_bytes", "n_tokens",
                    (F.col("n_tokens") > limit).alias("over_limit")))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts from an empty cache, so that each call does all its work."""
    return token_counts(table(spark, sf_dir, "documents"),
                        public_tokenizers.path("byte_bpe_50k.json"),
                        f"{shared_dir(spark)}/token-counts-{uuid.uuid4().hex}")
