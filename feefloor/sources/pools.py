"""The public mining-pool list: a JSON array, or an older JSON object by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POOL_SCHEMA = "pool_name string, pool_id long, tags array<string>, addresses array<string>"


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _strings(entry: Column, field: str) -> Column:
    """Non-empty string elements of a list field; anything else is ignored."""
    items = F.try_variant_get(entry, f"$.{field}", "array<variant>")
    kept = F.filter(items, lambda v: _kind(v) == "STRING")
    texts = F.transform(kept, lambda v: F.try_variant_get(v, "$", "string"))
    return F.coalesce(F.filter(texts, lambda t: t != ""), F.array().cast("array<string>"))


def _entries(docs: DataFrame, column: str) -> DataFrame:
    """(pos, pool_name, pool_id, entry) of every object entry of the documents."""
    doc = docs.select(F.try_parse_json(F.col(column)).alias("doc"))
    listed = doc.select(F.posexplode(
        F.try_variant_get("doc", "$", "array<variant>")).alias("pos", "entry"),
        F.lit(None).cast("string").alias("key"))
    named = doc.where(_kind(F.col("doc")).startswith("OBJECT")).select(
        F.posexplode(F.map_entries(F.try_variant_get("doc", "$", "map<string,variant>")))
        .alias("pos", "kv")).select("pos", F.col("kv.value").alias("entry"),
                                    F.col("kv.key").alias("key"))
    entry = F.col("entry")
    name_value = F.try_variant_get(entry, "$.name", "variant")
    name = F.when(_kind(name_value) == "STRING",
                  F.try_variant_get(entry, "$.name", "string"))
    id_value = F.try_variant_get(entry, "$.id", "variant")
    # The object form falls back to its key for a missing, null or empty name;
    # a name of another type still makes the entry unusable.
    nameless = F.coalesce(name_value.isNull() | (_kind(name_value) == "VOID")
                          | (name == ""), F.lit(False))
    return (listed.unionByName(named).where(_kind(entry).startswith("OBJECT")).select(
        "pos",
        F.when(nameless, F.coalesce("key", name)).otherwise(name).alias("pool_name"),
        F.when(_kind(id_value) == "BIGINT", F.try_variant_get(entry, "$.id", "long"))
        .alias("pool_id"),
        "entry"))


def parse_pools(docs: DataFrame, column: str = "value") -> DataFrame:
    """One row per usable pool from JSON documents held in ``column``.

    Entries without a name, or with neither tag nor address, are dropped, as
    are ids that are not integers. Of entries sharing a name the last stays.
    """
    entry = F.col("entry")
    return (_entries(docs, column)
            .select("pos", "pool_name", "pool_id",
                    _strings(entry, "tags").alias("tags"),
                    _strings(entry, "addresses").alias("addresses"))
            .where("pool_name <> '' AND (size(tags) > 0 OR size(addresses) > 0)")
            .groupBy("pool_name")
            .agg(F.max_by(F.struct("pool_id", "tags", "addresses"), "pos").alias("e"))
            .select("pool_name", "e.pool_id", "e.tags", "e.addresses"))


def parse_pool_ids(docs: DataFrame, column: str = "value") -> DataFrame:
    """id -> name for every named entry with an integer id, tags or not; of
    entries sharing an id the last stays."""
    return (_entries(docs, column).where("pool_id IS NOT NULL AND pool_name IS NOT NULL")
            .groupBy("pool_id").agg(F.max_by("pool_name", "pos").alias("pool_name")))


def read_pools(spark: SparkSession, path: str) -> DataFrame:
    return parse_pools(spark.read.text(path, wholetext=True))
