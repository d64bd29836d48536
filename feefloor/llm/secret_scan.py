"""Secrets in texts, with credentials linked from their parts.

Some strings are secrets by themselves: assignments to a secret-like name, access
identifiers, long hexadecimal strings. Others are too weak alone: a mixed
40-character string may be a key or a hash, an endpoint may be any link. A weak
candidate is reported only if complementary parts lie within the same scope, the
stretch of text around an access identifier:

* ``pair``: a mixed string within a scope, so beside an access identifier;
* ``endpoint``: a service address in a scope that also holds a secret (an
  assignment, a hexadecimal string or a ``pair``) no farther away than a scope is wide.

Scopes of one document that overlap are merged, so a part lies in one scope at
most and the interval join yields at most one row per part, whatever the number
of identifiers. How long a merged scope gets does not matter, since the distance to
the nearest secret decides. The join is on the document and the block of text, so a long
document full of parts is spread over many keys.

Spans are code points, end exclusive, written ``kind:start:end``. A null text is
an empty one and has no spans. Rows that share a doc_id and a text share their
spans, and each gets a row; so do rows without an id. Inside, rows go by 64-bit hashes
of their id and of their text.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feefloor.llm.common import over_batches, table
from feefloor.session import cut_lineage

# The base kinds in the order they are listed.
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "pair", "endpoint")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
                    r"([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")

# Weak parts. A pair is 40 characters with upper, lower and digit, and enough
# different characters that it is no word or number.
PAIR = re.compile(r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])")
ENDPOINT = re.compile(r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?[A-Za-z0-9/_.-]*")
MIN_PAIR_BITS = 3.5

#: Characters around an access identifier that belong to its scope.
SCOPE = 300
#: Blocks that the interval join meets on.
BLOCK = 1024
KEY = ["row_key", "text_key"]

def entropy(text: str) -> float:
    return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values())


def parts_of(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every strong or weak part."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text)]
        found += [("pair", *m.span()) for m in PAIR.finditer(text) if _mixed(m[0])]
        found += [("endpoint", *m.span()) for m in ENDPOINT.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return found


def _mixed(text: str) -> bool:
    return (re.search("[A-Z]", text) is not None and re.search("[a-z]", text) is not None
            and re.search("[0-9]", text) is not None and entropy(text) >= MIN_PAIR_BITS)


def parts(docs: DataFrame) -> DataFrame:
    """(row_key, text_key, kind, start, end) of each part of each document.

    Weak parts can only count beside an access identifier, so texts without one
    are not searched for them.
    """

    def run(batch):
        ids, kinds, starts, ends, keys = [], [], [], [], []
        for doc, key, text in zip(batch.column("row_key").to_pylist(),
                                  batch.column("text_key").to_pylist(),
                                  batch.column("text").to_pylist()):
            for kind, start, end in parts_of(text or ""):
                ids.append(doc)
                keys.append(key)
                kinds.append(kind)
                starts.append(start)
                ends.append(end)
        yield {"row_key": pa.array(ids, pa.int64()),
               "text_key": pa.array(keys, pa.int64()), "kind": pa.array(kinds, pa.string()),
               "start": pa.array(starts, pa.int64()), "end": pa.array(ends, pa.int64())}

    return over_batches(docs.select(*KEY, "text"), run,
                        "row_key long,text_key long,kind string,start long,end long")


def scopes(found: DataFrame, width: int = SCOPE) -> DataFrame:
    """(row_key, text_key, scope, low, high): merged stretches around identifiers."""
    key = KEY
    order = W.partitionBy(*key).orderBy("low", "high")
    around = (found.where("kind = 'access'")
              .select(*key, (F.col("start") - width).alias("low"),
                      (F.col("end") + width).alias("high")))
    reach = F.max("high").over(order.rowsBetween(W.unboundedPreceding, -1))
    begins = (reach.isNull() | (F.col("low") > reach)).cast("int")
    return (around.withColumn("begins", begins)
            .withColumn("scope", F.sum("begins").over(order))
            .groupBy(*key, "scope").agg(F.min("low").alias("low"), F.max("high").alias("high")))


def linked(found: DataFrame, width: int = SCOPE, block: int = BLOCK) -> DataFrame:
    """The weak parts of ``found`` that complementary parts support."""
    key = KEY
    areas = scopes(found, width).withColumns({
        "b0": F.floor(F.greatest(F.col("low"), F.lit(0)) / block),
        "b1": F.floor(F.col("high") / block)})
    areas = areas.withColumn("block", F.explode(F.sequence("b0", "b1"))).drop("b0", "b1")
    inside = (found.where("kind <> 'access'")
              .withColumn("block", F.floor(F.col("start") / block))
              .join(areas, [*key, "block"])
              .where("start >= low AND end <= high"))
    # The last secret before each part and the first after it, within its scope.
    secret = F.col("kind") != "endpoint"
    scope = W.partitionBy(*key, "scope").orderBy("start", "end", "kind")
    before = F.max(F.when(secret, F.col("end"))).over(
        scope.rowsBetween(W.unboundedPreceding, 0))
    after = F.min(F.when(secret, F.col("start"))).over(
        scope.rowsBetween(0, W.unboundedFollowing))
    near = inside.withColumns({"before": before, "after": after}).where(
        (F.col("kind") == "pair") | ((F.col("kind") == "endpoint") & F.coalesce(
            F.least(F.col("start") - F.col("before"), F.col("after") - F.col("end"))
            <= 2 * width, F.lit(False))))
    return near.select(*found.columns)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"], s["end"])), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("span_list", lambda s: s["kind"] == kind)).cast("long")


def secret_scan(docs: DataFrame, width: int = SCOPE) -> DataFrame:
    """(doc_id, n_<base kind>, base_sha256, spans, span_list) for every row of ``docs``.

    ``span_list`` holds all spans as (start, rank of kind, end, kind) in order;
    ``base_sha256`` covers the base kinds only.
    """
    docs = docs.select("doc_id", F.xxhash64("doc_id").alias("row_key"), "text",
                       F.xxhash64("text").alias("text_key"))
    found = cut_lineage(parts(docs).distinct(), "secret-parts")
    spans = found.where(F.col("kind").isin(*BASE_KINDS)).unionByName(linked(found, width))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    listed = spans.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct(
        "start", rank.alias("rank"), "end", "kind"))).alias("span_list"))
    none = F.array().cast("array<struct<start:bigint,rank:bigint,end:bigint,kind:string>>")
    out = (docs.select("doc_id", *KEY).join(listed, KEY, "left")
           .withColumn("span_list", F.coalesce("span_list", none)))
    base = F.filter("span_list", lambda s: s["rank"] <= len(BASE_KINDS))
    counts = [_count(kind).alias(f"n_{kind}") for kind in BASE_KINDS]
    return out.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"),
                      _joined(F.col("span_list")).alias("spans"), "span_list", "text_key")


def redact(docs: DataFrame, width: int = SCOPE) -> DataFrame:
    """``docs`` with every span replaced by ``[kind]``; all rows and columns stay.

    Of overlapping spans the first wins, and its mark covers what the others
    add. ``n_chars``, if there is one, is counted anew.
    """
    spans = (secret_scan(docs, width).where("size(span_list) > 0")
             .select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k"), "span_list")
             .dropDuplicates(["_d", "_k"]))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    text = F.col("text")

    def step(s, x):
        fresh = x["start"] >= s["at"]
        gap = F.substring(text, (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int"))
        mark = F.concat(F.lit("["), x["kind"], F.lit("]"))
        return F.struct(
            F.when(fresh, F.concat(s["out"], gap, mark)).otherwise(s["out"]).alias("out"),
            F.greatest(s["at"], x["end"]).alias("at"))

    cleaned = F.aggregate("span_list", start, step, lambda s: F.concat(
        s["out"], F.substring(text, (s["at"] + 1).cast("int"), F.lit(2**31 - 1))))
    joined = docs.withColumn("_key", F.xxhash64("text")).join(
        spans, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_k")), "left")
    out = joined.withColumn("text", F.when(F.col("_d").isNull() & F.col("span_list").isNull(),
                                           text).otherwise(cleaned))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("span_list").isNull(), F.col("n_chars"))
                             .otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (secret_scan(table(spark, sf_dir, "documents"))
            .drop("span_list", "text_key"))
