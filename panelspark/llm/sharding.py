"""Operator 5: reproducible shuffle into shards by a Feistel permutation with cycle walking.

Rows get global row numbers 0..n-1 in an order that depends on their contents
only, the numbers go through a keyed bijection of 0..n-1, and the image gives
shard ``image % shards`` and slot ``image div shards``.  Shard sizes differ by one
row at the most (law ``rows``), slots have no gaps, and anyone who knows n, the
seed and a row number can compute both.

Only DataFrame functions run here: no Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import load, scratch

#: Walks of up to this many steps cover every n below its square; beyond, a step
#: leaves the range with a chance below 1/STEPS, and a walk that long raises an error.
STEPS = 40
#: Buckets number rows independently of each other; their offsets are a broadcast of at most this many rows.
MOST_BUCKETS = 65_536


def feistel(x: Column, a: Column, b: Column, seed: int, rounds: int = 2) -> Column:
    """One pass over pairs (x div b, x % b) of Z_a x Z_b: each half-round adds a keyed hash of the other half."""
    left, right = (x - x % b) / b, x % b
    left = left.cast("long")
    for i in range(rounds):
        left = (left + F.pmod(F.xxhash64(right, F.lit(2 * i), F.lit(seed)), a)) % a
        right = (right + F.pmod(F.xxhash64(left, F.lit(2 * i + 1), F.lit(seed)), b)) % b
    return left * b + right


def permute(x: Column, n: Column, a: Column, b: Column, seed: int) -> Column:
    """The keyed bijection of 0..n-1, for a*b >= n: apply the network again while the image is n or more."""
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(STEPS)),
        feistel(x, a, b, seed),
        lambda image, _: F.when(image < n, image).otherwise(feistel(image, a, b, seed)),
    )
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("cycle walk too long")).cast("long"))


def shard(docs: DataFrame, shards: int, *, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, bucket_rows: int = 50_000, chunk_rows: int = 10_000) -> DataFrame:
    """Return (doc_id, size, text_crc32, law, shard, slot, grown_shard), one row per row of ``docs``.

    size is the text's UTF-8 bytes (null: none) plus 8.  The order behind the row
    numbers is (bucket, doc_id, crc32, size, chunk); rows equal in doc_id, crc32 and
    size are interchangeable, share aggregated rows of up to ``chunk_rows`` copies
    until the last step, each in a bucket of its own, and get different slots.  A null text counts as empty, a null doc_id is a value like
    any other, an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = (
        docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
        .groupBy("doc_id", "size", "text_crc32")
        .agg(F.count("*").alias("all"))
        .withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("all") - 1) / chunk_rows))))
        .select("doc_id", "size", "text_crc32", "chunk", F.least(F.lit(chunk_rows), F.col("all") - F.col("chunk") * chunk_rows).alias("copies"))
    )
    rows = scratch(rows, "shard-rows")
    buckets = int(min(MOST_BUCKETS, max(1, rows.count() // bucket_rows + 1)))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32", "size", "chunk"), F.lit(buckets)))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = (
        rows.groupBy("bucket")
        .agg(F.sum("copies").alias("in_bucket"))
        .select("bucket", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("first"), F.sum("in_bucket").over(every).alias("n"))
        .withColumn("a", F.ceil(F.sqrt("n")))
        .withColumn("b", F.ceil(F.col("n") / F.col("a")))
    )
    within = Window.partitionBy("bucket").orderBy("doc_id", "text_crc32", "size", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    numbered = (
        rows.withColumn("before", F.coalesce(F.sum("copies").over(within), F.lit(0)))
        .join(F.broadcast(offsets), "bucket")
        .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
        .withColumn("row", F.col("first") + F.col("before") + F.col("copy"))
        .withColumn("image", permute(F.col("row"), F.col("n"), F.col("a"), F.col("b"), seed))
    )
    image = F.col("image")
    return numbered.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (image % shards).cast("int").alias("shard"),
        ((image - image % shards) / shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op5_sharding(spark, sf_dir):
    return shard(load(spark, sf_dir, "documents"), 24)


QUERIES = {"op5_sharding": op5_sharding}
ORACLES: dict[str, str] = {}
