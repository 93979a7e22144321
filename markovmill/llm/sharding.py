"""Rendezvous hashing of stable record keys over weighted shards, with gapless slots. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts into which each shard is cut while slots are counted; a shard of 10^10 rows so has 2.5 million in a part.
SLOT_PARTS = 4096  # three hex digits
DIGITS = 13  # hex digits of md5: 52 bits, exact in a double


def uniform(key: Column, shard: int) -> Column:
    """A number over 0, below 1, by key and shard alone."""
    hexed = F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f"#{shard}")).cast("binary")), 1, DIGITS)
    return (F.conv(hexed, 16, 10).cast("double") + 0.5) / float(16**DIGITS)


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard of least -ln(u)/weight; ties go to the lower shard. Shards of weight 0 get nothing.

    A new shard takes the rows whose score there is least and leaves all others where they were; so does a gone one's rows go to the
    rest. Shares are proportional to weights.
    """
    live = [(i, float(w)) for i, w in enumerate(weights) if w > 0]
    if not live:
        raise ValueError("no shard has a weight over 0")
    scores = F.array(*[F.struct((-F.log(uniform(key, i)) / w).alias("score"), F.lit(i).alias("shard")) for i, w in live])
    return F.array_min(scores)["shard"]


def assign_shards(docs: DataFrame, weights: list[float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) for each row.

    Null texts: size 1, checksum of nothing (0). Null keys: one key of their own, "null". Repeated rows: each has a slot. No rows: no
    rows. Other columns of docs are not read. Slots: shards are cut into SLOT_PARTS parts by a hash of the key; a first pass counts the
    parts (from keys alone), and a row's slot is its part's offset plus its rank there, so that no task sees a whole shard. Repeats of a
    single key are dealt over the parts by size and checksum too.
    """
    n = len(weights)
    grown = [*weights, sum(weights) / n]
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key), (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    rows = rows.withColumn("shard", rendezvous(F.col(key), weights))
    # a new shard changes a row's place only if it wins against the old one
    old = F.element_at(F.array(*[-F.log(uniform(F.col(key), i)) / w if w > 0 else F.lit(float("inf")) for i, w in enumerate(weights)]), F.col("shard") + 1)
    new = -F.log(uniform(F.col(key), n)) / grown[-1]
    rows = rows.withColumn("grown_shard", F.when(new < old, F.lit(n)).otherwise(F.col("shard")))
    rows = rows.withColumn("part", F.substring(F.md5(F.concat_ws("#", F.col(key).cast("string"), "size", "text_crc32").cast("binary")), 1, 3))
    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    # bounded: shards x SLOT_PARTS rows
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    rank = F.row_number().over(Window.partitionBy("shard", "part").orderBy(F.col(key).asc_nulls_first(), "size", "text_crc32"))
    ranked = rows.withColumn("rank", rank.cast("long"))
    out = ranked.join(F.broadcast(offsets), ["shard", "part"])
    return out.select(key, "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("rank") - 1).alias("slot"), "grown_shard")
