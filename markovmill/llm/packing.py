"""Harmonic packing: pieces by reciprocal-capacity class, each class's sequences filled with a fixed number of pieces."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, map_rows
from .encoding import encode_all, shared_encoder, tokenizer_path
from .tokens import CHUNK, OVERLAP

CAPACITY = 1024
#: Remainders are cut to these reciprocals of the capacity; what is left is shorter than the last.
EXACT = (512, 256, 128, 64)
#: Pieces that share a sequence at most; shorter tails than CAPACITY / MOST are still MOST to a sequence.
MOST = 64
#: Parts by which ranks within a class are counted.
PARTS = 1024
#: Parts over which equal rows are dealt.
SPREAD = 64


def pieces(n: int, capacity: int = CAPACITY, exact: tuple[int, ...] = EXACT) -> list[tuple[int, int]]:
    """(start, length) of a document of n ids: full sequences, then the reciprocals that fit, then a tail."""
    full = n // capacity
    out = [(i * capacity, capacity) for i in range(full)]
    at, rest = full * capacity, n % capacity
    for size in exact:
        if rest >= size:
            out.append((at, size))
            at, rest = at + size, rest - size
    if rest:
        out.append((at, rest))
    return out


def document_pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k.json", ranks: str | None = "byte_bpe_50k.tiktoken", end_id: int = 0, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens): each document's ids and an end id, cut into pieces. Huge texts are encoded as in token_counts()."""
    path, fast = tokenizer_path(tokenizer), tokenizer_path(ranks) if ranks else None
    rows = docs.select(F.col(key).alias("key_"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def make():
        encoder = shared_encoder(path, fast)

        def run(part):
            out: dict[str, list] = {"key_": [], "start": [], "length": [], "ids_crc32": [], "doc_tokens": []}
            for k, ids in zip(part.column("key_").to_pylist(), encode_all(encoder, part.column("text").to_pylist(), chunk, overlap)):
                a = np.array([*ids, end_id], dtype="<u4")
                for start, length in pieces(len(a)):
                    out["key_"].append(k)
                    out["start"].append(start)
                    out["length"].append(length)
                    out["ids_crc32"].append(zlib.crc32(a[start : start + length]))
                    out["doc_tokens"].append(len(a))
            return out

        return run

    kind = rows.schema["key_"].dataType.simpleString().replace("bigint", "long")
    return map_rows(rows, make, f"key_ {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def pack(found: DataFrame) -> DataFrame:
    """Adds sequence_id and offset to document_pieces().

    A piece of length L is of class k = min(CAPACITY // L, MOST): k of them always fit. Class k's pieces are ranked (part by part, so
    that no task sees a class), and rank r goes to the class's sequence r // k; a worker so fills sequences without knowing of others.
    The fewer than k pieces over in each class, a number bounded by MOST alone, are packed first-fit by falling length in one task.
    """
    k = F.least(F.floor(F.lit(CAPACITY) / F.col("length")), F.lit(MOST)).cast("long")
    # rows that repeat an id and a text are spread too
    part = F.pmod(F.xxhash64("key_", "start", "ids_crc32"), F.lit(PARTS)) + F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD))
    part = F.pmod(part, F.lit(PARTS)).cast("int")
    rows = cut(found.withColumn("k", k).withColumn("part", part))
    counts = rows.groupBy("k", "part").agg(F.count("*").alias("n"))
    # bounded: classes x PARTS rows
    before = Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("k", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    totals = counts.groupBy("k").agg(F.sum("n").alias("n"))
    whole = totals.withColumn("whole", F.floor(F.col("n") / F.col("k")).cast("long"))
    base = whole.select("k", "whole", F.coalesce(F.sum("whole").over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("k", "part").orderBy("key_", "start", "length", "ids_crc32"))
    ranked = rows.withColumn("rank", rank.cast("long")).join(F.broadcast(firsts), ["k", "part"]).join(F.broadcast(base), "k")
    ranked = ranked.withColumn("rank", F.col("first") + F.col("rank") - 1)
    ranked = ranked.withColumn("bin", F.floor(F.col("rank") / F.col("k")).cast("long"))
    here = Window.partitionBy("sequence_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    filled = ranked.where(F.col("bin") < F.col("whole")).withColumn("sequence_id", F.col("base") + F.col("bin"))
    columns = ["key_", "start", "length", "ids_crc32", "doc_tokens", "sequence_id"]
    filled = filled.withColumn("offset", F.coalesce(F.sum("length").over(here), F.lit(0))).select(*columns, "offset")

    over = ranked.where(F.col("bin") >= F.col("whole"))
    n_whole = whole.agg(F.coalesce(F.sum("whole"), F.lit(0)).alias("n_whole"))
    over = over.crossJoin(F.broadcast(n_whole))  # one row
    kind = found.schema["key_"].dataType.simpleString()

    def first_fit(table):
        import pyarrow as pa

        rows = sorted(table.to_pylist(), key=lambda r: (-r["length"], str(r["key_"]), r["start"], r["ids_crc32"]))
        room: list[int] = []
        for r in rows:
            b = next((i for i, x in enumerate(room) if x >= r["length"]), len(room))
            if b == len(room):
                room.append(CAPACITY)
            r["sequence_id"], r["offset"] = r["n_whole"] + b, CAPACITY - room[b]
            room[b] -= r["length"]
        return pa.Table.from_pylist([{c: r[c] for c in [*columns, "offset"]} for r in rows], schema=pa.schema([("key_", table.schema.field("key_").type), *[(c, pa.int64()) for c in [*columns[1:], "offset"]]]))

    spare = over.select("*", F.lit(0).alias("all_")).groupBy("all_").applyInArrow(first_fit, f"key_ {kind}, " + ", ".join(f"{c} bigint" for c in [*columns[1:], "offset"]))
    return filled.unionByName(spare)


def pack_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens, sequence_id, offset) for each piece.

    Null and empty texts: the end id alone, a piece of length 1. Repeated rows: pieces each. No rows: no rows. Other columns aren't read.
    """
    return pack(document_pieces(docs, key, text, **options)).withColumnRenamed("key_", key)
