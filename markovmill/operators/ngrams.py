"""Transitions: windows over documents' tokens, counts and fixed-point weights. Keys are scalar columns f0.. and t0.."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_WEIGHT = 2**32 - 1


def from_columns(n: int) -> list[str]:
    return [f"f{i}" for i in range(n)]


def to_columns(n: int) -> list[str]:
    return [f"t{i}" for i in range(n)]


def windows(docs: DataFrame, n_from: int, n_to: int, keep: list[str] = (), include_last: bool = False) -> DataFrame:
    """keep, f0.., t0..: the windows of n_from + n_to tokens of each document, but for the last one (unless include_last)."""
    if not (1 <= n_from <= 255 and 1 <= n_to <= 255):
        raise ValueError("depths must be from 1 to 255")
    size, names = n_from + n_to, from_columns(n_from) + to_columns(n_to)
    m = F.greatest(F.size("tokens") - size + int(include_last), F.lit(0))
    zipped = F.arrays_zip(*[F.slice("tokens", k + 1, m).alias(c) for k, c in enumerate(names)])
    # outer, and short documents left out afterwards: conditions on tokens would move down and make them twice
    return docs.select(*keep, F.inline_outer(zipped)).toDF(*keep, *names).where(F.col(names[0]).isNotNull())


def count_transitions(docs: DataFrame, n_from: int, n_to: int, keep: list[str] = (), include_last: bool = False) -> DataFrame:
    """keep, f0.., t0.., count."""
    names = from_columns(n_from) + to_columns(n_to)
    # one string as key: fewer bytes in the exchange, less work in the aggregate
    rows = windows(docs, n_from, n_to, keep, include_last).select(*keep, packed(F.array(*names)).alias("key"))
    counts = rows.groupBy(*keep, "key").agg(F.count("*").alias("count"))
    return named(counts, names).select(*keep, *names, "count")


def named(counts: DataFrame, names: list[str]) -> DataFrame:
    """counts with columns of these names in the place of `key`, packed words. They are never null, and so declared: else a join's condition
    to that effect would move below the aggregate of its rows, but not of its totals, and it would be made twice."""
    split = counts.withColumn("key", unpacked("key"))
    return split.withColumns({c: F.coalesce(F.get("key", F.lit(i)), F.lit("")) for i, c in enumerate(names)}).drop("key")


def packed(tokens: str | Column = "tokens") -> Column:
    """Tokens as one string: under half of an array's bytes in an exchange. Tokens have no spaces, at which the tokenizer splits."""
    return F.array_join(tokens, " ")


def unpacked(text: str) -> Column:
    return F.split(text, " ")


def distinct_documents(docs: DataFrame) -> DataFrame:
    """One row for each sequence of tokens; the base chain counts copies once."""
    return docs.select(packed().alias("packed")).distinct().select(unpacked("packed").alias("tokens"))


def fixed_point(count: Column, total: Column) -> Column:
    """A share in single precision as a whole number of 2^-32, cut off, at most 2^32 - 1."""
    # greatest() keeps the casts apart: Spark takes bigint to float to double for bigint to double, without rounding in between
    single = [F.greatest(c.cast("float"), F.lit(0).cast("float")).cast("double") for c in (count, total)]
    share = (single[0] / single[1]).cast("float").cast("double")
    return F.least(F.floor(share * float(2**32)).cast("bigint"), F.lit(MOST_WEIGHT).cast("bigint"))


def weigh(counts: DataFrame, by: list[str] = ()) -> DataFrame:
    """counts with the weight of each transition among all (of `by`). The totals are one row, or one for each expert."""
    totals = counts.groupBy(*by).agg(F.sum("count").alias("total"))
    joined = counts.join(F.broadcast(totals), list(by)) if by else counts.crossJoin(F.broadcast(totals))
    return joined.withColumn("weight", fixed_point(F.col("count"), F.col("total"))).drop("total")


def base_transitions(docs: DataFrame, n_from: int = 2, n_to: int = 1, include_last: bool = False) -> DataFrame:
    """f0.., t0.., count, weight of the base chain: documents of equal tokens count once."""
    return weigh(count_transitions(distinct_documents(docs), n_from, n_to, include_last=include_last))


def transitions_bytes(n_from: int, n_to: int, token_bytes: int = 3) -> int:
    """Of one record: its tokens and a weight."""
    return token_bytes * (n_from + n_to) + 4
