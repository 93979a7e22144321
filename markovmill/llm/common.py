"""What the operators share: the shared folder, cut lineage, batches of rows, groups cut in blocks, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..plans.lineage import cut, shared_folder

__all__ = ["cut", "shared_folder"]

#: Rows that a Python worker turns into Python objects at once, and bytes of text it holds in one go.
SLICE_ROWS, SLICE_BYTES = 512, 4 << 20


#: What the session uses unless it has a setting of its own. Rows and bytes of the batches that go to Python workers, as texts may be long
#: and both sides hold a few.
SETTINGS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "4194304"}


def settle(spark: SparkSession) -> None:
    for k, v in SETTINGS.items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Cuts batches into slices of bounded rows and bytes; one text may be longer than that."""
    for batch in batches:
        sizes = np.cumsum(np.diff(np.asarray(_offsets(batch.column(text)), dtype=np.int64)))
        start = 0
        while start < batch.num_rows:
            base = sizes[start - 1] if start else 0
            stop = min(int(np.searchsorted(sizes, base + SLICE_BYTES, "right")), start + SLICE_ROWS)
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def _offsets(column: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + len(column) + 1]


def _arrow(schema: str) -> pa.Schema:
    return to_arrow_schema(_parse_datatype_string(schema))


def _batch(out: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([out[f.name] if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], type=f.type) for f in schema], schema=schema)


def map_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict[str, list] | None]], schema: str) -> DataFrame:
    """Runs a function of row slices over each partition. make() is called once in each task and may load models."""
    settle(df.sparkSession)
    types = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = None
        for part in slices(batches):
            f = f or make()
            out = f(part)
            if out and len(out[types.names[0]]):
                yield _batch(out, types)

    return df.mapInArrow(run, schema)


def map_groups(df: DataFrame, keys: list[str], f: Callable[[dict[str, object]], dict[str, list] | None], schema: str) -> DataFrame:
    """Runs f over the rows of each key, as columns. Groups must be small enough for a worker (see blocks()).

    Rows come sorted, so that thousands of small groups share one Arrow batch rather than a frame each.
    """
    settle(df.sparkSession)
    types = _arrow(schema)
    names, columns = types.names, df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def done(parts: list[pa.RecordBatch]) -> dict[str, list] | None:
            table = pa.Table.from_batches(parts)
            return f({c: table.column(c).to_pylist() if not pa.types.is_primitive(table.schema.field(c).type) or table.column(c).null_count else table.column(c).to_numpy() for c in columns})

        def batch(outs: list[dict[str, list]]) -> pa.RecordBatch:
            return _batch({n: [v for o in outs for v in o[n]] for n in names}, types)

        ready: list[dict[str, list]] = []
        rows = 0
        for b in batches:
            if not b.num_rows:
                continue
            keyed = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
            change = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keyed])) + 1
            starts = [0, *change.tolist(), b.num_rows]
            for s, e in zip(starts, starts[1:]):
                key = tuple(k[s] for k in keyed)
                if held and key != last:
                    if out := done(held):
                        ready.append(out)
                        rows += len(out[names[0]])
                    held = []
                held.append(b.slice(s, e - s))
                last = key
                if rows > 5000:
                    yield batch(ready)
                    ready, rows = [], 0
        if held and (out := done(held)):
            ready.append(out)
        if ready:
            yield batch(ready)

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def blocks(df: DataFrame, parts: Column, *ident: str) -> DataFrame:
    """Deals groups to `parts` blocks and these to pairs: each two rows of a group meet in one pair (block_i, block_j).

    Adds block_i, block_j and block (the row's own); pairs of different blocks meet where block_i < block_j, a block's own pairs
    where they are equal. A group of one part has the pair (0, 0) alone, so copying starts with groups over what a task may hold, and no
    task holds more than about two blocks. ident: columns that tell a group's rows apart.
    """
    g = F.greatest(F.ceil(parts), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64(*ident, F.lit(77)), g).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), g - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("block_i"), F.greatest(o, F.col("block")).alias("block_j")))
    return df.withColumn("block", own).withColumn("pair_", F.explode(pairs)).select("*", "pair_.block_i", "pair_.block_j").drop("pair_")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a long, b long): (id, component), the least id that is reached. Ids without an edge don't appear.

    Rounds of large-star and small-star contraction, each written to the shared folder; a hot centre is a skewed join that adaptive
    execution splits, and minima are summed up before rows are dealt out. The number of rounds grows with the logarithm of a path.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = cut(large.distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = cut(small.distinct())
        state = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if state == before or state[0] == 0:
            break
        before = state
    heads = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(heads)


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Roots (the least index of each component) of n nodes under the given links, by vectorised label spreading with pointer jumps."""
    root = np.arange(n)
    while True:
        a, b = root[left], root[right]
        low, high = np.minimum(a, b), np.maximum(a, b)
        new = root.copy()
        np.minimum.at(new, high, low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == root).all():
            return root
        root = new


def held_out(ident: Column, parts: int, rest: int) -> Column:
    return F.pmod(F.crc32(ident.cast("string").cast("binary")), F.lit(parts)) == rest


#: Rows of a few numbers each that a join sends to every executor at most: about 40 MB there as a hash table.
BROADCAST_ROWS = 500_000


def sent_if_small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `most` rows; beyond that the join deals both sides out by key. df should be cut()."""
    return F.broadcast(df) if df.count() <= most else df
