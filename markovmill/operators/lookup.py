"""Transitions that follow a context: by its last tokens, or by fewer where the context is shorter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .ngrams import from_columns

#: Of an index: rows of a folder, about, folders at most, and contexts that are looked up at once.
GROUP_ROWS, MOST_GROUPS, MOST_ASKED = 16_000, 8192, 1000


def group_of(context: list[Column], groups: int) -> Column:
    """The folder of a full context in an index of so many."""
    return F.pmod(F.xxhash64(*context), F.lit(groups)).cast("int")


def groups_for(rows: int) -> int:
    return min(MOST_GROUPS, 1 + rows // GROUP_ROWS)


def index(transitions: DataFrame) -> DataFrame:
    """transitions with group_, dealt out by it, as a table cut into a folder for each group: near() reads few, however many there are."""
    return cut(transitions, "group_")


def near(transitions: DataFrame, groups: list[int]) -> DataFrame:
    """An indexed table's rows of these groups; of all if there are more than MOST_ASKED."""
    return (transitions.where(F.col("group_").isin(groups)) if len(groups) <= MOST_ASKED else transitions).drop("group_")


def find_transitions(contexts: DataFrame, transitions: DataFrame, n_from: int, key: list[str], on: list[str] = (), sequence: str = "seq", shortest: int = 0) -> DataFrame:
    """key, and the transitions of each context (array of words): those whose f columns end with its last n_from words.

    A context of k < n_from words matches the last k columns; an empty one everything. on: further columns that must be equal, such as
    expert. One equality join for each length from `shortest` on, which no context may be under: a caller who knows that all contexts are
    long has one join, and none with every transition.
    """
    names = from_columns(n_from)
    size = F.least(F.size(sequence), F.lit(n_from))
    last = F.slice(sequence, -1 * size, size)
    base = contexts.withColumn("k_", size).withColumn("ctx_", F.when(size > 0, last).otherwise(F.array().cast("array<string>"))).drop(sequence)
    out = None
    for k in range(n_from, min(shortest, n_from) - 1, -1):
        own = base.where(F.col("k_") == k)
        tail = names[n_from - k :]
        own = own.select(*dict.fromkeys([*key, *on]), *[F.get("ctx_", F.lit(i)).alias(c) for i, c in enumerate(tail)])
        by = [*on, *tail]
        found = own.join(transitions, by) if by else own.crossJoin(transitions)
        found = found.select(*dict.fromkeys([*key, *on]), *[c for c in transitions.columns if c not in on])
        out = found if out is None else out.unionByName(found)
    return out
