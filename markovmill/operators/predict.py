"""One step of prediction: active experts, blended candidates, top k, a seeded draw."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .experts import similarity
from .lookup import find_transitions
from .ngrams import from_columns, to_columns

EPSILON = 2.0**-52


@dataclass(frozen=True)
class Chains:
    """What predicts: base and expert transitions, the experts' ranks, the depths and the number of experts.

    both: in the place of the first two, mixed_transitions(), which index() may have written, in `groups` folders."""

    base: DataFrame
    experts: DataFrame
    ranks: DataFrame
    n_from: int = 2
    n_to: int = 1
    total: int = 4
    both: DataFrame | None = None
    groups: int = 0


def similarities(state: DataFrame, ranks: DataFrame, total: int) -> DataFrame:
    """(query_id, expert, sim) for each query and expert, over the whole sequence seq; 0 without a common word."""
    sims = similarity(state, ranks, "query_id", "seq")
    every = state.select("query_id", F.explode(F.sequence(F.lit(0), F.lit(total - 1))).alias("expert"))
    return every.join(sims, ["query_id", "expert"], "left").select("query_id", "expert", F.coalesce("sim", F.lit(0.0)).alias("sim"))


def activate(sims: DataFrame, active: int) -> DataFrame:
    """(query_id, expert, sim, place): the `active` most similar experts of each query; of equal ones the lowest first."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sim"), "expert"))
    return sims.withColumn("place", place).where(F.col("place") <= active)


def multipliers(activated: DataFrame, active: int, total: int) -> DataFrame:
    """(query_id, expert, multiplier): the share of similarity by the root of all over the configured active experts."""
    share = F.try_divide("sim", F.sum("sim").over(Window.partitionBy("query_id")))
    return activated.withColumn("multiplier", share * F.sqrt(F.lit(total / active) if active else F.lit(0.0)))


def activated(sims: str, active: int, total: int) -> Column:
    """activate() and multipliers() of one row: an array of (expert, multiplier) by an array of the experts' similarities, in place order."""
    chosen = f"slice(array_sort(transform({sims}, (s, e) -> struct(-s AS o, e AS expert))), 1, {active})"
    whole = f"aggregate({chosen}, 0D, (a, y) -> a - y.o)"
    return F.expr(f"transform({chosen}, x -> struct(x.expert AS expert, try_divide(-x.o, {whole}) * sqrt({total / active!r}D) AS multiplier))")


def choose(state: DataFrame, chains: Chains, active: int) -> DataFrame:
    """state (query_id, seq) with `chosen`, the experts that the whole sequence activates and their multipliers."""
    sims = F.transform(F.array_sort(F.collect_list(F.struct("expert", "sim"))), lambda x: x["sim"])
    found = similarities(state, chains.ranks, chains.total).groupBy("query_id").agg(sims.alias("sims"))
    return state.join(found, "query_id").withColumn("chosen", activated("sims", active, chains.total)).drop("sims")


def candidates(state: DataFrame, chains: Chains, active: int, shortest: int = 0) -> DataFrame:
    """query_id, f0.., t0.., p: base and expert transitions, smoothed, blended and summed up by (from, to).

    (w + 1) over the query's sum of w + 1, by the multiplier (1 for the base), at least epsilon; an undefined share counts as epsilon.
    state: query_id, seq, and `chosen` as of choose() where the caller has it. Each of a query's chains has a slot of its own, so that sums
    do not depend on the order of rows; a query's total is summed up from partial sums before it meets its candidates.
    """
    names = from_columns(chains.n_from) + to_columns(chains.n_to)
    active = min(active, chains.total)
    if active and "chosen" not in state.columns:
        state = choose(state, chains, active)
    together = shortest >= chains.n_from
    w, slots = "CAST({} + 1 AS DOUBLE)", range(active + 1)
    if chains.both is not None:
        key = ["query_id", *(["chosen"] if active else [])]
        found = find_transitions(state.select(*key, "seq"), chains.both.select(*names, "weight", *(["own"] if active else [])), chains.n_from, key, shortest=shortest)
        own = [(w.format("weight"), "1D"), *[(w.format(f"get(own, chosen[{i}].expert)"), f"chosen[{i}].multiplier") for i in range(active)]]
        sums = " + ".join(f"coalesce({x}, 0D)" for x, _ in own)
        found = found.selectExpr("query_id", *names, *[f"{x} AS w{i}_" for i, (x, _) in enumerate(own)], *[f"{m} AS m{i}_" for i, (_, m) in enumerate(own)], f"{sums} AS w_")
        found = found.repartition("query_id") if together else found
    else:
        base = find_transitions(state.select("query_id", "seq"), chains.base.select(*names, "weight"), chains.n_from, ["query_id"], shortest=shortest)
        found = base.select("*", F.lit(0).alias("slot"), F.lit(1.0).alias("multiplier"))
        if active:
            asked = state.select("query_id", "seq", F.posexplode("chosen").alias("slot", "x")).select("query_id", "seq", (F.col("slot") + 1).alias("slot"), "x.expert", "x.multiplier")
            own = find_transitions(asked, chains.experts.select("expert", *names, "weight"), chains.n_from, ["query_id", "slot", "multiplier"], ["expert"], shortest=shortest)
            found = found.unionByName(own.drop("expert"))
        if together:
            # a full context has no more successors than there are words: one exchange by query serves sums, places and draws
            found = found.repartition("query_id")
        each = [f"max(CASE WHEN slot = {i} THEN {x} END) AS {n}{i}_" for i in slots for n, x in (("w", w.format("weight")), ("m", "multiplier"))]
        found = found.groupBy("query_id", *names).agg(*map(F.expr, [*each, f"sum({w.format('weight')}) AS w_"]))
    if together:
        found = found.selectExpr("*", "sum(w_) OVER (PARTITION BY query_id) AS total_")
    else:
        found = found.join(found.groupBy("query_id").agg(F.sum("w_").alias("total_")), "query_id")
    found = found.selectExpr("query_id", *names, *[f"w{i}_ / total_ * m{i}_ AS p{i}_" for i in slots], *[f"w{i}_" for i in slots])
    shares = [f"CASE WHEN w{i}_ IS NULL THEN 0D WHEN isnan(p{i}_) OR p{i}_ IS NULL OR p{i}_ < {EPSILON!r}D THEN {EPSILON!r}D ELSE p{i}_ END" for i in slots]
    return found.selectExpr("query_id", *names, f"{' + '.join(shares)} AS p")


def top_candidates(found: DataFrame, n_from: int, n_to: int, k: int) -> DataFrame:
    """The k likeliest candidates of each query with their place; of equal ones the first by words."""
    words = ", ".join(from_columns(n_from) + to_columns(n_to))
    return found.selectExpr("*", f"row_number() OVER (PARTITION BY query_id ORDER BY p DESC, {words}) AS place").where(f"place <= {k}")


def uniform(seed: int, step: Column) -> Column:
    """A number from 0 to 1 by seed, query_id and step."""
    hexed = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("query_id").cast("string"), step.cast("string")).cast("binary")), 1, 8)
    return F.conv(hexed, 16, 10).cast("double") / float(2**32 - 1)


def draw(top: DataFrame, u: Column) -> DataFrame:
    """The first candidate whose cumulative weight reaches u times the sum; the first of all if rounding leaves none."""
    cum = "sum(p) OVER (PARTITION BY query_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum"
    marked = top.selectExpr("*", cum).withColumn("u", u).selectExpr("*", "u * max(cum) OVER (PARTITION BY query_id) AS target").drop("u")
    chosen = "coalesce(min(CASE WHEN cum >= target THEN place END) OVER (PARTITION BY query_id), 1) AS chosen"
    return marked.selectExpr("*", chosen).where("place = chosen")


def predict(state: DataFrame, chains: Chains, active: int, top_k: int, step: Column, seed: int | None = None, shortest: int = 0) -> DataFrame:
    """query_id, t0..: the next tokens of each query that has candidates; the likeliest if seed is None, else drawn. state: as for candidates()."""
    top = top_candidates(candidates(state, chains, active, shortest), chains.n_from, chains.n_to, top_k if seed is not None else 1)
    chosen = top if seed is None else draw(top, uniform(seed, step))
    return chosen.select("query_id", *to_columns(chains.n_to))


def successors(base: DataFrame, n_from: int, n_to: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """keep, f0.., t0.., weight: what greedy prediction by the base chain alone gives after each full context; of equal ones the first by
    words. Of a shorter context's transitions the likeliest, first by words, is among these too."""
    best = F.min(F.struct((-F.col("weight")).alias("o"), *to_columns(n_to))).alias("best")
    return base.groupBy(*keep, *from_columns(n_from)).agg(best).select(*keep, *from_columns(n_from), *[f"best.{c}" for c in to_columns(n_to)], (-F.col("best.o")).alias("weight"))
