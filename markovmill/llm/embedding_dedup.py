"""Near-duplicate vectors: robust-pruned graphs over overlapping cluster shards, joined and searched by range."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, components, cut, forest, map_groups, sent_if_small

#: Vectors by which centroids are fitted, at most, and centroids, at most.
FIT_ROWS, MOST_CENTROIDS = 20_000, 4_096
#: Vectors to a shard, as aimed at; a shard of more than BLOCK is dealt to pairs of blocks.
SHARD_ROWS, BLOCK = 600, 1_000
#: Nearest centroids whose shards a vector belongs to, in the first and in each later attempt.
OVERLAP = (2, 4, 8)
#: Neighbours within the range and beyond it that pruning keeps, its slack, and the width of the search's beam.
NEAR, FAR, ALPHA, BEAM = 16, 16, 1.2, 24
#: Vectors whose links are counted over all the table to audit recall, at first and, while too few have few links, at most; vectors of up
#: to FEW_LINKS links that are wanted among them; the least recall that is accepted.
AUDIT_ROWS, AUDIT_MOST, FEW_LINKS, AUDIT_FEW, LEAST_RECALL = 200, 3_200, 16, 50, 0.97


def robust_prune(sims: np.ndarray, allowed: np.ndarray, degree: int, alpha: float = ALPHA) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges (from, to) of robust pruning over all allowed candidates: the nearest one left is kept, and it rules out those to which it is
    nearer by the factor alpha than the vector itself. sims: cosines; all vectors are pruned side by side."""
    n = len(sims)
    dist = np.sqrt(np.maximum(0.0, 2 - 2 * sims)).astype(np.float32)
    left = np.where(allowed, dist, np.inf).astype(np.float32)
    out = []
    rows = np.arange(n)
    for _ in range(degree):
        nearest = left.argmin(axis=1)
        ok = np.isfinite(left[rows, nearest])
        if not ok.any():
            break
        out.append((rows[ok], nearest[ok]))
        left[alpha * dist[nearest] <= dist] = np.inf
        left[rows, nearest] = np.inf
    return out


def build_graph(x: np.ndarray, near: float) -> tuple[np.ndarray, np.ndarray]:
    """Directed edges of a shard's graph: pruned among neighbours within the range, pruned among all beyond it, each edge both ways."""
    sims = x @ x.T
    inside = sims >= near
    np.fill_diagonal(inside, False)
    beyond = sims < near
    np.fill_diagonal(beyond, False)
    edges = robust_prune(sims, inside, NEAR) + robust_prune(sims, beyond, FAR)
    if not edges:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    a, b = np.concatenate([e[0] for e in edges]), np.concatenate([e[1] for e in edges])
    code = np.unique(np.concatenate([a * len(x) + b, b * len(x) + a]))
    return code // len(x), code % len(x)


def range_search(x: np.ndarray, a: np.ndarray, b: np.ndarray, queries: np.ndarray, near: float, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, node) with a cosine >= near that a search finds: greedy from the medoid with a beam, then, from what lies in range,
    along edges as long as they lead to more in range. All queries walk side by side; each node is compared once to each."""
    n, q = len(x), len(queries)
    first = np.searchsorted(a, np.arange(n + 1))
    medoid = int((x @ x.mean(axis=0)).argmax())
    target = x[queries]
    seen = np.zeros((q, n), dtype=bool)
    sims = np.full((q, n), -2.0, dtype=np.float64)

    def visit(row: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        code = np.unique(row * n + node)
        row, node = code // n, code % n
        new = ~seen[row, node]
        row, node = row[new], node[new]
        seen[row, node] = True
        for at in range(0, len(row), 200_000):
            r, v = row[at : at + 200_000], node[at : at + 200_000]
            sims[r, v] = np.einsum("ij,ij->i", target[r], x[v])
        return row, node

    def neighbours(row: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count = first[node + 1] - first[node]
        start = np.repeat(first[node] - np.r_[0, np.cumsum(count)[:-1]], count)
        return np.repeat(row, count), b[start + np.arange(count.sum())]

    visit(np.arange(q), np.full(q, medoid))
    spread = np.zeros((q, n), dtype=bool)
    for _ in range(n):
        top = np.argpartition(-sims, min(beam, n - 1), axis=1)[:, :beam]
        rows = np.arange(q)[:, None]
        open_ = seen[rows, top] & ~spread[rows, top]
        # the nearest few of the beam that have not been spread yet
        score = np.where(open_, sims[rows, top], -3.0)
        best = np.argsort(-score, axis=1)[:, :4]
        row, at = np.nonzero(np.take_along_axis(open_, best, 1))
        if not len(row):
            break
        node = top[row, best[row, at]]
        spread[row, node] = True
        visit(*neighbours(row, node))
    row, node = np.nonzero((sims >= near) & ~spread)
    while len(row):
        spread[row, node] = True
        row, node = visit(*neighbours(row, node))
        good = sims[row, node] >= near
        row, node = row[good], node[good]
    return np.nonzero(sims >= near)


def _unit(column: list) -> np.ndarray:
    x = np.asarray(column, dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square is too large or too small
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _by_length(column) -> list[tuple[int, np.ndarray]]:
    """Lengths, and the places of the vectors that have them."""
    lengths = np.fromiter(map(len, column), np.int64, len(column))
    return [(int(d), np.flatnonzero(lengths == d)) for d in np.unique(lengths)]


def fit_centroids(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means of a bounded sample, on the driver."""
    rng = np.random.default_rng(7)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = np.concatenate([(x[i : i + 2000] @ c.T).argmax(axis=1) for i in range(0, len(x), 2000)])
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        size = np.sqrt((total * total).sum(axis=1))
        c = np.where(size[:, None] > 1e-12, total / np.maximum(size, 1e-12)[:, None], c)
    return c


def _shards(vectors: DataFrame, centroids: dict[int, np.ndarray], overlap: int) -> DataFrame:
    """(id, mult, v, shard, home): a row for each of the `overlap` nearest centroids of the vector's length; home: the nearest."""
    import pandas as pd

    def run(frames):
        for f in frames:
            for d, at in _by_length(f["v"]):
                part = f.iloc[at]
                if d in centroids:
                    s = _unit(part["v"].tolist()) @ centroids[d].T
                    top = np.argsort(-s, axis=1, kind="stable")[:, :overlap]
                else:  # none of that length is in the sample: they are one shard
                    top = np.zeros((len(part), 1), dtype=np.int64)
                for k in range(top.shape[1]):
                    yield pd.DataFrame({"id": part["id"], "mult": part["mult"], "v": part["v"], "shard": d * MOST_CENTROIDS + top[:, k], "home": k == 0})

    return vectors.mapInPandas(run, "id long, mult long, v array<double>, shard long, home boolean")


def _graph(dealt: DataFrame, near: float) -> DataFrame:
    """(id, within, beyond): each shard's (or pair of blocks') graph, lists of one vector joined over all; within: neighbours in range."""

    def run(g: dict) -> dict | None:
        ids = np.asarray(g["id"])
        if len(ids) < 2:
            return None
        x = _unit(g["v"]).astype(np.float32)
        a, b = build_graph(x, near)
        close = np.einsum("ij,ij->i", x[a], x[b]) >= near - 1e-5
        out: dict[str, list] = {"id": ids.tolist()}
        for name, some in (("within", close), ("beyond", ~close)):
            cuts = np.searchsorted(a[some], np.arange(len(ids) + 1))
            out[name] = [ids[b[some][cuts[i] : cuts[i + 1]]].tolist() for i in range(len(ids))]
        return out

    lists = map_groups(dealt.select("id", "v", "shard", "block_i", "block_j"), ["shard", "block_i", "block_j"], run, "id long, within array<long>, beyond array<long>")
    return lists.groupBy("id").agg(*[F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("within", "beyond")])


def _reached(dealt: DataFrame, graph: DataFrame, once: DataFrame) -> DataFrame:
    """Rows as of dealt, of block -1, for vectors outside a shard to which its members' joined lists lead within the range.

    A list has at most NEAR own edges in each shard, and others' back to it, so these are few to a member.
    """
    own = dealt.where("block_i = block_j").select("id", "shard", "block")
    out = own.join(graph.where(F.size("within") > 0).select("id", "within"), "id").select("shard", "block", F.explode("within").alias("id")).distinct()
    out = out.join(own.select("id", "shard"), ["id", "shard"], "left_anti")
    out = out.select("id", "shard", F.col("block").alias("block_i"), F.col("block").alias("block_j"), F.lit(-1).alias("block"), F.lit(False).alias("home"))
    return out.join(once.select("id", "mult", "v"), "id")


def _search(dealt: DataFrame, graph: DataFrame, once: DataFrame, near: float) -> DataFrame:
    """(id, links, root): each vector searched once, from the medoid of the shard it is at home in, over the joined adjacency lists of the
    shard's members and of the vectors beyond it to which they lead within the range."""

    def run(g: dict) -> dict | None:
        ids = np.asarray(g["id"])
        if len(ids) < 2:
            return None
        order = np.argsort(ids)
        ids, mult, block, home = (np.asarray(g[c])[order] for c in ("id", "mult", "block", "home"))
        x = _unit([g["v"][i] for i in order])
        lists = [[*(g["within"][i] or []), *(g["beyond"][i] or [])] for i in order]
        a = np.repeat(np.arange(len(ids)), [len(v) for v in lists])
        flat = np.fromiter((v for l in lists for v in l), np.int64, len(a))
        at = np.minimum(np.searchsorted(ids, flat), len(ids) - 1)
        ok = ids[at] == flat
        # each edge both ways, also those to vectors beyond the shard
        code = np.unique(np.r_[a[ok] * len(ids) + at[ok], at[ok] * len(ids) + a[ok]])
        a, b = code // len(ids), code % len(ids)
        queries = np.flatnonzero(home.astype(bool))
        found_i, found_j = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for s in range(0, len(queries), 256):
            part = queries[s : s + 256]
            rows, nodes = range_search(x, a, b, part, near)
            found_i.append(part[rows])
            found_j.append(nodes)
        i, j = np.concatenate(found_i), np.concatenate(found_j)
        # of two that are both at home here a find from either side counts
        asked = np.zeros(len(ids), dtype=bool)
        asked[queries] = True
        back = asked[j]
        code = np.unique(np.r_[i * len(ids) + j, j[back] * len(ids) + i[back]])
        i, j = code // len(ids), code % len(ids)
        keep = i != j
        if g["block_i"][0] != g["block_j"][0]:
            keep &= block[i] != block[j]
        i, j = i[keep], j[keep]
        exact = np.einsum("ij,ij->i", x[i], x[j]) >= near
        i, j = i[exact], j[exact]
        if not len(i):
            return None
        links = np.bincount(i, weights=mult[j], minlength=len(ids))
        root = forest(len(ids), i, j)
        has = np.unique(np.r_[i, j])
        return {"id": ids[has].tolist(), "links": links[has].astype(np.int64).tolist(), "root": ids[root[has]].tolist()}

    nodes = dealt.unionByName(_reached(dealt, graph, once))
    return map_groups(nodes.join(graph, "id", "left"), ["shard", "block_i", "block_j"], run, "id long, links long, root long")


def _true_links(vectors: DataFrame, near: float) -> dict[int, int]:
    """Links over the whole table of vectors that a hash picks: AUDIT_ROWS, and more while few of them have few links, up to AUDIT_MOST."""
    import pandas as pd

    wanted, start, done = AUDIT_ROWS, 0, {}
    while True:
        picked = vectors.orderBy(F.xxhash64("id", F.lit(3)), "id").limit(wanted).collect()[start:]
        if not picked:
            return done
        ids = np.array([r.id for r in picked])
        own = {d: (at, _unit([picked[i].v for i in at])) for d, at in _by_length([r.v for r in picked])}

        def run(frames, ids=ids, own=own):
            links = np.zeros(len(ids), dtype=np.int64)
            for f in frames:
                for d, there in _by_length(f["v"]):
                    if d in own:
                        at, x = own[d]
                        part = f.iloc[there]
                        hit = (x @ _unit(part["v"].tolist()).T >= near) & (ids[at][:, None] != part["id"].to_numpy()[None, :])
                        links[at] += hit @ part["mult"].to_numpy(dtype=np.int64)
            yield pd.DataFrame({"id": ids, "links": links})

        true = vectors.mapInPandas(run, "id long, links long").groupBy("id").agg(F.sum("links").alias("n")).collect()
        done |= {r.id: done.get(r.id, 0) + r.n for r in true}
        if wanted >= AUDIT_MOST or sum(0 < n <= FEW_LINKS for n in done.values()) >= AUDIT_FEW:
            return done
        start, wanted = wanted, min(4 * wanted, AUDIT_MOST)


def _recall(true: dict[int, int], counts: DataFrame) -> float:
    """Mean share of a vector's links that are found, of vectors with few links or of those with more, whichever is less, so that a large
    group doesn't hide what small ones lose."""
    rows = counts.sparkSession.createDataFrame([(i,) for i, n in true.items() if n] or [(-1,)], "id long")
    found = {r.id: r.links for r in counts.join(F.broadcast(rows), "id").collect()}  # at most AUDIT_MOST rows
    shares = [[min(found.get(i, 0), n) / n for i, n in true.items() if n and (n <= FEW_LINKS) == few] for few in (True, False)]
    return min((float(np.mean(s)) for s in shares if s), default=1.0)


def _all_pairs(dealt: DataFrame, near: float) -> DataFrame:
    """(id, links, root) as of _search(), by comparing all vectors of each pair of blocks."""

    def run(g: dict) -> dict | None:
        ids, mult, block = np.asarray(g["id"]), np.asarray(g["mult"]), np.asarray(g["block"])
        order = np.argsort(ids)
        ids, mult, block = ids[order], mult[order], block[order]
        x = _unit([g["v"][i] for i in order])
        i, j = np.nonzero(np.triu(x @ x.T >= near - 1e-9, 1))
        own = np.einsum("ij,ij->i", x[i], x[j]) >= near
        if g["block_i"][0] != g["block_j"][0]:
            own &= block[i] != block[j]
        i, j = i[own], j[own]
        if not len(i):
            return None
        links = np.bincount(i, weights=mult[j], minlength=len(ids)) + np.bincount(j, weights=mult[i], minlength=len(ids))
        root = forest(len(ids), i, j)
        has = np.flatnonzero(links)
        return {"id": ids[has].tolist(), "links": links[has].astype(np.int64).tolist(), "root": ids[root[has]].tolist()}

    return map_groups(dealt, ["d", "block_i", "block_j"], run, "id long, links long, root long")


def near_duplicates(vectors: DataFrame, near: float = 0.9, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, n_links, component_id, kept, audited_recall) for each row: links are pairs of rows with a cosine >= near, in doubles.

    Null, zero and empty vectors, and such with null or non-finite components, link with nothing; vectors of different lengths do not link
    with each other. Equal vectors are one from the start and count by their number. Repeated ids: rows of one id and vector are one;
    an id with several vectors has the links of each. Null ids: no links. No rows: no rows. Other columns aren't read.

    Each shard's graph is built from its members alone; lists of one vector are joined over its shards, and each vector is searched once,
    over its shard and what the joined lists reach beyond it. An audit counts links of AUDIT_ROWS vectors or more over the whole table, by vector; under LEAST_RECALL
    the shards overlap more, and after the last overlap all vectors of a length are compared, in pairs of blocks. Large shards are dealt to pairs of blocks, so that a hot cluster is many tasks.
    """
    v = F.col(vector).cast(T.ArrayType(T.DoubleType()))
    rows = vectors.select(F.col(key).cast("long").alias("id_"), v.alias("v"))
    finite = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    good = F.coalesce(F.col("id_").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda e: e != 0), F.lit(False))
    rows = rows.withColumn("digest", F.when(good, F.sha2(F.array_join(F.transform("v", lambda e: e.cast("string")), ",").cast("binary"), 256)))
    once = rows.where("digest is not null").groupBy("digest").agg(F.min("id_").alias("id"), F.countDistinct("id_").alias("mult"), F.first("v").alias("v"))
    once = cut(once)
    sample = once.select("v").orderBy(F.xxhash64("digest")).limit(FIT_ROWS).collect()
    if not sample:
        return vectors.select(F.col(key), F.lit(0).cast("long").alias("n_links"), F.col(key).cast("long").alias("component_id"), F.lit(True).alias("kept"), F.lit(1.0).alias("audited_recall"))
    sampled = _by_length([r.v for r in sample])
    wanted = F.size("v").isin([d for d, _ in sampled])  # at most FIT_ROWS lengths
    n = {r.d: r["count"] for r in once.where(wanted).groupBy(F.size("v").alias("d")).count().collect()}
    centroids = {d: fit_centroids(_unit([sample[i].v for i in at]), max(1, min(MOST_CENTROIDS, len(at), -(-n[d] // SHARD_ROWS)))) for d, at in sampled}
    true = _true_links(once, near)
    for overlap in OVERLAP:
        sharded = cut(_shards(once.select("id", "mult", "v"), centroids, overlap))
        sizes = cut(sharded.groupBy("shard").agg(F.count("*").alias("size")))
        dealt = blocks(sharded.join(sent_if_small(sizes), "shard"), F.col("size") / BLOCK, "id").drop("size")
        graph = cut(_graph(dealt, near))
        linked = cut(_search(dealt, graph, once, near))
        counts = linked.groupBy("id").agg(F.sum("links").alias("links"))
        recall = _recall(true, counts)
        if recall >= LEAST_RECALL:
            break
    else:
        lengths = cut(once.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("size")))
        dealt = once.select("id", "mult", "v", F.size("v").alias("d")).join(sent_if_small(lengths), "d")
        linked = cut(_all_pairs(blocks(dealt, F.col("size") / BLOCK, "id"), near))
        counts = linked.groupBy("id").agg(F.sum("links").alias("links"))
        recall = _recall(true, counts)
    classes = components(linked.select(F.col("id").alias("a"), F.col("root").alias("b")))
    facts = once.select("digest", "id", "mult").join(counts, "id", "left").join(classes, "id", "left")
    facts = cut(facts.where("mult > 1 or links is not null").withColumnRenamed("id", "rep"))
    out = rows.select("id_", "digest").join(sent_if_small(facts), "digest", "left")
    component = F.coalesce("component", "rep", "id_")
    links = (F.coalesce("links", F.lit(0)) + F.coalesce("mult", F.lit(1)) - 1).cast("long")
    return out.select(F.col("id_").alias(key), links.alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id_") == component, F.lit(True)).alias("kept"), F.lit(recall).alias("audited_recall"))
