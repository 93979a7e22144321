"""Documents whose word shingles have a Jaccard similarity over a threshold: MinHash, Bayesian pruning, exact verification."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, components, cut, forest, map_groups, map_rows, sent_if_small
from .shingles import WordHashes, shingles, signature, word_hashes

#: MinHash values of a document, in bands of ROWS; two sets of similarity 0.8 meet in a band but for a chance of 0.0004.
HASHES, ROWS = 100, 5
#: Values that are compared between two looks at the posterior, and the probability under which a pair is dropped.
STEP, TOLERANCE = 20, 1e-6
#: Rows of a group, and shingles of their texts, that make a block; larger groups are dealt to pairs of blocks.
BLOCK, BLOCK_SHINGLES = 512, 4 << 20
#: Bytes of a task's incidence matrix.
MATRIX_BYTES = 64 << 20


@lru_cache
def least_matches(n: int, threshold: float, tolerance: float = TOLERANCE) -> int:
    """Of n compared values so many must agree; with fewer, P(similarity >= threshold) is under the tolerance.

    With an even prior over the similarity, the posterior after m of n is Beta(m + 1, n - m + 1), and its upper tail is the chance that a
    binomial of n + 1 trials at the threshold has at most m hits.
    """
    tail = 0.0
    for m in range(n + 1):
        tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if tail >= tolerance:
            return m
    return n + 1


def surviving_pairs(left: np.ndarray, right: np.ndarray, threshold: float, own: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of signatures that the posterior never drops; own: i < j of one block. Compared STEP values at a time."""
    n, m = len(left), len(right)
    i, j = np.triu_indices(n, 1) if own else (np.repeat(np.arange(n), m), np.tile(np.arange(m), n))
    hits = np.zeros(len(i), dtype=np.int32)
    for at in range(0, left.shape[1], STEP):
        hits = hits + (left[i, at : at + STEP] == right[j, at : at + STEP]).sum(axis=1, dtype=np.int32)
        keep = hits >= least_matches(min(at + STEP, left.shape[1]), threshold)
        i, j, hits = i[keep], j[keep], hits[keep]
        if not len(i):
            break
    return i, j


def documents_signed(docs: DataFrame, key: str = "doc_id", text: str = "text", hashes: int = HASHES) -> DataFrame:
    """(doc, body, set_key, n, sig): a hash of the text, a digest of its set of shingles (null for none), the set's size and MinHash values."""
    rows = _bodies(docs, key, text)

    def make():
        known = WordHashes()

        def run(part):
            out: dict[str, list] = {"doc": part.column("doc").to_pylist(), "body": part.column("body").to_pylist(), "set_key": [], "n": [], "sig": []}
            for t in part.column("text").to_pylist():
                x = np.unique(shingles(word_hashes(t, known)))
                out["set_key"].append(xxhash.xxh128_digest(x) if len(x) else None)
                out["n"].append(len(x))
                out["sig"].append(signature(x, hashes).astype("<u4").tobytes() if len(x) else None)
            return out

        return run

    return map_rows(rows, make, "doc long, body long, set_key binary, n long, sig binary")


def _bodies(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, body, text): body tells texts of one id apart."""
    own = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).cast("long").alias("doc"), F.xxhash64(own).alias("body"), own.alias("text"))


def _signatures(column: list) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype="<u4").reshape(len(column), -1)


def candidate_components(reps: DataFrame, threshold: float, hashes: int = HASHES, rows: int = ROWS, most: int = BLOCK) -> DataFrame:
    """(id, component): documents joined by pairs that share a band and that the posterior keeps. reps: (set_key, rep, sig)."""
    bands = F.transform(F.sequence(F.lit(0), F.lit(hashes // rows - 1)), lambda b: F.xxhash64(b, F.substring("sig", b * (4 * rows) + 1, F.lit(4 * rows))))
    banded = reps.select("set_key", "rep", F.explode(bands).alias("h"))
    buckets = banded.groupBy("h").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("set_key")).alias("x"), F.min("rep").alias("low")).where("size > 1")
    # bands that hold the same documents say the same: one of them is enough
    buckets = cut(buckets.groupBy("size", "x", "low").agg(F.min("h").alias("h")).select("h", "size"))
    members = banded.join(sent_if_small(buckets), "h")
    members = blocks(members, F.col("size") / most, "set_key").join(reps.select("set_key", "sig"), "set_key").drop("set_key")

    def edges(g: dict) -> dict | None:
        rep, block, sig = np.asarray(g["rep"]), np.asarray(g["block"]), _signatures(g["sig"])
        i, j = _pairs(rep, block, g["block_i"][0], g["block_j"][0], sig, threshold)
        if not len(i):
            return None
        root = forest(len(rep), i, j)
        at = np.flatnonzero(root != np.arange(len(rep)))
        return {"a": rep[at].tolist(), "b": rep[root[at]].tolist()}

    return components(map_groups(members, ["h", "block_i", "block_j"], edges, "a long, b long"))


def _pairs(rep: np.ndarray, block: np.ndarray, bi: int, bj: int, sig: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    if bi == bj:
        return surviving_pairs(sig, sig, threshold, own=True)
    a, b = np.flatnonzero(block == bi), np.flatnonzero(block == bj)
    if not len(a) or not len(b):
        return a[:0], b[:0]
    i, j = surviving_pairs(sig[a], sig[b], threshold, own=False)
    return a[i], b[j]


def shared_shingles(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many shingles each pair of sets shares, exactly: products of 0/1 matrices, stretch by stretch of the shingles.

    Shingles of one set alone are left out beforehand; only sets of some pair get a row.
    """
    used = np.unique(np.concatenate([left, right]))
    row = np.full(len(sets), -1)
    row[used] = np.arange(len(used))
    flat = np.concatenate([sets[u] for u in used])
    owner = np.repeat(np.arange(len(used)), [len(sets[u]) for u in used])
    _, place, count = np.unique(flat, return_inverse=True, return_counts=True)
    keep = count[place] > 1
    _, place = np.unique(place[keep], return_inverse=True)
    owner = owner[keep]
    out = np.zeros(len(left), dtype=np.int64)
    if not len(place):
        return out
    l, r = row[left], row[right]
    if len(left) < 4 * len(used):  # few pairs: one by one
        order = np.argsort(owner, kind="stable")
        ends = np.searchsorted(owner[order], np.arange(len(used) + 1))
        own = [place[order[ends[k] : ends[k + 1]]] for k in range(len(used))]
        return np.array([len(np.intersect1d(own[a], own[b], assume_unique=True)) for a, b in zip(l, r)], dtype=np.int64)
    width = max(1, MATRIX_BYTES // (4 * len(used)))
    for at in range(0, int(place.max()) + 1, width):
        here = (place >= at) & (place < at + width)
        m = np.zeros((len(used), width), dtype=np.float32)
        m[owner[here], place[here] - at] = 1
        out += (m @ m.T)[l, r].astype(np.int64)
    return out


def ngram_join(docs: DataFrame, threshold: float = 0.8, key: str = "doc_id", text: str = "text", hashes: int = HASHES, rows: int = ROWS, most: int = BLOCK) -> DataFrame:
    """(key, class_id, n_links, kept) for each row: links are pairs of rows whose shingle sets have a Jaccard similarity >= threshold.

    Shingles: five words in a row, lower case, punctuation aside; texts of one to four words have one shingle of them all. Null texts,
    empty ones and such without words link with nothing. class_id: the least id that is reached by links; n_links: rows linked directly;
    kept: the class's least id. Repeated rows: rows of one id and text are one document (a row each, with the same values); an id
    with several texts is one document with the links of each. Null ids: no
    links, a class of their own (null), kept. No rows: no rows. Other columns aren't read.

    Rows of equal sets are one from the start and count by their number. The rest meet in bands of MinHash values, pairs are dropped when
    the posterior falls under TOLERANCE, and the others are joined to candidate components. Each component's texts are then fetched once
    (pairs of blocks where it is large), its pairs are pruned the same way and verified exactly; tasks return counts and a spanning
    forest, never pairs. The bands' misses apart, no link is lost.
    """
    signed = cut(documents_signed(docs, key, text, hashes))
    once = signed.where("set_key is not null and doc is not null")
    first = F.min(F.struct("doc", "body"))
    reps = once.groupBy("set_key").agg(first.alias("first"), F.countDistinct("doc").alias("mult"), F.first("sig").alias("sig"), F.first("n").alias("n"))
    reps = cut(reps.select("set_key", F.col("first.doc").alias("rep"), F.col("first.body").alias("body"), "mult", "sig", "n"))
    parts = cut(candidate_components(reps, threshold, hashes, rows, most))
    members = cut(parts.withColumnRenamed("id", "rep").join(reps, "rep"))
    sizes = members.groupBy("component").agg(F.greatest(F.count("*") / most, F.sum("n") / BLOCK_SHINGLES).alias("parts"))
    members = cut(members.join(sizes, "component"))
    # of rows that repeat an id and a text one text is fetched
    body = _bodies(docs, key, text).withColumnRenamed("doc", "rep")
    body = body.join(sent_if_small(members.select("rep", "body"), 100_000), ["rep", "body"], "left_semi").groupBy("rep", "body").agg(F.first("text").alias("text"))
    held = body.join(members.select("rep", "body", "component", "parts", "mult", "sig"), ["rep", "body"])
    dealt = blocks(held, F.col("parts"), "rep", "body").drop("body", "parts")

    def verify(g: dict) -> dict | None:
        rep, block, mult = np.asarray(g["rep"]), np.asarray(g["block"]), np.asarray(g["mult"])
        if len(rep) < 2:
            return None
        i, j = _pairs(rep, block, g["block_i"][0], g["block_j"][0], _signatures(g["sig"]), threshold)
        i, j = i[rep[i] != rep[j]], j[rep[i] != rep[j]]
        if not len(i):
            return None
        known = WordHashes()
        sets = [np.unique(shingles(word_hashes(t, known))) for t in g["text"]]
        size = np.array([len(s) for s in sets])
        shared = shared_shingles(sets, i, j)
        # integers on both sides: shared / (a + b - shared) >= threshold
        good = shared * (1 + threshold) >= threshold * (size[i] + size[j]) - 1e-9
        i, j = i[good], j[good]
        if not len(i):
            return None
        links = np.bincount(i, weights=mult[j], minlength=len(rep)) + np.bincount(j, weights=mult[i], minlength=len(rep))
        root = forest(len(rep), i, j)
        at = np.flatnonzero(links)
        return {"rep": rep[at].tolist(), "links": links[at].astype(np.int64).tolist(), "root": rep[root[at]].tolist()}

    linked = cut(map_groups(dealt, ["component", "block_i", "block_j"], verify, "rep long, links long, root long"))
    classes = components(linked.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    # a root of the forest need not be the component's least id, but components() finds that
    counts = linked.groupBy("rep").agg(F.sum("links").alias("links"))
    known = counts.join(classes, counts.rep == classes.id, "left").select("rep", "links", "component")
    facts = cut(reps.select("set_key", "rep", "mult").join(known, "rep", "left").where("mult > 1 or links is not null"))
    out = signed.select("doc", "set_key").join(sent_if_small(facts, 200_000), "set_key", "left")
    class_id = F.coalesce("component", "rep", "doc")
    return out.select(F.col("doc").alias(key), class_id.alias("class_id"), (F.coalesce("links", F.lit(0)) + F.coalesce("mult", F.lit(1)) - 1).cast("long").alias("n_links"), F.coalesce(F.col("doc") == class_id, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, threshold: float = 0.8, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with one document (the least id) of each class of ngram_join(), all columns as they are."""
    gone = cut(ngram_join(docs, threshold, key, text, **options).where("not kept").select(key).distinct())
    return docs.join(sent_if_small(gone), key, "left_anti").select(docs.columns)
