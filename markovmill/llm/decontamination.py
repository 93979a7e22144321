"""Test items within documents: size-partitioned MinHash containment search, verified by exact shingle containment."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_rows, sent_if_small
from .shingles import WordHashes, hash_rows, shingles, word_hashes

#: Hash functions; a window is a candidate where one of them has the item's least value (bands of one row).
HASHES = 56
#: Items are dealt by size to partitions whose upper bounds stand in this ratio.
RATIO = 2.0
#: Different items, and characters of their texts, that a worker's table holds; more are searched in rounds of about so many, each a scan.
ITEMS_AT_ONCE, CHARACTERS_AT_ONCE = 50_000, 32 << 20
#: The filter in front of the table of least values, in bits.
FILTER_BITS = 22


@dataclass(frozen=True)
class _Partition:
    upper: int  # shingles of the largest item
    windows: int  # shingles that a document's window steps by; a window is three steps
    keys: np.ndarray  # sorted: hash function and least value
    items: np.ndarray  # index of the item by key
    filter: np.ndarray


def _index(sets: list[np.ndarray], hashes: int) -> list[_Partition]:
    sizes = np.array([len(s) for s in sets])
    out, upper = [], 1
    done = 0
    while done < len(sets):
        mine = np.flatnonzero((sizes <= upper) & (sizes > upper / RATIO))
        if len(mine):
            least = np.array([hash_rows(sets[i], hashes).min(axis=1) for i in mine], dtype=np.uint64)
            keys = (np.arange(hashes, dtype=np.uint64)[None, :] << np.uint64(32) | least).ravel()
            items = np.repeat(mine, hashes)
            order = np.argsort(keys, kind="stable")
            bits = np.zeros(1 << FILTER_BITS, dtype=bool)
            bits[_slot(keys)] = True
            out.append(_Partition(int(upper), int(upper), keys[order], items[order], bits))
            done += len(mine)
        upper = int(upper * RATIO)
    return out


def _slot(keys: np.ndarray) -> np.ndarray:
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _candidates(x: np.ndarray, index: list[_Partition], hashes: int, step: int = 8192) -> set[int]:
    """Items that share a least value with a window of the document's shingles x.

    A window of a partition is three steps of its upper bound and starts at each step, so that a passage of up to twice the largest
    item's size lies whole in one. With containment 0.8 the Jaccard similarity of item and window is then over 0.8 q / (3 u + 0.2 q) >
    0.12 for sizes q from u / 2 to u, and 56 functions miss it with a probability under 0.0005, 0.00004 where it is there unchanged.
    """
    found: set[int] = set()
    widest = max(p.windows for p in index)  # each partition's step divides it
    span = max(step // widest, 3) * widest
    for at in range(0, len(x), span):
        # a stretch of whole steps, and two steps of the next stretch for the windows across
        stretch = hash_rows(x[at : at + span + 2 * widest], hashes)
        for p in index:
            v = stretch[:, : span + 2 * p.windows]
            least = np.minimum.reduceat(v, np.arange(0, v.shape[1], p.windows), axis=1)
            windows = least.copy()
            for s in (1, 2):
                windows[:, : least.shape[1] - s] = np.minimum(windows[:, : least.shape[1] - s], least[:, s:])
            keys = (np.arange(hashes, dtype=np.uint64)[:, None] << np.uint64(32) | windows).ravel()
            keys = np.unique(keys[p.filter[_slot(keys)]])
            if len(keys):
                a, b = np.searchsorted(p.keys, keys, "left"), np.searchsorted(p.keys, keys, "right")
                for i, j in zip(a.tolist(), b.tolist()):
                    found.update(p.items[i:j].tolist())
    return found


def find_contamination(docs: DataFrame, items: DataFrame, least: float = 0.8, hashes: int = HASHES, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item, n_item_shingles, n_shared, containment) for each document and item with containment >= least.

    Containment: the share of the item's distinct shingles of five words (lower case, punctuation aside) that the whole document holds
    anywhere. Items without words are never found; items and documents of fewer than five words have one shingle of them all. Null texts
    are empty. Repeated items and documents: each pair of rows. Other columns aren't read. No rows on either side: no rows.

    Items go to the workers by bounded rounds, each a scan, whatever their number and sizes (a single item may be longer); documents aren't
    shuffled.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be over 0, at most 1")
    tests = items.select(F.col(item).cast("long").alias("item"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    tests = cut(tests.groupBy("item", "text").agg(F.count("*").alias("mult")))
    total, size = tests.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    rounds = max(-(-total // ITEMS_AT_ONCE), -(-size // CHARACTERS_AT_ONCE), 1)
    groups = [tests.where(F.pmod(F.xxhash64("item", "text"), F.lit(rounds)) == r) for r in range(rounds)]
    rows = docs.select(F.col(key).alias("key_"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["key_"].dataType.simpleString().replace("bigint", "long")
    out = None
    for group in groups:
        known = WordHashes()
        held = [(r.item, np.unique(shingles(word_hashes(r.text, known))), r.mult) for r in group.collect()]  # about as many as the bounds say
        held = [x for x in held if len(x[1])]
        found = map_rows(rows, _searcher(held, least, hashes), f"key_ {kind}, item long, n_item_shingles long, n_shared long, containment double, mult long")
        out = found if out is None else out.unionByName(found)
    # a row for each of the item's rows
    out = out.withColumn("copy_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mult"))))
    return out.select(F.col("key_").alias(key), F.col("item").alias(item), "n_item_shingles", "n_shared", "containment")


def _searcher(held: list[tuple[int, np.ndarray, int]], least: float, hashes: int):
    def make():
        known = WordHashes()
        index = _index([s for _, s, _ in held], hashes)

        def run(part):
            out: dict[str, list] = {n: [] for n in ("key_", "item", "n_item_shingles", "n_shared", "containment", "mult")}
            for k, t in zip(part.column("key_").to_pylist(), part.column("text").to_pylist()):
                x = shingles(word_hashes(t, known))
                if not len(x) or not index:
                    continue
                own = None
                for i in sorted(_candidates(x, index, hashes)):
                    own = np.unique(x) if own is None else own
                    ident, s, mult = held[i]
                    at = np.searchsorted(own, s)
                    shared = int((own[np.minimum(at, len(own) - 1)] == s).sum())
                    if shared >= least * len(s):
                        for n, v in zip(out, (k, ident, len(s), shared, shared / len(s), mult)):
                            out[n].append(v)
            return out

        return run

    return make


def without_contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """docs without those that hold an item, all columns as they are; rows with a null id stay."""
    ids = cut(find_contamination(docs, items, key=key, **options).select(key).distinct())
    return docs.join(sent_if_small(ids), key, "left_anti").select(docs.columns)
