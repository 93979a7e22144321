"""Repeated runs of lines: winnowed line hashes as fingerprints, matches extended both ways, later runs deleted."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_rows

#: Words that a repeated run must have; each such run of whole lines is found.
RUN_WORDS = 12
#: A sentence of more words without an end mark is cut after words of least hash, one at least in each stretch of CUT_WITHIN words.
LONG_WORDS, CUT_WITHIN = 40, 12

#: Columns that dedup_lines() adds.
COUNTS = ["n_removed", "n_words_removed", "n_words_left", "n_words_once"]

_END = re.compile(r"[.!?]\s+|\n\s*")
_WORD = re.compile(r"\S+\s*")
_ODD_SPACE = re.compile(r"[^\S \n]")


def split_lines(text: str) -> list[tuple[int, int]]:
    """(start, end) of the lines of a text, which join to the whole of it.

    Lines end with a line break and, so that a passage within a line meets its copies elsewhere, with a sentence; long sentences are cut by
    _cuts(). Boundaries depend on nearby text alone.
    """
    out = []
    start = 0
    plain = _ODD_SPACE.search(text) is None
    for end in (*[m.end() for m in _END.finditer(text)], len(text)):
        if end > start:
            # without other white space a line has at most one word more than spaces
            if end - start > 2 * LONG_WORDS and not (plain and text.count(" ", start, end) < LONG_WORDS) and len(text[start:end].split()) > LONG_WORDS:
                for stop in _cuts(text, start, end):
                    if stop < end:
                        out.append((start, stop))
                        start = stop
            out.append((start, end))
            start = end
    return out


def _cuts(text: str, start: int, end: int) -> list[int]:
    """Ends of the words that have the least hash, the last of equal ones, of any CUT_WITHIN words in a row.

    Two sentences that share a passage of n words have the same cuts from its first CUT_WITHIN words to its last ones, and none there that
    only one has: all but CUT_WITHIN words at most on each side are whole lines in both. A word that stands before its like is no cut, so
    that a word repeated for pages is one line.
    """
    words = [(m.end(), xxhash.xxh32_intdigest(m.group().rstrip())) for m in _WORD.finditer(text, start, end)]
    n = len(words)
    h = np.fromiter((h for _, h in words), np.int64, n)
    h[:-1][h[:-1] == h[1:]] = 1 << 32
    key = h << 30 | np.arange(n - 1, -1, -1)
    least = key[: n - CUT_WITHIN + 1].copy()
    for s in range(1, CUT_WITHIN):
        np.minimum(least, key[s : n - CUT_WITHIN + 1 + s], out=least)
    least = least[least >> 30 < 1 << 32]
    return [words[i][0] for i in np.unique(n - 1 - (least & 0x3FFFFFFF)).tolist()]


def line_bodies(text: str, lines: list[tuple[int, int]]) -> list[str]:
    """The lines' words, parted by single spaces."""
    bodies = [text[a:b].strip() for a, b in lines]
    # all white space but the space counts as not printable, so few lines are split
    return [b if b.isprintable() and "  " not in b else " ".join(b.split()) for b in bodies]


def line_hashes(text: str, lines: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and numbers of words of the lines, whatever white space parts the words."""
    bodies = line_bodies(text, lines)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, bodies), np.uint64, len(bodies)).view(np.int64)
    return hashes, np.fromiter((b.count(" ") + 1 if b else 0 for b in bodies), np.int64, len(bodies))


def windows(words: np.ndarray, start: np.ndarray, stop: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) lines of the shortest stretches of at least `run` words that begin or end with each line of some texts, one after the
    other; start, stop: for each line the bounds of its text.

    Each line of a run of that many words lies in one of them that lies in the run: where the words up to the line are fewer, in the
    one from the run's first line on, else in the one that ends with the line.
    """
    total = np.cumsum(words)
    at = np.arange(len(words))
    to = np.searchsorted(total, total - words + run)
    since = np.searchsorted(total - words, total - run, "right") - 1
    begin, end = to < stop, since >= start
    spans = np.unique(np.r_[at[begin] << 32 | to[begin], since[end] << 32 | at[end]])
    return spans >> 32, spans & 0xFFFFFFFF


def winnow(hashes: np.ndarray, words: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The line that each window selects as its fingerprint: of least hash, if possible of 5 words or more, the last of equal ones.

    It depends on the window's lines alone, so two texts that share a window select the same line there.
    """
    key = (hashes.view(np.uint64) >> np.uint64(1)) | np.where(words < 5, np.uint64(1 << 63), np.uint64(0))
    best, live, at = first.copy(), np.arange(len(first)), first
    while True:
        at = at + 1
        go = at <= last[live]
        live, at = live[go], at[go]
        if not len(live):
            return best
        better = key[at] <= key[best[live]]
        best[live[better]] = at[better]


def window_hashes(hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of windows of lines: a polynomial of the lines' hashes modulo 2^64, from sums over all lines, moved to its first line by the
    base's inverse."""
    base = 0x9E3779B97F4A7C15
    power, inverse = (np.cumprod(np.r_[np.uint64(1), np.full(len(hashes), b, np.uint64)]) for b in (base, pow(base, -1, 1 << 64)))
    sums = np.r_[np.uint64(0), np.cumsum(hashes.view(np.uint64) * power[:-1])]
    h = (sums[last + 1] - sums[first]) * inverse[first] + (last - first).astype(np.uint64)
    for c in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(c)
    return (h ^ (h >> np.uint64(33))).view(np.int64)


def fingerprints(docs: DataFrame, run: int = RUN_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(f, doc, body, windows): a row for each fingerprint of a text, with the windows that select it.

    body: a hash of the text, which tells texts of one id apart; windows: (h, a, b), a hash of the window's lines, its first character and
    the one after its last. Of equal windows of one text the first alone is there; the lines of the others, which are repeats whatever
    other texts hold, are in a row without f as stretches without h.
    """

    def make():
        def work(part):
            texts = part.column("text").to_pylist()
            lines = [split_lines(t) for t in texts]
            found = [line_hashes(t, s) for t, s in zip(texts, lines) if s]
            if not found:
                return None
            sizes = np.fromiter(map(len, lines), np.int64, len(lines))
            hashes, words = (np.concatenate([f[i] for f in found]) for i in (0, 1))
            end = np.cumsum(sizes)
            start, stop = np.repeat(end - sizes, sizes), np.repeat(end, sizes)
            spans = np.array([x for s in lines for x in s], dtype=np.int32)
            row = np.repeat(np.arange(len(texts)), sizes)
            first, last = windows(words, start, stop, run)
            h = window_hashes(hashes, first, last)
            # windows come by place, so of equal ones of a text the first is the first
            order = np.lexsort((first, h, row[first]))
            again = np.zeros(len(first), dtype=bool)
            same = (h[order][1:] == h[order][:-1]) & (row[first[order]][1:] == row[first[order]][:-1])
            again[order[1:][same]] = True
            # a text's first line is in none of them, so none of the stretches reaches over two texts
            known = np.r_[0, np.cumsum(np.bincount(first[again], minlength=len(words) + 1) - np.bincount(last[again] + 1, minlength=len(words) + 1))] > 0
            change = np.flatnonzero(known[1:] != known[:-1])
            own_first, own_last = change[::2], change[1::2] - 1
            first, last, h = first[~again], last[~again], h[~again]
            f = hashes[winnow(hashes, words, first, last)]
            order = np.lexsort((f, row[first]))
            first, last, h, f = first[order], last[order], h[order], f[order]
            at, to = np.r_[first, own_first], np.r_[last, own_last]
            own = np.arange(len(at)) >= len(first)
            f, h = (np.r_[x, np.zeros(len(own_first), dtype=np.int64)] for x in (f, h))
            new = np.r_[True, (f[1:] != f[:-1]) | (row[at[1:]] != row[at[:-1]]) | (own[1:] != own[:-1])][: len(at)]
            offsets, head = np.r_[np.flatnonzero(new), len(at)].astype(np.int32), at[new]
            each = pa.StructArray.from_arrays([pa.array(h, pa.int64(), mask=own), pa.array(spans[at, 0]), pa.array(spans[to, 1])], ["h", "a", "b"])
            doc, body = (part.column(c).to_numpy(zero_copy_only=False)[row[head]] for c in ("doc", "body"))
            return {"f": pa.array(f[new], pa.int64(), mask=own[new]), "doc": doc, "body": body, "windows": pa.ListArray.from_arrays(offsets, each)}

        return work

    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc"), F.hash(body).alias("body"), body.alias("text"))
    return map_rows(rows, make, "f long, doc long, body int, windows array<struct<h: long, a: int, b: int>>")


def repeated_runs(docs: DataFrame, run: int = RUN_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, body, runs): stretches (first character << 32 | end) of text that equal earlier ones, by document. Earlier: of a lower id, or
    before in the text; the latter are bitwise inverted, so negative.

    Fingerprints are summed up by hash first, without their windows: a window can be repeated only where its fingerprint is, so most go no
    further. The places of those that repeat are extended to both sides as far as the window reaches: all that agree there meet under the
    window's own hash, the least id stays and the others are repeats. So each earlier place with equal lines counts, not just the first one
    of a common line. Longer runs are unions of windows.
    """
    found = cut(fingerprints(docs, run, key, text))
    shared = found.where("f is not null").groupBy("f").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").select("f")
    held = cut(found.join(shared, "f").select("doc", "body", F.inline("windows")))
    least = held.groupBy("h").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").select("h", "low")
    packed = F.col("a").cast("long") * (1 << 32) + F.col("b")
    later = held.join(least, "h").where("doc > low").select("doc", "body", packed.alias("run"))
    own = found.where("f is null").select("doc", "body", F.inline("windows")).select("doc", "body", F.bitwise_not(packed).alias("run"))
    return later.unionByName(own).groupBy("doc", "body").agg(F.collect_list("run").alias("runs"))  # of a document's own lines at most


def dedup_lines(docs: DataFrame, run: int = RUN_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with later copies of repeated runs deleted from the text, n_removed: how many runs, n_words_removed: their words, and where runs
    went n_words_left: words of the new text, n_words_once: words without the runs that stand before in the same text, else null (and
    n_chars, if there, of the new text).

    Lines are those of split_lines(): they end with line breaks, sentences, and within long sentences at words that their hashes pick. A run
    is deleted if its whole lines have at least `run` words and stand before, in the same text or in ones of a lower id; matches
    that touch are one run. The first copy of each line always stays, as what is deleted equals something earlier. White space around and within lines
    does not matter, case does.
    Null texts stay null, empty ones empty. Rows with a null id are left as they are. Rows of one id are one place: none is deleted for
    another of them. No rows: no rows. Columns of these four names are replaced.
    """
    old = docs.drop(*COUNTS)
    runs = repeated_runs(old, run, key, text)
    # the row in a struct, so that no name clashes; both sides are dealt out by id, at every size
    rows = old.select(F.struct(*old.columns).alias("row"))
    mine = (F.col(f"row.{key}") == F.col("doc")) & (F.hash(F.coalesce(F.col(f"row.{text}"), F.lit(""))) == F.col("body"))
    marked = rows.join(runs, mine, "left")
    # texts without a run aren't sent to Python
    marked = marked.withColumn("new", _rewrite()(F.when(F.col("runs").isNotNull(), F.col(f"row.{text}")), F.col("runs")))
    out = {c: F.col(f"row.{c}") for c in old.columns}
    out[text] = F.when(F.col("runs").isNull(), out[text]).otherwise(F.col("new.text"))
    if "n_chars" in out and text != "n_chars":
        out["n_chars"] = F.when(F.col("new.n_removed") > 0, F.length("new.text")).otherwise(out["n_chars"]).cast(old.schema["n_chars"].dataType)
    counts = [(F.coalesce(f"new.{c}", F.lit(0)) if c in COUNTS[:2] else F.col(f"new.{c}")).cast("long").alias(c) for c in COUNTS]
    return marked.select(*[c.alias(n) for n, c in out.items()], *counts)


def without_repeats(docs: DataFrame, run: int = RUN_WORDS, least_left: float = 0.0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with later copies of runs deleted; documents of which others hold so much that they keep no more than the share least_left of
    the words that stand in them once go: by default those of which nothing is left. Columns as they are, but for text and n_chars; odd
    rows as in dedup_lines()."""
    extra = {c: f"{c}_as_given_" for c in COUNTS if c in docs.columns}
    out = dedup_lines(docs.withColumnsRenamed(extra), run, key, text)
    kept = out.where((F.col("n_removed") == 0) | (F.col("n_words_left") > least_left * F.col("n_words_once")))
    return kept.drop(*COUNTS).withColumnsRenamed({b: a for a, b in extra.items()}).select(docs.columns)


def _rewrite():
    @F.pandas_udf("text string, n_removed long, n_words_removed long, n_words_left long, n_words_once long")
    def rewrite(texts: pd.Series, runs: pd.Series) -> pd.DataFrame:
        out = [(t, 0, 0, None, None) if t is None or r is None else _without(t, r) for t, r in zip(texts, runs)]
        return pd.DataFrame(out, columns=["text", *COUNTS]).astype({c: "Int64" for c in COUNTS})

    # evaluated once, wherever the optimizer moves what reads it
    return rewrite.asNondeterministic()


def _without(text: str, runs) -> tuple[str, int, int, int, int]:
    runs = np.array(runs, dtype=np.int64)
    own = runs < 0
    runs[own] = ~runs[own]
    kept, n = _cut_out(text, runs)
    words, left = len(text.split()), len(kept.split())
    once = len(_cut_out(text, runs[own])[0].split()) if own.any() else words
    return kept, n, words - left, left, once


def _cut_out(text: str, runs: np.ndarray) -> tuple[str, int]:
    """The text without the runs, and how many they are; those that touch or overlap are one."""
    kept, at, n, stop = [], 0, 0, -1
    for run in np.unique(runs).tolist():
        a, b = run >> 32, run & 0xFFFFFFFF
        if a > stop:
            kept.append(text[at:a])
            n += 1
        at = stop = max(stop, b)
    kept.append(text[at:])
    return "".join(kept), n
