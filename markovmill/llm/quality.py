"""Quality by compression: how much better a dictionary of good text compresses a document than one of bad text."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, held_out, map_rows, sent_if_small
from .labelled import labelled_sample, logistic

LEVEL = 3
#: Bytes that are added to a text's size, so that a few bytes more or less don't decide on short texts.
EVEN = 200


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    a: float
    b: float


def _differences(good: bytes, bad: bytes):
    import zstandard

    by = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d) if d else None) for d in (good, bad)]

    def one(text: str) -> float:
        raw = text.encode()
        return (len(by[1].compress(raw)) - len(by[0].compress(raw))) / (len(raw) + EVEN)

    return one


def _dictionary(segments: list[bytes], size: int) -> bytes:
    """A trained dictionary; of too little text, the text itself."""
    import zstandard

    total = sum(map(len, segments))
    if len(segments) < 20 or total < 20_000:
        return b"".join(segments)[:size]
    try:
        return zstandard.train_dictionary(min(size, total // 4), segments).as_bytes()
    except zstandard.ZstdError:
        return b"".join(segments)[:size]


def fit_quality(docs: DataFrame, labels: DataFrame, parts: int = 4, rest: int = 2, most: int = 12_000, segments: int = 4_000, segment_size: int = 2_048, dictionary_bytes: int = 112_640, key: str = "doc_id", text: str = "text") -> QualityModel:
    """Learns from at most `most` labelled documents outside the held-out fold.

    Three folds of the sample give the dictionaries: lines that several sampled documents hold are left out, as both classes have them,
    longer ones than segment_size characters are cut, and what stands together up to about that size is a segment. Up to `segments` of each
    class, those of least hash from all over the texts, come to the driver, which is a bounded sample too. The fourth fold gives the
    calibration. No labels, or of one class: the smoothed share of good ones.
    """
    sample = labelled_sample(docs, labels, "quality", parts, rest, most, key, text)
    dictionary_part = sample.where("fold <> 3")
    lines = dictionary_part.select("y", "key_", F.posexplode(F.split("text", "\n")).alias("at", "line")).where("line <> ''").withColumn("h", F.xxhash64("line"))
    common = cut(lines.groupBy("h").agg(F.min("key_").alias("a"), F.max("key_").alias("b")).where("a <> b").select("h"))
    own = lines.join(sent_if_small(common), "h", "left_anti")
    parts_of = F.transform(F.sequence(F.lit(0), F.floor((F.length("line") - 1) / segment_size).cast("int")), lambda i: F.substring("line", i * segment_size + 1, F.lit(segment_size)))
    own = own.select("y", "key_", "at", F.posexplode(parts_of).alias("part", "line"))
    # a segment is a run of lines or parts of one, by document
    size = F.sum(F.length("line") + 1).over(_by_line())
    cut_up = own.withColumn("segment", F.floor((size - 1) / segment_size)).groupBy("y", "key_", "segment")
    texts = cut_up.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "part", "line"))), lambda x: x["line"]), "\n").alias("body"))
    texts = texts.select("y", F.xxhash64("key_", "segment").alias("o"), F.encode("body", "UTF-8").alias("body"))
    picked = [[bytes(r.body) for r in texts.where(F.col("y") == y).orderBy("o", "body").limit(segments).collect()] for y in (0, 1)]
    bad, good = (_dictionary([x for x in p if x], dictionary_bytes) for p in picked)

    def make():
        one = _differences(good, bad)

        def run(part):
            return {"x": [one(t) for t in part.column("text").to_pylist()], "y": part.column("y").to_pylist()}

        return run

    rows = map_rows(sample.where("fold = 3"), make, "x double, y int").collect()  # at most `most` pairs of numbers
    x, y = np.array([r.x for r in rows]), np.array([float(r.y) for r in rows])
    c = Counter(y.tolist())
    prior = labels.where(F.col("quality").isNotNull() & ~held_out(F.col(key), parts, rest)).agg(F.avg(F.col("quality").cast("double"))).first()[0] or 0.5
    # the sample is dealt by class: weights restore the shares of the labels
    weight = np.array([(prior if v else 1 - prior) * len(y) / c[v] for v in y])
    a, b = logistic(x, y, weight)
    return QualityModel(good, bad, a, b)


def _by_line():
    from pyspark.sql import Window

    return Window.partitionBy("y", "key_").orderBy("at", "part").rowsBetween(Window.unboundedPreceding, 0)


def score_quality(docs: DataFrame, model: QualityModel, parts: int = 4, rest: int = 2, threshold: float = 0.7, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, score, predicted, difference) for each row.

    difference: bytes that the bad dictionary needs over the good one, by the text's size plus EVEN; score: the calibrated probability of
    label 1; predicted: 1 from the threshold on. Null and empty texts are compressed like any text, to a difference of about 0. Repeated
    rows: a row each. No rows: no rows. Texts are compressed whole; other columns aren't read. One scan, no shuffle.
    """
    rows = docs.select(F.col(key).alias("key_"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def make():
        one = _differences(model.good, model.bad)

        def run(part):
            x = [one(t) for t in part.column("text").to_pylist()]
            score = (1 / (1 + np.exp(-np.clip(model.a + model.b * np.array(x), -500, 500)))).tolist()
            return {"key_": part.column("key_").to_pylist(), "score": score, "predicted": [int(s >= threshold) for s in score], "difference": x}

        return run

    kind = rows.schema["key_"].dataType.simpleString().replace("bigint", "long")
    out = map_rows(rows, make, f"key_ {kind}, score double, predicted int, difference double")
    return out.select(F.col("key_").alias(key), F.coalesce(held_out(F.col("key_"), parts, rest), F.lit(False)).alias("held_out"), "score", "predicted", "difference")
