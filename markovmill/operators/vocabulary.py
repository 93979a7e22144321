"""Vocabulary: distinct words with dense ids in binary word order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .experts import numbered

TOKEN_BYTES = 3
MOST_WORDS = 1 << (8 * TOKEN_BYTES)
MOST_WORD_BYTES = 65_535


def build_vocabulary(docs: DataFrame, strict: bool = True) -> DataFrame:
    """(token int, word) of docs (tokens array). Words over 65,535 bytes and more than 2^24 words raise when rows are made, if strict.

    Ids are ranks by the words' bytes. Words are dealt out by ranges of about equal size, whatever their first letters; the ranges' counts
    give each its offset, so that no task ranks more than a range.
    """
    words = docs.select(F.explode_outer("tokens").alias("word")).where("word is not null").distinct()
    if strict:
        words = words.where(F.when(F.octet_length("word") > MOST_WORD_BYTES, F.raise_error(F.lit("word of over 65535 bytes")).cast("boolean")).otherwise(True))
    ranges = cut(words.repartitionByRange("word").withColumn("part", F.spark_partition_id()))
    out = numbered(ranges, "part", "word").select(F.col("place").alias("token"), "word")
    if strict:
        out = out.withColumn("token", F.when(F.col("token") >= MOST_WORDS, F.raise_error(F.lit("over 2^24 words")).cast("bigint")).otherwise(F.col("token")))
    return out.select(F.col("token").cast("int").alias("token"), "word")


def vocabulary_size(vocab: DataFrame) -> DataFrame:
    """(words, bytes): a record takes its id, two bytes of length and the word."""
    return vocab.agg(F.count("*").alias("words"), F.coalesce(F.sum(F.octet_length("word").cast("long") + TOKEN_BYTES + 2), F.lit(0)).alias("bytes"))


def encode(rows: DataFrame, vocab: DataFrame, key: str, words: str = "words") -> DataFrame:
    """(key, ids, words): each row's words that the vocabulary has, in order; unknown ones are dropped. Rows without any have empty arrays."""
    at = rows.select(key, F.posexplode_outer(words).alias("pos", "word")).join(vocab, "word")
    known = at.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "token", "word"))).alias("x"))
    out = rows.select(key).join(known, key, "left")
    return out.select(key, F.coalesce(F.col("x.token"), F.array().cast("array<int>")).alias("ids"), F.coalesce(F.col("x.word"), F.array().cast("array<string>")).alias("words"))


def decode_ids(rows: DataFrame, vocab: DataFrame, key: str, ids: str = "ids") -> DataFrame:
    """(key, words): the words of ids; ids that the vocabulary lacks are dropped."""
    at = rows.select(key, F.posexplode(ids).alias("pos", "token")).join(vocab, "token")
    known = at.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("x"))
    return rows.select(key).join(known, key, "left").select(key, F.coalesce(F.col("x.word"), F.array().cast("array<string>")).alias("words"))


def word_ids() -> Column:
    """An aggregate: the whole vocabulary as a map from words to ids (small vocabularies)."""
    return F.map_from_entries(F.collect_list(F.struct("word", "token")))


def id_words() -> Column:
    """An aggregate: the whole vocabulary as a map from ids to words (small vocabularies)."""
    return F.map_from_entries(F.collect_list(F.struct("token", "word")))
