"""Documents from text files and from tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import WordTokenizer, split_documents, trim_unicode
from .recipe import Recipe


def read_files(spark: SparkSession, recipe: Recipe) -> DataFrame:
    """(doc_id, text) of the recipe's files, split at their delimiters, in the order of files and places; empty documents are kept.

    A file is read by records that its delimiter ends, so that a large one is many tasks and no task holds more than a document. Bytes that
    are not UTF-8 raise. doc_id: the file's number by 2^40, and the document's place."""
    parts, n = [], 0
    for f in recipe.files:
        for path, size in _files(spark, f.path):
            parts.append(_records(spark, path, size, f.delimiter).select((F.lit(n).cast("bigint") * (1 << 40) + F.col("place")).alias("doc_id"), "text"))
            n += 1
    if not parts:
        return spark.createDataFrame([], "doc_id bigint, text string")
    return reduce(DataFrame.unionByName, parts)


def _files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Files of a path, pattern or folder, by name, with their sizes. One that isn't there raises."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(at)
    if not found:
        raise FileNotFoundError(path)
    found = [x for s in found for x in (fs.listStatus(s.getPath()) if s.isDirectory() else [s])]
    files = [(s.getPath().toString(), s.getLen()) for s in found if s.isFile() and s.getPath().getName()[0] not in "._"]
    return sorted(files)


def _records(spark: SparkSession, path: str, size: int, delimiter: str) -> DataFrame:
    """(place, text) of a file. Each block's records stand together in one task, so a record's place is its block's first and its own there."""
    if not delimiter:
        raise ValueError("empty delimiter")
    own = F.validate_utf8(F.col("value"))
    raw = spark.read.option("lineSep", delimiter).text(path).select(own.alias("text"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("o"))
    blocks = raw.groupBy("block").agg(F.count("*").alias("n"), F.min("o").alias("o_1"), F.sum(F.octet_length("text")).alias("bytes"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    firsts = blocks.select("block", "o_1", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    docs = raw.join(F.broadcast(firsts), "block").select((F.col("first") + F.col("o") - F.col("o_1")).alias("place"), trim_unicode(F.col("text")).alias("text"))
    # a delimiter at the end, or nothing at all, leaves one more document, an empty one
    whole = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("place"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
    last = whole.where(F.col("bytes") + F.col("place") * len(delimiter.encode()) == size).select("place", F.lit("").alias("text"))
    return docs.unionByName(last)


def spread(scan: DataFrame) -> DataFrame:
    """A scan's rows dealt over all cores, if it has fewer tasks than two for each: small tables come in few files and row groups.

    Larger scans stay as they are, without a shuffle. scan: a plain read; counting its tasks runs nothing.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan._jdf.queryExecution().toRdd().getNumPartitions() < 2 * cores else scan


def tokenised(docs: DataFrame, tokenizer: WordTokenizer, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, tokens): start, words, stop. A null text is an empty document."""
    return docs.select(key, tokenizer.tokens(F.coalesce(F.col(text), F.lit(""))).alias("tokens"))


def dialogues(conversations: DataFrame) -> DataFrame:
    """(doc_id, text): each conversation's turns in order, each after a tag of its role."""
    turn = F.struct("turn", F.concat(F.lit("<|"), "role", F.lit("|> "), "text").alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(turn)), lambda x: x["line"])
    return conversations.groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(lines, "\n").alias("text"))


def event_sequences(events: DataFrame) -> DataFrame:
    """(doc_id, text): each user's event types in order of time and id."""
    kinds = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"])
    return events.groupBy(F.col("user_id").alias("doc_id")).agg(F.array_join(kinds, " ").alias("text"))


def joined_corpus(docs: DataFrame, delimiter: str, group: Column, key: str = "doc_id") -> DataFrame:
    """(group, text): texts of a group joined by a delimiter, the inverse of splitting. A group is one row, so groups have to be small."""
    return docs.groupBy(group.alias("group")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, "text"))), lambda x: x["text"]), delimiter).alias("text"))


def split_corpus(files: DataFrame, delimiter: str) -> DataFrame:
    """(group, place, text): the documents of each file."""
    return files.select("group", F.posexplode(split_documents(F.col("text"), delimiter)).alias("place", "text"))


def prompt_lines(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, text): the trimmed lines of a text file, numbered in order: a part's first number, and the place in the part."""
    lines = spark.read.text(path).select(trim_unicode(F.col("value")).alias("text"), F.monotonically_increasing_id().alias("o"))
    lines = lines.select("text", F.shiftright("o", 33).alias("part"), F.col("o").bitwiseAND((1 << 33) - 1).alias("at"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task of the scan
    firsts = lines.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return lines.join(F.broadcast(firsts), "part").select((F.col("first") + F.col("at")).cast("bigint").alias("query_id"), "text")
