"""A corpus pipeline of five stages: toxicity, line dedup, n-gram Jaccard join, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the columns of documents.
Between stages the rows are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from markovmill.llm.common import cut
from markovmill.llm.decontamination import without_contaminated
from markovmill.llm.line_dedup import without_repeats
from markovmill.llm.ngram_join import one_of_each
from markovmill.llm.packing import pack_documents
from markovmill.llm.toxicity import fit_toxicity, without_toxic


#: Documents that others' runs leave no more than this share of the words that stand in them once are near copies of earlier text, and go.
LEAST_LEFT = 0.2


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are scored as toxic. Null and empty texts have no evidence and stay; repeated rows are scored alike; null and
    repeated ids and other columns don't matter. No rows: no rows; labels without documents: a model without evidence, which keeps all
    unless most labels are toxic."""
    return without_toxic(docs, fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of repeated runs of lines, and documents of which earlier ones hold all but LEAST_LEFT: what near copies keep
    are stray lines, by which the next stage could not know them. Repeats within a document alone don't make it go. Null and empty texts and rows with a null id stay as they are;
    rows of one id are one place, and none loses text for another; of equal texts the least id's stays. Columns whose names the operator
    uses stay as they are. No rows: no rows."""
    return without_repeats(docs, least_left=LEAST_LEFT)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the least id, of each class of near duplicates. Null and empty texts and rows with a null id are classes
    of their own and stay; rows of the kept id all stay. Other columns don't matter. No rows: no rows."""
    return one_of_each(docs, threshold=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, with all rows of their ids. Null and empty texts hold none; rows with a null id stay;
    items without words are in no document. Other columns don't matter. No rows: no rows; no items: all rows."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 1024 tokens, a row for each piece. Null and empty texts are the end token alone; repeated rows
    and null ids have pieces each. Other columns aren't read. No rows: no rows."""
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("ngram_join", ngram_join), ("decontamination", decontamination), ("packing", packing)]

#: Scores, token ids and winnowing have no SQL; tests hold each stage and run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
