"""Transitions of a growing corpus and answers to a stream of prompts (an addition of our own; both are Structured Streaming)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from ..functions.text import WordTokenizer
from ..operators.ngrams import count_transitions, from_columns, to_columns, weigh
from ..plans.model import Model
from ..sources.corpora import tokenised


class TransitionStream:
    """Base transitions of documents that arrive: counts are additive, and a digest of each text's tokens keeps copies from counting.

    Each batch writes its new digests and its counts to folders of its number, so that a batch that is run again replaces its own files.
    """

    def __init__(self, path: str, tokenizer: WordTokenizer, n_from: int = 2, n_to: int = 1):
        self.path, self.tokenizer, self.n_from, self.n_to = path.rstrip("/"), tokenizer, n_from, n_to

    def _read(self, spark: SparkSession, name: str) -> DataFrame | None:
        try:
            return spark.read.parquet(f"{self.path}/{name}")
        except AnalysisException:  # nothing there yet
            return None

    def add(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        tokens = tokenised(batch, self.tokenizer).withColumn("digest", F.sha2(F.to_json(F.struct("tokens")).cast("binary"), 256))
        fresh = tokens.dropDuplicates(["digest"])
        before = self._read(spark, "digests")
        if before is not None:
            fresh = fresh.join(before.where(F.col("batch") != number).select("digest"), "digest", "left_anti")
        # the batch's documents before its digests: a failure between the two leads to a rerun of both
        count_transitions(fresh, self.n_from, self.n_to).write.mode("overwrite").parquet(f"{self.path}/counts/batch={number}")
        fresh.select("digest").write.mode("overwrite").parquet(f"{self.path}/digests/batch={number}")

    def start(self, documents: DataFrame, checkpoint: str, available_now: bool = False) -> StreamingQuery:
        """documents: a stream of (doc_id, text)."""
        writer = documents.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()

    def transitions(self, spark: SparkSession) -> DataFrame:
        """f0.., t0.., count, weight of all batches so far."""
        counts = self._read(spark, "counts")
        by = from_columns(self.n_from) + to_columns(self.n_to)
        return weigh(counts.groupBy(*by).agg(F.sum("count").alias("count")))


def answer_stream(prompts: DataFrame, model: Model, sink: Callable[[DataFrame, int], None], steps: int, checkpoint: str, seed: int | None = 0, available_now: bool = False) -> StreamingQuery:
    """Generates text for a stream of prompts (query_id, text), batch by batch; sink gets (query_id, words, done) and the batch's number."""

    def answer(batch: DataFrame, number: int) -> None:
        sink(model.generate(batch, steps, seed)[0], number)

    writer = prompts.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
