"""Models: built from a recipe, kept as Parquet tables, summed up and changed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import START, STOP, WordTokenizer
from ..operators import experts as X
from ..operators.generate import Limits, generate, prepare_prompts
from ..operators.ngrams import base_transitions, transitions_bytes
from ..operators.predict import Chains
from ..operators.vocabulary import build_vocabulary, vocabulary_size
from ..sources.corpora import read_files, tokenised
from ..sources.recipe import Recipe
from .lineage import cut, release

TABLES = ("metadata", "vocabulary", "transitions", "expert_transitions", "ranks")
# Metadata keys
NAME, TOKENIZER = "model.name", "model.tokens.tokenizer"
FROM_DEPTH, TO_DEPTH = "model.tokens.from_depth", "model.tokens.to_depth"
START_TOKEN, STOP_TOKEN = "model.tokens.start_token", "model.tokens.stop_token"
EXPERTS_TOTAL, EXPERTS_ACTIVE, EXPERTS_CENTROIDS = "model.experts.total", "model.experts.active", "model.experts.centroids"
TEMPLATE, STOPS, TOP_K, MAX_TOKENS = "model.inference.template", "model.inference.stop_tokens[{}]", "model.inference.top_k", "model.inference.max_tokens"


def metadata(recipe: Recipe, experts: int) -> dict[str, str]:
    """The recipe's keys, and defaults for those that it does not set. experts: as built; centroids: as the recipe has them."""
    defaults = {NAME: recipe.name, TOKENIZER: str(recipe.tokenizer), FROM_DEPTH: recipe.from_depth, TO_DEPTH: recipe.to_depth, START_TOKEN: START, STOP_TOKEN: STOP}
    defaults |= {EXPERTS_TOTAL: experts, EXPERTS_ACTIVE: recipe.active_experts, EXPERTS_CENTROIDS: recipe.centroids, TEMPLATE: recipe.template}
    defaults |= {STOPS.format(i): t for i, t in enumerate(recipe.stop_tokens)} | {TOP_K: 10, MAX_TOKENS: 200}
    return {k: str(v) for k, v in defaults.items()} | recipe.keys


@dataclass(frozen=True)
class Model:
    spark: SparkSession
    keys: dict[str, str]
    vocabulary: DataFrame
    transitions: DataFrame
    expert_transitions: DataFrame
    ranks: DataFrame

    @staticmethod
    def build(spark: SparkSession, recipe: Recipe, docs: DataFrame | None = None, seed: int = 0, strict: bool = False, by_similarity: bool = False) -> Model:
        """From docs (doc_id, text), or the recipe's files. Tokens are written once and read by each table's plan.

        An expert without documents has no transitions; strict: it raises. by_similarity: seeds of later experts are drawn by their
        distance from those before, rather than evenly.
        """
        n_from, n_to = recipe.from_depth, recipe.to_depth
        tokens = cut(tokenised(docs if docs is not None else read_files(spark, recipe), recipe.tokenizer))
        total, centroids = X.cluster_numbers(tokens.count(), recipe.total_experts, recipe.centroids)
        tf = X.term_frequency(tokens)
        pick = X.seeds_by_similarity if by_similarity else X.pick_seeds
        ranks = cut(X.cluster_ranks(tokens, cut(pick(tokens, total, centroids, seed)), tf))
        assigned = X.assign_documents(tokens, X.similarity(tokens, ranks), total)
        own = cut(X.expert_transitions(tokens, assigned, n_from, n_to))
        if strict and own.select("expert").distinct().count() < total:
            raise ValueError("an expert has no transitions")
        return Model(spark, metadata(recipe, total), cut(build_vocabulary(tokens)), cut(base_transitions(tokens, n_from, n_to)), own, ranks)

    def metadata(self) -> DataFrame:
        return self.spark.createDataFrame(sorted(self.keys.items()), "key string, value string")

    def save(self, path: str) -> None:
        """Transitions are sorted by context within files, so that a lookup reads few row groups; experts are partitions."""
        self.metadata().coalesce(1).write.mode("overwrite").parquet(f"{path}/metadata")
        self.vocabulary.sortWithinPartitions("word").write.mode("overwrite").parquet(f"{path}/vocabulary")
        by = [c for c in self.transitions.columns if c[0] in "ft"]
        self.transitions.repartition(*by[:1]).sortWithinPartitions(*by).write.mode("overwrite").parquet(f"{path}/transitions")
        # the context joins the expert as key, so that a large expert is written by many tasks
        self.expert_transitions.repartition("expert", by[0]).sortWithinPartitions("expert", *by).write.mode("overwrite").partitionBy("expert").parquet(f"{path}/expert_transitions")
        self.ranks.write.mode("overwrite").parquet(f"{path}/ranks")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Model:
        t = {n: spark.read.parquet(f"{path}/{n}") for n in ("metadata", "vocabulary", "transitions", "ranks")}
        keys = {r.key: r.value for r in t["metadata"].collect()}
        names = t["transitions"].columns
        schema = "expert int, " + ", ".join(f"{c} {t['transitions'].schema[c].dataType.simpleString()}" for c in names)
        own = spark.read.schema(schema).parquet(f"{path}/expert_transitions").select("expert", *names)
        return Model(spark, keys, t["vocabulary"], t["transitions"], own, t["ranks"])

    @staticmethod
    def set_key(spark: SparkSession, path: str, key: str, value: str) -> None:
        rows = {r.key: r.value for r in spark.read.parquet(f"{path}/metadata").collect()} | {key: value}
        spark.createDataFrame(sorted(rows.items()), "key string, value string").coalesce(1).write.mode("overwrite").parquet(f"{path}/metadata")

    @property
    def tokenizer(self) -> WordTokenizer:
        return WordTokenizer.parse(self.keys[TOKENIZER])

    @property
    def depths(self) -> tuple[int, int]:
        return int(self.keys[FROM_DEPTH]), int(self.keys[TO_DEPTH])

    def chains(self) -> Chains:
        return Chains(self.transitions, self.expert_transitions, self.ranks, *self.depths, int(self.keys[EXPERTS_TOTAL]))

    def limits(self) -> Limits:
        """Stops: the model's list, up to the first number that is missing, and its start and stop tokens; without a stop token the start
        token stands for it."""
        stops, i = [], 0
        while STOPS.format(i) in self.keys:
            stops.append(self.keys[STOPS.format(i)])
            i += 1
        start = self.keys.get(START_TOKEN, START)
        stops += [start, self.keys.get(STOP_TOKEN, START)]
        return Limits(int(self.keys.get(EXPERTS_ACTIVE, 0)), int(self.keys.get(TOP_K, 10)), int(self.keys.get(MAX_TOKENS, 200)), tuple(stops))

    def generate(self, prompts: DataFrame, steps: int | None = None, seed: int | None = 0) -> tuple[DataFrame, DataFrame]:
        """(query_id, words, done) and (query_id, expert, uses, frequency) for prompts (query_id, text)."""
        limits = self.limits()
        start, stop = self.keys.get(START_TOKEN, START), self.keys.get(STOP_TOKEN, START)
        ready = cut(prepare_prompts(prompts, self.vocabulary, self.tokenizer, self.keys.get(TEMPLATE, "{{content}}"), start, stop))
        found = generate(ready, self.chains(), limits, limits.max_tokens if steps is None else steps, seed)
        release(ready)
        return found

    def summary(self) -> DataFrame:
        """(part, expert, items, bytes): vocabulary, base and each expert's transitions, and the sum of bytes."""
        return model_summary(self.vocabulary, self.transitions, self.expert_transitions, *self.depths)


def model_summary(vocab: DataFrame, base: DataFrame, own: DataFrame, n_from: int, n_to: int) -> DataFrame:
    none = F.lit(None).cast("int").alias("expert")
    items = base.agg(F.count("*").alias("items")).select(none, "items")
    return summed_up(vocab, items.unionByName(own.groupBy("expert").agg(F.count("*").alias("items"))), n_from, n_to)


def summed_up(vocab: DataFrame, items: DataFrame, n_from: int, n_to: int) -> DataFrame:
    """items: (expert, items), the number of transitions, the base chain's at null."""
    none = F.lit(None).cast("int")
    part = F.when(F.col("expert").isNull(), "base").otherwise("expert").alias("part")
    rows = vocabulary_size(vocab).select(F.lit("vocabulary").alias("part"), none.alias("expert"), F.col("words").alias("items"), "bytes")
    rows = rows.unionByName(items.select(part, "expert", "items", (F.col("items") * transitions_bytes(n_from, n_to) + 2).alias("bytes")))
    rows = cut(rows)  # a few, read twice
    total = rows.agg(F.sum("items").alias("items"), F.sum("bytes").alias("bytes"))
    return rows.unionByName(total.select(F.lit("total").alias("part"), none.alias("expert"), "items", "bytes"))
