"""python -m markovmill.cli COMMAND ..."""

from __future__ import annotations

import argparse
import os
import sys
from itertools import batched
from typing import IO

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators.lookup import find_transitions
from .operators.ngrams import to_columns
from .operators.vocabulary import encode
from .plans.model import Model
from .service import Service, generate_all
from .sources import exports
from .sources.recipe import Recipe, parse_recipe

RECIPE_FILE = "recipe.txt"
#: Prompts of a file or pipe that are answered in one run.
PROMPTS_AT_ONCE = 1_000


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="markovmill")
    sub = p.add_subparsers(dest="command")
    for name, text in (("new", "write an example recipe"), ("build", "build a recipe's model")):
        sub.add_parser(name, help=text).add_argument("recipe", nargs="?", default=RECIPE_FILE)
    run = sub.add_parser("run", help="answer prompts, one to a line")
    run.add_argument("model")
    run.add_argument("-v", "--verbose", action="store_true")
    run.add_argument("--seed", type=int)
    run.add_argument("--steps", type=int)
    show = sub.add_parser("show", help="sum up a model, then list what follows each prompt")
    show.add_argument("model")
    keys = sub.add_parser("set", help="set a metadata key")
    for a in ("model", "key", "value"):
        keys.add_argument(a)
    for name in ("export-tokens", "export-transitions"):
        e = sub.add_parser(name, help="a table as CSV, to stdout or a folder")
        e.add_argument("model")
        e.add_argument("--to", help="folder to write to, for tables of any size")
    sub.add_parser("serve", help="answer over HTTP").add_argument("address", nargs="?", default="0.0.0.0:8080")
    sub.add_parser("help", help="show this")
    return p


def _recipe_path(path: str) -> str:
    return os.path.join(path, RECIPE_FILE) if os.path.isdir(path) else path


def main(args: list[str] | None = None, spark: SparkSession | None = None, inp: IO[str] = sys.stdin, out: IO[str] = sys.stdout) -> int:
    p = parser()
    a = p.parse_args(args)
    if a.command in (None, "help"):
        p.print_help(out)
        return 0
    if a.command == "new":
        with open(_recipe_path(a.recipe), "w", encoding="utf-8") as f:
            f.write(str(Recipe()))
        print("An example recipe is written", file=out)
        return 0
    spark = spark or SparkSession.builder.appName("markovmill").getOrCreate()
    if a.command == "build":
        path = _recipe_path(a.recipe)
        with open(path, encoding="utf-8") as f:
            recipe = parse_recipe(f.read()).relative_to(os.path.dirname(os.path.abspath(path)))
        target = os.path.join(os.path.dirname(os.path.abspath(path)), recipe.name)
        Model.build(spark, recipe).save(target)
        print(f"Built {target}", file=out)
    elif a.command == "set":
        Model.set_key(spark, a.model, a.key, a.value)
        print(f"Changed {a.model}", file=out)
    elif a.command == "serve":
        Service(spark).serve(a.address).serve_forever()
    else:
        {"run": _run, "show": _show, "export-tokens": _export, "export-transitions": _export}[a.command](spark, Model.load(spark, a.model), a, inp, out)
    return 0


def _run(spark: SparkSession, model: Model, a: argparse.Namespace, inp: IO[str], out: IO[str]) -> None:
    # a terminal is answered line by line, anything else in batches
    for lines in batched(inp, 1 if inp.isatty() else PROMPTS_AT_ONCE):
        for words, shares in generate_all(spark, model, list(lines), a.seed, a.steps):
            print(" ".join(words), file=out)
            if a.verbose and shares:
                print("\nActive experts:", file=out)
                for expert, share in shares:
                    print(f"  {expert}: {share:.2%}", file=out)


def _show(spark: SparkSession, model: Model, a: argparse.Namespace, inp: IO[str], out: IO[str]) -> None:
    for r in model.summary().where("part <> 'total'").orderBy(F.col("expert").asc_nulls_first(), F.desc("part")).collect():
        name = {"vocabulary": "Words", "base": "Transitions of the base"}.get(r.part, f"Transitions of expert {r.expert}")
        print(f"{name}: {r['items']}", file=out)
    print("\nKeys:", file=out)
    for k, v in sorted(model.keys.items()):
        print(f"  [{k!r}] = {v!r}", file=out)
    n_from, n_to = model.depths
    for line in inp:
        asked = spark.createDataFrame([(0, line.strip())], "query_id int, text string").select("query_id", model.tokenizer.encode(F.col("text")).alias("words"))
        known = encode(asked, model.vocabulary, "query_id").first()
        print("Ids: " + " ".join(map(str, known.ids)), file=out)
        context = spark.createDataFrame([(0, known.words)], "query_id int, seq array<string>")
        found = find_transitions(context, model.transitions, n_from, ["query_id"]).orderBy(F.desc("weight"), *to_columns(n_to))
        for i, r in enumerate(found.toLocalIterator()):
            print(("\nWhat follows:\n" if i == 0 else "") + f"  [{r.weight:8}] " + " ".join(r[c] for c in to_columns(n_to)), file=out)


def _export(spark: SparkSession, model: Model, a: argparse.Namespace, inp: IO[str], out: IO[str]) -> None:
    rows = exports.tokens_rows(model.vocabulary) if a.command == "export-tokens" else exports.transitions_rows(model.transitions, model.vocabulary, *model.depths)
    if a.to:
        exports.write_lines(rows, a.to)
        return
    print(",".join(rows.columns), file=out)
    for r in rows.toLocalIterator():  # a partition at a time
        print(",".join(str(v) for v in r), file=out)


if __name__ == "__main__":
    sys.exit(main())
