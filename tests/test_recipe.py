import pytest

from markovmill.functions.text import WordTokenizer
from markovmill.plans.model import metadata
from markovmill.sources.recipe import Recipe, SourceFile, parse_recipe


def test_round_trip():
    r = Recipe("test recipe", {"test": "123"}, (SourceFile("test", "</test>"),), WordTokenizer(True, False), "{{content}}", ("<|document|>",), 5, 2, 64, 4, 4)
    assert parse_recipe(str(r)) == r


def test_defaults():
    assert parse_recipe("Name a\nTokenizer word-tokenizer") == Recipe("a", tokenizer=WordTokenizer(False, False), stop_tokens=(), from_depth=1, to_depth=1, total_experts=0, active_experts=0, centroids=0)
    r = parse_recipe("Name a\nTokenizer word-tokenizer[lowercase]\nFile x.txt\nSplit -- File y z.txt\nSet a = 1\nSet a = 2 = 3")
    assert r.files == (SourceFile("x.txt", "<|document|>"), SourceFile("y z.txt", "--")) and r.keys == {"a": "2 = 3"}
    assert r.relative_to("/d").files[0].path == "/d/x.txt"


@pytest.mark.parametrize("line", ["Depth 2", "Depth 2/x", "Depth  2/1", "Experts 1", "Centroids 2 ", "Set a=1", "Split x", "# note", " ", "Bogus 1"])
def test_errors(line):
    with pytest.raises(ValueError):
        parse_recipe(f"Name a\nTokenizer word-tokenizer\n{line}")


@pytest.mark.parametrize("text", ["Name a", "Tokenizer word-tokenizer"])
def test_needed(text):
    with pytest.raises(ValueError):
        parse_recipe(text)


def test_metadata_defaults_and_overrides():
    keys = metadata(Recipe(keys={"model.inference.top_k": "3"}, centroids=0), 4)
    assert keys["model.inference.top_k"] == "3" and keys["model.experts.centroids"] == "0" and keys["model.experts.total"] == "4"
    assert keys["model.inference.stop_tokens[3]"] == "<|answer|>" and keys["model.inference.max_tokens"] == "200"
