"""Recipes: how a model is built, as text of one setting to a line."""

from __future__ import annotations

import posixpath
from dataclasses import dataclass, field, replace

from ..functions.text import DOCUMENT, WordTokenizer


@dataclass(frozen=True)
class SourceFile:
    path: str
    delimiter: str = DOCUMENT


@dataclass(frozen=True)
class Recipe:
    """Settings of a new model; parse() has defaults of its own for what a text leaves out."""

    name: str = "new-model"
    keys: dict[str, str] = field(default_factory=dict)
    files: tuple[SourceFile, ...] = ()
    tokenizer: WordTokenizer = WordTokenizer(lowercase=True, punctuation=False)
    template: str = "{{content}}"
    stop_tokens: tuple[str, ...] = ("<|start|>", "<|stop|>", "<|document|>", "<|answer|>")
    from_depth: int = 2
    to_depth: int = 1
    total_experts: int = 4
    active_experts: int = 1
    centroids: int = 2

    def relative_to(self, folder: str) -> Recipe:
        return replace(self, files=tuple(replace(f, path=posixpath.join(folder, f.path)) for f in self.files))

    def __str__(self) -> str:
        head = [f"Name {self.name}", f"Tokenizer {self.tokenizer}", f"Template {self.template}"]
        head += [f"Depth {self.from_depth}/{self.to_depth}", f"Experts {self.active_experts}/{self.total_experts}", f"Centroids {self.centroids}"]
        groups = [head, [f"Stop {t}" for t in self.stop_tokens], [f"Set {k} = {v}" for k, v in self.keys.items()]]
        groups.append([f"Split {f.delimiter} File {f.path}" if f.delimiter else f"File {f.path}" for f in self.files])
        return "\n\n".join("\n".join(g) for g in groups if g)


def _number(text: str, line: str) -> int:
    if not text.removeprefix("+").isdecimal() or not text.isascii():  # no white space, no sign but +
        raise ValueError(f"not a number: {line}")
    return int(text)


def _pair(text: str, mark: str, line: str) -> tuple[str, str]:
    left, found, right = text.partition(mark)
    if not found:
        raise ValueError(f"invalid parameter: {line}")
    return left, right


def parse_recipe(text: str) -> Recipe:
    """A recipe from its text. Name and Tokenizer are needed; unknown lines, blank ones of white space included, raise."""
    found: dict = {"template": "{{content}}", "from_depth": 1, "to_depth": 1, "total_experts": 0, "active_experts": 0, "centroids": 0}
    stops: list[str] = []
    keys: dict[str, str] = {}
    files: list[SourceFile] = []
    for line in text.replace("\r\n", "\n").split("\n"):
        word, _, rest = line.partition(" ")
        if not line:
            continue
        if not line.startswith(f"{word} "):
            raise ValueError(f"unknown model parameter: {line}")
        match word:
            case "Name" | "Template":
                found[word.lower()] = rest.strip()
            case "Tokenizer":
                found["tokenizer"] = WordTokenizer.parse(rest)
            case "Stop":
                stops.append(rest.strip())
            case "Set":
                key, value = _pair(rest, " = ", line)
                keys[key.strip()] = value.strip()
            case "File":
                files.append(SourceFile(rest.strip()))
            case "Split":
                delimiter, path = _pair(rest, " File ", line)
                files.append(SourceFile(path.strip(), delimiter.strip()))
            case "Depth":
                found["from_depth"], found["to_depth"] = (_number(x, line) for x in _pair(rest, "/", line))
            case "Experts":
                found["active_experts"], found["total_experts"] = (_number(x, line) for x in _pair(rest, "/", line))
            case "Centroids":
                found["centroids"] = _number(rest, line)
            case _:
                raise ValueError(f"unknown model parameter: {line}")
    for needed in ("name", "tokenizer"):
        if needed not in found:
            raise ValueError(f"missing model {needed}")
    return Recipe(keys=keys, files=tuple(files), stop_tokens=tuple(stops), **found)
