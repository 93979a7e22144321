"""Token ids of a byte-level BPE file: texts by units that white space parts, huge ones in overlapping chunks that are spliced where both agree.

The pattern by which byte-level BPE cuts a text to pieces before it merges has no piece in which white space follows anything else, and its
only look ahead is within white space. So a piece always ends before white space that follows another character, whatever stands around,
merges never cross pieces, and the ids of a text are those of its units one after the other. Special strings without white space lie in a
unit whole.

A second library encodes by ranks, several times faster. proven_ranks() shows for a pair of files that both give the same ids, before it is used.
"""

from __future__ import annotations

import base64
import json
import os
import re
from collections.abc import Iterable
from functools import lru_cache
from itertools import chain

import numpy as np

# Unicode's White_Space, which is \s to the tokenizers library (tests hold it against each character)
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Characters whose kind (letter, number, space, other) no version of Unicode has changed, as classes of the pattern go by kind alone.
COMMON = re.compile("[\\t\\n\\r -~\\xa1-\\u024f\\u0391-\\u03a1\\u03a3-\\u03c9\\u0410-\\u044f\\u2013\\u2014\\u2018\\u2019\\u201c\\u201d\\u2026\\u20ac]*")
#: A unit: white space and what follows it; at the end of a text white space alone.
UNIT = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: White space after another character: a boundary of pieces in any text.
STABLE = re.compile(f"(?<=[^{SPACE}])[{SPACE}]")
#: Characters of units whose ids a worker keeps.
KEPT_CHARACTERS = 4 << 20


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def cuts_before_space(path: str) -> bool:
    """Whether a tokenizers file is of the kind that the module's docstring speaks of: nothing in it reaches over a unit's end."""
    with open(path, encoding="utf-8") as f:
        own = json.load(f)
    steps = own["pre_tokenizer"] or {}
    plain = steps.get("type") == "ByteLevel" and steps.get("use_regex", True) and not steps.get("add_prefix_space") and own["normalizer"] is None
    model = own["model"].get("type") == "BPE" and not own["model"].get("dropout")
    return plain and model and all(not (x["lstrip"] or x["rstrip"] or x["single_word"] or re.search(r"\s", x["content"])) for x in own["added_tokens"])


def token_bytes(token: str) -> bytes:
    """The bytes for which a token of a byte-level vocabulary stands: printable ones of Latin-1 as they are, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: b for b in plain} | {256 + i: b for i, b in enumerate(b for b in range(256) if b not in plain)}
    return bytes(map(table.__getitem__, map(ord, token)))


def proven_ranks(path: str, ranks_path: str):
    """An encoding by a file of ranks, if it is proven to give the tokenizers file's ids for texts of COMMON characters, else None.

    Both cut a text to pieces by the same pattern, and merge neighbours of least rank first, the leftmost of equal ones. The library by
    ranks merges two tokens if their bytes are a token's, the other one only the listed pair of that token; if merges are listed in the
    order of their ids, that is the only difference. It needs two neighbours a, b that are not the pair listed for t = ab. Tokens only
    grow, so nothing has crossed the bytes of t before, and they came to be a, b as if they stood alone. Alone they then stay a, b. So
    there are no such neighbours if each token's bytes, encoded alone by listed pairs, give that token: which is checked for all.
    """
    import public_tokenizers
    import tiktoken

    if not cuts_before_space(path):
        return None
    with open(path, encoding="utf-8") as f:
        own = json.load(f)
    vocabulary, special = own["model"]["vocab"], {x["content"]: x["id"] for x in own["added_tokens"]}
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    if ranks != {token_bytes(t): i for t, i in vocabulary.items() if t not in special}:
        return None
    made = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in own["model"]["merges"]]
    model = load_tokenizer(path).model
    if made != sorted(set(made)) or any([x.id for x in model.tokenize(t)] != [i] for t, i in vocabulary.items() if t not in special):
        return None
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


class Encoder:
    """Ids as the tokenizers library gives them. Texts of COMMON characters go by ranks, where these are proven to give the same. Of others
    each unit is encoded once and the ids of a bounded number of them are kept; with a file for which units prove nothing whole texts are
    encoded."""

    def __init__(self, path: str, ranks: str | None = None):
        self.tokenizer = load_tokenizer(path)
        self.by_units = cuts_before_space(path)
        self.quick = proven_ranks(path, ranks) if ranks else None
        self.known: dict[str, list[int]] = {}
        self.held = 0
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.sizes = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)  # bytes of each token, which are its characters in the file
        self.sizes[list(vocabulary.values())] = list(map(len, vocabulary))

    def _learn(self, units: Iterable[str]) -> None:
        if self.held > KEPT_CHARACTERS:
            self.known.clear()
            self.held = 0
        new = list(set(units).difference(self.known))
        self.held += sum(map(len, new))
        first = [u for u in new if u[0] not in SPACE]
        for u in first:
            self.known[u] = self.tokenizer.encode(u, add_special_tokens=False).ids
        # units that begin with white space, and end otherwise, are units of one text too; its ids are dealt out by their bytes
        rest = [u for u in new if u[0] in SPACE and u[-1] not in SPACE]
        for u in set(new).difference(first, rest):
            self.known[u] = self.tokenizer.encode(u, add_special_tokens=False).ids
        if rest:
            (found,) = self.tokenizer.encode_batch_fast(["".join(rest)], add_special_tokens=False)
            ids = found.ids
            ends = np.cumsum(self.sizes[ids])
            at = np.searchsorted(ends, np.cumsum([len(u.encode()) for u in rest])) + 1
            for u, a, b in zip(rest, [0, *at.tolist()], at.tolist()):
                self.known[u] = ids[a:b]

    def _quick(self, text: str) -> list[int] | None:
        if self.quick is None or not COMMON.fullmatch(text):
            return None
        return self.quick.encode(text, allowed_special="all", disallowed_special=())

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text."""
        if not self.by_units:
            return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        out = [self._quick(t) for t in texts]
        units = {i: UNIT.findall(t) for i, t in enumerate(texts) if out[i] is None}
        self._learn(chain.from_iterable(units.values()))
        for i, u in units.items():
            out[i] = list(chain.from_iterable(map(self.known.__getitem__, u)))
        return out

    def offsets(self, text: str) -> tuple[list[int], np.ndarray]:
        """Ids of a text, and for each the place of the character in which it begins, or of one before in the same unit."""
        ids = self._quick(text)
        if ids is not None:
            ends = np.cumsum(self.sizes[ids])
            # characters by the bytes that begin one
            begins = np.cumsum(np.frombuffer(text.encode(), np.uint8) & 0xC0 != 0x80) - 1
            return ids, begins[np.r_[0, ends[:-1]]] if len(ids) else ends
        units = UNIT.findall(text)
        self._learn(units)
        found = [self.known[u] for u in units]
        starts = np.cumsum([0, *map(len, units)])[:-1]
        return list(chain.from_iterable(found)), np.repeat(starts, list(map(len, found)))


@lru_cache(maxsize=2)
def shared_encoder(path: str, ranks: str | None = None) -> Encoder:
    """One encoder for all tasks of a worker."""
    return Encoder(path, ranks)


def chunked_ids(encoder: Encoder, text: str, chunk: int, overlap: int) -> list[int]:
    """Ids of a text that is encoded in chunks of `chunk` characters and an overlap.

    Two neighbours are spliced at a boundary of STABLE at which both have an offset: the left chunk's ids before it and the right one's
    from the first of that offset on are those of the whole text. A chunk's last unit may be cut and is no boundary of it. An overlap without such a boundary is doubled, up to the end of the text.
    """
    ids: list[int] = []
    start = 0  # all before it is done; it is the text's start or a proven boundary
    while len(text) - start > chunk + overlap:
        wide = overlap
        while True:
            stop = start + chunk + wide
            if stop >= len(text):
                return ids + encoder.offsets(text[start:])[0]
            left, ours = encoder.offsets(text[start:stop])
            _, theirs = encoder.offsets(text[start + chunk : min(len(text), stop + overlap)])
            both = np.intersect1d(ours + start, theirs + start + chunk)
            both = set(both[both < stop - 1].tolist())
            at = next((m.start() for m in STABLE.finditer(text, start + chunk + 1, stop - 1) if m.start() in both), None)
            if at is not None:
                ids += left[: int(np.searchsorted(ours, at - start))]
                start = at
                break
            wide *= 2
    return ids + encoder.offsets(text[start:])[0]


def encode_all(encoder: Encoder, texts: list[str], chunk: int, overlap: int) -> list[list[int]]:
    """Ids of each text; those over chunk + overlap characters in chunks."""
    huge = {i for i, t in enumerate(texts) if encoder.by_units and len(t) > chunk + overlap}
    rest = iter(encoder.encode([t for i, t in enumerate(texts) if i not in huge]))
    return [chunked_ids(encoder, t, chunk, overlap) if i in huge else next(rest) for i, t in enumerate(texts)]
