"""Word tokens as native columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

START, STOP, DOCUMENT = "<|start|>", "<|stop|>", "<|document|>"

# ASCII white space (no vertical tab), ASCII punctuation, Unicode White_Space, as classes of regular expressions
SPACE = r"[ \t\n\f\r]"
PUNCTUATION = r"[!-/:-@\[-`{-~]"
UNICODE_SPACE = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_ENDS = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_RARE_SPACE = r"[\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


@dataclass(frozen=True)
class WordTokenizer:
    """lowercase: words in lower case; punctuation: keep ASCII punctuation at a word's ends."""

    lowercase: bool = False
    punctuation: bool = True

    def encode(self, text: Column) -> Column:
        """Words of a text: split at ASCII white space, trimmed of Unicode white space; tags <|...|> as they are, others stripped of
        punctuation at both ends and lowered by the options. Words of punctuation alone become "". White space at the end adds a "".
        Null gives null."""
        body = F.regexp_replace(text, f"^{SPACE}+", "")
        quick = F.regexp_replace(body, f"{SPACE}+", " ")
        if not self.punctuation:
            quick = F.regexp_replace(quick, f"(?<![^ ]){PUNCTUATION}+|{PUNCTUATION}+(?![^ ])", "")
        if self.lowercase:
            quick = F.lower(quick)
        each = F.transform(F.split(body, f"{SPACE}+"), self._word)
        # a tag needs "<|"; rare spaces are trimmed word by word
        odd = text.contains("<|") | (_may_hold_rare_space(text) & text.rlike(_RARE_SPACE))
        return F.when(text == "", F.array().cast("array<string>")).when(odd, each).otherwise(F.split(quick, " "))

    def _word(self, w: Column) -> Column:
        w = trim_unicode(w)
        out = w
        if not self.punctuation:
            out = F.regexp_replace(out, f"^{PUNCTUATION}+|{PUNCTUATION}+$", "")
        if self.lowercase:
            out = F.lower(out)
        return F.when(w.startswith("<|") & w.endswith("|>"), w).otherwise(out)

    def tokens(self, text: Column, start: str = START, stop: str = STOP) -> Column:
        """A document's tokens: the words of the trimmed text between start and stop."""
        return F.concat(F.array(F.lit(start)), self.encode(trim_unicode(text)), F.array(F.lit(stop)))

    def __str__(self) -> str:
        options = [n for n in ("lowercase", "punctuation") if getattr(self, n)]
        return "word-tokenizer" + (f"[{','.join(options)}]" if options else "")

    @staticmethod
    def parse(spec: str) -> WordTokenizer:
        """From its text form; spaces between options and an empty list are accepted."""
        kind, _, rest = spec.strip().partition("[")
        if kind.strip() != "word-tokenizer" or (rest and not rest.endswith("]")):
            raise ValueError(f"unknown tokenizer: {spec}")
        options = [x.strip() for x in rest.rstrip("]").split(",") if x.strip()]
        for o in options:
            if o not in ("lowercase", "punctuation"):
                raise ValueError(f"unknown word tokenizer parameter: {o}")
        return WordTokenizer("lowercase" in options, "punctuation" in options)


def trim_unicode(text: Column) -> Column:
    return F.btrim(text, F.lit(_ENDS))  # UNICODE_SPACE, without a regular expression's pass over the whole text


def _may_hold_rare_space(text: Column) -> Column:
    """False only where _RARE_SPACE isn't found: the first bytes of its characters in UTF-8, which are looked for faster."""
    data, found = text.cast("binary"), text.contains("\x0b")
    for first in (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80"):
        found = found | F.contains(data, F.lit(first))
    return found


def decode(words: Column) -> Column:
    """Words joined by one space."""
    return F.array_join(words, " ")


def fill_template(template: str, content: Column, start: str = START, stop: str = STOP) -> Column:
    """The template with the content, then the start and stop tokens, put in; the content may itself name the latter two."""
    out = F.replace(F.lit(template), F.lit("{{content}}"), content)
    return F.replace(F.replace(out, F.lit("{{start_token}}"), F.lit(start)), F.lit("{{stop_token}}"), F.lit(stop))


def split_documents(text: Column, delimiter: str = DOCUMENT) -> Column:
    """The documents of a file's text: split at the literal delimiter, trimmed, empty ones kept."""
    if not delimiter:
        raise ValueError("empty delimiter")
    quoted = "\\Q" + delimiter.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return F.transform(F.split(text, quoted), trim_unicode)
