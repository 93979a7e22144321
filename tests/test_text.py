import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from markovmill.functions.text import WordTokenizer, decode, fill_template, split_documents, trim_unicode

CASES = [
    ("Hello,   World!", True, False, ["hello", "world"]),
    ("", True, False, []),
    ("a -- b", True, False, ["a", "", "b"]),
    ("a -- b", True, True, ["a", "--", "b"]),
    ("<|Start|> Hi", True, False, ["<|Start|>", "hi"]),
    ("<|start|>, Hi", True, False, ["start", "hi"]),
    ("<|>", True, False, ["<|>"]),
    ("don't STOP.", False, False, ["don't", "STOP"]),
    ("x ", True, False, ["x", ""]),
    ("  x", True, False, ["x"]),
    ("   ", True, False, [""]),
    ("a\tb\nc\fd\re", True, False, ["a", "b", "c", "d", "e"]),
    ("a\x0bb", True, False, ["a\x0bb"]),
    ("\x0b(a)　 b ", True, False, ["a", "b"]),
    ("ÄÈ Über!", True, False, ["äè", "über"]),
    ("[x] {y} ~z`", True, False, ["x", "y", "z"]),
    ("...", False, False, [""]),
]


def test_encode_cases(spark):
    for lower in (True, False):
        for punct in (True, False):
            own = [(i, c) for i, c in enumerate(CASES) if c[1:3] == (lower, punct)]
            if not own:
                continue
            df = spark.createDataFrame([(i, c[0]) for i, c in own], "i int, text string")
            got = {r.i: r.w for r in df.select("i", WordTokenizer(lower, punct).encode(F.col("text")).alias("w")).collect()}
            assert got == {i: c[3] for i, c in own}


def reference_words(text, lower, punct):
    space = " \t\n\f\r"
    unicode_space = "\t\n\x0b\f\r \x85\xa0                　"
    marks = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    if not text:
        return []
    words, word = [], ""
    for c in text.lstrip(space) + "\0":
        if c == "\0" or c in space:
            if word or c == "\0":
                words.append(word)
            word = ""
        else:
            word += c
    out = []
    for w in words:
        w = w.strip(unicode_space)
        if w.startswith("<|") and w.endswith("|>"):
            out.append(w)
            continue
        w = w if punct else w.strip(marks)
        out.append(w.lower() if lower else w)
    return out


@settings(max_examples=12, deadline=None)
@given(st.lists(st.text(alphabet="aB \t\n\x0b　.,!<|>é-", max_size=12), min_size=1, max_size=30), st.booleans(), st.booleans())
def test_encode_like_brute_force(spark, texts, lower, punct):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = [r.w for r in df.select("i", WordTokenizer(lower, punct).encode(F.col("text")).alias("w")).orderBy("i").collect()]
    assert got == [reference_words(t, lower, punct) for t in texts]


def test_tokens_decode_and_null(spark):
    df = spark.createDataFrame([("  Hi there. ",), (None,)], "text string")
    rows = df.select(WordTokenizer(True, False).tokens(F.col("text")).alias("t"), decode(WordTokenizer(True, False).encode(trim_unicode(F.col("text")))).alias("d")).collect()
    assert rows[0].t == ["<|start|>", "hi", "there", "<|stop|>"] and rows[0].d == "hi there" and rows[1].t is None


def test_split_and_template(spark):
    df = spark.createDataFrame([("a <|document|>  b<|document|><|document|>c.*",)], "text string")
    assert df.select(split_documents(F.col("text")).alias("d")).first().d == ["a", "b", "", "c.*"]
    assert df.select(split_documents(F.col("text"), ".*").alias("d")).first().d[1] == ""
    with pytest.raises(ValueError):
        split_documents(F.col("text"), "")
    one = spark.createDataFrame([("say {{stop_token}}",)], "text string")
    assert one.select(fill_template("{{start_token}} {{content}}", F.col("text")).alias("t")).first().t == "<|start|> say <|stop|>"


def test_parse_and_print():
    for t in (WordTokenizer(), WordTokenizer(True, False), WordTokenizer(True, True), WordTokenizer(False, False)):
        assert WordTokenizer.parse(str(t)) == t
    assert WordTokenizer.parse("word-tokenizer[lowercase, punctuation]") == WordTokenizer(True, True)
    for bad in ("other", "word-tokenizer[x]", "word-tokenizer[lowercase"):
        with pytest.raises(ValueError):
            WordTokenizer.parse(bad)
