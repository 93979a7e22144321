"""Token counts, packing, sharding, toxicity and quality: edge cases, brute force, held-out accuracy."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from markovmill.llm import queries as Q
from markovmill.llm.encoding import COMMON, SPACE, Encoder, chunked_ids, cuts_before_space, encode_all, load_tokenizer, proven_ranks, tokenizer_path
from markovmill.llm.labelled import labelled_sample
from markovmill.llm.packing import CAPACITY, pack_documents, pieces
from markovmill.llm.quality import _dictionary, fit_quality, score_quality
from markovmill.llm.sharding import assign_shards
from markovmill.llm.tokens import token_counts
from markovmill.llm.toxicity import fit_toxicity, maximal_segments, score_toxicity, without_toxic

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, size int, slot int, key_ string, score double"
ODD = [None, "", " ", "x", "word " * 30_000, "<|endoftext|> a<|endoftext|>", "é ü 中文 \U0001f600 1234", "中\u3000文。\u2003b\xa0\u3000 " * 4_000]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in each column, empty and long texts, repeated rows and ids, clashing names."""
    rows = [(i, t, None, 1, None, None) for i, t in enumerate(ODD)] + [(3, "x", 1, None, "k", 0.5)] * 2 + [(None, "no id", 1, 1, "k", 0.1), (None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def tokenizer():
    return load_tokenizer(tokenizer_path("byte_bpe_50k.json"))


def ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


PARTS = ["a", "Bc", "é", "ß", " ", "  ", "\n", "\t", "1", "23", "'s", "'re", ",", "!!", "<|endoftext|>", "…", "x<|endof", "€", "the ", "Ω", "\r\n", "中", "\U0001f600"]
PARTS += ["\u3000", "\u2003", "\xa0", "\x85", "\x1c", "\u180e", "\u200b", "\u2028", "\x00", "\u0301", "a\u3000b"]


@pytest.fixture(scope="module", params=[None, "byte_bpe_50k.tiktoken"])
def encoder(request):
    return Encoder(tokenizer_path("byte_bpe_50k.json"), request.param and tokenizer_path(request.param))


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=60), st.integers(1, 12), st.integers(1, 5))
def test_chunks_give_the_whole_texts_ids(tokenizer, encoder, parts, chunk, overlap):
    text = "".join(parts)
    assert chunked_ids(encoder, text, chunk, overlap) == ids(tokenizer, text)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.text(max_size=40) | st.sampled_from(PARTS), max_size=20))
def test_units_give_the_whole_texts_ids(tokenizer, encoder, parts):
    text = "".join(parts)
    assert encoder.encode([text, text[:5]]) == [ids(tokenizer, text), ids(tokenizer, text[:5])]


def test_white_space_is_the_tokenizers(tokenizer):
    """A character is in SPACE if and only if the tokenizer's pattern always ends a piece before it."""
    cut = tokenizer.pre_tokenizer.pre_tokenize_str
    for c in (c for c in map(chr, range(0x110000)) if not "\ud800" <= c <= "\udfff"):
        assert (re.fullmatch(f"[{SPACE}]", c) is not None) == all(cut(x + c)[0][1] == (0, 1) for x in "a1!"), hex(ord(c))


def test_long_texts_of_wide_spaces(tokenizer, encoder):
    rng = random.Random(3)
    for text in ("\u3000".join(rng.choices(["中文", "ab", "é,", "1"], k=9_000)), "\u2003\u3000".join(["x"] * 12_000), "中" * 30_000, " " * 30_000, "a" * 9 + "\u3000" * 40_000 + "b"):
        for chunk, overlap in ((16_384, 512), (100, 10)):
            assert encode_all(encoder, [text], chunk, overlap) == [ids(tokenizer, text)]


def test_ranks_are_used_if_proven(tokenizer):
    import public_tokenizers as P

    path = P.path("byte_bpe_50k.json")
    quick = proven_ranks(path, P.path("byte_bpe_50k.tiktoken"))
    assert proven_ranks(path, P.path("byte_bpe_multi_50k.tiktoken")) is None and proven_ranks(P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.tiktoken")) is None
    for c in (c for c in map(chr, range(0x2200)) if COMMON.fullmatch(c)):
        text = "".join(f"{x}{c}{y}" for x in ("a", "1", "!", " ", "\n", c, "é") for y in ("a", "1", "!", " ", "\n", c, "é"))
        assert quick.encode(text, disallowed_special=()) == ids(tokenizer, text)


def test_files_that_prove_no_boundary_are_encoded_whole():
    import public_tokenizers as P

    assert cuts_before_space(P.path("byte_bpe_50k.json")) and not cuts_before_space(P.path("word_bpe_49k.json"))
    text = "Some  words\n" * 3_000
    other = Encoder(P.path("word_bpe_49k.json"))
    assert encode_all(other, [text], 100, 10) == [other.tokenizer.encode(text, add_special_tokens=False).ids]


def test_token_counts(spark, odd, tokenizer):
    for chunk, overlap, ranks in ((500, 20, None), (16_384, 512, tokenizer_path("byte_bpe_50k.tiktoken"))):
        got = token_counts(odd, tokenizer_path("byte_bpe_50k.json"), chunk=chunk, overlap=overlap, ranks=ranks)
        want = sorted((str(r.doc_id), len((r.text or "").encode()), len(ids(tokenizer, r.text)), len(ids(tokenizer, r.text)) > 1024) for r in odd.collect())
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got.collect()) == want
    assert token_counts(odd.limit(0), tokenizer_path("byte_bpe_50k.json")).count() == 0
    with pytest.raises(ValueError):
        token_counts(odd, "x", chunk=0)


def test_token_count_query(spark, tokenizer):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    got = Q.op2_token_counts(spark, DIR).collect()
    assert len(got) == len(docs)
    assert all(r.n_tokens == len(ids(tokenizer, docs[r.doc_id])) and r.n_bytes == len(docs[r.doc_id].encode()) for r in got)


def check_packing(rows, texts, tokenizer):
    """rows: of documents with unique ids"""
    sequences, documents = {}, {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        documents.setdefault(r.doc_id, []).append(r)
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= CAPACITY
    assert set(documents) == set(texts)
    for k, own in documents.items():
        a = np.array([*ids(tokenizer, texts[k]), 0], dtype="<u4")
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(a) and r.ids_crc32 == zlib.crc32(a[at : at + r.length].tobytes())
            at += r.length
        assert at == len(a)
    used = [sum(n for _, n in s) for s in sequences.values()]
    return sum(CAPACITY - u for u in used if u & (u - 1)), sum(used)


def test_packing(spark, odd, tokenizer):
    assert pieces(2048 + 700) == [(0, 1024), (1024, 1024), (2048, 512), (2560, 128), (2688, 60)] and pieces(1) == [(0, 1)]
    unique = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    check_packing(pack_documents(unique).collect(), {r.doc_id: r.text for r in unique.collect()}, tokenizer)
    assert pack_documents(odd).where("length = doc_tokens").count() >= odd.count() - 2
    assert pack_documents(odd.limit(0)).count() == 0


def test_packing_query(spark, tokenizer):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    padding, used = check_packing(Q.op6_packing(spark, DIR).collect(), docs, tokenizer)
    assert padding < 0.02 * used


def test_sharding(spark, odd):
    rows = assign_shards(odd, [1.0] * 8).collect()
    assert len(rows) == odd.count()
    assert all(r.size == len((t or "").encode()) + 1 and r.text_crc32 == zlib.crc32((t or "").encode()) for r in rows if r.doc_id is not None for t in [ODD[r.doc_id]])
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert len({r.shard for r in rows if r.doc_id == 3}) == 1
    assert assign_shards(odd.limit(0), [1.0] * 8).count() == 0
    with pytest.raises(ValueError):
        assign_shards(odd, [0.0])


def test_sharding_moves_rows_only_to_a_new_shard(spark):
    many = spark.range(4000).selectExpr("id as doc_id", "'' as text")
    before, after = assign_shards(many, [1.0] * 8), assign_shards(many, [1.0] * 9)
    both = before.join(after.selectExpr("doc_id", "shard as later"), "doc_id").collect()
    assert all(r.later == r.grown_shard and r.later in (r.shard, 8) for r in both)
    assert 300 < sum(r.later == 8 for r in both) < 600
    sizes = assign_shards(many, [3.0, 1.0, 0.0]).groupBy("shard").count().collect()
    assert {r.shard: round(r["count"] / 1000) for r in sizes} == {0: 3, 1: 1}


def brute_segments(s):
    """Recursion by definition: the greatest segment, then those of what lies before and after it."""
    best = max(((sum(s[i:j]), -(j - i), -i, i, j) for i in range(len(s)) for j in range(i + 1, len(s) + 1)), default=None)
    if best is None or best[0] <= 0:
        return []
    i, j = best[3], best[4]
    return [(a, b, c) for a, b, c in brute_segments(s[:i])] + [(i, j, best[0])] + [(a + j, b + j, c) for a, b, c in brute_segments(s[j:])]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([-1.0, -0.5, 3.0, 1.25, 2.0]), max_size=14))
def test_maximal_segments(scores):
    assert sum(x[2] for x in maximal_segments(np.array(scores))) == pytest.approx(sum(x[2] for x in brute_segments(scores)))
    assert max((x[2] for x in maximal_segments(np.array(scores))), default=0) == max((x[2] for x in brute_segments(scores)), default=0)


def labelled(spark, n=800):
    rng = random.Random(4)
    words = ["ba", "co", "di", "fu", "ge", "ha"]
    docs, labels = [], []
    for i in range(n):
        y = int(rng.random() < 0.3)
        text = ["".join(rng.choices(words, k=3)) for _ in range(rng.randint(30, 90))]
        if y:
            for _ in range(4):
                text[rng.randrange(len(text))] = rng.choice(["Vile!", "nasty,", "grim"])
        docs.append((i, " ".join(text) if y else ". ".join(text)))
        labels.append((i, 1 - y, y))
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


@pytest.mark.parametrize(("fit", "score", "name", "parts", "rest"), [(fit_toxicity, score_toxicity, "toxic", 5, 0), (fit_quality, score_quality, "quality", 4, 2)])
def test_classifiers(spark, odd, fit, score, name, parts, rest):
    docs, labels = labelled(spark)
    truth = {r.doc_id: r[name] for r in labels.collect()}
    rows = score(docs, fit(docs, labels)).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == rest) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.9
    # held-out labels are never seen
    other = labels.selectExpr("doc_id", *[f"case when crc32(cast(doc_id as string)) % {parts} = {rest} then 1 - {c} else {c} end as {c}" for c in ("quality", "toxic")])
    assert sorted((r.doc_id, r.score) for r in score(docs, fit(docs, other)).collect()) == sorted((r.doc_id, r.score) for r in rows)
    model = fit(docs, labels)
    assert score(odd, model).count() == odd.count() and score(odd.limit(0), model).count() == 0
    assert score(odd, model).where("score is null or predicted is null or held_out is null").count() == 0
    # no labels, one class, null labels
    for few in (labels.limit(0), labels.where(f"{name} = 1"), labels.selectExpr("doc_id", "cast(null as int) as quality", "cast(null as int) as toxic")):
        assert score(odd, fit(docs, few)).count() == odd.count()
    assert fit(docs.limit(0), labels).a is not None


def test_toxicity_is_calibrated_alike_where_the_sample_cuts_a_class(spark):
    rng = random.Random(8)
    docs = []
    for i in range(2000):
        words = rng.choices(["ba", "co", "di", "fu", "ge", "ha", "ki"], k=20)
        docs.append((i, " ".join(words + ["vile"] * (rng.random() < (0.15 if i % 10 else 0.7))), int(i % 10 == 0)))
    docs = spark.createDataFrame(docs, "doc_id bigint, text string, toxic int").repartition(3).cache()
    means = [score_toxicity(docs, fit_toxicity(docs, docs.select("doc_id", "toxic"), most=most)).agg({"score": "avg"}).first()[0] for most in (300, 16_000)]
    assert all(abs(m - 0.1) < 0.05 for m in means), means
    # documents with some evidence are clean more often than not
    model = fit_toxicity(docs, docs.select("doc_id", "toxic"), most=300)
    assert score_toxicity(docs, model).where("predicted = 1").count() == 0


def brute_score(text, model):
    """A text's score by the formulas alone: greatest segments by all pairs of places, Karlin-Altschul sums, logistic calibration."""
    def token(t):
        found = [next((model.scores[f] for f in (w, *(w[:k] + "*" for k in (6, 5, 4) if len(w) >= k)) if f in model.scores), -model.drift) for w in re.findall(r"\w+", t.lower())]
        return max([-model.drift, *found])

    def greatest(total, low, high):
        best = max(((total[j] - total[i], i - j, -i) for i in range(low, high) for j in range(i + 1, high + 1)), default=(0.0, 0, 0))
        if best[0] <= 1e-12:
            return []
        i = -best[2]
        j = i - best[1]
        return greatest(total, low, i) + [best[0]] + greatest(total, j, high)

    s = [token(t) for t in text.split()]
    found = greatest([sum(s[:i]) for i in range(len(s) + 1)], 0, len(s)) if any(x > 0 for x in s) else []
    each = sorted((model.decay * x - math.log(model.scale * len(s)) for x in found), reverse=True)
    nats = max([0.0, *(sum(each[:r]) - math.lgamma(r + 1) for r in range(1, len(each) + 1))])
    return 1 / (1 + math.exp(-(model.a + model.b * math.log1p(nats)))), len(found)


def at_optimum(x, y, weight, a, b, ridge=1e-3):
    """Whether (a, b) is where the logistic loss and a ridge on the scaled slope have no slope."""
    x, y, weight = map(np.asarray, (x, y, weight))
    p = 1 / (1 + np.exp(-(a + b * x)))
    z = (x - x.mean()) / (x.std() or 1.0)
    return abs((weight * (p - y)).sum()) < 1e-4 and abs((weight * (p - y) * z).sum() + ridge * len(y) * b * x.std()) < 1e-4


def test_toxicity_by_the_formulas(spark):
    docs, labels = labelled(spark, 400)
    model = fit_toxicity(docs, labels)
    sample = labelled_sample(docs, labels, "toxic", 5, 0, 16_000).collect()
    held = Counter()
    for r in sample:
        if r.fold != 3:
            words = set(re.findall(r"\w+", r.text.lower()))
            held.update((f, r.y) for f in words | {w[:k] + "*" for w in words for k in (6, 5, 4) if len(w) >= k})
    n = [sum(v for (_, y), v in held.items() if y == k) for k in (0, 1)]
    want, share = {}, {}
    for f in {f for f, _ in held}:
        c, t = held[f, 0], held[f, 1]
        alpha, expected = 500 * (t + c) / sum(n), (t + c) * n[1] / sum(n)
        odds = math.log((t + alpha) / (n[1] + 500 - t - alpha)) - math.log((c + alpha) / (n[0] + 500 - c - alpha))
        gain = 2 * ((t * math.log(t / expected) if t else 0) + (c * math.log(c / (t + c - expected)) if c else 0))
        if t >= 3 and gain >= 14 and odds > 0.5:
            want[f], share[f] = odds - 0.5, (c + alpha) / (n[0] + 500)
    assert want and model.scores == pytest.approx(want)
    words = [f for f in want if not f.endswith("*")]
    assert sum(share[f] * math.exp(model.decay * want[f]) for f in words) + (1 - sum(share[f] for f in words)) * math.exp(-0.5 * model.decay) == pytest.approx(1)
    rest = [r for r in sample if r.fold == 3]
    clean = [r for r in rest if not r.y]
    found = sum(brute_score(r.text, model)[1] for r in clean)
    assert model.scale == pytest.approx((found + 0.5) / (math.exp(-model.decay * min(want.values())) * sum(len(r.text.split()) for r in clean)))
    scores = {r.doc_id: r.score for r in score_toxicity(docs, model).collect()}
    assert scores == pytest.approx({r.doc_id: brute_score(r.text, model)[0] for r in docs.collect()})
    x = [(math.log(s / (1 - s)) - model.a) / model.b for s in (scores[r.key_] for r in rest)]
    assert at_optimum(x, [r.y for r in rest], np.ones(len(rest)), model.a, model.b)


def test_quality_by_the_formulas(spark):
    import zstandard
    from pyspark.sql import functions as F

    docs, labels = labelled(spark, 400)
    # a line in all, empty lines, and one document of a single line of many segments
    docs = docs.select("doc_id", F.concat(F.lit("All have this line.\n\n"), F.regexp_replace("text", "a ", "a\n"), F.when(F.col("doc_id") == 7, F.repeat(F.concat("text", F.lit(" 7 ")), 60)).otherwise("")).alias("text"))
    model = fit_quality(docs, labels)
    sample = labelled_sample(docs, labels, "quality", 4, 2, 12_000).collect()
    train = [r for r in sample if r.fold != 3]
    holders = {}
    for r in train:
        for line in r.text.split("\n"):
            holders.setdefault(line, set()).add(r.key_)
    segments = {}
    for r in train:
        size = 0
        for line in r.text.split("\n"):
            if line and len(holders[line]) == 1:
                for at in range(0, len(line), 2048):
                    size += len(line[at : at + 2048]) + 1
                    segments.setdefault((r.y, r.key_, (size - 1) // 2048), []).append(line[at : at + 2048])
    assert max(len("".join(v)) for v in segments.values()) <= 4096 and len([k for k in segments if k[1] == 7]) != 1
    order = spark.createDataFrame([(k[1], k[2]) for k in segments], "key_ bigint, segment bigint").select("*", F.xxhash64("key_", "segment").alias("o")).collect()
    order = {(r.key_, r.segment): r.o for r in order}
    for y, dictionary in enumerate((model.bad, model.good)):
        own = sorted((order[k[1:]], "\n".join(v).encode()) for k, v in segments.items() if k[0] == y)
        assert dictionary == _dictionary([b for _, b in own], 112_640)
    by = [zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d)) for d in (model.good, model.bad)]

    def difference(text):
        raw = text.encode()
        return (len(by[1].compress(raw)) - len(by[0].compress(raw))) / (len(raw) + 200)

    for r, text in zip(*(sorted(x, key=lambda r: r.doc_id) for x in (score_quality(docs, model).collect(), docs.collect()))):
        assert r.difference == difference(text.text) and r.score == pytest.approx(1 / (1 + math.exp(-model.a - model.b * r.difference))) and r.predicted == (r.score >= 0.7)
    rest = [r for r in sample if r.fold == 3]
    prior = np.mean([r.quality for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2])
    of = Counter(r.y for r in rest)
    weight = [(prior if r.y else 1 - prior) * len(rest) / of[r.y] for r in rest]
    assert at_optimum([difference(r.text) for r in rest], [r.y for r in rest], weight, model.a, model.b)


def test_without_toxic(spark, odd):
    docs, labels = labelled(spark)
    model = fit_toxicity(docs, labels)
    kept = without_toxic(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in score_toxicity(docs, model).where("predicted = 0").collect()}
    assert without_toxic(odd, model).columns == odd.columns and without_toxic(odd, model).count() == odd.count()


@pytest.mark.parametrize(("name", "label", "least"), [("op3_toxicity", "toxic", 0.9), ("op7_quality", "quality", 0.88)])
def test_classifier_queries(spark, name, label, least):
    d = "/root/testdata/sf0.01"
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = getattr(Q, name)(spark, d).collect()
    assert len(rows) == 1000
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > least
