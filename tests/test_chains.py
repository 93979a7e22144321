import math
import struct

import pytest
from pyspark.sql import functions as F

from markovmill.functions.text import WordTokenizer
from markovmill.operators import experts as X
from markovmill.operators.generate import Limits, generate
from markovmill.operators.lookup import find_transitions, index, near
from markovmill.operators.ngrams import base_transitions, count_transitions, weigh, windows
from markovmill.operators.predict import Chains, activate, candidates, draw, predict, similarities, top_candidates
from markovmill.operators.vocabulary import build_vocabulary, decode_ids, encode, id_words, vocabulary_size, word_ids
from markovmill.plans.lineage import cut, release
from markovmill.plans.model import Model
from markovmill.sources.corpora import prompt_lines, read_files, tokenised
from markovmill.sources.recipe import Recipe, SourceFile
from markovmill.streaming.transitions import TransitionStream, answer_stream

T = WordTokenizer(True, False)
M = 2**32 - 1


def docs(spark, *texts):
    return tokenised(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), T)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_vocabulary(spark):
    words = spark.createDataFrame([(["hello", "world"],)], "tokens array<string>")
    v = build_vocabulary(words)
    assert rows(v) == [(0, "hello"), (1, "world")]
    # 3-byte ids: a byte more for each word than ids of 2
    assert tuple(vocabulary_size(v).first()) == (2, 20)
    assert v.where("word = 'amogus'").count() == 0 and v.where("token = 42").count() == 0
    assert v.agg(word_ids().alias("m")).first().m == {"hello": 0, "world": 1} and v.agg(id_words().alias("m")).first().m == {0: "hello", 1: "world"}
    asked = spark.createDataFrame([(1, ["world", "x", "hello"]), (2, ["y"])], "q int, words array<string>")
    e = {r.q: (r.ids, r.words) for r in encode(asked, v, "q").collect()}
    assert e == {1: ([1, 0], ["world", "hello"]), 2: ([], [])}
    ids = spark.createDataFrame([(1, [1, 9, 0])], "q int, ids array<int>")
    assert decode_ids(ids, v, "q").first().words == ["world", "hello"]


def test_long_words_raise(spark):
    words = spark.createDataFrame([(["x" * 65_536],)], "tokens array<string>")
    with pytest.raises(Exception, match="65535"):
        build_vocabulary(words).collect()


def test_windows_drop_the_last(spark):
    d = docs(spark, "a b c", "", "x")
    assert rows(windows(d, 2, 1)) == [("<|start|>", "a", "b"), ("a", "b", "c")]
    assert ("b", "c", "<|stop|>") in rows(windows(d, 2, 1, include_last=True))
    with pytest.raises(ValueError):
        windows(d, 0, 1)


def test_copies_and_weights(spark):
    d = docs(spark, "a b c", "a b c")
    assert {r["count"] for r in base_transitions(d).collect()} == {1}
    assert {r["count"] for r in count_transitions(d, 2, 1).collect()} == {2}
    assert {r.weight for r in base_transitions(d).collect()} == {2**31}
    assert [r.weight for r in base_transitions(docs(spark, "a b")).collect()] == [M]


@pytest.mark.parametrize("total", [2**24 + 1, 24_857_627, 100_000_001])
def test_totals_beyond_single_precision_are_rounded(spark, total):
    def single(x):
        return struct.unpack("f", struct.pack("f", x))[0]

    n = 3000
    rest = total - n * (n - 1) // 2
    counts = spark.range(1, n).unionByName(spark.createDataFrame([(rest,)], "id bigint")).withColumnRenamed("id", "count")
    got = {r["count"]: r.weight for r in weigh(counts).collect()}
    assert got == {c: min(M, math.floor(single(single(c) / single(total)) * 2**32)) for c in (*range(1, n), rest)}


A = [("1", "2", "3", "4"), ("2", "3", "4", "5"), ("3", "4", "5", "1")]
B = [("1", "0", "1"), ("2", "0", "2"), ("3", "1", "3"), ("4", "1", "4"), ("5", "1", "5")]


@pytest.mark.parametrize(("context", "found"), [(["2"], [0]), (["1", "2"], [0]), (["3"], [1]), (["3", "4"], [2]), (["9"], []), ([], [0, 1, 2]), (["8", "1", "2"], [0])])
def test_lookup_two_to_two(spark, context, found):
    t = spark.createDataFrame([(*r, M // 3) for r in A], "f0 string, f1 string, t0 string, t1 string, weight bigint")
    asked = spark.createDataFrame([(0, context)], "q int, seq array<string>")
    got = find_transitions(asked, t, 2, ["q"])
    assert rows(got.select("f0", "f1", "t0", "t1")) == [A[i] for i in found]


@pytest.mark.parametrize(("context", "found"), [(["1", "0"], [0]), (["5", "1"], [4]), (["0"], [0, 1]), (["1"], [2, 3, 4])])
def test_lookup_two_to_one(spark, context, found):
    t = spark.createDataFrame([(*r, M // 5) for r in B], "f0 string, f1 string, t0 string, weight bigint")
    asked = spark.createDataFrame([(0, context)], "q int, seq array<string>")
    assert rows(find_transitions(asked, t, 2, ["q"]).select("f0", "f1", "t0")) == [B[i] for i in found]


def test_rank(spark):
    d = docs(spark, "a a")
    seeds = spark.createDataFrame([(0, 0)], "expert int, doc_id bigint")
    ranks = {r.word: r.rank for r in X.cluster_ranks(d, seeds, X.term_frequency(d)).collect()}
    assert ranks["a"] == 2 and ranks["<|start|>"] == 0


def test_ties(spark):
    sims = spark.createDataFrame([(0, 0, 1.0), (0, 1, 1.0)], "doc_id bigint, expert int, sim double")
    d = spark.createDataFrame([(0,), (1,)], "doc_id bigint")
    got = {r.doc_id: r.expert for r in X.assign_documents(d, sims, 2).collect()}
    assert got == {0: 1, 1: 1}  # of equal similarity the highest; so without any common word
    low = spark.createDataFrame([(0, 0, -1.0)], "doc_id bigint, expert int, sim double")
    assert X.assign_documents(d, low, 1).where("doc_id = 0").first().sim == -1
    q = sims.withColumnRenamed("doc_id", "query_id")
    assert [r.expert for r in activate(q, 1).collect()] == [0]


def test_cluster_numbers():
    assert X.cluster_numbers(17, 0, 0) == (4, 2) and X.cluster_numbers(1, 0, 0) == (1, 1)
    with pytest.raises(ValueError):
        X.cluster_numbers(7, 4, 2)


def test_invariants(spark):
    d = docs(spark, "a b c d", "a b c d", "b c a", "", "c c c c c", "d a b").cache()
    n, distinct = sum(max(r.n - 3, 0) for r in d.select(F.size("tokens").alias("n")).collect()), sum(max(r.n - 3, 0) for r in d.select("tokens").distinct().select(F.size("tokens").alias("n")).collect())
    base = base_transitions(d)
    assert base.agg(F.sum("count")).first()[0] == distinct
    ranks = X.cluster_ranks(d, X.pick_seeds(d, 2, 2), X.term_frequency(d))
    own = X.assign_documents(d, X.similarity(d, ranks), 2)
    assert own.count() == 6 and own.where("expert is null").count() == 0
    t = X.expert_transitions(d, own)
    assert t.agg(F.sum("count")).first()[0] == n
    assert t.join(base, ["f0", "f1", "t0"], "left_anti").count() == 0
    assert base.agg(F.max("weight")).first()[0] <= M


def test_blending(spark):
    base = spark.createDataFrame([("a", "b", "c", 99), ("a", "b", "d", 299)], "f0 string, f1 string, t0 string, weight bigint")
    own = spark.createDataFrame([(0, "a", "b", "d", 399), (1, "a", "b", "c", 7)], "expert int, f0 string, f1 string, t0 string, weight bigint")
    ranks = spark.createDataFrame([(0, "a", 1.0), (1, "b", -3.0)], "expert int, word string, rank double")
    state = spark.createDataFrame([(0, ["a", "b"])], "query_id int, seq array<string>")
    one = {r.t0: r.p for r in candidates(state, Chains(base, own, ranks, 2, 1, 2), 1).collect()}
    # expert 0 alone: its share is 1, by the root of 2
    assert one["c"] == pytest.approx(100 / 800) and one["d"] == pytest.approx(300 / 800 + 400 / 800 * math.sqrt(2))
    two = {r.t0: r.p for r in candidates(state, Chains(base, own, ranks, 2, 1, 2), 2).collect()}
    # shares 1/-2 and -3/-2
    assert two["c"] == pytest.approx(100 / 808 + 8 / 808 * 1.5) and two["d"] == pytest.approx(300 / 808)
    top = top_candidates(candidates(state, Chains(base, own, ranks, 2, 1, 2), 1), 2, 1, 1)
    assert [r.t0 for r in top.collect()] == ["d"]


def test_zero_similarity_counts_as_epsilon(spark):
    t = spark.createDataFrame([("a", "b", "c", 0)], "f0 string, f1 string, t0 string, weight bigint")
    own = t.select(F.lit(0).alias("expert"), "*")
    ranks = spark.createDataFrame([(0, "z", 1.0)], "expert int, word string, rank double")
    state = spark.createDataFrame([(0, ["a", "b"])], "query_id int, seq array<string>")
    assert candidates(state, Chains(t, own, ranks, 2, 1, 1), 1).first().p == pytest.approx(0.5)


def chain(spark, text, n_from=1, n_to=1):
    return Chains(base_transitions(docs(spark, text), n_from, n_to), None, None, n_from, n_to, 0)


def say(spark, chains, seq, steps, **limits):
    state = spark.createDataFrame([(0, seq)], "query_id int, seq array<string>")
    found, used = generate(state, chains, Limits(**limits), steps)
    r = found.first()
    return r.words, r.done


def test_generation_stops(spark):
    c = chain(spark, "a b c d e")
    assert say(spark, c, ["a"], 2) == (["b", "c"], False)
    assert say(spark, c, ["a"], 9) == (["b", "c", "d", "e"], True)  # nothing follows the last word
    assert say(spark, c, ["a"], 9, stops=("d",)) == (["b", "c"], True)
    assert say(spark, c, ["a"], 9, max_tokens=3) == (["b", "c"], True)
    assert say(spark, c, ["a"], 9, top_k=0) == ([], True)
    assert say(spark, c, ["nowhere"], 9) == ([], True)


def test_generation_gives_longer_transitions_word_by_word(spark):
    c = chain(spark, "a b c d e f g", 1, 2)
    assert say(spark, c, ["a"], 3)[0] == ["b", "c", "d"]
    # tokens that were appended but not given are lost at the limit
    assert say(spark, c, ["a"], 9, max_tokens=3) == (["b"], True)


def test_model_round_trip(spark, tmp_path):
    texts = ["the cat sat on the mat", "the dog sat on the log", "a cat and a dog", "the cat ran"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    recipe = Recipe("m", tokenizer=T, total_experts=2, centroids=1, active_experts=1)
    model = Model.build(spark, recipe, d)
    path = str(tmp_path / "m")
    model.save(path)
    Model.set_key(spark, path, "model.inference.top_k", "1")
    again = Model.load(spark, path)
    assert again.keys["model.inference.top_k"] == "1" and again.limits().top_k == 1
    for a, b in ((model.transitions, again.transitions), (model.expert_transitions, again.expert_transitions), (model.vocabulary, again.vocabulary), (model.ranks, again.ranks)):
        assert rows(a) == rows(b.select(a.columns))
    prompts = spark.createDataFrame([(0, "The cat unknown"), (1, "")], "query_id int, text string")
    found, used = again.generate(prompts, 3)
    assert found.count() == 2 and found.where("query_id = 0").first().words
    assert {r[0] for r in used.groupBy("query_id").agg(F.round(F.sum("frequency"), 9)).select(F.col("round(sum(frequency), 9)")).collect()} <= {0.0, 1.0}
    once, twice = (sorted(tuple(map(str, r)) for r in model.generate(prompts, 3, seed=5)[0].collect()) for _ in range(2))
    assert once == twice
    s = {(r.part, r.expert): (r["items"], r.bytes) for r in model.summary().collect()}
    assert s["base", None][1] == s["base", None][0] * 13 + 2 and s["total", None][1] == sum(v[1] for k, v in s.items() if k[0] != "total")
    Model.build(spark, recipe, d, by_similarity=True).ranks.count()


def test_files(spark, tmp_path):
    (tmp_path / "x.txt").write_text("one two<|document|> three <|document|>")
    (tmp_path / "y.txt").write_text("four--five", encoding="utf-8")
    r = Recipe(files=(SourceFile("x.txt"), SourceFile("y.txt", "--"))).relative_to(f"file://{tmp_path}")
    assert [x.text for x in read_files(spark, r).orderBy("doc_id").collect()] == ["one two", "three", "", "four", "five"]


@pytest.mark.parametrize("end", ["", "--", "--x--", "----"])
def test_files_of_many_blocks(spark, tmp_path, end):
    texts = [f"text {i} " + "é" * (i % 50) + "\nmore" * (i % 3) for i in range(3000)]
    whole = "--".join(texts) + end
    (tmp_path / "a.txt").write_text(whole, encoding="utf-8")
    (tmp_path / "b.txt").write_text("")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in before:
            spark.conf.set(k, "10000")
        found = read_files(spark, Recipe(files=(SourceFile("a.txt", "--"), SourceFile("b.txt", "--"))).relative_to(str(tmp_path)))
        got = [(r.doc_id, r.text) for r in found.orderBy("doc_id").collect()]
        assert found.rdd.getNumPartitions() > 10
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = [t.strip() for t in whole.split("--")]
    assert got == [*enumerate(want), (1 << 40, "")]
    with pytest.raises(FileNotFoundError):
        read_files(spark, Recipe(files=(SourceFile("no.txt"),)).relative_to(str(tmp_path)))


def test_bytes_that_are_not_text_raise(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"fine--\xff\xfe")
    with pytest.raises(Exception, match="UTF|utf"):
        read_files(spark, Recipe(files=(SourceFile("a.txt", "--"),)).relative_to(str(tmp_path))).collect()


def test_prompt_lines_are_numbered_in_order(spark, tmp_path):
    (tmp_path / "p.txt").write_text("\n".join(f" prompt {i} " for i in range(2000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
        got = [(r.query_id, r.text) for r in prompt_lines(spark, str(tmp_path / "p.txt")).orderBy("query_id").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [(i, f"prompt {i}") for i in range(2000)]


def test_words_of_one_prefix_are_ranked(spark):
    words = spark.createDataFrame([([f"pre{i}" for i in range(5000)],), (["pre7", "é", "z"],)], "tokens array<string>")
    got = [r.word for r in build_vocabulary(words).orderBy("token").collect()]
    assert got == sorted({"é", "z", *(f"pre{i}" for i in range(5000))}, key=str.encode)


def test_draws_among_candidates_at_the_floor(spark):
    top = spark.createDataFrame([(0, "a", 1, 2.0**-52), (0, "b", 2, 2.0**-52), (0, "c", 3, 2.0**-52)], "query_id int, t0 string, place int, p double")
    assert [draw(top, F.lit(u)).first().t0 for u in (0.0, 0.5, 0.9, 1.0)] == ["a", "b", "c", "c"]


def test_sums_over_a_sequence_are_those_of_its_steps(spark):
    """The experts that a step activates are those of the whole sequence, computed anew."""
    texts = ["a b c d e f g", "c d e b a", "f g a b c c", "e e f a d"]
    d = docs(spark, *texts).cache()
    ranks = X.cluster_ranks(d, X.pick_seeds(d, 2, 2), X.term_frequency(d))
    own = X.expert_transitions(d, X.assign_documents(d, X.similarity(d, ranks), 2), 1, 1)
    ranks = cut(ranks)
    chains = Chains(cut(base_transitions(d, 1, 1)), cut(own), ranks, 1, 1, 2)
    asked = spark.createDataFrame([(0, ["a"]), (1, ["c", "d"]), (2, ["none"])], "query_id int, seq array<string>")
    found, used = generate(asked, chains, Limits(1, 3, 8), 8, seed=3)
    words, uses = {r.query_id: r.words for r in found.collect()}, {(r.query_id, r.expert): r.uses for r in used.collect()}
    state, count = {0: ["a"], 1: ["c", "d"], 2: ["none"]}, {}
    for step in range(8):
        live = {k: s for k, s in state.items() if len(s) < 8}
        rows_ = spark.createDataFrame(list(live.items()), "query_id int, seq array<string>") if live else None
        if rows_ is None:
            break
        for r in activate(similarities(rows_, ranks, 2), 1).collect():
            count[r.query_id, r.expert] = count.get((r.query_id, r.expert), 0) + 1
        picked = {r.query_id: r.t0 for r in predict(rows_, chains, 1, 3, F.lit(step), 3).collect()}
        state = {k: [*s, picked[k]] if k in picked and picked[k] not in Limits().stops else [*s, *["end"] * 8] for k, s in live.items()} | {k: s for k, s in state.items() if k not in live}
    want = {k: [w for w in s if w != "end"] for k, s in state.items()}
    assert {k: w for k, w in words.items()} == {0: want[0][1:], 1: want[1][2:], 2: []}
    assert {k: n for k, n in uses.items() if n} == count


def test_cut_tables_are_released(spark):
    import os

    one = cut(spark.range(3))
    at = one.cut_path.removeprefix("file://")
    assert os.path.isdir(at)
    release(one, None)
    assert not os.path.exists(at)


def test_streams(spark, tmp_path):
    schema = "doc_id bigint, text string"
    for i, t in enumerate((["a b c", "a b c", "b c d e"], ["a b c", "c d e f"])):
        spark.createDataFrame([(10 * i + k, x) for k, x in enumerate(t)], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    s = TransitionStream(str(tmp_path / "state"), T)
    s.start(stream, str(tmp_path / "check"), available_now=True).awaitTermination(120)
    whole = base_transitions(docs(spark, "a b c", "b c d e", "c d e f"))
    got = s.transitions(spark)
    assert rows(got.select(whole.columns)) == rows(whole)

    model = Model.build(spark, Recipe(tokenizer=T, total_experts=1, centroids=1, from_depth=1), spark.createDataFrame([(0, "a b c d")], schema))
    spark.createDataFrame([(1, "a")], "query_id bigint, text string").write.json(str(tmp_path / "asked"))
    asked = spark.readStream.schema("query_id bigint, text string").json(str(tmp_path / "asked"))
    out = []
    answer_stream(asked, model, lambda df, n: out.extend(df.collect()), 2, str(tmp_path / "check2"), None, True).awaitTermination(120)
    assert [r.words for r in out] == [["b", "c"]]


def corpus(spark):
    return cut(docs(spark, "a b c a b d", "a b c a b d", "b c a b e", "c a b", "", "a b d b c a", "x y"))


def test_one_pass_gives_both_chains_and_those_near_prompts(spark):
    d = corpus(spark)
    own = d.select("doc_id", (F.col("doc_id") % 3).cast("int").alias("expert"))
    base, each = base_transitions(d), X.expert_transitions(d, own)
    marked = X.marks(d, own)
    both = X.mixed_transitions(d, marked, 4).cache()
    assert rows(both.select("f0", "f1", "t0", "count", "weight")) == rows(base)
    held = both.select(F.posexplode("own").alias("expert", "w"), "f0", "f1", "t0", "counts").where("w IS NOT NULL")
    assert rows(held.selectExpr("expert", "f0", "f1", "t0", "counts[expert]", "w")) == rows(each.select("expert", "f0", "f1", "t0", "count", "weight"))
    asked = cut(spark.createDataFrame([(0, ["z", "a", "b"]), (1, ["b"]), (2, ["a", "b"]), (3, ["q", "q"])], "query_id int, seq array<string>"))
    few = X.mixed_transitions(d, marked, 4, near=asked)
    assert rows(few) == rows(both.where("f1 = 'b'")) and few.count()
    # what is dealt out is what follows the prompts: no exchange before the join with them
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=broadcast") >= 2


@pytest.mark.parametrize("seed", [None, 5])
def test_generation_by_an_index(spark, seed, monkeypatch):
    d = corpus(spark)
    ranks = cut(X.cluster_ranks(d, cut(X.pick_seeds(d, 2, 2)), X.term_frequency(d)))
    own = X.assign_documents(d, X.similarity(d, ranks), 2)
    marked = X.marks(d, own)
    both = index(X.mixed_transitions(d, marked, 2, groups=3).drop("counts"))
    prompts = cut(spark.createDataFrame([(i, s.split()) for i, s in enumerate(("a b", "b", "c a", "x a b", "<|start|>", "q q", "y a b"))], "query_id int, seq array<string>"))
    active = 0 if seed is None else 1
    limits = Limits(active, 3, 12)
    plain = generate(prompts, Chains(base_transitions(d), X.expert_transitions(d, own), ranks, 2, 1, 2), limits, 12, seed)
    asked = []
    monkeypatch.setattr("markovmill.operators.generate.near", lambda t, groups: asked.append(groups) or near(t, groups))
    fast = generate(prompts, Chains(None, None, ranks, 2, 1, 2, both, 3), limits, 12, seed)
    assert rows(fast[0]) == rows(plain[0]) and rows(fast[1]) == rows(plain[1])
    assert asked and all(set(g) <= {0, 1, 2} for g in asked)
    # a step reads the folders of its contexts alone
    assert {r.group_ for r in both.where(F.col("group_").isin([1])).select("group_").collect()} <= {1}


def test_alike_prompts_are_one_query(spark, monkeypatch):
    d = corpus(spark)
    prompts = cut(spark.createDataFrame([(i, [w, "a", "b"]) for i, w in enumerate("abcdefgh")] + [(8, ["x"] * 30)], "query_id int, seq array<string>"))
    sizes, own = [], generate.__globals__["_generate"]
    monkeypatch.setitem(generate.__globals__, "_generate", lambda p, *a: sizes.append(p.count()) or own(p, *a))
    got = rows(generate(prompts, Chains(base_transitions(d), None, None, 2, 1, 0), Limits(0, 1, 9), 9)[0])
    assert sizes == [2] and len(got) == 9 and len({tuple(r[1]) for r in got[:8]}) == 1 and got[0][1] and got[8][1:] == ([], True)


def test_counts_of_documents_deal_out_words_alone(spark):
    d = corpus(spark)
    found = {r.word: (r.docfreq, r.tf) for r in X.term_frequency(d).collect()}
    tokens = [r.tokens for r in d.collect()]
    n = sum(map(len, tokens))
    assert found == {w: (k, k / n) for w in {x for t in tokens for x in t} for k in [sum(w in t for t in tokens)]}
    assert "doc_id" not in X.word_documents(d)._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]


def test_totals_and_rows_share_one_count(spark):
    d = corpus(spark)
    found = base_transitions(d)
    joined = found.join(build_vocabulary(d), found.f0 == F.col("word"))
    joined.collect()
    plan = joined._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[0]
    # windows are made once, and read again for the totals
    assert plan.count("Generate inline") == 1 and "ReusedExchange" in plan
