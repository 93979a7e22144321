"""Vectors, line dedup, n-gram join, decontamination and revisits: edge cases and brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from markovmill.llm import queries as Q
from markovmill.llm.common import components, forest
from markovmill.llm.decontamination import find_contamination, without_contaminated
from markovmill.llm.embedding_dedup import near_duplicates
from markovmill.llm.line_dedup import dedup_lines, split_lines, without_repeats
from markovmill.llm.ngram_join import least_matches, ngram_join, one_of_each, shared_shingles
from markovmill.llm.revisits import canonical_url, page_records, resolve_revisits
from markovmill.llm.shingles import WordHashes, shingles, word_hashes

DIR = "/root/testdata/sf0.001"


def prose(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choices(["ba", "co", "di", "fu", "ge", "ha", "ki"], k=3)) for _ in range(n)]


def classes(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    want = classes(2000, edges)
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: want[i] for e in edges if e[0] != e[1] for i in e}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
    a, b = np.array([e[0] for e in edges]), np.array([e[1] for e in edges])
    assert forest(2000, a, b).tolist() == want


# --- vectors


def vector_truth(vectors, near=0.9):
    good = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    n = len(vectors)
    links = []
    for i in range(n):
        for j in range(i):
            if good[i] and good[j] and len(vectors[i]) == len(vectors[j]):
                a, b = np.array(vectors[i]), np.array(vectors[j])
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= near:
                    links.append((i, j))
    count = Counter(i for p in links for i in p)
    return [count[i] for i in range(n)], classes(n, links)


def test_vectors(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8))
    vectors = [(c + rng.normal(size=8) * s).tolist() for c in centres for s in (0, 0, 0.05, 0.1, 0.2, 0.3)] + rng.normal(size=(30, 8)).tolist()
    vectors += [None, [], [0.0] * 8, [None] + [1.0] * 7, [float("nan")] * 8, [float("inf")] + [0.0] * 7, [1.0, 2.0], [2.0 * x for x in vectors[0]]]
    rows = [(i, v, "x", i, i) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, shard string, n_links int, component_id int").repartition(3)
    got = near_duplicates(df).orderBy("vec_id").collect()
    count, own = vector_truth(vectors)
    assert [r.n_links for r in got] == count and [r.component_id for r in got] == own
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert near_duplicates(df.limit(0)).count() == 0
    assert near_duplicates(df.where("vec_id >= 102 and vec_id < 108")).where("n_links = 0 and kept").count() == 6
    twice = near_duplicates(df.unionByName(df.where("vec_id in (0, 3)"))).where("vec_id = 0").select("n_links").distinct().collect()
    assert [r.n_links for r in twice] == [count[0]]
    assert near_duplicates(spark.createDataFrame([(None, [1.0, 0.0]), (1, [1.0, 0.0])], "vec_id bigint, embedding array<double>")).where("n_links > 0").count() == 0


def test_vectors_of_several_lengths_and_sizes(spark):
    rng = np.random.default_rng(11)
    vectors = rng.normal(size=(30, 3)).tolist() + [[1.0, 0.01], [1.0, 0.0], [5.0], [7.0], [-7.0]]
    vectors += [[1e200, 1e200, 0.0], [1e201, 1e201, 0.0], [1e-200, 0.0, 1e-200], [3e-300, 0.0, 3e-300], [5e-324, 0.0, 5e-324]]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id bigint, embedding array<double>").repartition(3)
    got = near_duplicates(df).orderBy("vec_id").collect()
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        scaled = [(np.array(v) / np.abs(v).max()).tolist() for v in vectors]
    count, own = vector_truth(scaled)
    assert [r.n_links for r in got] == count and [r.component_id for r in got] == own
    assert count[30] == count[32] == 1 and count[34] == 0 and min(count[35:]) >= 1


def test_vectors_without_a_common_shard(spark, monkeypatch):
    """A chain of near vectors over many shards: links between vectors of different shards come from the joined lists."""
    import markovmill.llm.embedding_dedup as E

    monkeypatch.setattr(E, "SHARD_ROWS", 15)
    monkeypatch.setattr(E, "OVERLAP", (2,))
    monkeypatch.setattr(E, "LEAST_RECALL", 0.0)
    angle = np.linspace(0, np.pi, 240)
    vectors = np.stack([np.cos(angle), np.sin(angle)], 1).tolist()
    got = near_duplicates(spark.createDataFrame(list(enumerate(vectors)), "vec_id bigint, embedding array<double>")).orderBy("vec_id").collect()
    count, own = vector_truth(vectors)
    shared = sum(min(r.n_links, c) for r, c in zip(got, count)) / sum(count)
    assert all(r.n_links <= c for r, c in zip(got, count)) and shared > 0.6 and [r.component_id for r in got] == own


def test_vectors_of_a_hot_cluster(spark, monkeypatch):
    import markovmill.llm.embedding_dedup as E

    monkeypatch.setattr(E, "BLOCK", 60)
    rng = np.random.default_rng(6)
    vectors = ([1.0] + [0.0] * 7 + rng.normal(size=(200, 8)) * 0.08).tolist() + rng.normal(size=(60, 8)).tolist()
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id bigint, embedding array<double>")
    got = near_duplicates(df).orderBy("vec_id").collect()
    count, own = vector_truth(vectors)
    assert all(r.n_links <= c for r, c in zip(got, count))
    assert sum(r.n_links for r in got) >= 0.97 * sum(count) and [r.component_id for r in got] == own


def test_vectors_of_small_groups_beside_a_hot_one(spark, monkeypatch):
    import markovmill.llm.embedding_dedup as E

    rng = np.random.default_rng(9)
    hot = ([1.0] + [0.0] * 7 + rng.normal(size=(150, 8)) * 0.05).tolist()
    pairs = [(c + rng.normal(size=8) * 0.02).tolist() for c in rng.normal(size=(60, 8)) for _ in (0, 1)]
    vectors = hot + pairs
    search = E._search

    def lossy(dealt, graph, once, near):  # of the small groups nothing is found, whatever the overlap
        return search(dealt, graph, once, near).where(f"id < {len(hot)}")

    monkeypatch.setattr(E, "_search", lossy)
    monkeypatch.setattr(E, "BLOCK", 100)
    got = near_duplicates(spark.createDataFrame(list(enumerate(vectors)), "vec_id bigint, embedding array<double>")).orderBy("vec_id").collect()
    count, own = vector_truth(vectors)
    assert [r.n_links for r in got] == count and [r.component_id for r in got] == own and got[0].audited_recall == 1.0


def test_vector_query(spark):
    rows = spark.read.parquet(f"{DIR}/embeddings.parquet").orderBy("vec_id").collect()
    got = Q.op1_embedding_neardup(spark, DIR).orderBy("vec_id").collect()
    assert [r.vec_id for r in got] == [r.vec_id for r in rows]
    x = np.array([r.embedding for r in rows], dtype=np.float64)
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    assert [r.n_links for r in got] == near.sum(1).tolist()


# --- lines


def test_lines_join_to_the_text():
    for t in ("", "a", "a. b\n\nc! d", " \n x", "word " * 300 + "end.", "x" * 500):
        assert "".join(t[a:b] for a, b in split_lines(t)) == t


def lines_of(text):
    return [text[a:b].strip() for a, b in split_lines(text or "")]


def test_line_dedup(spark):
    passage = " ".join(prose(1, 30)) + "."
    long_ = ". ".join(" ".join(prose(i, 14)) for i in range(400))
    texts = [f"{' '.join(prose(2, 20))}. {passage}", f"Start here. {passage}\nOther words at the end of it.", None, "", "Short. Short. Short.", long_, f"{long_[:500]}", passage, passage]
    rows = [(i, t, len(t or ""), "r", i) for i, t in enumerate(texts)] + [(None, passage, 1, "r", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint, runs string, doc bigint").repartition(3)
    got = {r.doc_id: r for r in dedup_lines(df).collect()}
    assert got[0].text == texts[0] and got[2].text is None and got[3].text == "" and got[4].text == texts[4] and got[5].text == long_
    assert got[None].text == passage and got[7].text == got[8].text == ""
    assert got[1].text == "Start here. Other words at the end of it." and got[1].n_removed == 1 and got[1].n_chars == len(got[1].text)
    assert got[6].n_removed > 0
    assert dedup_lines(df.limit(0)).count() == 0
    kept = without_repeats(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {0, 1, 2, 3, 4, 5, 6, None} - ({6} if not got[6].text.strip() else set())
    # rows that repeat an id and a text stay
    twice = spark.createDataFrame([(1, passage), (1, passage)], "doc_id bigint, text string")
    assert dedup_lines(twice).where("n_removed > 0").count() == 0


def dedup_truth(docs, run=12):
    """Texts by id without the lines of each shortest stretch of `run` words, from a line on or up to one, that stands earlier."""
    seen, out = {}, {}
    for k in sorted(docs):
        own = [docs[k][a:b] for a, b in split_lines(docs[k])]
        words = [x.split() for x in own]
        gone = set()
        for i in range(len(own)):
            for way in (1, -1):
                j, n = i, 0
                while 0 <= j < len(own) and n + len(words[j]) < run:
                    n, j = n + len(words[j]), j + way
                if 0 <= j < len(own):
                    span = range(min(i, j), max(i, j) + 1)
                    if seen.setdefault(tuple(tuple(words[x]) for x in span), (k, span[0])) < (k, span[0]):
                        gone.update(span)
        out[k] = "".join(x for i, x in enumerate(own) if i not in gone)
    return out


def test_line_dedup_query(spark):
    for d in (DIR, "/root/testdata/sf0.01"):
        docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
        got = {r.doc_id: r for r in Q.op4_line_dedup(spark, d).collect()}
        truth = dedup_truth(docs)
        assert {k: r.text for k, r in got.items()} == truth
        assert all(len(docs[k].split()) - r.n_words_removed == len(r.text.split()) and (r.n_removed > 0) == (r.text != docs[k]) for k, r in got.items())


def removed_truth(texts, run=12):
    """Lines that lie in a run of that many words which stands before, in a lower text or earlier in the same one, by all pairs of places."""
    lines = [lines_of(t) for t in texts]
    gone = [set() for _ in texts]
    for d, own in enumerate(lines):
        for i in range(len(own)):
            for e in range(d + 1):
                for j in range(len(lines[e]) if e < d else i):
                    n = 0
                    while i + n < len(own) and j + n < len(lines[e]) and own[i + n] == lines[e][j + n]:
                        n += 1
                    if sum(len(x.split()) for x in own[i : i + n]) >= run:
                        gone[d].update(range(i, i + n))
    return gone


def test_line_dedup_of_runs_around_frequent_lines(spark):
    rng = random.Random(4)
    pool = [" ".join(prose(i, rng.randint(1, 8))) for i in range(25)]
    texts = ["\n".join(rng.choices(pool, k=rng.randint(1, 25))) for _ in range(40)]
    texts += ["\n".join(texts[i].split("\n")[2:]) for i in range(20)]
    # a frequent line stands first among others; two later texts share a run around it
    run = ["\n".join([" ".join(prose(900 + i, 6)), line, " ".join(prose(950 + i, 6))]) for i, line in enumerate(pool)]
    texts += [f"{a} {i} of its own\n{t}" for i, t in enumerate(run) for a in ("one", "two")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: r for r in dedup_lines(df).collect()}
    truth = removed_truth(texts)
    assert sum(map(len, truth)) > 100
    for d, t in enumerate(texts):
        assert got[d].text == "".join(t[a:b] for i, (a, b) in enumerate(split_lines(t)) if i not in truth[d])
    for i in range(len(pool)):
        assert got[60 + 2 * i + 1].text.strip() == f"two {i} of its own"


@pytest.mark.parametrize("white", ["  ", "\t", "\u00a0", " \u3000"])
def test_line_dedup_whatever_the_white_space(spark, white):
    line, long_ = " ".join(prose(1, 13)) + ".", " ".join(prose(2, 60)) + "."
    short = "\n".join(" ".join(prose(i, 5)) for i in range(10, 13))
    texts = [x for t in (line, long_, short) for x in (t, t.replace(" ", white), t)]
    texts += [white.join(prose(3, 13)), white.join(prose(3, 13)), white.join(prose(4, 6)), white.join(prose(4, 6))]
    got = {r.doc_id: r for r in dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    gone = {1, 2, 4, 5, 7, 8, 10}
    assert all(got[i].text == ("" if i in gone else t) for i, t in enumerate(texts))


def test_line_dedup_of_passages_in_running_text(spark):
    rng = random.Random(12)
    words = lambda n: ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(n)]
    passages = [words(51) for _ in range(150)]
    texts = [" ".join(words(60) + p + words(60)) for p in passages for _ in (0, 1)]
    got = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    for i, p in enumerate(passages):
        assert got[2 * i] == texts[2 * i]
        left = set(got[2 * i + 1].split())
        # all of it goes but up to 12 words at each end, and nothing else does
        assert not left & set(p[12:-12]) and left >= set(texts[2 * i + 1].split()) - set(p)


# --- n-grams


def sets(texts):
    known = WordHashes()
    return [set(shingles(word_hashes(t or "", known)).tolist()) for t in texts]


def join_truth(texts, threshold=0.8):
    s = sets(texts)
    links = [(i, j) for i in range(len(s)) for j in range(i) if s[i] and s[j] and len(s[i] & s[j]) >= threshold * len(s[i] | s[j]) - 1e-9]
    count = Counter(i for p in links for i in p)
    return [count[i] for i in range(len(s))], classes(len(s), links)


def near_copies(seed, n, copies, changes):
    rng = random.Random(seed)
    base, out = prose(seed, n), []
    for _ in range(copies):
        w = list(base)
        for _ in range(rng.randint(0, changes)):
            w[rng.randrange(n)] = f"new{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_posterior():
    assert least_matches(100, 0.8) < 80 and least_matches(20, 0.8) < least_matches(100, 0.8)
    assert least_matches(20, 0.8, 0.5) >= 16


def test_shared_shingles():
    rng = np.random.default_rng(1)
    s = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(30)]
    i, j = np.triu_indices(30, 1)
    want = [len(np.intersect1d(s[a], s[b])) for a, b in zip(i, j)]
    assert shared_shingles(s, i, j).tolist() == want
    assert shared_shingles(s, i[:5], j[:5]).tolist() == want[:5]


def test_ngram_join(spark, monkeypatch):
    texts = near_copies(1, 120, 40, 4) + near_copies(2, 300, 12, 10) + near_copies(3, 60, 6, 2) + [" ".join(prose(10 + i, 80)) for i in range(20)]
    texts += [None, "", "...", "one two", "One, two!", "one two three", " ".join(prose(99, 30_000)), texts[0], texts[0].upper()]
    rows = [(i, t, 1, "c", i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, class_id int, rep string, n_links int").repartition(3)
    count, own = join_truth(texts)
    for most, shingles_ in ((512, 1 << 22), (16, 1 << 22), (512, 1_500)):
        monkeypatch.setattr("markovmill.llm.ngram_join.BLOCK_SHINGLES", shingles_)
        got = ngram_join(df, most=most).orderBy("doc_id").collect()
        assert [r.n_links for r in got] == count and [r.class_id for r in got] == own
        assert all(r.kept == (r.doc_id == r.class_id) for r in got)
    assert ngram_join(df.limit(0)).count() == 0
    kept = one_of_each(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(own)


def test_ngram_join_of_repeated_rows_and_null_ids(spark):
    a, b = " ".join(prose(1, 50)), " ".join(prose(2, 50))
    df = spark.createDataFrame([(1, a), (1, a), (2, a + " more"), (3, b), (3, a), (None, a), (None, None)], "doc_id bigint, text string")
    got = {(r.doc_id, r.kept): (r.class_id, r.n_links) for r in ngram_join(df).collect()}
    assert got[1, True][0] == 1 and got[2, False][0] == 1 and got[None, True] == (None, 0)
    assert one_of_each(df).where("doc_id is null").count() == 2


def test_ngram_join_of_an_id_with_many_texts(spark):
    """Rows of one id don't link with each other, and each of them links with others."""
    texts = near_copies(4, 100, 60, 3)
    df = spark.createDataFrame([(1, t) for t in texts] + [(1, texts[0])] * 50 + [(2, texts[0]), (3, " ".join(prose(77, 100)))], "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: r for r in ngram_join(df, most=16).collect()}
    assert got[1].class_id == got[2].class_id == 1 and got[2].n_links >= 1 and got[3].n_links == 0 and got[3].kept


def test_ngram_join_query(spark):
    rows = spark.read.parquet(f"{DIR}/documents.parquet").orderBy("doc_id").collect()
    count, own = join_truth([r.text for r in rows])
    got = Q.op8_ngram_join(spark, DIR).orderBy("doc_id").collect()
    assert [r.n_links for r in got] == count and [r.class_id for r in got] == [rows[i].doc_id for i in own]


# --- decontamination


def test_decontamination(spark):
    items = [" ".join(prose(i, n)) for i, n in enumerate((5, 9, 30, 70, 150))] + [None, "", "two words", " ".join(prose(2, 30))]
    half = " ".join(prose(2, 30)[:20])
    texts = [" ".join(prose(50 + i, 3000)) + " " + t + ". " + " ".join(prose(70 + i, 500)) for i, t in enumerate(items[:5])]
    texts += [None, "", items[2].upper(), half, "two words", " ".join(prose(90, 200)), " ".join(prose(3, 70)[:62])]
    docs = spark.createDataFrame([(i, t, i, "x") for i, t in enumerate(texts)] + [(0, texts[0], 0, "x")], "doc_id bigint, text string, item_id int, item string").repartition(3)
    tests = spark.createDataFrame([(i, t, i) for i, t in enumerate(items)], "item_id bigint, text string, doc_id int")
    s, q = sets(texts), sets(items)
    want = Counter((d, i) for d in [*range(len(texts)), 0] for i in range(len(items)) if q[i] and len(q[i] & s[d]) >= 0.8 * len(q[i]))
    found = find_contamination(docs, tests).collect()
    assert Counter((r.doc_id, r.item_id) for r in found) == want
    assert all(r.n_shared == len(q[r.item_id] & s[r.doc_id]) and r.n_item_shingles == len(q[r.item_id]) for r in found)
    assert find_contamination(docs.limit(0), tests).count() == 0 and find_contamination(docs, tests.limit(0)).count() == 0
    clean = without_contaminated(docs, tests)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == set(range(len(texts))) - {d for d, _ in want}
    with pytest.raises(ValueError):
        find_contamination(docs, tests, least=0)


def test_decontamination_in_rounds(spark, monkeypatch):
    """Many items, long ones, and repeated rows of items: the same rows, whatever goes to a scan."""
    items = [" ".join(prose(i, 20 + i)) for i in range(12)]
    docs = spark.createDataFrame([(i, " ".join(prose(100 + i, 200)) + " " + items[i % 12]) for i in range(40)], "doc_id bigint, text string")
    tests = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(3, items[3])] * 2 + [(3, items[4])], "item_id bigint, text string")
    want = Counter((i, i % 12) for i in range(40)) + Counter((i, 3) for i in range(40) for _ in range({3: 2, 4: 1}.get(i % 12, 0)))
    for bounds in ((50_000, 1 << 25), (3, 1 << 25), (50_000, 400)):
        monkeypatch.setattr("markovmill.llm.decontamination.ITEMS_AT_ONCE", bounds[0])
        monkeypatch.setattr("markovmill.llm.decontamination.CHARACTERS_AT_ONCE", bounds[1])
        assert Counter((r.doc_id, r.item_id) for r in find_contamination(docs, tests).collect()) == want


def test_decontamination_of_items_of_a_few_words(spark):
    items = [" ".join(f"w{i}x{k}" for k in range(5 + i % 4)) for i in range(8)]
    docs = [(i, " ".join(prose(i, 300)) + " " + items[i % 8] + " " + " ".join(prose(5000 + i, 300))) for i in range(800)]
    found = find_contamination(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(i, i % 8) for i in range(800)}


# --- revisits

RECORD = "record_id bigint, url string, kind string, at bigint, etag string, last_modified string, digest string, headers map<string,string>, canonical_url string, stretch int"


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTPS://www.Example.com:443/a/index.html#x", "example.com/a"),
        ("http://m.example.com/b.html?utm_source=f&z=1&a=2", "example.com/b?a=2&z=1"),
        ("http://u:p@example.com:8080//", "example.com:8080"),
        ("http://example.com?ref=x", "example.com"),
        ("http://example.com/A?page=2&ref=x", "example.com/A?page=2"),
        ("", None),
        ("mailto:x", None),
        (None, None),
    ],
)
def test_canonical_url(spark, url, want):
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(url,)], "url string").select(canonical_url(F.col("url")).alias("u")).first().u == want


def revisit_truth(rows):
    out = {}
    for r in rows:
        if r[2] != "revisit":
            continue
        at = -(2**63) if r[3] is None else r[3]
        if r[1] is None:
            out[r[0]] = ("no_url", None)
            continue
        earlier = [x for x in rows if x[2] == "response" and x[1] == r[1] and (-(2**63) if x[3] is None else x[3]) < at]
        if not earlier:
            out[r[0]] = ("no_response", None)
            continue
        best = max(earlier, key=lambda x: (-(2**63) if x[3] is None else x[3], x[0]))
        shared = [(a, b) for a, b in zip(r[4:7], best[4:7]) if a is not None and b is not None]
        out[r[0]] = ("no_validator", None) if not shared else ("resolved" if shared[0][0] == shared[0][1] else "changed", best[0])
    return out


def test_revisits_like_brute_force(spark):
    rng = random.Random(3)
    pick = lambda *x: rng.choice(x)
    rows = [(i, pick("http://hot.org/a", "http://hot.org/a", "http://b.org/", "http://c.org/x?y=1", None), pick("response", "revisit", "request"), pick(None, *range(40)), pick(None, '"1"', '"2"'), pick(None, "mon"), pick(None, "d1", "d2"), pick(None, {"Date": str(i)}), "x", 1) for i in range(400)]
    df = spark.createDataFrame(rows, RECORD).repartition(4)
    got = {r.record_id: (r.outcome, r.resolved_id) for r in resolve_revisits(df).collect()}
    assert got == revisit_truth(rows)
    assert resolve_revisits(df.limit(0)).count() == 0
    assert resolve_revisits(df.unionByName(df)).count() == 2 * len(got)


def test_page_records_like_brute_force(spark):
    urls = ["http://a.org/x", "https://www.a.org/x/index.html", "http://b.org/", None, "no url", "http://c.org/1?utm_source=f"]
    rng = random.Random(8)
    pages = [(i, rng.choice(urls), rng.choice(["one", "two", "three", f"page {i}", None])) for i in range(300)] + [(None, "http://a.org/x", "x"), (2**62 + 5, "http://a.org/x", "y"), (2**63 - 1, "http://a.org/x", "z"), (-5, "http://b.org/", "w")]
    records = page_records(spark.createDataFrame(pages, "page_id bigint, url string, html string").repartition(3))
    # the brute force's order of ids: null first, as in columns
    key = lambda r: (-(2**63) if r.page is None else r.page, r.visit)
    from pyspark.sql import functions as F

    rows = [(key(r.record_id), r.u, r.kind, r.at, r.etag and r.etag.removeprefix("W/"), r.last_modified, r.digest) for r in records.withColumn("u", canonical_url(F.col("url"))).collect()]
    want = revisit_truth(rows)
    got = {key(r.record_id): (r.outcome, r.resolved_id and key(r.resolved_id)) for r in resolve_revisits(records).collect()}
    assert got == want and Counter(o for o, _ in got.values()).keys() == {"resolved", "changed", "no_response", "no_validator", "no_url"}


def test_revisit_query_has_each_outcome(spark):
    found = Q.op10_warc_revisits(spark, "/root/testdata/sf0.01")
    assert found.count() == 500
    assert {"resolved", "no_response"} <= {r.outcome for r in found.select("outcome").distinct().collect()}


def test_headers(spark):
    rows = [(1, "http://a.org", "response", 1, 'W/"1"', None, None, {"ETag": "1", "Content-Length": "9", "X": "old"}, None, 1), (2, "https://www.a.org/", "revisit", 2, '"1"', None, None, {"content-length": "0", "x": "new", "Date": "d"}, None, 1), (3, "http://a.org", "revisit", 3, '"2"', None, None, None, None, 1)]
    got = {r.record_id: r for r in resolve_revisits(spark.createDataFrame(rows, RECORD)).collect()}
    assert got[2].headers == {"etag": "1", "content-length": "9", "x": "new", "date": "d"} and got[2].outcome == "resolved"
    assert got[3].outcome == "changed" and got[3].headers is None and got[3].resolved_id == 1
