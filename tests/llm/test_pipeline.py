"""The pipeline against its stages' operators and plain Python."""

import corpus_pipeline
import duckdb
import pytest

from markovmill.llm import queries as Q
from markovmill.llm.common import cut
from markovmill.llm.encoding import load_tokenizer, tokenizer_path
from markovmill.llm.toxicity import fit_toxicity
from test_duplicate_operators import dedup_truth, join_truth, sets
from test_text_operators import brute_score, check_packing

DIR = "/root/testdata/sf0.001"


def test_stages_and_run_like_brute_force(spark):
    """Each stage against plain Python over what its predecessor kept, and run() against the last one's pieces."""
    table = spark.read.parquet(f"{DIR}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_join", "decontamination", "packing"]
    stages = dict(corpus_pipeline.STAGES)
    rows = {r.doc_id: r for r in table.collect()}
    texts = {k: r.text for k, r in rows.items()}

    def next_(name, docs, want):
        out = cut(stages[name](spark, docs, DIR))
        got = {r.doc_id: r for r in out.collect()}
        assert out.columns == table.columns and out.count() == len(got) <= len(rows)
        assert {k: r.text for k, r in got.items()} == want, name
        # other columns stay as they are, but for the number of characters
        assert all((r.lang, r.source, r.n_chars) == (rows[k].lang, rows[k].source, len(r.text) if r.text != rows[k].text else rows[k].n_chars) for k, r in got.items())
        return out, want

    model = fit_toxicity(table, spark.read.parquet(f"{DIR}/labels.parquet"))
    docs, texts = next_("toxicity", table, {k: t for k, t in texts.items() if brute_score(t, model)[0] < 0.5})
    left, once = dedup_truth(texts), {k: dedup_truth({k: t})[k] for k, t in texts.items()}
    gone = {k for k, t in left.items() if t != texts[k] and len(t.split()) <= corpus_pipeline.LEAST_LEFT * len(once[k].split())}
    docs, texts = next_("line_dedup", docs, {k: t for k, t in left.items() if k not in gone})
    ids = sorted(texts)
    own = join_truth([texts[k] for k in ids])[1]
    docs, texts = next_("ngram_join", docs, {k: texts[k] for i, k in enumerate(ids) if own[i] == i})
    items = [i for i in sets([r.text for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]) if i]
    held = dict(zip(texts, sets(texts.values())))
    docs, texts = next_("decontamination", docs, {k: t for k, t in texts.items() if not any(len(i & held[k]) >= 0.8 * len(i) for i in items)})
    packed = corpus_pipeline.run(spark, DIR).collect()
    check_packing(packed, texts, load_tokenizer(tokenizer_path("byte_bpe_50k.json")))
    assert sorted(map(tuple, packed)) == sorted(map(tuple, stages["packing"](spark, docs, DIR).collect()))


def test_stages_of_odd_rows(spark):
    """Nulls in each column, empty and very long texts, ties, repeated rows and ids, extra columns with names that stages use."""
    long_ = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(1, "a b c d e f", None, "s", 1, 2, "x"), (1, "a b c d e f", None, "s", 1, 2, "x"), (2, None, "en", None, None, None, None), (3, "", "en", "s", 0, 1, ""), (None, "no id", None, None, 5, 1, "y"), (None, None, None, None, None, None, None), (4, long_, "en", "s", 9, 9, "z"), (5, long_, "en", "s", 9, 9, "z"), (5, "another text of that id", "en", "s", 9, 9, "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, n_removed int, doc string").repartition(2)
    before = sorted(map(repr, docs.collect()))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DIR)
        kept = sorted(map(repr, out.collect()))
        assert out.columns == docs.columns, name
        # the later copy of the long text goes, by its lines or as a near duplicate; other rows stay as they were
        changed = [r for r in before if r not in kept]
        assert all("doc_id=5" in r or "w0 w1" in r for r in changed) and len(kept) >= len(before) - 2, (name, changed)
        assert stage(spark, docs.limit(0), DIR).count() == 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, DIR)
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == {1, 2, 3, 4, 5, None}
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), DIR).count() == 0


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_like_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = Q.queries()[name](spark, DIR)
    found = con.execute(f"SELECT {', '.join(sorted(df.columns))} FROM ({Q.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.select(sorted(df.columns)).collect()))) == sorted(map(repr, found))
