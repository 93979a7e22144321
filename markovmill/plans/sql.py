"""DuckDB SQL of the same results, put together from common table expressions."""

from __future__ import annotations

# ASCII punctuation and white space
PUNCT = "'!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~'"
WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(133) || chr(160) || chr(12288)"


def words(text: str, lower: bool = True, punct: bool = False) -> str:
    w = "w" if punct else f"trim(w, {PUNCT})"
    w = f"lower({w})" if lower else w
    tag = "starts_with(w, '<|') AND ends_with(w, '|>')"
    parts = f"string_split_regex(ltrim({text}, ' ' || chr(9) || chr(10) || chr(12) || chr(13)), '[ \\t\\n\\f\\r]+')"
    return f"CASE WHEN {text} = '' THEN [] ELSE list_transform({parts}, lambda w: CASE WHEN {tag} THEN w ELSE {w} END) END"


def tokens(source: str = "SELECT doc_id, coalesce(text, '') AS text FROM documents", lower: bool = True, punct: bool = False) -> str:
    """toks(doc_id, tokens)"""
    return f"""toks AS MATERIALIZED (
  SELECT doc_id, list_concat(list_concat(['<|start|>'], w), ['<|stop|>']) AS tokens
  FROM (SELECT doc_id, {words("t", lower, punct)} AS w FROM (SELECT doc_id, trim(text, {WHITE}) AS t FROM ({source})))
)"""


DIALOGUES = "SELECT conv_id AS doc_id, string_agg('<|' || role || '|> ' || text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id"
EVENTS = "SELECT user_id AS doc_id, string_agg(event_type, ' ' ORDER BY ts, event_id) AS text FROM events GROUP BY user_id"
BENCHMARK = "SELECT item_id AS query_id, coalesce(text, '') AS text FROM benchmark"
TURNS = "SELECT conv_id || '-' || turn AS query_id, coalesce(text, '') AS text FROM conversations"


def names(nf: int, nt: int) -> list[str]:
    return [f"f{i}" for i in range(nf)] + [f"t{i}" for i in range(nt)]


def windows(nf: int, nt: int, source: str, keep: str = "") -> str:
    cols = ", ".join(f"tokens[i + {k}] AS {c}" for k, c in enumerate(names(nf, nt)))
    return f"SELECT {keep + ', ' if keep else ''}{cols} FROM ({source}) d, unnest(range(1, len(d.tokens) - {nf + nt} + 1)) AS u(i)"


def weight(count: str, total: str) -> str:
    return f"CAST(least(floor(({count}::FLOAT::DOUBLE / {total}::FLOAT::DOUBLE)::FLOAT::DOUBLE * 4294967296), 4294967295) AS BIGINT)"


def base(nf: int = 2, nt: int = 1, name: str = "base") -> str:
    """base(f0.., t0.., count, weight)"""
    cols = ", ".join(names(nf, nt))
    return f"""{name}_counts AS MATERIALIZED (
  SELECT {cols}, count(*) AS count FROM ({windows(nf, nt, "SELECT DISTINCT tokens FROM toks")}) GROUP BY ALL
), {name} AS MATERIALIZED (
  SELECT {cols}, count, {weight("count", "(SELECT sum(count) FROM " + name + "_counts)")} AS weight FROM {name}_counts
)"""


TERMS = """terms AS MATERIALIZED (
  SELECT doc_id, word, len, count(*) AS cnt FROM (SELECT doc_id, len(tokens) AS len, unnest(tokens) AS word FROM toks) GROUP BY ALL
), tf AS MATERIALIZED (
  SELECT word, count(*) AS docfreq, count(*)::DOUBLE / (SELECT sum(len(tokens)) FROM toks)::DOUBLE AS tf FROM terms GROUP BY word
)"""


def seeds(experts: int, centroids: int, seed: int = 0) -> str:
    return f"""seeds AS MATERIALIZED (
  SELECT ((row_number() OVER (ORDER BY o, doc_id) - 1) // {centroids})::INT AS expert, doc_id
  FROM (SELECT doc_id, md5('{seed}|' || doc_id) AS o FROM toks ORDER BY o, doc_id LIMIT {experts * centroids})
)"""


RANKS = """ranks AS MATERIALIZED (
  SELECT expert, word, log2(sum(cnt * cnt / len / k)) - log2(any_value(tf)) AS rank
  FROM terms JOIN seeds USING (doc_id) JOIN (SELECT expert, count(*) AS k FROM seeds GROUP BY 1) USING (expert) JOIN tf USING (word)
  GROUP BY expert, word
)"""


def seeds_by_similarity(experts: int, centroids: int, seed: int = 0) -> str:
    """seeds0.., each with one expert's seeds more; needs toks, TERMS"""
    first = f"SELECT 0 AS expert, doc_id FROM (SELECT doc_id, md5('{seed}|' || doc_id) AS o FROM toks ORDER BY o, doc_id LIMIT {centroids})"
    out = [f"seeds0 AS MATERIALIZED ({first})"]
    for e in range(1, experts):
        before = f"seeds{e - 1}"
        u = f"((('0x' || substr(md5('{seed}|{e}|' || doc_id), 1, 8))::BIGINT::DOUBLE + 1) / 4294967297.0)"
        out.append(RANKS.replace("ranks AS", f"ranks{e} AS").replace("seeds", before))
        out.append(f"""near{e} AS MATERIALIZED (
  SELECT doc_id, expert, sum(cnt * round(rank * 1e6)::BIGINT)::BIGINT / 1e6::DOUBLE AS sim FROM terms JOIN ranks{e} USING (word) GROUP BY ALL
), weights{e} AS MATERIALIZED (
  SELECT doc_id, exp(-avg(ln(greatest(coalesce(sim, 1.0), 1e-6)))) AS w FROM (SELECT doc_id FROM toks) LEFT JOIN near{e} USING (doc_id) GROUP BY doc_id
), seeds{e} AS MATERIALIZED (
  SELECT * FROM {before} UNION ALL
  SELECT {e}, doc_id FROM (SELECT doc_id, ln({u}) / w AS o FROM weights{e} WHERE doc_id NOT IN (SELECT doc_id FROM {before}) ORDER BY o DESC, doc_id LIMIT {centroids})
)""")
    return ",\n".join(out)


def assignment(experts: int) -> str:
    return f"""sims AS MATERIALIZED (
  SELECT doc_id, expert, (coalesce(sum(cnt * round(rank * 1e6)::BIGINT), 0)::BIGINT / 1e6::DOUBLE) AS sim
  FROM (SELECT doc_id, unnest(range({experts}))::INT AS expert FROM toks) LEFT JOIN
       (SELECT doc_id, expert, cnt, rank FROM terms JOIN ranks USING (word)) USING (doc_id, expert) GROUP BY ALL
), assigned AS MATERIALIZED (
  SELECT doc_id, arg_max(expert, (sim, expert)) AS expert, max(sim) AS sim FROM sims GROUP BY doc_id
)"""


def own(nf: int = 2, nt: int = 1) -> str:
    """own(expert, f0.., t0.., count, weight)"""
    cols = ", ".join(names(nf, nt))
    source = "SELECT expert, tokens FROM toks JOIN assigned USING (doc_id)"
    return f"""own_counts AS MATERIALIZED (
  SELECT expert, {cols}, count(*) AS count FROM ({windows(nf, nt, source, "expert")}) GROUP BY ALL
), own AS MATERIALIZED (
  SELECT c.*, {weight("c.count", "s.total")} AS weight FROM own_counts c JOIN (SELECT expert, sum(count) AS total FROM own_counts GROUP BY 1) s USING (expert)
)"""


def mixture(experts: int, centroids: int, seed: int = 0, toks: str = "") -> str:
    """All tables of a model, over prose unless toks says otherwise: toks, base, terms, tf, seeds, ranks, sims, assigned, own."""
    return ",\n".join([toks or tokens(), base(), TERMS, seeds(experts, centroids, seed), RANKS, assignment(experts), own()])


def prompts(source: str, lower: bool = True, punct: bool = False) -> str:
    """prompts(query_id, seq): known words, the start token where there are none"""
    return f"""known AS MATERIALIZED (SELECT DISTINCT unnest(tokens) AS word FROM toks),
asked AS MATERIALIZED (SELECT query_id, {words("text", lower, punct)} AS w FROM ({source})),
prompts AS MATERIALIZED (
  SELECT query_id, coalesce(seq, ['<|start|>']) AS seq FROM asked LEFT JOIN (
    SELECT query_id, list(word ORDER BY pos) AS seq
    FROM (SELECT query_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM asked) JOIN known USING (word) GROUP BY query_id
  ) USING (query_id)
)"""


def follow(state: str, table: str, extra: str = "", on: str = "") -> str:
    """Transitions of a state's contexts, by two words or, for a shorter sequence, one. extra: further columns of the state."""
    e = "".join(f", s.{c}" for c in extra.split(",") if c)
    more = f" AND s.{on} = t.{on}" if on else ""
    return f"""SELECT s.query_id{e}, t.f0, t.f1, t.t0, t.weight FROM {state} s JOIN {table} t ON len(s.seq) >= 2 AND s.seq[-2] = t.f0 AND s.seq[-1] = t.f1{more}
  UNION ALL SELECT s.query_id{e}, t.f0, t.f1, t.t0, t.weight FROM {state} s JOIN {table} t ON len(s.seq) = 1 AND s.seq[-1] = t.f1{more}"""


def activation(state: str, n: str, experts: int, active: int) -> str:
    """sim{n}, act{n}(query_id, expert, sim, place, multiplier)"""
    return f"""sim{n} AS MATERIALIZED (
  SELECT query_id, expert, (coalesce(sum(cnt * round(rank * 1e6)::BIGINT), 0)::BIGINT / 1e6::DOUBLE) AS sim
  FROM (SELECT query_id, unnest(range({experts}))::INT AS expert FROM {state}) LEFT JOIN
       (SELECT query_id, expert, cnt, rank FROM (SELECT query_id, word, count(*) AS cnt FROM (SELECT query_id, unnest(seq) AS word FROM {state}) GROUP BY ALL) JOIN ranks USING (word))
       USING (query_id, expert) GROUP BY ALL
), act{n} AS MATERIALIZED (
  SELECT *, CASE WHEN sum(sim) OVER (PARTITION BY query_id) <> 0 THEN sim / sum(sim) OVER (PARTITION BY query_id) END * sqrt({experts}::DOUBLE / {active}) AS multiplier
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, expert) AS place FROM sim{n}) WHERE place <= {active}
)"""


def blended(state: str, n: str, experts: int, active: int) -> str:
    """cand{n}(query_id, f0, f1, t0, p)"""
    found = f"SELECT *, 0 AS slot, 1.0::DOUBLE AS multiplier FROM ({follow(state, 'base')})"
    head = ""
    if active:
        head = activation(state, n, experts, active) + f""", ask{n} AS MATERIALIZED (
  SELECT query_id, seq, expert, place AS slot, multiplier FROM {state} JOIN act{n} USING (query_id)
), """
        found += f" UNION ALL SELECT query_id, f0, f1, t0, weight, slot, multiplier FROM ({follow(f'ask{n}', 'own', 'slot,multiplier', 'expert')})"
    floor = "2.220446049250313e-16"
    slots = " + ".join(f"coalesce(max(p) FILTER (slot = {i}), 0)" for i in range(active + 1))
    return f"""{head}raw{n} AS MATERIALIZED ({found}), cand{n} AS MATERIALIZED (
  SELECT query_id, f0, f1, t0, {slots} AS p
  FROM (SELECT query_id, f0, f1, t0, slot, CASE WHEN p IS NULL OR isnan(p) OR p < {floor} THEN {floor} ELSE p END AS p
        FROM (SELECT *, (weight + 1)::DOUBLE / (sum(weight + 1) OVER (PARTITION BY query_id))::DOUBLE * multiplier AS p FROM raw{n})) GROUP BY ALL
)"""


def top(n: str, k: int) -> str:
    return f"""top{n} AS MATERIALIZED (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY p DESC, f0, f1, t0) AS place FROM cand{n}) WHERE place <= {k}
)"""


def drawn(n: str, step: str, seed: int) -> str:
    u = f"(('0x' || substr(md5('{seed}|' || query_id || '|' || {step}), 1, 8))::BIGINT::DOUBLE / 4294967295.0)"
    return f"""cum{n} AS MATERIALIZED (
  SELECT query_id, place, t0, list_reduce(ps[1:place], lambda a, b: a + b) AS cum, {u} * list_reduce(ps, lambda a, b: a + b) AS target
  FROM top{n} JOIN (SELECT query_id, list(p ORDER BY place) AS ps FROM top{n} GROUP BY query_id) USING (query_id)
), pick{n} AS MATERIALIZED (
  SELECT query_id, t0 FROM (SELECT *, coalesce(min(CASE WHEN cum >= target THEN place END) OVER (PARTITION BY query_id), 1) AS chosen FROM cum{n}) WHERE place = chosen
)"""


def generation(experts: int, active: int, k: int, seed: int | None, stops: list[str], most: int) -> str:
    """ends(query_id, words, uses), when a sequence has `most` words, a stop word or no successor, from prompts; for WITH RECURSIVE"""
    listed = ", ".join(f"'{s}'" for s in stops)
    # all live queries are at the same step
    drawing = drawn("", "(SELECT any_value(step) FROM live)", seed) if seed is not None else "pick AS MATERIALIZED (SELECT query_id, t0 FROM top)"
    used = "list_concat(uses, experts)" if active else "uses"
    chosen = "JOIN (SELECT query_id, list(expert) AS experts FROM act GROUP BY query_id) a ON a.query_id = l.query_id" if active else ""
    return f"""state AS (
  SELECT query_id, seq, []::VARCHAR[] AS words, []::INT[] AS uses, false AS done, 0 AS step FROM prompts
  UNION ALL SELECT * FROM (
    WITH live AS MATERIALIZED (SELECT * FROM state WHERE NOT done AND len(seq) < {most}),
    {blended("live", "", experts, active)}, {top("", k if seed is not None else 1)}, {drawing}
    SELECT l.query_id, CASE WHEN t0 IS NULL THEN seq ELSE list_append(seq, t0) END, CASE WHEN t0 IS NULL OR t0 IN ({listed}) THEN words ELSE list_append(words, t0) END,
      {used}, t0 IS NULL OR t0 IN ({listed}), step + 1
    FROM live l {chosen} LEFT JOIN pick p ON l.query_id = p.query_id
  )
), ends AS MATERIALIZED (SELECT query_id, arg_max(words, step) AS words, arg_max(uses, step) AS uses FROM state GROUP BY query_id)"""


def pairs(stops: list[str], most: int) -> str:
    """ends(query_id, words): greedy generation by two tokens at a time, of which the second is given if the sequence is not full by then"""
    listed = ", ".join(f"'{s}'" for s in stops)
    return f"""state AS (
  SELECT query_id, seq, []::VARCHAR[] AS words, false AS done, 0 AS step FROM prompts
  UNION ALL SELECT * FROM (
    WITH live AS MATERIALIZED (SELECT * FROM state WHERE NOT done AND len(seq) < {most}),
    pick AS MATERIALIZED (
      SELECT query_id, arg_min(t0, {{'o': -weight, 'a': f0, 'b': f1, 'c': t0, 'd': t1}}) AS t0, arg_min(t1, {{'o': -weight, 'a': f0, 'b': f1, 'c': t0, 'd': t1}}) AS t1
      FROM live JOIN base ON (len(seq) >= 2 AND seq[-2] = f0 AND seq[-1] = f1) OR (len(seq) = 1 AND seq[-1] = f1) GROUP BY query_id
    )
    SELECT l.query_id, CASE WHEN t0 IS NULL THEN seq ELSE list_concat(seq, [t0, t1]) END,
      CASE WHEN t0 IS NULL OR t0 IN ({listed}) THEN words WHEN len(seq) + 2 >= {most} OR t1 IN ({listed}) THEN list_append(words, t0) ELSE list_concat(words, [t0, t1]) END,
      t0 IS NULL OR t0 IN ({listed}) OR t1 IN ({listed}), step + 1
    FROM live l LEFT JOIN pick p ON l.query_id = p.query_id
  )
), ends AS MATERIALIZED (SELECT query_id, arg_max(words, step) AS words FROM state GROUP BY query_id)"""
