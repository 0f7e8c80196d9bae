"""Queries of the operators, each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from veilwork.llm import (
    archive, bpe, chat, divergence, minhash, mixing, quality, spelling, surrogates, token_counts, topk,
    toxicity, urls,
)
from veilwork.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


#: The tree of sources: a domain is every fourth source.
LEVELS = ["domain", "lang", "source"]
WEIGHTS = {
    ("domain0",): 4, ("domain1",): 2, ("domain2",): 2, ("domain3",): 1,
    ("domain0", "en"): 4, ("domain0", "de"): 2, ("domain0", "fr"): 2,
    ("domain1", "en"): 3, ("domain2", "en"): 2, ("domain3", "es"): 0,
    ("domain1", "en", "src1"): 3, ("domain2", "fr", "src2"): 5,
}


def with_domain(docs: DataFrame) -> DataFrame:
    number = F.regexp_extract(F.coalesce("source", F.lit("")), "([0-9]+)$", 1)
    domain = F.concat(F.lit("domain"), F.coalesce(number.try_cast("long"), F.lit(0)) % 4)
    return docs.withColumn("domain", domain)


@query
def op1_mixing(spark, sf_dir):
    docs = with_domain(table(spark, sf_dir, "documents")).select(
        "doc_id", *LEVELS, mixing.count_words(F.col("text")).alias("n_tokens")
    )
    return mixing.mix_to_weights(docs, LEVELS, WEIGHTS, budget_share=0.9, seed=17)


@query
def op2_quality_rules(spark, sf_dir):
    return quality.quality_cascade(table(spark, sf_dir, "documents"))


@query
def op3_toxicity(spark, sf_dir):
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def tokenizer(name: str) -> str:
    """Where a public vocabulary file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op4_bpe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_checked(docs, tokenizer("byte_bpe_50k.json")).drop("text")


@query
def op5_token_counts(spark, sf_dir):
    counts = token_counts.count_tokens(
        table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json")
    )
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)


@query
def op6_top_k(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"))


@query
def op7_warc(spark, sf_dir):
    return archive.convert_pages(table(spark, sf_dir, "pages"))


@query
def op8_pii_surrogates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.replace_entities(docs, secret="veilwork-surrogates-1")


@query
def op9_chat_formatting(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema
    )
    return chat.read_back(chat.format_chat(turns.unionByName(planted)))


@query
def op10_near_duplicates(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), n=3, percent=85)


@query
def op11_spelling_variants(spark, sf_dir):
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


#: Rules for hosts with their subdomains and the beginnings of paths.
URL_RULES = [
    ("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"),
    ("net/es/", "block"), ("net/fr/", "block"),
]


@query
def op12_url_filters(spark, sf_dir):
    return urls.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


@query
def op13_source_divergence(spark, sf_dir):
    return divergence.audit_sources(table(spark, sf_dir, "documents"))


ORACLES["op2_quality_rules"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), e AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l,
    len(string_split(t, chr(10))) AS n_lines
  FROM d
), g AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT r, w, unnest(generate_series(1, len(w) - 2)) AS i FROM e)
), twice AS (
  SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, g) > 1
), covered AS (
  SELECT r, count(DISTINCT i + o) AS n FROM twice, (VALUES (0), (1), (2)) v(o) GROUP BY r
), m AS (
  SELECT doc_id, t, w, n_lines, len(w) AS n_words,
    coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM e LEFT JOIN covered USING (r)
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed
    OR n_symbols * 10 > n_words
    OR (n_dup_lines > 2 AND n_dup_lines * 10 > n_lines * 3)
    OR word_chars < 2 * n_words OR word_chars > 20 * n_words
    OR length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) * 2 > length(regexp_replace(t, '[^\p{L}]', '', 'g'))
    OR length(regexp_replace(t, '[^!?]', '', 'g')) * 2 > n_words
    OR len(list_filter(w, lambda x: regexp_matches(x, '\p{L}'))) * 10 < n_words * 6) AS kept
FROM f
"""

ORACLES["op9_chat_formatting"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), s AS (
  SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS u
  FROM t GROUP BY conv_id
), a AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i,
    len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + 4 AS tok,
    23 + length(role) + length(text)
      + length(regexp_replace(role || chr(0) || text, '[^\\]', '', 'g'))
      + length(regexp_replace(role, '[^␤\n]', '', 'g'))
      + len(regexp_extract_all(role || chr(0) || text, '<[|/s]'))
      + len(regexp_extract_all(role || chr(0) || text, '\[/?INST\]')) + 1 AS shown
  FROM t
), b AS (
  SELECT *, i = 1 AND role = 'system' AS sys,
    first_value(CASE WHEN role = 'system' THEN tok ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY i) AS st
  FROM a
), c AS (
  SELECT *, sum(tok) OVER (PARTITION BY conv_id ORDER BY i) - tok - st AS pre,
    greatest(1024 - 256 - st, 256) AS room
  FROM b
), d AS (
  SELECT *, CASE WHEN sys THEN -1 ELSE
    2 * (pre // room) + CASE WHEN pre + tok > (pre // room + 1) * room THEN 1 ELSE 0 END END AS unit
  FROM c
), e AS (
  SELECT *, lag(unit) OVER (PARTITION BY conv_id ORDER BY i) AS lu,
    lag(tok) OVER (PARTITION BY conv_id ORDER BY i) AS lt
  FROM d
), f AS (
  SELECT *, sum(tok) OVER (PARTITION BY conv_id, unit) AS total,
    arg_min(lu, i) OVER (PARTITION BY conv_id, unit) AS cu,
    arg_min(lt, i) OVER (PARTITION BY conv_id, unit) AS ct
  FROM e
), g AS (
  SELECT *, CASE WHEN unit >= 0 AND unit % 2 = 0 AND cu >= 0 AND cu % 2 = 1 AND ct + total <= room
    THEN cu ELSE unit END AS win
  FROM f
), w AS (
  SELECT conv_id, win, min(pre) AS p0, row_number() OVER (PARTITION BY conv_id ORDER BY win) AS k
  FROM g WHERE NOT sys GROUP BY conv_id, win
), h AS (
  SELECT conv_id, shown FROM g
  UNION ALL SELECT w.conv_id, g.shown FROM w JOIN g ON g.conv_id = w.conv_id AND g.sys AND w.k > 1
  UNION ALL SELECT w.conv_id, g.shown FROM w JOIN g
    ON g.conv_id = w.conv_id AND NOT g.sys AND g.pre < w.p0 AND g.pre >= w.p0 - 256
), n AS (SELECT conv_id, sum(shown)::BIGINT AS formatted_chars FROM h GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(u) AS loss_chars, sha256(u) AS loss_sha256, formatted_chars
FROM s JOIN n USING (conv_id)
"""

ORACLES["op6_top_k"] = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    coalesce(list_sum(list_transform(generate_series(1, len(q.v)), lambda i: q.v[i] * c.v[i])), 0)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank,
    vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def _dealt(depth: int) -> str:
    """Budgets of the nodes at one depth from those above, in plain SQL."""
    on = ", ".join(LEVELS[:depth])
    parent = ", ".join(LEVELS[:depth - 1]) or "1"
    join = f"JOIN b{depth - 1} USING ({parent})" if depth > 1 else "CROSS JOIN b0"
    return f"""
n{depth} AS (
  SELECT {on}, budget AS given, cap{depth} AS cap, w{depth} AS w FROM caps{depth} {join}
), r{depth} AS (
  SELECT *, row_number() OVER (PARTITION BY {parent} ORDER BY CASE WHEN w = 0 THEN 1 ELSE 0 END,
    CASE WHEN w > 0 THEN cap // w ELSE 0 END, CASE WHEN w > 0 THEN (cap % w) / w ELSE 0 END, {on}) AS i
  FROM n{depth}
), f{depth} AS (
  SELECT *, w = 0 OR cap::HUGEINT * sum(w) OVER (PARTITION BY {parent} ORDER BY i DESC)
    <= (given - (sum(cap) OVER (PARTITION BY {parent} ORDER BY i) - cap))::HUGEINT * w AS is_full
  FROM r{depth}
), g{depth} AS (
  SELECT *, given - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER (PARTITION BY {parent}) AS room,
    sum(CASE WHEN is_full THEN 0 ELSE w END) OVER (PARTITION BY {parent}) AS wide,
    sum(CASE WHEN is_full THEN 0 ELSE w END) OVER (PARTITION BY {parent} ORDER BY i) AS upto
  FROM f{depth}
), b{depth} AS (
  SELECT {on}, CASE WHEN is_full THEN cap ELSE
    (room::HUGEINT * upto) // wide - (room::HUGEINT * (upto - w)) // wide END AS budget
  FROM g{depth}
)"""


def _caps() -> str:
    out = []
    below = "SELECT *, 4 * supply AS c FROM supplies"
    for depth in range(len(LEVELS), 0, -1):
        on = ", ".join(LEVELS[:depth])
        cases = " ".join(
            "WHEN " + " AND ".join(f"{c} = '{v}'" for c, v in zip(LEVELS, path)) + f" THEN {w}"
            for path, w in WEIGHTS.items() if len(path) == depth
        )
        weight = f"CASE {cases} ELSE 1 END" if cases else "1"
        out.append(f"""caps{depth} AS (
  SELECT {on}, {weight} AS w{depth}, CASE WHEN {weight} > 0 THEN sum(c) ELSE 0 END::BIGINT AS cap{depth}
  FROM ({below}) GROUP BY {on}
)""")
        below = f"SELECT *, cap{depth} AS c FROM caps{depth}"
    return ",\n".join(out)


ORACLES["op1_mixing"] = rf"""
WITH d AS (
  SELECT doc_id, 'domain' || (coalesce(try_cast(regexp_extract(coalesce(source, ''), '([0-9]+)$', 1) AS BIGINT), 0) % 4) AS domain,
    lang, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens
  FROM documents
), supplies AS (
  SELECT domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source, sum(n_tokens)::BIGINT AS supply
  FROM d GROUP BY ALL
), {_caps()},
b0 AS (
  SELECT least((SELECT sum(cap1) FROM caps1), floor((SELECT sum(supply) FROM supplies) * 0.9))::BIGINT AS budget
), {_dealt(1)}, {_dealt(2)}, {_dealt(3)},
leaf AS (
  SELECT s.*, CASE WHEN supply > 0 THEN budget // supply ELSE 0 END AS epochs,
    CASE WHEN supply > 0 THEN budget % supply ELSE 0 END AS rest
  FROM supplies s JOIN b3 USING (domain, lang, source)
), o AS (
  SELECT d.*, epochs, rest,
    ('0x' || substr(md5('17|' || epochs || '|' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS u
  FROM d JOIN leaf l ON l.domain = d.domain AND l.lang = coalesce(d.lang, '') AND l.source = coalesce(d.source, '')
), p AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY u, coalesce(doc_id::VARCHAR, '')
    RANGE UNBOUNDED PRECEDING) - n_tokens AS before
  FROM o
)
SELECT doc_id, domain, lang, source, n_tokens,
  (epochs + CASE WHEN before < rest THEN 1 ELSE 0 END)::BIGINT AS copies
FROM p
"""

ORACLES["op7_warc"] = r"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
    sha256(coalesce(html, '')) AS payload_digest
  FROM pages
), f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
FROM f
"""

ORACLES["op10_near_duplicates"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(generate_series(1, len(w) - 2),
      lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END) AS g
  FROM d
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY ALL
), l AS (
  SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)
), r AS (
  SELECT doc_id, doc_id AS seen FROM d UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.seen
), c AS (SELECT doc_id, min(seen) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM c LEFT JOIN n USING (doc_id)
"""

ORACLES["op11_spelling_variants"] = r"""
WITH RECURSIVE o AS (
  SELECT doc_id, lower_run AS run, count(*) AS n FROM (
    SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_run
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS r FROM documents)
  ) WHERE length(lower_run) >= 6 GROUP BY ALL
), c AS (
  SELECT run, n, list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda x: unicode(x)::BIGINT) AS u FROM o
), b AS (
  SELECT run, n, flatten(list_transform(u, lambda x: CASE WHEN x < 128 THEN [x] ELSE [192 + (x >> 6), 128 + (x & 63)] END)) AS b FROM c
), h AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, b), lambda x, y:
    list_reduce([xor(x, y), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, k: xor(v >> 1, 3988292384 * (v & 1))))) AS h FROM b
), e AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM h
), w AS (
  SELECT word, sum(n)::BIGINT AS n FROM e WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), less AS (
  SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM w)
), near AS (
  SELECT x.word AS a, y.word AS b FROM less x JOIN less y ON x.rest = y.rest AND x.i = y.i AND x.word <> y.word
  UNION SELECT rest, word FROM less WHERE rest IN (SELECT word FROM w)
  UNION SELECT word, rest FROM less WHERE rest IN (SELECT word FROM w)
), k AS (
  SELECT a AS word, count(*) AS n_near, min({'m': -y.n, 'b': b}) AS best FROM near JOIN w y ON y.word = b GROUP BY a
), f AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near,
    CASE WHEN -best.m >= 5 * n THEN best.b END AS form, CASE WHEN -best.m >= 5 * n THEN -best.m END AS form_n
  FROM w LEFT JOIN k USING (word)
), r AS (
  SELECT word, word AS at, form AS ahead FROM f
  UNION ALL SELECT r.word, f.word, f.form FROM r JOIN f ON f.word = r.ahead
)
SELECT word, f.form, r.at AS root, n, n_near, form_n FROM f JOIN r USING (word) WHERE r.ahead IS NULL
"""

ORACLES["op13_source_divergence"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce("source", '') AS src,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
), o AS (
  SELECT r, lang, src, term, count(*) AS n FROM (
    SELECT r, lang, src, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
  ) GROUP BY ALL
), k AS (
  SELECT lang, term, sum(n) AS m FROM o GROUP BY lang, term HAVING count(*) >= 30
), v AS (
  SELECT lang, count(*) AS v, sum(m) AS total FROM k GROUP BY lang
), g AS (
  SELECT lang, src, coalesce(v, 0) AS v, coalesce(total, 0) AS total FROM (SELECT DISTINCT lang, src FROM d) LEFT JOIN v USING (lang)
), c AS (
  SELECT g.lang, src, term, coalesce(n, 0) AS n, m, v, total AS whole
  FROM g JOIN k USING (lang) LEFT JOIN (SELECT lang, src, term, sum(n) AS n FROM o GROUP BY ALL) USING (lang, src, term)
), p AS (
  SELECT lang, src, term, n,
    1 + 1000000000 * (n + 5)::HUGEINT // (sum(n) OVER (PARTITION BY lang, src) + 5 * v)::HUGEINT AS p,
    1 + 1000000000 * (m + 5)::HUGEINT // (whole + 5 * v)::HUGEINT AS q
  FROM c
), pair AS (
  SELECT a.lang, a.src, b.src AS item, sum(abs(x.p - y.p)) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.src <> b.src
  LEFT JOIN p x ON x.lang = a.lang AND x.src = a.src
  LEFT JOIN p y ON y.lang = b.lang AND y.src = b.src AND y.term = x.term
  WHERE x.term IS NULL OR y.term IS NOT NULL GROUP BY ALL
), both_parts AS (
  SELECT lang, src, 'pair' AS part, item, coalesce(value, 0)::BIGINT AS value FROM pair
  UNION ALL SELECT lang, src, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q
)
SELECT lang, src AS source, part, item, value,
  row_number() OVER (PARTITION BY lang, src, part ORDER BY value DESC, item)::INTEGER AS rank
FROM both_parts QUALIFY part = 'pair' OR rank <= 50
"""
