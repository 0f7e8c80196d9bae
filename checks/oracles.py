"""The same answers in DuckDB SQL, written apart from the Spark expressions:
RE2 patterns, positions by window sums, overlaps by gaps and islands."""

from __future__ import annotations

from checks import probes

NAMES = "Alice|Amanda|David|Emily|François|James|Jane|Jennifer|John|Lisa|Maria|Michael|Robert|Sarah"
MONTHS = (
    "January|February|March|April|May|June|July|August|September|October|November|December"
)
STREETS = "Street|St|Avenue|Ave|Road|Rd|Boulevard|Terrace|Center|Lane|Drive"
PII = (
    ("EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("SSN", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("CREDIT_CARD", r"\b(?:\d{4}[- ]){3}\d{4}\b|\b\d{16}\b"),
    (
        "PHONE_NUMBER",
        r"(?:\+1[ -])?\(\d{3}\) ?\d{3}-\d{4}\b|\b\d{3}-\d{3}-\d{4}\b"
        r"|\+\d{1,3}(?: \d{2,10}){1,4}\b|\b555-\d{4}\b",
    ),
    ("IPV4", r"\b\d{1,3}(?:\.\d{1,3}){3}\b"),
    ("DATE", rf"\b\d{{1,2}}/\d{{1,2}}/\d{{4}}\b|\b(?:{MONTHS}) \d{{1,2}}(?:, \d{{4}})?\b"),
    ("ID", r"\b(?:MRN|MED|PAT|CUST|EMP|ACC|ORD|INV)-?\d[\d-]*\d\b"),
    (
        "ADDRESS",
        rf"\b\d{{1,5}} (?:\p{{Lu}}\p{{L}}+ ){{1,3}}(?:{STREETS})\b"
        r"(?:, \p{Lu}\p{L}+(?: \p{Lu}\p{L}+)?(?:, [A-Z]{2}(?: \d{5})?)?)?",
    ),
    (
        "PERSON",
        r"\b(?:Dr|Mr|Mrs|Ms)\. \p{Lu}\p{L}+(?: \p{Lu}\p{L}+)?"
        rf"|\b(?:{NAMES}) \p{{Lu}}\p{{L}}+",
    ),
)
INJECTION = (
    (0.9, r"\b(?:ignore|forget|disregard)\b[^\n]{0,20}\b(?:instructions?|rules?|everything|safety protocols)\b"),
    (0.8, r"\b(?:bypass|override)\b[^\n]{0,40}\b(?:protocols?|filters?|restrictions?|directive)\b"),
    (
        0.8,
        r"\b(?:reveal|leak|print|repeat|show|tell me|quote)\b[^\n]{0,40}\b(?:system prompt|system message"
        r"|system text|training data|configuration|rules|user data|database|secrets|everything above|verbatim)\b",
    ),
    (0.7, r"\bverbatim\b[^\n]{0,40}\bsystem\b"),
    (0.8, r"(?:^|[ \t\r\n\f\]}])system(?: command| override)?:|\{\{ ?system ?\}\}"),
    (
        0.8,
        r"\b(?:act as|pretend to be|you are now)\b[^\n]{0,60}\b(?:ai|dan|mode|restrictions|guidelines)\b",
    ),
    (0.7, r"\bno (?:restrictions|ethical guidelines)\b|\brules are suspended\b"),
    (0.6, r"\bnew (?:task|directive)\b"),
    (0.7, r"\bprompt injection\b[^\n]{0,40}\bperform\b"),
)
UNSEEN = r"\p{Cf}+"
BLANKS = r"[ \t\n\x0B\f\r\x{A0}\x{2028}\x{2029}]+"
QUOTED = r"[\x22\x27]ignore previous instructions[\x22\x27]"
ASKING = r"\bhow (?:do|can) i (?:protect|defend|prevent)\b"


WORD = r"[^\x20\x09-\x0D]+"


def s(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def pick(values, key: str) -> str:
    return f"list_extract([{', '.join(values)}], (({key}) % {len(values)})::INT + 1)"


DOCS = "SELECT doc_id AS id, text FROM documents"
PROBED_DOCS = (
    f"SELECT doc_id AS id, text || ' ' || {pick([s(t) for t, _ in probes.PII_PROBES], 'doc_id')} AS text, "
    f"{pick([s(','.join(e)) for _, e in probes.PII_PROBES], 'doc_id')} AS expected FROM documents"
)
PROBED_CHATS = (
    "SELECT conv_id, turn, role, "
    f"text || ' ' || {pick([s(t) for t, _ in probes.INJECTION_PROBES], 'conv_id + turn')} AS text, "
    f"{pick([s(e) for _, e in probes.INJECTION_PROBES], 'conv_id + turn')} AS expected FROM conversations"
)
MESSAGES = (
    f"SELECT 'd' || id AS id, text FROM ({PROBED_DOCS}) UNION ALL "
    f"SELECT 'c' || conv_id || '-' || turn AS id, text FROM ({PROBED_CHATS})"
)


def raw(src: str) -> str:
    """CTEs src and raw: one row per match of each rule."""
    hits = " UNION ALL ".join(
        f"SELECT id, {i + 1} AS prio, '{label}' AS label, regexp_extract_all(text, {s(p)}) AS m, "
        f"string_split_regex(text, {s(p)}) AS g FROM src WHERE regexp_matches(text, {s(p)})"
        for i, (label, p) in enumerate(PII)
    )
    return f"""src AS ({src}),
hits AS ({hits}),
parts AS (SELECT id, prio, label, unnest(generate_series(1, len(m))) AS i, unnest(m) AS word,
    unnest(g[1:len(m)]) AS gap FROM hits),
raw AS (SELECT id, prio, label, word,
    (sum(length(gap) + length(word)) OVER (PARTITION BY id, prio ORDER BY i) - length(word))::INT AS st,
    (sum(length(gap) + length(word)) OVER (PARTITION BY id, prio ORDER BY i))::INT AS en FROM parts)"""


def resolved(src: str) -> str:
    """CTEs up to spans: disjoint, with the label of the best rule."""
    return f"""{raw(src)},
edges AS (SELECT *, CASE WHEN st < max(en) OVER (PARTITION BY id ORDER BY st, prio, en
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM raw),
isles AS (SELECT *, sum(opens) OVER (PARTITION BY id ORDER BY st, prio, en ROWS UNBOUNDED PRECEDING) AS isle
    FROM edges),
joined AS (SELECT id, min(st) AS st, max(en) AS en, arg_min(label, prio) AS label FROM isles GROUP BY id, isle),
spans AS (SELECT j.id, j.st, j.en, j.label, substr(src.text, j.st + 1, j.en - j.st) AS word
    FROM joined j JOIN src USING (id))"""


def masked(src: str) -> str:
    """CTEs up to masked: id, text, masked text, number of spans, types."""
    return f"""{resolved(src)},
gaps AS (SELECT *, lag(en, 1, 0) OVER (PARTITION BY id ORDER BY st) AS pe FROM spans),
heads AS (SELECT id, string_agg(substr(src.text, pe + 1, st - pe) || '[' || label || ']', '' ORDER BY st) AS head,
    max(en) AS le, count(*) AS n, string_agg(DISTINCT label, ',' ORDER BY label) AS types
    FROM gaps JOIN src USING (id) GROUP BY id),
masked AS (SELECT src.id, src.text, CASE WHEN head IS NULL THEN src.text ELSE head || substr(src.text, le + 1) END
    AS masked_text, coalesce(n, 0) AS n, coalesce(types, '') AS types FROM src LEFT JOIN heads USING (id))"""


def score(text: str = "text", mitigation: str = "strip") -> str:
    seen = f"regexp_replace({text}, {s(UNSEEN)}, '', 'g')"
    low = f"lower(regexp_replace({seen}, {s(BLANKS)}, ' ', 'g'))"
    if mitigation == "strip":
        low = f"regexp_replace({low}, {s(QUOTED)}, ' ', 'g')"
    product = " * ".join(
        f"CASE WHEN regexp_matches({low}, {s(p)}) THEN 1::DOUBLE - {w}::DOUBLE ELSE 1::DOUBLE END"
        for w, p in INJECTION
    )
    if mitigation == "zero":
        quiet = f"regexp_matches({low}, {s(QUOTED)}) OR regexp_matches({low}, {s(ASKING)})"
        return f"CASE WHEN {quiet} THEN 0::DOUBLE ELSE 1::DOUBLE - {product} END"
    return f"1::DOUBLE - {product}"


def judged(src: str) -> str:
    """CTEs up to judged, by the better label alone and the default threshold."""
    return f"""scored AS (SELECT *, {score()} AS sc FROM ({src})),
judged AS (SELECT *, sc > 0.5 AS is_injection, CASE WHEN sc >= 0.5 THEN sc ELSE 1 - sc END AS confidence,
    CASE WHEN sc > 0.5 THEN 'INJECTION_DETECTED' ELSE 'SAFE' END AS classification FROM scored)"""


def bucket(key: str, salt: str) -> str:
    return f"('0x' || substr(md5('{salt}' || {key}), 1, 8))::BIGINT % 10000"




LOG = (
    "SELECT event_id, ts, 'v' || (user_id % 2) AS variant, value AS latency, event_type = 'error' AS is_error "
    "FROM events"
)
# what the broken, nested and mixed label responses hold, by kind 0..4
LABELLED = f"""scored AS (SELECT *, {score()} AS sc, (conv_id + 2 * turn) % 5 AS kind FROM ({PROBED_CHATS})),
folded AS (SELECT *, CASE WHEN kind <= 2 THEN sc ELSE 0 END AS inj,
    CASE WHEN kind <= 1 THEN 1 - sc WHEN kind = 2 THEN 0.25 ELSE 0 END AS safe FROM scored)"""
RESPONSE_ERROR = "malformed response"


def oracles() -> dict[str, str]:
    out: dict[str, str] = {}
    out["detect_entities"] = f"""WITH {resolved(DOCS)}
SELECT id AS doc_id, label, st AS "start", en AS "end", word, 0.9::DOUBLE AS score FROM spans"""
    out["resolve_spans"] = f"""WITH {resolved(PROBED_DOCS)}
SELECT id AS doc_id, st AS "start", en AS "end", label, word FROM spans"""
    out["apply_mask"] = f"""WITH RECURSIVE {raw(PROBED_DOCS)},
steps AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY st DESC, prio, en) AS n FROM raw),
fold AS (SELECT id, 0::BIGINT AS n, text AS t FROM src
    UNION ALL SELECT f.id, steps.n, substr(f.t, 1, steps.st) || '[' || steps.label || ']' || substr(f.t, steps.en + 1)
    FROM fold f JOIN steps ON steps.id = f.id AND steps.n = f.n + 1)
SELECT id AS doc_id, arg_max(t, n) AS masked_text FROM fold GROUP BY id"""
    out["extract_entities"] = f"""WITH {resolved(PROBED_DOCS)}
SELECT id AS doc_id, label AS type, word AS text, st AS "start", en AS "end", (length(word) % 5) * 0.25::DOUBLE
    AS confidence FROM spans WHERE (length(word) % 5) * 0.25 > 0.5"""
    out["mask_pii"] = f"""WITH {masked(DOCS)}
SELECT id AS doc_id, masked_text, n::INT AS n_entities FROM masked"""
    out["mask_pii_text"] = f"""WITH {masked(PROBED_DOCS)} SELECT id AS doc_id, masked_text FROM masked"""
    out["entity_rows"] = f"""WITH {resolved(PROBED_DOCS)}
SELECT id AS doc_id, (row_number() OVER (PARTITION BY id ORDER BY st) - 1)::INT AS entity_no, label AS type,
    word AS text, st AS "start", en AS "end", 0.9::DOUBLE AS confidence FROM spans"""
    out["pii_type_counts"] = f"""WITH {resolved(PROBED_DOCS)}
SELECT id AS doc_id, label AS type, count(*) AS n FROM spans GROUP BY id, label"""
    out["pii_type_totals"] = f"""WITH {resolved(PROBED_DOCS)}
SELECT label AS type, count(*) AS n FROM spans GROUP BY label"""
    out["pii_status"] = f"""WITH {masked(PROBED_DOCS)}
SELECT id AS doc_id, CASE WHEN masked_text <> text THEN 'masked' ELSE 'clean' END AS pii_status, types FROM masked"""
    out["deidentify_records"] = f"""WITH {masked(PROBED_DOCS)}
SELECT id AS doc_id, masked_text, n::INT AS pii_count FROM masked"""
    out["ticket_preview"] = f"""WITH {masked(PROBED_DOCS)},
per_type AS (SELECT id, label, count(*) AS k FROM spans GROUP BY id, label),
listed AS (SELECT id, string_agg(label || ':' || k, ',' ORDER BY label) AS type_counts FROM per_type GROUP BY id)
SELECT id AS doc_id, substr(text, 1, 100) || '...' AS original_preview,
    substr(masked_text, 1, 150) || '...' AS masked_preview, coalesce(type_counts, '') AS type_counts
FROM masked LEFT JOIN listed USING (id)"""
    names = ", ".join(f"({s(n)})" for n in probes.GIVEN_NAMES_TABLE)
    out["detect_persons"] = f"""WITH src AS ({PROBED_DOCS}),
cut AS (SELECT id, string_split_regex(text, '[^\\p{{L}}0-9_]') AS w FROM src),
words AS (SELECT id, unnest(generate_series(1, len(w))) AS i, unnest(w) AS word FROM cut),
placed AS (SELECT *, (sum(length(word) + 1) OVER (PARTITION BY id ORDER BY i) - length(word) - 1)::INT AS st
    FROM words),
paired AS (SELECT p.*, lead(word) OVER (PARTITION BY p.id ORDER BY i) AS after, src.text FROM placed p
    JOIN src USING (id)),
firsts AS (SELECT id, word, st, regexp_extract(after, '^\\p{{L}}+') AS next FROM paired JOIN (VALUES {names}) n(name)
    ON word = name WHERE regexp_matches(after, '^\\p{{Lu}}\\p{{L}}') AND substr(text, st + length(word) + 1, 1) = ' ')
SELECT id AS doc_id, 'PERSON' AS type, word || ' ' || next AS text, st AS "start",
    (st + length(word) + 1 + length(next))::INT AS "end", 0.9::DOUBLE AS confidence FROM firsts"""
    word = r"\p{L}+(?:['’\-]\p{L}+)*"
    out["detect_names"] = f"""WITH src AS ({PROBED_DOCS}),
names AS (SELECT DISTINCT n FROM (SELECT name AS n FROM (VALUES {names}) v(name)
    UNION ALL SELECT regexp_extract(text, '[A-Z][a-z]+ [a-z]+') FROM src WHERE id % 7 = 0) WHERE n <> ''),
parts AS (SELECT id, regexp_extract_all(text, {s(word)}) AS w, string_split_regex(text, {s(word)}) AS g FROM src
    WHERE regexp_matches(text, {s(word)})),
words AS (SELECT id, unnest(generate_series(1, len(w))) AS i, unnest(w) AS word, unnest(g[1:len(w)]) AS gap FROM parts),
placed AS (SELECT *, (sum(length(gap) + length(word)) OVER (PARTITION BY id ORDER BY i))::INT AS en FROM words),
pairs AS (SELECT id, word, en - length(word) AS st, en, lead(word) OVER v AS after, lead(gap) OVER v AS between_,
    lead(en) OVER v AS en2 FROM placed WINDOW v AS (PARTITION BY id ORDER BY i)),
met AS (SELECT id, word AS name, st, en FROM pairs JOIN names ON word = n
    UNION ALL SELECT id, word || ' ' || after, st, en2 FROM pairs JOIN names ON word || ' ' || after = n WHERE between_ = ' '),
whole AS (SELECT *, max(en) OVER (PARTITION BY id ORDER BY st, en DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM met)
SELECT id AS doc_id, name AS text, st::INT AS "start", en::INT AS "end" FROM whole WHERE reach IS NULL OR en > reach"""
    out["merge_bio"] = f"""WITH {resolved(PROBED_DOCS)},
sized AS (SELECT *, len(string_split(word, ' ')) AS n FROM spans)
SELECT id AS doc_id, label, st AS "start", en AS "end", word,
    round(list_sum(list_transform(range(n), lambda i: 0.5::DOUBLE + 0.125::DOUBLE * (i % 3))) / n, 6) AS score
FROM sized"""
    out["evaluate_pii"] = f"""WITH {masked(PROBED_DOCS)},
wanted AS ({PROBED_DOCS}),
right_ids AS (SELECT DISTINCT id FROM spans JOIN wanted USING (id)
    WHERE list_contains(string_split(expected, ','), label))
SELECT expected, count(*) AS n, count(*) FILTER (m.n > 0) AS n_passed, count(right_ids.id) AS n_type_found,
    sum(m.n)::BIGINT AS entities_found
FROM masked m JOIN wanted USING (id) LEFT JOIN right_ids USING (id) GROUP BY expected"""
    out["sql_functions"] = f"""WITH {masked(PROBED_DOCS)}
SELECT id AS doc_id, masked_text, {score()} > 0.5 AS is_injection FROM masked"""

    out["score_injection"] = f"""SELECT conv_id, turn, round({score()}, 6) AS score,
    round({score(mitigation='off')}, 6) AS score_plain, round({score(mitigation='zero')}, 6) AS score_zeroed
FROM ({PROBED_CHATS})"""
    out["detect_injection"] = f"""WITH scored AS (SELECT *, {score()} AS sc FROM ({PROBED_CHATS}))
SELECT conv_id, turn, sc > 0.3 AS is_injection,
    CASE WHEN sc > 0.3 THEN 'INJECTION_DETECTED' ELSE 'SAFE' END AS classification,
    round(sc, 6) AS injection_score, round(1 - sc, 6) AS safe_score, round(greatest(sc, 1 - sc), 6) AS confidence
FROM scored"""
    out["check_injection"] = f"""WITH {judged(PROBED_CHATS)} SELECT conv_id, turn, is_injection FROM judged"""
    out["response_tier"] = f"""WITH scored AS (SELECT *, round({score()}, 6) AS sc FROM ({PROBED_CHATS}))
SELECT conv_id, turn, CASE WHEN sc > 0.9 THEN 'block' WHEN sc > 0.5 THEN 'review' WHEN sc > 0.2 THEN 'log'
    ELSE 'allow' END AS tier FROM scored"""
    out["moderate_chat"] = f"""WITH {judged(PROBED_CHATS)}
SELECT conv_id, turn, role, classification, round(confidence, 6) AS confidence,
    CASE WHEN is_injection THEN 'blocked and logged' ELSE 'delivered' END AS action FROM judged"""
    out["validate_requests"] = f"""WITH {judged(PROBED_CHATS)}
SELECT conv_id, turn, CASE WHEN is_injection THEN 'BLOCKED' ELSE 'ALLOWED' END AS verdict,
    CASE WHEN is_injection THEN '400 Bad Request' ELSE '200 OK' END AS response,
    round(confidence, 6) AS confidence FROM judged"""
    out["evaluate_injection"] = f"""WITH {judged(PROBED_CHATS)}
SELECT expected, classification AS actual, count(*) AS n,
    count(*) FILTER ((expected = 'INJECTION') = is_injection) AS n_passed FROM judged GROUP BY ALL"""
    out["route_messages"] = f"""WITH {masked(MESSAGES)},
decided AS (SELECT *, {score()} > 0.5 AS bad FROM masked)
SELECT id AS message_id, CASE WHEN bad THEN 'blocked' WHEN masked_text <> text THEN 'masked' ELSE 'clean' END
    AS decision, CASE WHEN NOT bad THEN masked_text END AS masked_text, CASE WHEN NOT bad THEN types END AS types
FROM decided"""
    out["compliance_report"] = f"""WITH {masked(MESSAGES)},
flags AS (SELECT n, length(text) AS secs, {score()} > 0.5 AS bad FROM masked),
sums AS (SELECT count(*) AS total_items, count(*) FILTER (n > 0) AS items_with_pii,
    count(*) FILTER (bad) AS items_with_injection, sum(n)::BIGINT AS pii_entities,
    round(avg(secs), 6) AS avg_seconds, sum(secs)::DOUBLE AS total_seconds FROM flags)
SELECT *, (SELECT string_agg(DISTINCT u, ',' ORDER BY u) FROM (SELECT unnest(string_split(types, ',')) AS u
    FROM masked WHERE types <> '')) AS types_found, round(100.0 * items_with_pii / total_items::DOUBLE, 1) AS pct_with_pii,
    round(100.0 * items_with_injection / total_items::DOUBLE, 1) AS pct_with_injection,
    CASE WHEN items_with_pii = 0 THEN 'No unmasked PII detected'
        ELSE items_with_pii || ' items require PII handling' END AS pii_status,
    CASE WHEN items_with_injection = 0 THEN 'No injection attempts detected'
        ELSE items_with_injection || ' injection attempts blocked' END AS injection_status FROM sums"""

    out["parse_entities"] = f"""WITH {resolved(PROBED_DOCS)},
per_doc AS (SELECT id, count(*) AS n, string_agg(label || '@' || st || '-' || en, ' ' ORDER BY st) AS listed
    FROM spans GROUP BY id)
SELECT src.id AS doc_id, CASE WHEN src.id % 10 NOT IN (3, 7) THEN coalesce(n, 0)::INT END AS n_entities,
    CASE WHEN src.id % 10 NOT IN (3, 7) THEN coalesce(listed, '') END AS listed
FROM src LEFT JOIN per_doc USING (id)"""
    out["failed_rows"] = f"""SELECT id AS doc_id, text, CASE WHEN id % 10 IN (3, 7) THEN '{RESPONSE_ERROR}' END AS error,
    CASE WHEN id % 10 IN (3, 7) THEN 'failed' ELSE 'ok' END AS status FROM ({PROBED_DOCS})"""
    out["parse_labels"] = """SELECT conv_id, turn,
    CASE kind WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 0 END AS n_labels,
    CASE kind WHEN 0 THEN 'SAFE,injection' WHEN 1 THEN 'SAFE,injection' WHEN 2 THEN 'Malicious,LABEL_1,unsafe,benign'
        WHEN 3 THEN '' END AS names,
    CASE WHEN kind = 4 THEN 'failed' ELSE 'ok' END AS status
FROM (SELECT *, (conv_id + 2 * turn) % 5 AS kind FROM conversations)"""
    out["fold_label_scores"] = f"""WITH {LABELLED}
SELECT conv_id, turn, inj > 0.5 AS is_injection,
    CASE WHEN inj > 0.5 THEN 'INJECTION_DETECTED' ELSE 'SAFE' END AS classification,
    round(inj, 6) AS injection_score, round(safe, 6) AS safe_score, round(greatest(inj, safe), 6) AS confidence
FROM folded"""
    out["build_requests"] = """WITH numbered AS (SELECT text, row_number() OVER (ORDER BY doc_id) - 1 AS p FROM documents)
SELECT p // 10 + 1 AS batch_no, count(*) AS n_texts,
    '{"inputs":' || to_json(list(text ORDER BY p))::VARCHAR || '}' AS payload
FROM numbered GROUP BY p // 10"""
    out["capture_sample"] = f"""SELECT doc_id, text FROM documents WHERE {bucket('doc_id', 'capture')} < 1000"""

    out["assign_batches"] = """WITH numbered AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS position,
    count(*) OVER () AS n FROM events)
SELECT event_id, position, position // 7 + 1 AS batch_no, (n - 1) // 7 + 1 AS n_batches FROM numbered"""
    out["number_rows"] = """SELECT user_id, event_id, row_number() OVER (ORDER BY user_id, event_id) - 1 AS position,
    (row_number() OVER (ORDER BY user_id, event_id) - 1) // 16 + 1 AS batch_no FROM events"""
    out["adaptive_batch"] = """WITH every AS (SELECT role AS part, text FROM conversations
    UNION ALL SELECT lang AS part, text FROM documents)
SELECT part, count(*) AS n_texts, round(avg(length(text)), 6) AS mean_chars,
    CASE WHEN avg(length(text)) < 100 THEN 64 WHEN avg(length(text)) < 500 THEN 32 ELSE 16 END AS batch_size
FROM every GROUP BY part"""
    out["batch_mask"] = f"""WITH {masked(PROBED_DOCS)}
SELECT id AS doc_id, masked_text, n::INT AS n_entities, 'ok' AS status FROM masked"""
    out["batch_injection"] = f"""WITH {judged(PROBED_CHATS)}
SELECT conv_id, turn, classification, round(confidence, 6) AS confidence, 'ok' AS status FROM judged"""
    out["assign_variant"] = f"""SELECT doc_id,
    CASE WHEN {bucket('doc_id', 'variant')} < 5000 THEN 'PIIMasking' ELSE 'PromptInjection' END AS variant,
    CASE WHEN {bucket('doc_id', 'variant')} < 9000 THEN 'stable' ELSE 'canary' END AS rollout FROM documents"""
    out["assign_rollout"] = """WITH weights(since, until, variant, weight) AS (VALUES
    (TIMESTAMP '2024-01-03 00:00:00', TIMESTAMP '2024-01-08 12:00:00', 'stable', 95.0::DOUBLE),
    (TIMESTAMP '2024-01-03 00:00:00', TIMESTAMP '2024-01-08 12:00:00', 'canary', 5.0::DOUBLE),
    (TIMESTAMP '2024-01-08 12:00:00', TIMESTAMP '2024-01-15 06:30:00', 'stable', 50.0::DOUBLE),
    (TIMESTAMP '2024-01-08 12:00:00', TIMESTAMP '2024-01-15 06:30:00', 'canary', 30.0::DOUBLE),
    (TIMESTAMP '2024-01-08 12:00:00', TIMESTAMP '2024-01-15 06:30:00', 'new', 20.0::DOUBLE),
    (TIMESTAMP '2024-01-15 06:30:00', TIMESTAMP '9999-01-01 00:00:00', 'canary', 1.0::DOUBLE),
    (TIMESTAMP '2024-01-15 06:30:00', TIMESTAMP '9999-01-01 00:00:00', 'new', 1.0::DOUBLE)),
drawn AS (SELECT event_id, variant,
    -ln((('0x' || substr(md5('rollout' || variant || event_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE) / weight AS d
    FROM events JOIN weights ON ts >= since AND ts < until)
SELECT event_id, arg_min(drawn.variant, d) AS variant FROM events LEFT JOIN drawn USING (event_id) GROUP BY event_id"""
    out["score_by_variant"] = f"""WITH split AS (SELECT *, {bucket('conv_id', 'variant')} AS b, {score()} AS sc
    FROM ({PROBED_CHATS})),
named AS (SELECT *, CASE WHEN b < 4000 THEN 'a' WHEN b < 8000 THEN 'b' ELSE 'c' END AS variant FROM split)
SELECT conv_id, turn, variant, CASE WHEN variant = 'c' THEN NULL
    WHEN sc > CASE variant WHEN 'a' THEN 0.5::DOUBLE ELSE 0.85::DOUBLE END THEN 'INJECTION_DETECTED' ELSE 'SAFE' END
    AS classification, CASE WHEN variant = 'c' THEN 'failed' ELSE 'ok' END AS status,
    CASE WHEN variant = 'c' THEN 'no scorer for variant c' END AS error FROM named"""
    out["score_distinct"] = f"""WITH {masked(DOCS)} SELECT id AS doc_id, masked_text FROM masked"""
    steps, last = [], "pages"
    for i, (p, closed) in enumerate((
        (r"(?is)<script\b[^>]*>.*?</script[^>]*>", r"(?is)^.*</script[^>]*>"),
        (r"(?is)<style\b[^>]*>.*?</style[^>]*>", r"(?is)^.*</style[^>]*>"),
        (r"(?s)<!--.*?-->", r"(?s)^.*-->"),
        (r"<[/!?A-Za-z][^>]*>", r"(?s)^.*>"),
    )):
        steps.append(f"""h{i} AS (SELECT page_id, html, regexp_extract(html, {s(closed)}) AS h FROM {last}),
t{i} AS (SELECT page_id, regexp_replace(h, {s(p)}, ' ', 'g') || substr(html, length(h) + 1) AS html FROM h{i})""")
        last = f"t{i}"
    blanks = r"[ \t\r\n\f]+"
    out["normalize_pages"] = f"""WITH {", ".join(steps)}
SELECT page_id, trim(regexp_replace(html, {s(blanks)}, ' ', 'g'), ' ') AS text FROM {last}"""
    out["chunk_documents"] = """WITH counted AS (SELECT doc_id, text,
    greatest(ceil((length(text) - 1024) / 896.0), 0)::INT AS last FROM documents),
numbered AS (SELECT *, unnest(generate_series(0, last))::INT AS chunk_no FROM counted)
SELECT doc_id, chunk_no, (chunk_no * 896)::INT AS chunk_start, substr(text, chunk_no * 896 + 1, 1024) AS chunk
FROM numbered"""
    out["lift_spans"] = out["resolve_spans"]
    out["mask_in_chunks"] = f"""WITH {masked(PROBED_DOCS)}
SELECT id AS doc_id, masked_text, n::INT AS n_entities FROM masked"""

    out["score_with_model"] = """SELECT doc_id, CASE WHEN (length(text) - length(replace(text, 'e', '')))
    / greatest(length(text), 1) > 0.1 THEN 'INJECTION_DETECTED' ELSE 'SAFE' END AS classification,
    0.9::DOUBLE AS confidence, 'ok' AS status FROM documents"""

    out["score_with_token_budget"] = out["score_with_model"]
    out["score_with_store"] = """WITH cut AS (SELECT doc_id, substr(text, 1, 40 + doc_id % 2) AS t FROM documents),
known AS (SELECT DISTINCT t FROM cut WHERE doc_id % 3 > 0)
SELECT 'first' AS run, doc_id, length(t)::INT AS n, false AS reused FROM cut WHERE doc_id % 3 > 0
UNION ALL SELECT 'again', doc_id, length(t)::INT, t IN (SELECT t FROM known) FROM cut
UNION ALL SELECT 'other version', doc_id, length(t)::INT, false FROM cut"""
    out["token_batches"] = f"""WITH counted AS (SELECT doc_id, len(regexp_extract_all(text, '{WORD}'))::BIGINT AS n FROM documents),
sized AS (SELECT *, least(64, greatest(1, 8192 // greatest(n, 1))) AS fits FROM counted),
slots AS (SELECT *, ceil(count(*) OVER (PARTITION BY fits) / 300.0)::BIGINT AS slots FROM sized),
dealt AS (SELECT *, ('0x' || substr(md5('slot' || doc_id), 1, 8))::BIGINT % slots AS slot FROM slots),
cut AS (SELECT *, (row_number() OVER (PARTITION BY fits, slot ORDER BY n DESC, doc_id) - 1) // fits AS b FROM dealt)
SELECT doc_id, n AS n_tokens, fits || '-' || slot || '-' || b AS batch_id, count(*) OVER w AS batch_rows,
    max(n) OVER w AS batch_longest, count(*) OVER w * max(n) OVER w AS batch_cost
FROM cut WINDOW w AS (PARTITION BY fits, slot, b)"""
    out["chunk_tokens"] = f"""WITH split AS (SELECT doc_id, text,
    regexp_extract_all(text, '(?:\\A[\\x20\\x09-\\x0D]+)?{WORD}[\\x20\\x09-\\x0D]*') AS w FROM documents),
numbered AS (SELECT *, unnest(generate_series(0, greatest(ceil((len(w) - 1024) / 896.0), 0)::INT))::INT AS chunk_no FROM split)
SELECT doc_id, chunk_no, coalesce(list_sum(list_transform(w[1:chunk_no * 896], lambda x: length(x))), 0)::INT AS chunk_start,
    CASE WHEN len(w) = 0 THEN text ELSE array_to_string(w[chunk_no * 896 + 1:chunk_no * 896 + 1024], '') END AS chunk,
    len(w[chunk_no * 896 + 1:chunk_no * 896 + 1024])::INT AS n_tokens FROM numbered"""
    out["lift_token_spans"] = out["resolve_spans"]
    out["span_scores"] = f"""WITH {resolved(PROBED_DOCS)},
found AS (SELECT id, CASE WHEN st % 11 = 0 THEN 'OTHER' ELSE label END AS label, least(st + id % 6, en - 1) AS st, en
    FROM spans WHERE (st + id) % 5 <> 0),
pairs AS (SELECT f.id, f.label, f.st, f.en, bool_or(e.st = f.st AND e.en = f.en) AS exact FROM found f JOIN spans e
    ON e.id = f.id AND e.label = f.label AND 2 * (least(e.en, f.en) - greatest(e.st, f.st)) > greatest(e.en, f.en) - least(e.st, f.st)
    GROUP BY ALL),
counts AS (SELECT label, count(*) AS e, 0 AS f, 0 AS m, 0 AS x FROM spans GROUP BY label
    UNION ALL SELECT label, 0, count(*), 0, 0 FROM found GROUP BY label
    UNION ALL SELECT label, 0, 0, count(*), count(*) FILTER (exact) FROM pairs GROUP BY label),
sums AS (SELECT label, sum(e) AS e, sum(f) AS f, sum(m) AS m, sum(x) AS x FROM counts GROUP BY label
    UNION ALL SELECT 'overall', sum(e), sum(f), sum(m), sum(x) FROM counts)
SELECT label, e::BIGINT AS n_expected, f::BIGINT AS n_found, m::BIGINT AS n_matched, x::BIGINT AS n_exact,
    round(m / nullif(f, 0), 6) AS precision, round(m / nullif(e, 0), 6) AS recall, round(2 * m / nullif(e + f, 0), 6) AS f1 FROM sums"""
    curve = f"""scored AS (SELECT round({score()}, 6) + ((conv_id * 7 + turn) % 10)::DOUBLE / 100 AS s, expected = 'INJECTION' AS y
    FROM ({PROBED_CHATS})),
counts AS (SELECT s, count(*) FILTER (y) AS pos, count(*) FILTER (NOT y) AS neg FROM scored GROUP BY s),
totals AS (SELECT sum(pos)::DOUBLE AS p, sum(neg)::DOUBLE AS n FROM counts),
curve AS (SELECT s AS threshold, pos, neg, (sum(pos) OVER w)::BIGINT AS tp, (sum(neg) OVER w)::BIGINT AS fp, p, n
    FROM counts, totals WINDOW w AS (ORDER BY s DESC)),
rates AS (SELECT *, tp / (tp + fp) AS precision, tp / p AS recall, fp / n AS fpr, 2 * tp / (tp + fp + p) AS f1,
    tp / p - fp / n AS youden FROM curve)"""
    out["threshold_curve"] = f"""WITH {curve}
SELECT threshold, tp, fp, (p - tp)::BIGINT AS fn, (n - fp)::BIGINT AS tn, round(precision, 9) AS precision,
    round(recall, 9) AS recall, round(fpr, 9) AS fpr, round(f1, 9) AS f1, round(youden, 9) AS youden,
    round(neg * (tp - pos + pos / 2) / (p * n), 9) AS auc_step, round(pos / p * precision, 9) AS ap_step FROM rates"""
    best = "(SELECT {what} FROM rates WHERE {test} ORDER BY {by} DESC, threshold DESC LIMIT 1)"
    out["threshold_summary"] = f"""WITH {curve},
pairs AS (SELECT sum(a.pos * b.neg * CASE WHEN a.s > b.s THEN 1 WHEN a.s = b.s THEN 0.5 ELSE 0 END) AS u FROM counts a, counts b)
SELECT round(u / (p * n), 9) AS auc, (SELECT round(sum(pos / p * precision), 9) FROM rates) AS average_precision,
""" + ",\n".join(
        f"    round({best.format(what='threshold', test=test, by=by)}, 9) AS {name}_threshold, "
        f"round({best.format(what=by, test=test, by=by)}, 9) AS {value}"
        for name, by, value, test in (
            ("f1", "f1", "best_f1", "true"), ("youden", "youden", "best_youden", "true"),
            ("precise", "recall", "precise_recall", "precision >= 0.9"),
        )
    ) + "\nFROM pairs, totals"

    out["batch_failures"] = f"""SELECT doc_id, CASE WHEN length(text) % 5 > 2 THEN 'SAFE' END AS classification,
    CASE WHEN length(text) % 5 > 2 THEN 0.75::DOUBLE END AS confidence,
    CASE length(text) % 5 WHEN 0 THEN 'ThrottlingException' WHEN 1 THEN 'broken text' WHEN 2 THEN 'malformed response' END AS error,
    CASE WHEN length(text) % 5 > 2 THEN 'ok' ELSE 'failed' END AS status FROM documents"""
    out["batch_mask_model"] = f"""SELECT id AS doc_id, regexp_replace(text, '[^ \\n]*@[^ \\n]*', '[EMAIL]', 'g') AS masked_text,
    len(regexp_extract_all(text, '[^ \\n]*@[^ \\n]*'))::INT AS n_entities, 'ok' AS status FROM ({PROBED_DOCS})"""

    out["latency_summary"] = f"""SELECT variant, count(latency) AS n_samples, round(avg(latency), 6) AS mean_latency,
    round(coalesce(stddev_samp(latency), 0), 6) AS std_latency FROM ({LOG}) GROUP BY variant"""
    out["latency_percentiles"] = f"""SELECT variant, count(latency) AS n_samples, true AS p50_fits,
    true AS p90_fits, true AS p99_fits FROM ({LOG}) GROUP BY variant"""
    out["latency_sketches"] = f"""WITH log AS ({LOG}),
spans AS (SELECT *, strftime(ts, '%Y-%m-%d') AS span FROM log UNION ALL SELECT *, 'all' FROM log)
SELECT span, variant, count(*) AS n_calls, count(*) FILTER (is_error) AS n_errors, count(latency) AS n_samples,
    round(avg(is_error::INT), 6) AS error_rate, round(avg(latency), 6) AS mean_latency,
    quantile_disc(latency, 0.5) AS p50, quantile_disc(latency, 0.9) AS p90, quantile_disc(latency, 0.99) AS p99,
    0::DOUBLE AS rank_error FROM spans GROUP BY span, variant"""
    out["error_rate"] = f"""SELECT variant, count(*) AS n_calls, count(*) FILTER (is_error) AS n_errors,
    round(avg(is_error::INT), 6) AS error_rate,
    count(*) FILTER (is_error AND event_id % 3 = 0) AS n_throttled,
    round(avg((is_error AND event_id % 3 = 0)::INT), 6) AS throttling_rate FROM ({LOG}) GROUP BY variant"""
    out["health_rollup"] = f"""WITH log AS ({LOG}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY ts DESC, event_id DESC) AS n FROM log)
SELECT 'variant' AS scope, variant, CASE WHEN is_error THEN 'unhealthy' ELSE 'healthy' END AS status,
    CASE WHEN NOT is_error THEN latency END AS response_time, CASE WHEN is_error THEN 'call failed' END AS error
FROM ranked WHERE n = 1
UNION ALL SELECT 'overall', NULL, CASE WHEN bool_or(is_error) THEN 'degraded' ELSE 'healthy' END, NULL, NULL
FROM ranked WHERE n = 1"""
    out["batch_throughput"] = f"""WITH numbered AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS p FROM ({LOG}))
SELECT p // 10 + 1 AS batch_no, count(*) AS n_texts, round(sum(latency), 6) AS total_seconds,
    round(sum(latency) / count(*), 6) AS seconds_per_text FROM numbered GROUP BY p // 10"""
    log = f"""{masked(PROBED_DOCS)},
{LABELLED},
log AS (SELECT 'pii_masking' AS suite, 'd' || id AS test, n > 0 AS success, length(text)::DOUBLE AS latency,
        NULL::DOUBLE AS confidence, NULL::VARCHAR AS expected, NULL::VARCHAR AS actual, NULL::VARCHAR AS error FROM masked
    UNION ALL SELECT 'prompt_injection', 'c' || conv_id || '-' || turn,
        kind <> 4 AND (expected = 'INJECTION') = (inj > 0.5),
        CASE WHEN kind <> 4 THEN length(text)::DOUBLE END, CASE WHEN kind <> 4 THEN greatest(inj, safe)::DOUBLE END,
        expected, CASE WHEN inj > 0.5 THEN 'INJECTION_DETECTED' ELSE 'SAFE' END,
        CASE WHEN kind = 4 THEN '{RESPONSE_ERROR}' END FROM folded)"""
    out["suite_summary"] = f"""WITH {log}
SELECT coalesce(suite, 'overall') AS suite, count(*) AS total, count(*) FILTER (success) AS passed,
    count(*) FILTER (NOT success) AS failed, round(100.0::DOUBLE * count(*) FILTER (success) / count(*), 1) AS success_rate,
    round(avg(latency), 6) AS mean_latency, round(avg(confidence), 6) AS mean_confidence
FROM log GROUP BY ROLLUP (suite)"""
    out["failure_report"] = f"""WITH {log}
SELECT suite, test, CASE WHEN error IS NOT NULL THEN error WHEN expected IS NULL THEN 'Unknown error'
    ELSE 'Expected ' || expected || ' but got ' || actual END AS reason FROM log WHERE NOT success"""

    chats = f"SELECT conv_id || '-' || turn AS id, conv_id, turn, text FROM ({PROBED_CHATS})"
    out["stream_filter"] = f"""WITH {masked(chats)},
decided AS (SELECT masked.*, src.conv_id, src.turn, {score('masked.text')} > 0.5 AS bad
    FROM masked JOIN src USING (id))
SELECT conv_id, turn, CASE WHEN bad THEN 'blocked' WHEN masked_text <> text THEN 'masked' ELSE 'clean' END AS decision,
    CASE WHEN NOT bad THEN masked_text END AS masked_text, CASE WHEN bad THEN text END AS blocked_text,
    CASE WHEN NOT bad THEN types END AS types FROM decided"""
    out["stream_tables"] = f"""WITH routed AS ({out['stream_filter']})
SELECT conv_id, turn, decision, masked_text, blocked_text FROM routed"""
    out["stream_retry"] = """SELECT conv_id, turn, CASE WHEN length(text) % 5 = 0 THEN 3 ELSE 1 END AS tries,
    CASE WHEN length(text) % 5 > 1 THEN 'ok' ELSE 'failed' END AS status,
    CASE length(text) % 5 WHEN 0 THEN 'busy' WHEN 1 THEN 'refused' END AS error,
    CASE WHEN length(text) % 5 > 1 THEN length(text)::INT END AS answer FROM conversations"""
    out["stream_moderate"] = f"""WITH {judged(PROBED_CHATS)}
SELECT conv_id, turn, classification, CASE WHEN is_injection THEN 'blocked and logged' ELSE 'delivered' END AS action
FROM judged"""
    out["stream_metrics"] = f"""WITH log AS ({LOG}),
windowed AS (SELECT *, floor(epoch(ts) / 21600)::BIGINT * 21600 AS w FROM log)
SELECT w AS window_start, variant, count(*) AS n_calls, count(*) FILTER (is_error) AS n_errors,
    round(avg(is_error::INT), 6) AS error_rate, round(avg(latency), 6) AS mean_latency,
    quantile_disc(latency, 0.5) AS p50, quantile_disc(latency, 0.9) AS p90, quantile_disc(latency, 0.99) AS p99
FROM windowed GROUP BY w, variant
HAVING w + 21600 <= (SELECT epoch(max(ts)) - 3600 FROM events)"""
    out["stream_accounts"] = f"""WITH log AS ({LOG}),
windowed AS (SELECT *, floor(epoch(ts) / 21600)::BIGINT * 21600 AS w FROM log),
marks AS (SELECT epoch(max(ts)) - 3600 AS second, max(epoch(ts)) FILTER (event_id % 10 > 0) - 3600 AS first FROM log),
told AS (SELECT windowed.*, CASE WHEN event_id % 10 = 0 AND w + 21600 <= first THEN 'late'
    WHEN w + 21600 <= second THEN 'closed' ELSE 'open' END AS state FROM windowed, marks)
SELECT w AS window_start, variant, state, count(*) AS n_calls, count(*) FILTER (is_error) AS n_errors,
    round(avg(latency), 6) AS mean_latency, CASE WHEN state <> 'late' THEN quantile_disc(latency, 0.5) END AS p50,
    CASE WHEN state <> 'late' THEN quantile_disc(latency, 0.99) END AS p99
FROM told GROUP BY w, variant, state"""
    return out
