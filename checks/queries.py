"""The queries of the driver contract, each over whole tables of ``sf_dir``.

Two stand-ins, because the tables have no such data:

* *probed* tables: every row's text is followed by a probe text (see
  ``probes``), chosen by the row's key;
* a call log: ``events`` with ``value`` as latency, ``user_id % 2`` as variant
  and ``event_type = 'error'`` as failure.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from checks import probes
from veilwork import functions as vf
from veilwork.functions import injection as inj, rules, spans
from veilwork.functions.rules import PiiRule
from veilwork.functions.sqltext import any_of, lit
from veilwork.operators import (
    answers, batch, chunks, distinct, evaluation, gazetteer, injection, metrics, model, persons, pii, rollout, rows, sketches,
    span_eval, thresholds, tokens, variants,
)
from veilwork.plans import compliance
from veilwork.session import run_dir
from veilwork.sources import responses, sinks, texts
from veilwork.streaming import (
    accounts, filters as stream_filters, metrics as live_metrics, retries as stream_retries, sinks as stream_sinks,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# ---- inputs ---------------------------------------------------------------


def documents(spark, sf_dir) -> DataFrame:
    return texts.read_texts(spark, f"{sf_dir}/documents.parquet", "parquet", "doc_id", "text")


def _pick(values, key: str) -> str:
    return f"element_at(array({', '.join(values)}), CAST(pmod({key}, {len(values)}) AS int) + 1)"


def probed_documents(spark, sf_dir) -> DataFrame:
    probe = _pick([lit(t) for t, _ in probes.PII_PROBES], "doc_id")
    expected = _pick(
        [f"array({any_of(e)})" if e else "CAST(array() AS array<string>)" for _, e in probes.PII_PROBES],
        "doc_id",
    )
    return documents(spark, sf_dir).selectExpr(
        "doc_id", f"concat(text, ' ', {probe}) AS text", f"{expected} AS expected_types"
    )


def probed_conversations(spark, sf_dir) -> DataFrame:
    probe = _pick([lit(t) for t, _ in probes.INJECTION_PROBES], "conv_id + turn")
    expected = _pick([lit(e) for _, e in probes.INJECTION_PROBES], "conv_id + turn")
    return texts.spread(spark.read.parquet(f"{sf_dir}/conversations.parquet")).selectExpr(
        "conv_id", "turn", "role", f"concat(text, ' ', {probe}) AS text", f"{expected} AS expected"
    )


def call_log(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(
        "event_id", "ts", "concat('v', user_id % 2) AS variant", "value AS latency",
        "event_type = 'error' AS is_error",
    )


def _r(col, digits: int = 6):
    return F.round(col, digits)


# ---- personal data --------------------------------------------------------


@query
def detect_entities(spark, sf_dir):
    found = pii.add_entities(documents(spark, sf_dir))
    return rows.unroll(found, "raw_entities", "no", "doc_id").selectExpr(
        "doc_id", "e.entity_group AS label", "e.start", "e.end", "e.word", "e.score"
    )


@query
def resolve_spans(spark, sf_dir):
    """Overlapping spans of different rules become one."""
    df = probed_documents(spark, sf_dir).selectExpr("doc_id", "text", f"{spans.raw_spans('text')} AS raw")
    joined = rows.unroll(df, spans.resolve_spans("text", "raw"), "no", "doc_id")
    return joined.select("doc_id", "e.start", "e.end", "e.label", "e.word")


@query
def apply_mask(spark, sf_dir):
    """Spans as the rules give them, overlaps and all, put in right to left."""
    df = probed_documents(spark, sf_dir).selectExpr(
        "doc_id", "text", f"{spans.spans_to_entities(spans.raw_spans('text'))} AS e"
    )
    return df.select("doc_id", vf.apply_mask("text", "e").alias("masked_text"))


@query
def extract_entities(spark, sf_dir):
    """Tagged labels and scores on, below and above the cut-off."""
    tagged = (
        "transform(raw_entities, e -> named_struct('entity_group', concat('B-', e.entity_group), "
        "'entity', e.entity, 'score', (length(e.word) % 5) * 0.25D, 'word', e.word, "
        "'start', e.start, 'end', e.end))"
    )
    df = pii.add_entities(probed_documents(spark, sf_dir)).selectExpr("doc_id", f"{tagged} AS e")
    return rows.unroll(df, spans.extract_entities("e"), "no", "doc_id").select("doc_id", "e.*")


@query
def mask_pii(spark, sf_dir):
    masked = pii.mask_pii(documents(spark, sf_dir))
    return masked.select("doc_id", "masked_text", F.size("entities").alias("n_entities"))


@query
def mask_pii_text(spark, sf_dir):
    return probed_documents(spark, sf_dir).select("doc_id", vf.mask_pii_text("text").alias("masked_text"))


@query
def entity_rows(spark, sf_dir):
    return pii.entity_rows(pii.mask_pii(probed_documents(spark, sf_dir)), "doc_id")


@query
def pii_type_counts(spark, sf_dir):
    return pii.pii_type_counts(pii.mask_pii(probed_documents(spark, sf_dir)), "doc_id")


@query
def pii_type_totals(spark, sf_dir):
    return pii.pii_type_totals(pii.mask_pii(probed_documents(spark, sf_dir)))


@query
def pii_status(spark, sf_dir):
    out = pii.pii_status(pii.mask_pii(probed_documents(spark, sf_dir)))
    return out.select("doc_id", "pii_status", F.array_join("types", ",").alias("types"))


@query
def deidentify_records(spark, sf_dir):
    return pii.deidentify_records(probed_documents(spark, sf_dir).select("doc_id", "text"))


@query
def ticket_preview(spark, sf_dir):
    out = pii.redaction_summary(probed_documents(spark, sf_dir).select("doc_id", "text"))
    counts = "array_join(transform(map_entries(type_counts), e -> concat(e.key, ':', e.value)), ',')"
    return out.selectExpr("doc_id", "original_preview", "masked_preview", f"{counts} AS type_counts")


@query
def detect_persons(spark, sf_dir):
    names = spark.sql(f"SELECT explode(array({any_of(probes.GIVEN_NAMES_TABLE)})) AS name")
    return persons.detect_persons(probed_documents(spark, sf_dir), names, "doc_id")


@query
def detect_names(spark, sf_dir):
    """Names of one and two words; those of two are the first such words of some texts."""
    docs = probed_documents(spark, sf_dir).select("doc_id", "text")
    single = spark.sql(f"SELECT explode(array({any_of(probes.GIVEN_NAMES_TABLE)})) AS name")
    double = docs.where("doc_id % 7 = 0").selectExpr("regexp_extract(text, '[A-Z][a-z]+ [a-z]+', 0) AS name").where("name <> ''")
    return gazetteer.detect_names(docs, single.unionByName(double), "doc_id")


@query
def merge_bio(spark, sf_dir):
    """Spans cut into word tokens with B- and I- tags, and merged again."""
    word = PiiRule("W", "", "[^ ]+", in_line=False)
    token = (
        "named_struct('entity_group', CAST(NULL AS string), "
        "'entity', concat(IF(i = 0, 'B-', 'I-'), e.entity_group), "
        "'score', 0.5D + 0.125D * (i % 3), 'word', s.word, "
        "'start', e.start + s.start, 'end', e.start + s.end)"
    )
    tokens = (
        "flatten(transform(raw_entities, e -> "
        f"transform({spans.raw_spans('e.word', (word,))}, (s, i) -> {token})))"
    )
    df = pii.add_entities(probed_documents(spark, sf_dir)).selectExpr("doc_id", "text", f"{tokens} AS tokens")
    merged = rows.unroll(df, spans.merge_bio("text", "tokens"), "no", "doc_id")
    return merged.select(
        "doc_id", F.col("e.entity_group").alias("label"), "e.start", "e.end", "e.word",
        _r("e.score").alias("score"),
    )


@query
def evaluate_pii(spark, sf_dir):
    """Per set of expected types: texts, texts with a find, and with a right one."""
    judged = evaluation.evaluate_pii(pii.mask_pii(probed_documents(spark, sf_dir)))
    return judged.groupBy(F.array_join("expected_types", ",").alias("expected")).agg(
        F.count("*").alias("n"),
        F.count_if("success").alias("n_passed"),
        F.count_if(F.coalesce("type_found", F.lit(False))).alias("n_type_found"),
        F.sum("entities_found").alias("entities_found"),
    )


#: A stand-in for another detector: it misses some spans, begins others late, and names some otherwise.
_OTHER_SPANS = (
    "transform(filter(entities, e -> (e.start + doc_id) % 5 != 0), e -> named_struct('label', "
    "IF(e.start % 11 = 0, 'OTHER', e.type), 'start', least(e.start + doc_id % 6, e.end - 1), 'end', e.end))"
)


@query
def span_scores(spark, sf_dir):
    """The rules' spans as expected, those of the stand-in as found."""
    found = pii.mask_pii(probed_documents(spark, sf_dir)).selectExpr(
        "doc_id", "transform(entities, e -> named_struct('label', e.type, 'start', e.start, 'end', e.end)) AS expected",
        f"{_OTHER_SPANS} AS found",
    )
    scores = span_eval.span_scores(span_eval.match_spans(found, "doc_id", "expected", "found"))
    return scores.withColumns({c: _r(c) for c in ("precision", "recall", "f1")})


def _injection_counts(spark, sf_dir) -> DataFrame:
    """Scores of the rules beside what is expected; digits of the turn stand for a finer model."""
    judged = injection.detect_prompt_injection(probed_conversations(spark, sf_dir)).selectExpr(
        "round(injection_score, 6) + CAST((conv_id * 7 + turn) % 10 AS double) / 100 AS s", "expected = 'INJECTION' AS y"
    )
    return thresholds.score_counts(judged, "s", "y")


@query
def threshold_curve(spark, sf_dir):
    curve = thresholds.threshold_curve(_injection_counts(spark, sf_dir))
    shares = ("precision", "recall", "fpr", "f1", "youden", "auc_step", "ap_step")
    return curve.withColumns({c: _r(c, 9) for c in shares})


@query
def threshold_summary(spark, sf_dir):
    summary = thresholds.curve_summary(thresholds.threshold_curve(_injection_counts(spark, sf_dir)))
    return summary.select(*[_r(c, 9).alias(c) for c in summary.columns])


@query
def sql_functions(spark, sf_dir):
    vf.register_functions(spark)
    probed_documents(spark, sf_dir).createOrReplaceTempView("veilwork_sql_documents")
    return spark.sql(
        "SELECT doc_id, mask_pii_text(text) AS masked_text, check_prompt_injection(text) AS is_injection "
        "FROM veilwork_sql_documents"
    )


# ---- prompt injection -----------------------------------------------------


@query
def score_injection(spark, sf_dir):
    return probed_conversations(spark, sf_dir).select(
        "conv_id", "turn",
        _r(vf.score_injection("text")).alias("score"),
        _r(vf.score_injection("text", mitigation="off")).alias("score_plain"),
        _r(vf.score_injection("text", mitigation="zero")).alias("score_zeroed"),
    )


@query
def detect_injection(spark, sf_dir):
    """Both labels known, with a low threshold."""
    out = injection.detect_prompt_injection(probed_conversations(spark, sf_dir), threshold=0.3, top_k=2)
    return out.select(
        "conv_id", "turn", "is_injection", "classification",
        *[_r(c).alias(c) for c in ("injection_score", "safe_score", "confidence")],
    )


@query
def check_injection(spark, sf_dir):
    return probed_conversations(spark, sf_dir).select(
        "conv_id", "turn", vf.check_prompt_injection("text").alias("is_injection")
    )


@query
def response_tier(spark, sf_dir):
    scored = probed_conversations(spark, sf_dir).withColumn("score", _r(vf.score_injection("text")))
    return scored.select("conv_id", "turn", vf.response_tier("score").alias("tier"))


@query
def moderate_chat(spark, sf_dir):
    out = injection.moderate_chat(probed_conversations(spark, sf_dir))
    return out.select(
        "conv_id", "turn", "role", "classification", _r("confidence").alias("confidence"), "action"
    )


@query
def validate_requests(spark, sf_dir):
    requests = probed_conversations(spark, sf_dir).withColumnRenamed("text", "query")
    out = injection.validate_requests(requests)
    return out.select("conv_id", "turn", "verdict", "response", _r("confidence").alias("confidence"))


@query
def evaluate_injection(spark, sf_dir):
    judged = injection.detect_prompt_injection(probed_conversations(spark, sf_dir))
    return evaluation.confusion_counts(evaluation.evaluate_injection(judged))


def messages(spark, sf_dir) -> DataFrame:
    docs = probed_documents(spark, sf_dir).selectExpr(
        "concat('d', doc_id) AS message_id", "text"
    )
    chats = probed_conversations(spark, sf_dir).selectExpr(
        "concat('c', conv_id, '-', turn) AS message_id", "text"
    )
    return docs.unionByName(chats)


@query
def route_messages(spark, sf_dir):
    out = injection.route(messages(spark, sf_dir))
    return out.select(
        "message_id", "decision", "masked_text",
        F.array_join(F.array_sort(F.array_distinct("entities.type")), ",").alias("types"),
    )


@query
def compliance_report(spark, sf_dir):
    """Stand-in for the time of an item: one second per character."""
    df = messages(spark, sf_dir).withColumn("seconds", F.length("text"))
    out = compliance.compliance_report(df, seconds_col="seconds")
    return out.withColumn("avg_seconds", _r("avg_seconds"))


# ---- requests, responses, failures ----------------------------------------


def token_responses(spark, sf_dir) -> DataFrame:
    """Detected spans as a model would send them; some answers are broken."""
    found = pii.add_entities(probed_documents(spark, sf_dir))
    json = "to_json(raw_entities)"
    return found.selectExpr(
        "doc_id", "text",
        f"CASE WHEN doc_id % 10 = 3 THEN 'oops' WHEN doc_id % 10 = 7 THEN substring({json}, 1, length({json}) - 1) "
        f"ELSE {json} END AS response",
    )


@query
def parse_entities(spark, sf_dir):
    parsed = responses.parse_entities(token_responses(spark, sf_dir), "response")
    listed = "array_join(transform(entities, e -> concat(e.entity_group, '@', e.start, '-', e.end)), ' ')"
    return parsed.selectExpr("doc_id", "size(entities) AS n_entities", f"{listed} AS listed")


@query
def failed_rows(spark, sf_dir):
    parsed = responses.parse_entities(token_responses(spark, sf_dir), "response")
    return responses.with_status(parsed, "entities").select("doc_id", "text", "error", "status")


def label_responses(spark, sf_dir) -> DataFrame:
    """Scores as label responses: flat, nested, extra labels, broken."""
    scored = probed_conversations(spark, sf_dir).withColumn("score", F.expr(inj.score_injection("text")))

    def entry(label: str, score: str) -> str:
        return f"named_struct('label', '{label}', 'score', {score})"

    both = f"array({entry('SAFE', '1D - score')}, {entry('injection', 'score')})"
    more = (
        f"array({entry('Malicious', '0.125D')}, {entry('LABEL_1', '0.75D')}, "
        f"{entry('unsafe', 'score')}, {entry('benign', '0.25D')})"
    )
    return scored.selectExpr(
        "conv_id", "turn", "text",
        f"CASE pmod(conv_id + 2 * turn, 5) WHEN 0 THEN to_json({both}) WHEN 1 THEN to_json(array({both})) "
        f"WHEN 2 THEN to_json({more}) WHEN 3 THEN '[]' ELSE 'oops' END AS response",
    )


@query
def parse_labels(spark, sf_dir):
    parsed = responses.with_status(responses.parse_labels(label_responses(spark, sf_dir), "response"), "labels")
    return parsed.selectExpr(
        "conv_id", "turn", "size(labels) AS n_labels",
        "array_join(transform(labels, e -> e.label), ',') AS names", "status",
    )


@query
def fold_label_scores(spark, sf_dir):
    parsed = responses.parse_labels(label_responses(spark, sf_dir), "response")
    out = injection.detect_prompt_injection(parsed, labels_col="labels")
    return out.select(
        "conv_id", "turn", "is_injection", "classification",
        *[_r(c).alias(c) for c in ("injection_score", "safe_score", "confidence")],
    )


@query
def build_requests(spark, sf_dir):
    batched = batch.assign_batches(documents(spark, sf_dir), "doc_id", rows_per_slot=100)
    return responses.build_requests(batched)


@query
def capture_sample(spark, sf_dir):
    return sinks.capture_sample(documents(spark, sf_dir), "doc_id").select("doc_id", "text")


# ---- batches, variants, chunks, copies ------------------------------------


@query
def assign_batches(spark, sf_dir):
    """Small slots, so that many of them have to fit together."""
    out = batch.assign_batches(call_log(spark, sf_dir), "event_id", size=7, rows_per_slot=500)
    return out.select("event_id", "position", "batch_no", "n_batches")


@query
def number_rows(spark, sf_dir):
    """Rows in the order of their users, of which some have many."""
    return batch.number_rows(spark.read.parquet(f"{sf_dir}/events.parquet"), "user_id", "event_id", size=16)


@query
def adaptive_batch(spark, sf_dir):
    by_role = batch.adaptive_batch_size(
        spark.read.parquet(f"{sf_dir}/conversations.parquet"), by="role"
    ).withColumnRenamed("role", "part")
    by_lang = batch.adaptive_batch_size(
        spark.read.parquet(f"{sf_dir}/documents.parquet"), by="lang"
    ).withColumnRenamed("lang", "part")
    return by_role.unionByName(by_lang).withColumn("mean_chars", _r("mean_chars"))


@query
def batch_mask(spark, sf_dir):
    out = batch.batch_process(probed_documents(spark, sf_dir), "mask_pii")
    return out.select("doc_id", "masked_text", F.size("entities").alias("n_entities"), "status")


@query
def batch_injection(spark, sf_dir):
    out = batch.batch_process(probed_conversations(spark, sf_dir), "detect_injection")
    return out.select("conv_id", "turn", "classification", _r("confidence").alias("confidence"), "status")


@query
def assign_variant(spark, sf_dir):
    out = variants.assign_variant(documents(spark, sf_dir), "doc_id", {"PIIMasking": 0.5, "PromptInjection": 0.5})
    out = variants.assign_variant(out, "doc_id", {"stable": 9, "canary": 1}, out="rollout")
    return out.select("doc_id", "variant", "rollout")


#: Two variants at first, a third from the second week on; the weights of a day hold until the next one named.
ROLLOUT = [
    ("2024-01-03 00:00:00", "stable", 95.0), ("2024-01-03 00:00:00", "canary", 5.0),
    ("2024-01-08 12:00:00", "stable", 50.0), ("2024-01-08 12:00:00", "canary", 30.0), ("2024-01-08 12:00:00", "new", 20.0),
    ("2024-01-15 06:30:00", "stable", 0.0), ("2024-01-15 06:30:00", "canary", 1.0), ("2024-01-15 06:30:00", "new", 1.0),
]


@query
def assign_rollout(spark, sf_dir):
    weights = spark.createDataFrame(ROLLOUT, "valid_from string, variant string, weight double")
    calls = call_log(spark, sf_dir).withColumn(
        "ts", F.expr("timestamp_micros(timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts))")
    )
    out = rollout.assign_rollout(calls, weights.withColumn("valid_from", F.to_timestamp("valid_from")), "event_id")
    return out.select("event_id", "variant")


@query
def score_by_variant(spark, sf_dir):
    """Two variants with rules of their own threshold, and an unknown one."""
    split = variants.assign_variant(probed_conversations(spark, sf_dir), "conv_id", {"a": 4, "b": 4, "c": 2})
    scorers = {n: inj.judge_text("text", t) for n, t in (("a", 0.5), ("b", 0.85))}
    out = variants.score_by_variant(split, "variant", scorers)
    return out.selectExpr("conv_id", "turn", "variant", "scored.classification", "status", "error")


@query
def score_distinct(spark, sf_dir):
    return distinct.score_distinct(
        documents(spark, sf_dir), lambda d: pii.mask_pii(d, return_entities=False), key="doc_id"
    ).select("doc_id", "masked_text")


@query
def normalize_pages(spark, sf_dir):
    pages = texts.spread(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"))
    return pages.select("page_id", vf.normalize_text("html").alias("text"))


@query
def chunk_documents(spark, sf_dir):
    return chunks.chunk_text(documents(spark, sf_dir), max_chars=1024, overlap=128)


@query
def lift_spans(spark, sf_dir):
    """Found piece by piece, the spans are those of the whole text."""
    pieces = chunks.chunk_text(probed_documents(spark, sf_dir).select("doc_id", "text"), max_chars=512, overlap=128)
    found = pii.add_entities(pieces, "chunk", "entities")
    lifted = chunks.lift_spans(found, "doc_id", priority=[r.label for r in rules.PII_RULES])
    return rows.unroll(lifted, "entities", "no", "doc_id").selectExpr(
        "doc_id", "e.start", "e.end", "e.entity_group AS label", "e.word"
    )


@query
def score_with_store(spark, sf_dir):
    """Two runs over texts that partly repeat, then a new version: what was scored, what was reused."""
    docs = documents(spark, sf_dir).withColumn("text", F.expr("substring(text, 1, 40 + doc_id % 2)"))
    store = run_dir(spark, "answer-store")

    def scorer(new: DataFrame) -> DataFrame:
        return new.withColumn("n", F.length("text"))

    runs = [("first", docs.where("doc_id % 3 > 0"), "1"), ("again", docs, "1"), ("other version", docs, "2")]
    out = [
        answers.score_with_store(part, scorer, store, version, "doc_id").selectExpr(
            f"'{run}' AS run", "doc_id", "CAST(get_json_object(answer, '$.n') AS int) AS n", "reused"
        )
        for run, part, version in runs
    ]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query
def chunk_tokens(spark, sf_dir):
    return tokens.chunk_tokens(documents(spark, sf_dir))


@query
def lift_token_spans(spark, sf_dir):
    """Found in pieces of so many words, the spans are those of the whole text."""
    pieces = tokens.chunk_tokens(probed_documents(spark, sf_dir).select("doc_id", "text"), max_tokens=90, overlap=30)
    found = pii.add_entities(pieces, "chunk", "entities")
    lifted = chunks.lift_spans(found, "doc_id", priority=[r.label for r in rules.PII_RULES])
    return rows.unroll(lifted, "entities", "no", "doc_id").selectExpr(
        "doc_id", "e.start", "e.end", "e.entity_group AS label", "e.word"
    )


@query
def mask_in_chunks(spark, sf_dir):
    out = chunks.mask_in_chunks(
        probed_documents(spark, sf_dir).select("doc_id", "text"),
        lambda pieces: pii.add_entities(pieces, "chunk", "entities"),
        "doc_id", max_chars=700, overlap=200, priority=[r.label for r in rules.PII_RULES],
    )
    return out.select("doc_id", "masked_text", F.size("entities").alias("n_entities"))


# ---- models ---------------------------------------------------------------


@query
def score_with_model(spark, sf_dir):
    """The model stands for a user's: it flags texts with many e's."""

    def make_model():
        def score(batch_texts: list[str]) -> list:
            shares = [t.count("e") / max(len(t), 1) for t in batch_texts]
            return [[{"label": "INJECTION" if s > 0.1 else "SAFE", "score": 0.9}] for s in shares]

        return score

    out = batch.batch_process(
        documents(spark, sf_dir), "detect_injection", batch_size=32, make_model=make_model
    )
    return out.select("doc_id", "classification", "confidence", "status")


@query
def token_batches(spark, sf_dir):
    """Small slots, so that classes are spread over several."""
    out = tokens.token_batches(
        documents(spark, sf_dir).select("doc_id", tokens.count_words("text").alias("words")), "doc_id", "words",
        rows_per_slot=300,
    )
    return out.drop("words")


@query
def score_with_token_budget(spark, sf_dir):
    """The model refuses calls over the budget, so each of them would be a failed row."""
    budget, most = rules.MAX_BATCH_TOKENS, rules.MAX_BATCH_ROWS

    def make_model():
        def score(batch_texts: list[str]) -> list:
            sizes = [len(t.split()) for t in batch_texts]
            if len(sizes) > most or len(sizes) > 1 and max(sizes) * len(sizes) > budget:
                raise model.ServiceError("ValidationException", "too many tokens")
            shares = [t.count("e") / max(len(t), 1) for t in batch_texts]
            return [[{"label": "INJECTION" if s > 0.1 else "SAFE", "score": 0.9}] for s in shares]

        return score

    out = batch.batch_process(
        documents(spark, sf_dir), "detect_injection", batch_size=most, make_model=make_model, token_budget=budget
    )
    return out.select("doc_id", "classification", "confidence", "status")


@query
def batch_failures(spark, sf_dir):
    """The model fails by content: for good, as busy at each try, or with an answer no one can read."""
    failure = model.ServiceError

    def make_model():
        def score(batch_texts: list[str]) -> list:
            kind = len(batch_texts[0]) % 5
            if kind == 0:
                raise failure("ThrottlingException")
            if kind == 1:
                raise failure("ModelError", "broken text")
            return ["no labels"] if kind == 2 else [[{"label": "SAFE", "score": 0.75}]]

        return score

    retry = model.RetryPolicy(max_retries=2, delay=0.0)
    out = batch.batch_process(
        documents(spark, sf_dir), "detect_injection", batch_size=1, make_model=make_model, retry=retry
    )
    return out.select("doc_id", "classification", "confidence", "error", "status")


@query
def batch_mask_model(spark, sf_dir):
    """The model tags the parts of whatever has an @, as one that answers by token does."""

    def make_model():
        import re

        def tag(text: str) -> list:
            tags = []
            for m in re.finditer(r"[^ \n]*@[^ \n]*", text):
                cut = m.start() + m[0].index("@") + 1
                tags.append({"entity": "B-EMAIL", "score": 0.9, "word": text[m.start():cut], "start": m.start(), "end": cut})
                if cut < m.end():
                    tags.append({"entity": "I-EMAIL", "score": 0.8, "word": text[cut:m.end()], "start": cut, "end": m.end()})
            return tags

        return lambda batch_texts: [tag(t) for t in batch_texts]

    out = batch.batch_process(
        probed_documents(spark, sf_dir), "mask_pii", make_model=make_model, merge_tags=True
    )
    return out.select("doc_id", "masked_text", F.size("entities").alias("n_entities"), "status")


@query
def score_with_pipeline(spark, sf_dir):
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    fitted = model.fit_text_classifier(docs.join(labels, "doc_id"))
    out = injection.detect_prompt_injection(
        model.score_with_pipeline(docs, fitted), labels_col="labels"
    )
    return out.select("doc_id", "classification", _r("confidence").alias("confidence"))


# ---- metrics and reports --------------------------------------------------


@query
def latency_summary(spark, sf_dir):
    out = metrics.latency_summary(call_log(spark, sf_dir), "variant")
    return out.select("variant", "n_samples", *[_r(c).alias(c) for c in ("mean_latency", "std_latency")])


@query
def latency_percentiles(spark, sf_dir):
    """Whether each percentile's rank lies within the sketch's stated error, at any size."""
    ranks = metrics.percentile_ranks(call_log(spark, sf_dir), "variant")
    return ranks.select("variant", "n_samples", "p50_fits", "p90_fits", "p99_fits")


@query
def latency_sketches(spark, sf_dir):
    """Hours are sketched and stored, then merged to days and to the whole."""
    path = run_dir(spark, "sketches")
    sketches.latency_sketches(call_log(spark, sf_dir)).write.parquet(path)
    stored = spark.read.parquet(path)
    day = sketches.merge_sketches(stored, [F.to_date("span_start").cast("string").alias("span"), "variant"])
    whole = sketches.merge_sketches(stored, [F.lit("all").alias("span"), "variant"])
    out = day.unionByName(whole)
    return out.withColumns({c: _r(c) for c in ("error_rate", "mean_latency")})


@query
def error_rate(spark, sf_dir):
    """One error in three stands for a throttled call."""
    code = F.when(F.col("is_error") & (F.col("event_id") % 3 == 0), "ThrottlingException").when(F.col("is_error"), "ModelError")
    rates = metrics.error_rate(call_log(spark, sf_dir).withColumn("code", code), "variant", code="code")
    return rates.withColumns({c: _r(c) for c in ("error_rate", "throttling_rate")})


@query
def health_rollup(spark, sf_dir):
    log = call_log(spark, sf_dir).withColumns(
        {"ok": ~F.col("is_error"), "error": F.when(F.col("is_error"), "call failed")}
    )
    return metrics.health_rollup(log, "variant", ["ts", "event_id"])


@query
def batch_throughput(spark, sf_dir):
    batched = batch.assign_batches(call_log(spark, sf_dir), "event_id", rows_per_slot=1000)
    out = metrics.batch_throughput(batched)
    return out.select(
        "batch_no", "n_texts", *[_r(c).alias(c) for c in ("total_seconds", "seconds_per_text")]
    )


def evaluation_log(spark, sf_dir) -> DataFrame:
    """One row per evaluated text of both suites; latency is a stand-in."""
    found = pii.mask_pii(probed_documents(spark, sf_dir))
    pii_log = evaluation.evaluate_pii(found).selectExpr(
        "'pii_masking' AS suite", "concat('d', doc_id) AS test", "success",
        "CAST(length(text) AS double) AS latency", "CAST(entities_found AS bigint) AS entities_found",
        "CAST(NULL AS double) AS confidence", "CAST(NULL AS string) AS expected",
        "CAST(NULL AS string) AS actual", "CAST(NULL AS string) AS error",
    )
    labelled = responses.with_status(
        responses.parse_labels(
            label_responses(spark, sf_dir).withColumn(
                "expected", F.expr(_pick([lit(e) for _, e in probes.INJECTION_PROBES], "conv_id + turn"))
            ),
            "response",
        ),
        "labels",
    )
    judged = evaluation.evaluate_injection(injection.detect_prompt_injection(labelled, labels_col="labels"))
    injection_log = judged.selectExpr(
        "'prompt_injection' AS suite", "concat('c', conv_id, '-', turn) AS test",
        "success AND error IS NULL AS success",
        "IF(error IS NULL, CAST(length(text) AS double), NULL) AS latency",
        "CAST(NULL AS bigint) AS entities_found", "IF(error IS NULL, confidence, NULL) AS confidence",
        "expected", "classification AS actual", "error",
    )
    return pii_log.unionByName(injection_log).select(*evaluation.EVAL_FIELDS)


@query
def suite_summary(spark, sf_dir):
    out = evaluation.suite_summary(evaluation_log(spark, sf_dir))
    return out.withColumns({c: _r(c) for c in ("mean_latency", "mean_confidence")})


@query
def failure_report(spark, sf_dir):
    return evaluation.failure_report(evaluation_log(spark, sf_dir))


# ---- streams --------------------------------------------------------------


def _stream_of(spark, sf_dir, table: str) -> DataFrame:
    """A table as a stream, be it one file or a folder of part files; only as a pattern may the path be a file."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    return texts.stream_texts(
        spark, f"{sf_dir}/{table}.parque[t]", "parquet", schema.simpleString()[7:-1].replace(":", " "),
    )


def _probed_stream(spark, sf_dir) -> DataFrame:
    probe = _pick([lit(t) for t, _ in probes.INJECTION_PROBES], "conv_id + turn")
    return _stream_of(spark, sf_dir, "conversations").selectExpr(
        "conv_id", "turn", "role", f"concat(text, ' ', {probe}) AS text"
    )


@query
def stream_filter(spark, sf_dir):
    base = run_dir(spark, "stream-filter")
    stream_filters.filter_stream(
        _probed_stream(spark, sf_dir), f"{base}/out", f"{base}/state", available_now=True
    ).awaitTermination()
    return spark.read.parquet(f"{base}/out").select(
        "conv_id", "turn", "decision", "masked_text", "blocked_text",
        F.array_join(F.array_sort(F.array_distinct("entities.type")), ",").alias("types"),
    )


@query
def stream_moderate(spark, sf_dir):
    base = run_dir(spark, "stream-moderate")
    stream_filters.moderate_stream(
        _probed_stream(spark, sf_dir), f"{base}/out", f"{base}/state", available_now=True
    ).awaitTermination()
    return spark.read.parquet(f"{base}/out").select("conv_id", "turn", "classification", "action")


@query
def stream_metrics(spark, sf_dir):
    """Six-hour windows that the watermark has closed; times as seconds since 1970 (UTC)."""
    base = run_dir(spark, "stream-metrics")
    calls = _stream_of(spark, sf_dir, "events").selectExpr(
        "timestamp_micros(timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)) AS ts",
        "concat('v', user_id % 2) AS variant", "value AS latency", "event_type = 'error' AS is_error",
    )
    figures = live_metrics.metrics_stream(calls, "6 hours", "1 hour", by="variant")
    live_metrics.write_metrics(
        figures, f"{base}/out", f"{base}/state", available_now=True
    ).awaitTermination()
    return spark.read.parquet(f"{base}/out").select(
        F.unix_seconds("window_start").alias("window_start"), "variant", "n_calls", "n_errors",
        _r("error_rate").alias("error_rate"), _r("mean_latency").alias("mean_latency"), "p50", "p90", "p99",
    )


@query
def stream_accounts(spark, sf_dir):
    """Two runs: a tenth of the events comes with the second, and part of it too late."""
    base = run_dir(spark, "stream-accounts")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(
        "timestamp_micros(timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)) AS ts",
        "concat('v', user_id % 2) AS variant", "value AS latency", "event_type = 'error' AS is_error", "event_id",
    )
    for part in ("event_id % 10 > 0", "event_id % 10 = 0"):
        events.where(part).drop("event_id").write.mode("append").parquet(f"{base}/in")
        calls = spark.readStream.schema(events.drop("event_id").schema).parquet(f"{base}/in")
        accounts.write_accounts(
            calls, f"{base}/out", f"{base}/state", "6 hours", "1 hour", by=("variant",), available_now=True
        ).awaitTermination()
    kept = accounts.read_accounts(spark, f"{base}/out").select(
        F.unix_seconds("window_start").alias("window_start"), "variant",
        F.expr("IF(provisional, 'open', 'closed')").alias("state"), "n_calls", "n_errors",
        _r("mean_latency").alias("mean_latency"), "p50", "p99",
    )
    late = accounts.read_late(spark, f"{base}/out").groupBy(
        F.unix_seconds(F.window("ts", "6 hours")["start"]).alias("window_start"), "variant", F.lit("late").alias("state")
    ).agg(
        F.count("*").alias("n_calls"), F.count_if("is_error").alias("n_errors"), _r(F.avg("latency")).alias("mean_latency"),
        F.lit(None).cast("double").alias("p50"), F.lit(None).cast("double").alias("p99"),
    )
    return kept.unionByName(late)


@query
def stream_tables(spark, sf_dir):
    """Each message is in one table, whose rows say which."""
    base = run_dir(spark, "stream-tables")
    stream_sinks.route_tables(
        _probed_stream(spark, sf_dir), f"{base}/out", f"{base}/state", available_now=True
    ).awaitTermination()
    table = lambda name: stream_sinks.read_table(spark, f"{base}/out", name)
    shown = {"blocked": ("NULL", "text"), "masked": ("masked_text", "NULL"), "clean": ("text", "NULL")}
    parts = [
        table(name).selectExpr("conv_id", "turn", f"'{name}' AS decision", f"CAST({masked} AS string) AS masked_text",
                               f"CAST({blocked} AS string) AS blocked_text")
        for name, (masked, blocked) in shown.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def stream_retry(spark, sf_dir):
    """The model is busy for some texts, whenever it is asked, and refuses others."""

    def make_model():
        def score(batch_texts: list[str]) -> list:
            kinds = {len(t) % 5 for t in batch_texts}
            if 0 in kinds:
                raise model.ServiceError("ThrottlingException", "busy")
            if 1 in kinds:
                raise model.ServiceError("ValidationException", "refused")
            return [len(t) for t in batch_texts]

        return score

    base = run_dir(spark, "stream-retries")
    retries = stream_retries.Retries(f"{base}/out", "text", make_model, batch_size=1, retry=model.RetryPolicy(2, 0.0))
    retries.write(_stream_of(spark, sf_dir, "conversations"), f"{base}/state", available_now=True).awaitTermination()
    retries.drain(spark)
    shown = ["conv_id", "turn", "tries", "status", "error", "answer"]
    ok = retries.answered(spark).selectExpr(*shown[:3], "'ok' AS status", "CAST(NULL AS string) AS error", "CAST(response AS int) AS answer")
    return ok.unionByName(retries.dead(spark).selectExpr(*shown[:3], "'failed' AS status", "error", "CAST(NULL AS int) AS answer"))
