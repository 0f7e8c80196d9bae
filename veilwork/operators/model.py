"""Scoring with a user's model."""

from __future__ import annotations

import json
import sys
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F, types as T

from veilwork import schemas
from veilwork.functions import rules
from veilwork.operators.rows import quoted

# What runs in the workers travels with the job: they need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class ServiceError(Exception):
    """An error of the model service that carries a code."""

    def __init__(self, code: str, message: str = ""):
        super().__init__(message or code)
        self.code = code


@dataclass(frozen=True)
class RetryPolicy:
    """Retry busy signals and unknown errors; other service errors are final."""

    max_retries: int = rules.MAX_RETRIES
    delay: float = rules.RETRY_DELAY
    backoff: float = rules.RETRY_BACKOFF
    codes: tuple[str, ...] = rules.RETRY_CODES

    def may_retry(self, error: Exception) -> bool:
        return not isinstance(error, ServiceError) or error.code in self.codes

    def run(self, call: Callable, sleep: Callable[[float], None] = time.sleep):
        waits = [self.delay * self.backoff**i for i in range(self.max_retries)]
        for wait in waits:
            try:
                return call()
            except Exception as error:
                if not self.may_retry(error):
                    raise
            sleep(wait)
        return call()


def words_of(text: str) -> int:
    """Tokens of a text where the caller has no better count: its words."""
    return len(text.split())


def budgeted(lengths: list[int], batch_size: int, budget: int) -> Iterator[list[int]]:
    """Indexes in batches, longest first, whose padded cost (longest times count) keeps to the budget.

    Texts of like length go together.  A text over the budget goes alone.
    """
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    at = 0
    while at < len(order):
        room = max(1, min(batch_size, budget // max(lengths[order[at]], 1)))
        yield order[at:at + room]
        at += room


def score_with_model(
    df: DataFrame,
    text_col: str,
    make_model: Callable[[], Callable[[list[str]], list]],
    batch_size: int = rules.DEFAULT_BATCH_SIZE,
    retry: RetryPolicy | None = None,
    token_budget: int | None = None,
    count_tokens: Callable[[str], int] = words_of,
) -> DataFrame:
    """Add the model's answer per text as JSON, its latency, error and status.

    ``make_model`` is called once per task and returns a function from a list
    of texts to a list of answers.  Spark sets the partitions and Arrow moves
    the rows; inside a task the texts go to the model ``batch_size`` at a time.
    The time of a call is shared out over its texts.  A call that fails for
    good fails its texts, not the task.  NULL texts are not sent.

    With a ``token_budget`` the texts of an Arrow batch go to the model sorted
    by ``count_tokens``, in calls of at most ``batch_size`` texts whose longest
    times count keeps to the budget; no row is shuffled for it, and answers come
    back in the order of the rows.

    All columns of ``df`` make the trip to Python and back: select before.
    Columns of the names added give way.
    """
    policy = retry or RetryPolicy()
    added = T.StructType.fromDDL(schemas.MODEL_FIELDS)
    df = df.select(*quoted(df.columns, but=added.names))
    out_schema = T.StructType([*df.schema.fields, *added.fields])
    ok, failed = rules.STATUS_OK, rules.STATUS_FAILED

    def call(model, texts: list[str]) -> tuple[list, float]:
        started = time.perf_counter()
        answers = policy.run(lambda: model(texts))
        if len(answers) != len(texts):
            raise ValueError(f"{len(answers)} answers for {len(texts)} texts")
        return answers, (time.perf_counter() - started) / len(texts)

    text_at = df.columns.index(text_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make_model()
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            response, latency, error = [None] * len(texts), [None] * len(texts), [None] * len(texts)
            given = [i for i, t in enumerate(texts) if t is not None]
            if token_budget is None:
                calls = [given[at:at + batch_size] for at in range(0, len(given), batch_size)]
            else:
                lengths = [count_tokens(texts[i]) for i in given]
                calls = [[given[i] for i in b] for b in budgeted(lengths, batch_size, token_budget)]
            for sent in calls:
                try:
                    answers, seconds = call(model, [texts[i] for i in sent])
                    for i, answer in zip(sent, [json.dumps(a, ensure_ascii=False) for a in answers]):
                        response[i], latency[i] = answer, seconds
                except Exception as failure:
                    for i in sent:
                        error[i] = str(failure)
            status = [ok if e is None else failed for e in error]
            # the table's own columns go back as they came
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(response, pa.string()), pa.array(latency, pa.float64()),
                 pa.array(error, pa.string()), pa.array(status, pa.string())],
                names=out_schema.names,
            )

    return df.mapInArrow(score, out_schema)


def fit_text_classifier(
    labelled: DataFrame, text_col: str = "text", label_col: str = "label", features: int = 1 << 14
):
    """A small text-classification pipeline, trained by Spark ML."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, Tokenizer

    return Pipeline(
        stages=[
            Tokenizer(inputCol=text_col, outputCol="_words"),
            HashingTF(inputCol="_words", outputCol="_features", numFeatures=features),
            LogisticRegression(
                featuresCol="_features", labelCol=label_col, probabilityCol="_probability",
                rawPredictionCol="_raw", predictionCol="_prediction", maxIter=20, regParam=0.01,
            ),
        ]
    ).fit(labelled.where(F.col(text_col).isNotNull()))


def score_with_pipeline(
    df: DataFrame, model, labels: tuple[str, str] = ("SAFE", "INJECTION"), text_col: str = "text"
) -> DataFrame:
    """Add ``labels`` in the contract form from a fitted Spark ML pipeline."""
    from pyspark.ml.functions import vector_to_array

    keep = list(df.columns)
    # the tokenizer does not take NULL
    ready = df.withColumn("_original", F.col(text_col)).withColumn(
        text_col, F.coalesce(text_col, F.lit(""))
    )
    scored = model.transform(ready).withColumn("_p", vector_to_array("_probability"))
    answer = F.array(
        *[
            F.struct(F.lit(name).alias("label"), F.col("_p")[i].alias("score"))
            for i, name in enumerate(labels)
        ]
    )
    return scored.select(
        *[F.col("_original").alias(c) if c == text_col else F.col(f"`{c}`") for c in keep],
        answer.alias("labels"),
    )
