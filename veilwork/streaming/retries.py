"""Scoring a stream with a model that fails at times: rows wait for their next try across micro-batches."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from veilwork.functions import rules
from veilwork.operators.model import RetryPolicy, ServiceError, score_with_model
from veilwork.operators.rows import quoted

_FINAL = "final: "


class Retries:
    """Scores rows and keeps, below ``path``, the tables ``answered``, ``dead`` and the waiting ones.

    A row that fails with an error worth another try waits ``delay`` seconds,
    then ``backoff`` times as long after each try, and is taken up by the first
    micro-batch behind that time; no task sleeps for it.  With the last try, or
    an error that is final, it goes to ``dead`` with the error.  So each row
    comes out once, in one of the two tables.

    A step (a micro-batch, or a round of ``drain``) reads what waited after the
    step before and writes tables of its own; its last write names it as done.
    A step that is lost on the way is done again from what it had read, one that
    was done is not repeated.  The rows that wait are written below ``path``,
    and need no executor to live.
    """

    def __init__(
        self, path: str, text_col: str, make_model: Callable[[], Callable[[list[str]], list]],
        batch_size: int = rules.DEFAULT_BATCH_SIZE, retry: RetryPolicy | None = None, token_budget: int | None = None,
    ):
        self.path, self.text_col, self.make_model = path, text_col, make_model
        self.batch_size, self.retry, self.token_budget = batch_size, retry or RetryPolicy(), token_budget

    def write(self, messages: DataFrame, checkpoint: str, available_now: bool = False) -> StreamingQuery:
        def put(batch: DataFrame, number: int) -> None:
            done, label = self._last(batch.sparkSession)
            if done < number:
                self._step(batch, label, number, f"b{number}")

        writer = messages.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()

    def drain(self, spark: SparkSession, sleep: Callable[[float], None] = time.sleep) -> None:
        """Go on without new rows until none waits; not while the stream runs."""
        while True:
            number, label = self._last(spark)
            waiting = self._waiting(spark, label)
            soonest = None if waiting is None else waiting.agg(F.min("due")).first()[0]
            if soonest is None:
                return
            sleep(max(0.0, soonest - time.time()))
            self._step(waiting.select("row.*").limit(0), label, number, f"{label}d")

    def answered(self, spark: SparkSession) -> DataFrame:
        """The scored rows with ``response`` and ``tries``."""
        return self._out(spark, "answered")

    def dead(self, spark: SparkSession) -> DataFrame:
        """The rows given up, with ``error`` and ``tries``."""
        return self._out(spark, "dead")

    def _out(self, spark: SparkSession, name: str) -> DataFrame:
        steps = spark.read.parquet(f"{self.path}/steps").select("label")
        rows = spark.read.parquet(f"{self.path}/{name}")
        # a row a step: what an unfinished one has left does not count
        return rows.join(F.broadcast(steps), "label", "left_semi").select("row.*", *[c for c in rows.columns if c not in ("row", "label", "step")])

    def _last(self, spark: SparkSession) -> tuple[int, str | None]:
        try:
            last = spark.read.parquet(f"{self.path}/steps").orderBy(F.desc("number"), F.desc(F.length("label"))).first()
        except AnalysisException as missing:
            if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return -1, None
        return last["number"], last["label"]

    def _waiting(self, spark: SparkSession, label: str | None) -> DataFrame | None:
        return None if label is None else spark.read.parquet(f"{self.path}/waiting/step={label}").drop("step")

    def _step(self, new: DataFrame, before: str | None, number: int, label: str) -> None:
        spark, now, policy = new.sparkSession, time.time(), self.retry
        rows = new.select(F.struct(*quoted(new.columns)).alias("row"), F.lit(0).alias("tries"), F.lit(0.0).alias("due"))
        waiting = self._waiting(spark, before)
        if waiting is not None:
            rows = rows.unionByName(waiting)
        due = rows.where(F.col("due") <= now).select("row", "tries", F.col(f"row.{quoted([self.text_col])[0]}").alias("text"))
        make_model, once = self.make_model, RetryPolicy(max_retries=0)

        def marked():
            model = make_model()

            def call(texts: list[str]) -> list:
                try:
                    return model(texts)
                except Exception as error:
                    raise ServiceError("", ("" if policy.may_retry(error) else _FINAL) + str(error)) from error

            return call

        scored = score_with_model(due, "text", marked, self.batch_size, once, self.token_budget).drop("text")
        tried = f"{self.path}/tried/step={label}"
        scored.withColumn("tries", F.col("tries") + 1).write.mode("overwrite").parquet(tried)
        scored = spark.read.parquet(tried)
        failed = F.col("status") != rules.STATUS_OK
        given_up = failed & (F.startswith("error", F.lit(_FINAL)) | (F.col("tries") > policy.max_retries))
        error = F.regexp_replace("error", f"^{_FINAL}", "")
        put = lambda df, name: df.write.mode("overwrite").parquet(f"{self.path}/{name}/step={label}")
        named = F.lit(label).alias("label")
        put(scored.where(~failed).select("row", "response", "latency_seconds", "tries", named), "answered")
        put(scored.where(given_up).select("row", error.alias("error"), "tries", named), "dead")
        wait = F.lit(now) + F.lit(float(policy.delay)) * F.pow(F.lit(float(policy.backoff)), F.col("tries") - 1)
        again = scored.where(failed & ~given_up).select("row", "tries", wait.alias("due"))
        put(again.unionByName(rows.where(F.col("due") > now)), "waiting")
        steps = spark.createDataFrame([(number, label)], "number bigint, label string")
        steps.write.mode("overwrite").parquet(f"{self.path}/steps/step={label}")
