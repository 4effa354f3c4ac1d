"""Answers of a service to many texts: within its rate, tried again when it fails, and kept batch by batch, so that a run that is
stopped goes on where it was.

``limited`` makes a provider (see enrich) of a function of one text. The rate is one budget: it is divided among a fixed number
of tasks, each of which keeps to its share, so all together never exceed it, however many machines run them.

``ask`` writes the texts that are wanted as files of a bounded number of rows; ``resume`` streams those files through a provider
until none is left. A batch's answers are one folder, written whole or overwritten by the next try, and the stream's checkpoint
says which batches are done: a stopped run asks again at most for the batch at hand, and for what the service has not answered.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .enrich import Provider


@dataclass
class Limits:
    """Calls a second and in a row, of all tasks together; tries after the first; seconds before the first of those (each
    further one waits twice as long)."""

    rate: float = 10.0
    burst: int = 3
    retries: int = 2
    wait: float = 0.5


class Bucket:
    """Tokens that come at a rate, up to a burst; a call takes one, and waits for it."""

    def __init__(self, rate: float, burst: float, clock=time.monotonic, sleep=time.sleep):
        self.rate, self.burst, self.clock, self.sleep = rate, max(1.0, burst), clock, sleep
        self.tokens, self.last = self.burst, clock()

    def take(self) -> None:
        now = self.clock()
        self.tokens = min(self.burst, self.tokens + (now - self.last) * self.rate)
        self.last = now
        if self.tokens < 1:
            pause = (1 - self.tokens) / self.rate
            self.sleep(pause)
            self.tokens, self.last = 1.0, now + pause
        self.tokens -= 1


def called(call: Callable, text: str, bucket: Bucket, limits: Limits, sleep=time.sleep):
    """call(text), or None when it has failed as often as it may. Every try takes a token."""
    for n in range(limits.retries + 1):
        bucket.take()
        try:
            return call(text)
        except Exception:  # noqa: BLE001 - whatever a service's client raises counts as a failure
            if n < limits.retries:
                sleep(limits.wait * 2**n)
    return None


def limited(call: Callable[[str], object], key: str, value: str, kind: str, limits: Limits = Limits(), tasks: int = 4) -> Provider:
    """A provider of rows (key, value) from call(text), which gives None or raises where there is no answer. kind is value's
    type; failures have no row, so they are not kept and are asked again another time."""
    # Tasks start with what the burst has for each of them; a burst of fewer than one each would let them exceed it.
    tasks = max(1, min(tasks, limits.burst))

    def run(frames):
        bucket = Bucket(limits.rate / tasks, limits.burst / tasks)
        for frame in frames:
            found = [(t, called(call, t, bucket, limits)) for t in frame[key]]
            rows = [(t, a) for t, a in found if a is not None]
            yield pd.DataFrame({key: [t for t, _ in rows], value: pd.Series([a for _, a in rows], dtype=object)})

    return lambda texts: texts.select(key).repartition(tasks).mapInPandas(run, f"{key} string, {value} {kind}")


def ask(texts: DataFrame, key: str, folder: str, rows: int = 5000) -> None:
    """Adds the different texts that are not blank to what is wanted, as files of at most so many rows, each of which is a batch."""
    wanted = texts.select(F.trim(F.col(key).cast("string")).alias(key)).where(f"{key} <> ''").distinct()
    wanted.write.mode("append").option("maxRecordsPerFile", rows).parquet(folder)


def answered(spark: SparkSession, folder: str, key: str, value: str, kind: str) -> DataFrame:
    """(key, value) of all batches; the last answer to a text counts."""
    rows = spark.read.schema(f"{key} string, {value} {kind}, batch long").option("basePath", folder)
    try:
        found = rows.parquet(f"{folder}/batch=*")
    except Exception as error:  # noqa: BLE001 - only the absence of any batch is passed over
        if "PATH_NOT_FOUND" not in str(error):
            raise
        found = spark.createDataFrame([], f"{key} string, {value} {kind}, batch long")
    return found.groupBy(key).agg(F.max_by(F.struct(value), "batch").alias("x")).select(key, f"x.{value}")


def resume(
    spark: SparkSession, asked: str, answers: str, checkpoint: str, provider: Provider, key: str, value: str, kind: str,
    files: int = 1
) -> DataFrame:
    """Streams what is wanted and not yet done through the provider, so many files a batch, and gives all answers kept so far.
    Texts that a batch before has answered are not asked again. What goes wrong in a batch ends the run, which can be resumed."""
    def one(rows: DataFrame, number: int) -> None:
        known = answered(rows.sparkSession, answers, key, value, kind).select(key)
        new = provider(rows.distinct().join(known, key, "left_anti"))
        new.select(key, value).write.mode("overwrite").parquet(f"{answers}/batch={number}")

    stream = spark.readStream.schema(f"{key} string").option("maxFilesPerTrigger", files).parquet(asked)
    stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return answered(spark, answers, key, value, kind)
