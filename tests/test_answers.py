import time

import pytest

from addrloom.operators import answers, enrich
from pyspark.sql import functions as F

KIND = ("text", "reply", "string")


def _texts(spark, n):
    return spark.createDataFrame([(f"t{i:03}",) for i in range(n)] + [(" t000 ",), ("",), (None,)], "text string")


def _log(folder):
    return [float(x) for f in folder.iterdir() for x in f.read_text().split()]


def _client(folder, fails=()):
    """Writes down when it is called; by worker, as they do not share memory."""
    def call(text):
        import os

        with open(folder / str(os.getpid()), "a") as file:
            file.write(f"{time.time()}\n")
        if text in fails:
            raise ConnectionError(text)
        return text.upper()

    return call


def test_bucket():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    bucket = answers.Bucket(10, 3, lambda: now[0], sleep)
    for _ in range(13):
        bucket.take()
    assert len(slept) == 10 and abs(now[0] - 1.0) < 1e-9
    now[0] += 100
    for _ in range(3):
        bucket.take()
    assert len(slept) == 10


def test_tries_and_waits():
    waits, seen = [], []

    def call(text):
        seen.append(text)
        if len(seen) < 3:
            raise TimeoutError
        return "x"

    limits, bucket = answers.Limits(1e9, 10, 2, 0.5), answers.Bucket(1e9, 10)
    assert answers.called(call, "t", bucket, limits, waits.append) == "x" and waits == [0.5, 1.0]
    seen.clear()
    assert answers.called(call, "t", bucket, answers.Limits(1e9, 10, 1, 0.5), waits.append) is None and len(seen) == 2


def test_rate_of_four_tasks(spark, tmp_path):
    limits = answers.Limits(20.0, 4, 1, 0.01)
    provider = answers.limited(_client(tmp_path, {"t001"}), *KIND, limits, 4)
    texts = _texts(spark, 60).where("text like 't%'")
    got = {r.text: r.reply for r in provider(texts).collect()}
    assert got == {f"t{i:03}": f"T{i:03}" for i in range(60) if i != 1}
    calls = sorted(_log(tmp_path))
    assert len(calls) == 61
    # No second sees more than the rate and the burst.
    assert max(sum(a <= t < a + 1 for t in calls) for a in calls) <= 24


def test_a_stopped_run_asks_for_the_rest_only(spark, tmp_path):
    (calls := tmp_path / "calls").mkdir()
    asked, kept, checkpoint = (f"file://{tmp_path}/{n}" for n in ("asked", "kept", "checkpoint"))
    answers.ask(_texts(spark, 40).coalesce(1), "text", asked, 10)
    service = answers.limited(_client(calls, {"t003"}), *KIND, answers.Limits(1e6, 100, 0, 0.0), 2)
    batches = []

    def dies(texts):
        batches.append(1)
        if len(batches) == 3:
            raise RuntimeError("stopped")
        return service(texts)

    assert answers.answered(spark, kept, *KIND).collect() == []
    with pytest.raises(Exception, match="stopped"):
        answers.resume(spark, asked, kept, checkpoint, dies, *KIND)
    before, held = len(_log(calls)), answers.answered(spark, kept, *KIND).count()
    assert 0 < before < 40 and held >= before - 1
    found = answers.resume(spark, asked, kept, checkpoint, service, *KIND)
    assert {r.text for r in found.collect()} == {f"t{i:03}" for i in range(40)} - {"t003"}
    assert len(_log(calls)) == 40
    # More texts, some of which are known: only new ones are asked for.
    answers.ask(_texts(spark, 45), "text", asked, 100)
    assert answers.resume(spark, asked, kept, checkpoint, service, *KIND).count() == 44
    assert len(_log(calls)) == 40 + 5 + 1  # and the one that had no answer


def test_any_columns_go_along(spark):
    rows = spark.createDataFrame([(1, "city=杭州市", "x", "y", "old")], "rid long, addr string, text string, std string, cached string")
    known = spark.createDataFrame([("city=杭州市", {"city": "杭州市"})], enrich.STRUCTURES)
    out, _, _ = enrich.standardise(rows, "addr", known, spark.createDataFrame([], enrich.POIS), None, lambda d: d.withColumn("poi", F.lit("")))
    got = out.first()
    assert (got.rid, got.text, got.std, got["市"], got.cached) == (1, "x", "y", "杭州市", False)
