"""All places of known names in texts.

Up to ``MOST`` names are sent to the workers as one Aho-Corasick automaton, which reads a text once for all of them. More names
than that are met by an equi-join with the texts' substrings of the names' lengths: the same places, without a broadcast.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

MOST = 200_000
PLACES = "name string, at int"


def _automaton(names: list[str]):
    found = ahocorasick.Automaton()
    for name in names:
        found.add_word(name, len(name))
    found.make_automaton()
    return found


def _by_automaton(rows: DataFrame, names: list[str]) -> DataFrame:
    held = rows.sparkSession.sparkContext.broadcast(names)

    def run(batches):
        automaton = _automaton(held.value) if held.value else None
        for batch in batches:
            rows, ends, lengths = [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                for end, length in automaton.iter(text) if automaton and text else ():
                    rows.append(i)
                    ends.append(end)
                    lengths.append(length)
            at = np.array(ends, np.int32) - np.array(lengths, np.int32) + 1
            found = batch.take(pa.array(np.array(rows, np.int64)))
            texts = found.column("text").to_pylist()
            name = pa.array([t[a : a + n] for t, a, n in zip(texts, at, lengths)], pa.string())
            yield found.append_column("name", name).append_column("at", pa.array(at))

    schema = rows.select("*", F.lit("").alias("name"), F.lit(0).alias("at")).schema
    return rows.mapInArrow(run, schema)


def _by_substrings(rows: DataFrame, names: DataFrame) -> DataFrame:
    lengths = [r.n for r in names.select(F.length("name").alias("n")).distinct().orderBy("n").collect()]  # few
    sizes = F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>")
    spread = rows.select("*", F.explode(sizes).alias("_n")).where("length(text) >= _n").withColumn(
        "at", F.explode(F.expr("sequence(0, length(text) - _n)"))
    )
    spread = spread.withColumn("name", F.expr("substring(text, at + 1, _n)")).drop("_n")
    return spread.join(names.hint("merge"), "name").select(*rows.columns, "name", "at")


def places(rows: DataFrame, names: DataFrame, most: int | None = None) -> DataFrame:
    """rows (with a text column) once for every place at which a name (column name) starts, with name and at (from 0).

    Names that overlap, or lie within others, are all found. A null text has no place; empty and null names none either."""
    known = names.select("name").where("name <> ''").distinct()
    most = MOST if most is None else most
    few = [r.name for r in known.limit(most + 1).collect()]
    if len(few) <= most:
        return _by_automaton(rows, sorted(few))
    return _by_substrings(rows, known)
