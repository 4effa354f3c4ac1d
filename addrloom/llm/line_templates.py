"""Line dedup by a log-template tree: lines of templates that recur across documents stay in their first document only.

Documents of one and the same text count as one, and fare alike: what recurs only within copies of a text stays for the operators
that find copies, which would meet nothing but remnants otherwise.

The tree has a fixed depth: the number of tokens, then the leading tokens (a token with a digit counts as a variable field).
In a leaf, a line joins the nearest seed that it shares all but ``VARIABLE_MOST`` of its places with; the places where a
template's lines deviate are its variable ones, whatever stands there, and documents are counted over all of its lines. Seeds are
lines whose tokens are the most frequent at their places, then the more frequent lines, so the outcome hangs on no order. One
worker clusters at most ``LEAF_MOST`` different lines of a leaf: a larger leaf is first divided by counts of (place, token),
round by round, into the lines near its most frequent tokens (one template) and the others, by their token at the steadiest place.

Lines of fewer than ``LEAST`` tokens, and lines that their fields leave without two constant tokens, are templates as they stand
(digits too). Only blank lines are never dropped. Documents stay, also when all their lines go (empty text then); a null text
stays null; texts are read whole, however long. The first document is the least by id (a null id before all), then by its
text's hash; equal rows count once and are treated alike; of lines tied for a seed the first by its letters is it. An empty
table gives no row. Extra columns are kept, whatever their names: where kept_text, n_lines or n_dropped is taken, the added
column gets an underscore before its name.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import bloom_of, carrying, column, finished, free_names, int64_lists, keep_only, rows_held, slices, staged, table, without_held

DEPTH, LEAST, DOCUMENTS, VARIABLE_MOST, LEAF_MOST = 3, 3, 2, 0.3, 4000
_DIGIT, _FIELD, FIELD = re.compile(rb"[0-9]"), re.compile(rb"(?<![^ ])[^ ]*[0-9][^ ]*"), "<*>"


def _signed(x: int) -> int:
    return x - (1 << 64) * (x >> 63)


def parse(line: bytes) -> tuple[int, int, bytes] | None:
    """Leaf, hash and form (tokens with fields masked, one space between) of a line; None if it is blank."""
    tokens = line.split()
    if not tokens:
        return None
    exact = form = b" ".join(tokens)
    if len(tokens) >= LEAST and _DIGIT.search(form):
        form = _FIELD.sub(FIELD.encode(), form)
        tokens = form.split(b" ")
    if len(tokens) - tokens.count(
        FIELD.encode()
    ) < 2 or len(tokens) < LEAST:  # a leaf of its own: nothing is generalised
        own = _signed(xxhash.xxh3_64_intdigest(exact, seed=1))
        return own, own, exact
    leaf = xxhash.xxh3_64_intdigest(b"%d " % len(tokens) + b" ".join(tokens[:DEPTH]))
    return _signed(leaf), _signed(xxhash.xxh3_64_intdigest(form)), form


def lines_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split(b"\n") if text else []


def _leaves(batches):
    keep_only()
    for batch in slices(batches):
        found = []
        for text in batch.column(0).to_pylist():
            found.append(np.array(list({p[0] for p in map(parse, lines_of(text)) if p}), np.int64))
        yield pa.RecordBatch.from_arrays([int64_lists(found)], ["leaf"])


def _candidates(wanted):
    def run(batches):
        keep_only()
        for batch in slices(batches):
            at, leaves, lines, forms = [], [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                parsed = {p[1]: p for p in map(parse, lines_of(text)) if p}
                if parsed:
                    keys = np.array([p[0] for p in parsed.values()], np.int64)
                    for p, held in zip(parsed.values(), wanted.value.holds(keys).tolist()):
                        if held:
                            at.append(i)
                            leaves.append(p[0])
                            lines.append(p[1])
                            forms.append(p[2].decode("utf-8", "surrogatepass"))
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(rows), batch.column(1).take(rows), pa.array(leaves, pa.int64()),
                    pa.array(lines, pa.int64()), pa.array(forms, pa.string())
                ],
                ["doc_id", "rk", "leaf", "line", "form"]
            )

    return run


def cluster(forms: list[str], counts: list[int]) -> list[int]:
    """The place of each line's seed among the lines (forms of one number of tokens); a seed's own place for itself."""
    ids: dict[tuple[int, str], int] = {}
    rows = np.array([[ids.setdefault(x, len(ids)) for x in enumerate(f.split(" "))] for f in forms], np.int64)
    weight = np.bincount(rows.ravel())[rows].sum(axis=1).tolist()
    most = int(VARIABLE_MOST * rows.shape[1] + 1e-9)
    seeds, held, out = np.empty_like(rows), [], [0] * len(forms)
    for i in sorted(range(len(forms)), key=lambda i: (-weight[i], -counts[i], forms[i])):
        if held:
            far = (seeds[: len(held)] != rows[i]).sum(axis=1)
            near = int(far.argmin())
            if far[near] <= most:
                out[i] = held[near]
                continue
        seeds[len(held)] = rows[i]
        held.append(i)
        out[i] = i
    return out


def _clusters(batches):
    """(part, line, n, form), sorted by part, to the (line, template) of lines that have joined another one's template."""
    keep_only()
    now, lines, counts, forms = None, [], [], []

    def settled():
        made = [(lines[i], lines[k]) for i, k in enumerate(cluster(forms, counts)) if i != k] if len(lines) > 1 else []
        lines.clear(), counts.clear(), forms.clear()
        return made

    for batch in batches:
        found = []
        for part, line, n, form in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if part != now:
                found += settled()
                now = part
            lines.append(line)
            counts.append(n)
            forms.append(form)
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())],
            ["line", "template"]
        )
    found = settled()
    yield pa.RecordBatch.from_arrays(
        [pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["line", "template"]
    )


def _divided(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines (part, line, n, form) near their part's most frequent tokens, as (line, template), and the others in smaller parts."""
    # Keys are cast so that both sides of the join are dealt anew: then the rows of a part with very many lines can be split.
    tokens = lines.select(
        "part", F.posexplode(F.split("form", " ")).alias("at", "token")
    ).groupBy("part", "at", "token").agg(F.count("*").alias("n"))
    places = tokens.groupBy("part", "at").agg(
        F.max_by("token", F.struct("n", "token")).alias("token"), F.count("*").alias("different"),
        F.sum(F.col("n").cast("double") * F.col("n")).alias("steady")
    )
    split_at = F.max_by("at", F.struct(F.col("different") > 1, "steady", -F.col("at"))).alias("split_at")
    parts = places.groupBy("part").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("at", "token"))), lambda x: x["token"]).alias("usual"),
        split_at
    ).withColumnRenamed("part", "part_")
    joined = lines.join(
        parts, F.col("part").cast("string") == F.col("part_").cast("string")
    ).withColumn("tokens", F.split("form", " "))
    far = F.expr("size(filter(zip_with(tokens, usual, (x, y) -> x <> y), x -> x))")
    judged = staged(
        joined.select(
            "part", "line", "n", "form", F.xxhash64("part", "split_at", F.expr("tokens[split_at]")).alias("next"),
            (far <= F.floor(VARIABLE_MOST * F.size("tokens") + F.lit(1e-9))).alias("near")
        )
    )
    return judged.where("near").select(
        "line", F.xxhash64("part", F.lit("usual")).alias("template")
    ), judged.where("not near").select(F.col("next").alias("part"), "line", "n", "form")


def templates(lines: DataFrame, documents: int = DOCUMENTS, leaf_most: int = LEAF_MOST) -> DataFrame:
    """(leaf, line, n, form) of the different lines to (line, template); lines that are missing are their own template."""
    leaves = lines.groupBy("leaf").agg(
        F.count("*").alias("size"), F.sum("n").alias("total")
    ).where(f"size > 1 and total >= {documents}").select(F.col("leaf").cast("string").alias("l"))
    open_lines = lines.join(
        leaves, F.col("leaf").cast("string") == F.col("l")
    ).select(F.col("leaf").alias("part"), "line", "n", "form")
    made = []
    while True:
        large = open_lines.groupBy("part").count().where(F.col("count") > leaf_most).select(
            F.col("part").cast("string").alias("p")
        )
        clustered = lambda df: df.select(
            "part", "line", "n", "form"
        ).repartition("part").sortWithinPartitions("part").mapInArrow(
            _clusters, "line long, template long"
        )
        if large.isEmpty():
            made.append(clustered(open_lines))
            return functools.reduce(DataFrame.unionByName, made)
        large = staged(large)
        made.append(clustered(open_lines.join(large, F.col("part").cast("string") == F.col("p"), "left_anti")))
        near, open_lines = _divided(open_lines.join(large, F.col("part").cast("string") == F.col("p"), "left_semi"))
        made.append(near)


def dropped_lines(docs: DataFrame, documents: int = DOCUMENTS) -> DataFrame:
    """(doc_id, rk, line): hashes of the lines that go, by document; docs has doc_id, rk (a hash of the text) and text."""
    leaves = docs.select("text").mapInArrow(_leaves, "leaf array<long>").select(F.explode("leaf").alias("leaf"))
    often = bloom_of(leaves.groupBy("leaf").count().where(F.col("count") >= documents).select("leaf"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = staged(
        docs.select("doc_id", "rk", "text").mapInArrow(
            _candidates(often), f"doc_id {kind}, rk long, leaf long, line long, form string"
        ),
        heavy=True
    )
    lines = staged(found.groupBy("leaf", "line").agg(F.count("*").alias("n"), F.min("form").alias("form")))
    known = lines.select("line").join(
        templates(lines, documents).withColumnRenamed("line", "line_"), F.col("line") == F.col("line_"), "left"
    ).select(F.col("line").cast("string").alias("line_"), F.coalesce("template", "line").alias("template"))
    rows = staged(
        found.select("doc_id", "rk", "line").join(
            known, F.col("line").cast("string") == F.col("line_")
        ).select("doc_id", "rk", "line", "template"),
        heavy=True
    )
    # rk is the text's hash: texts are counted, not rows.
    first = F.struct(F.col("doc_id").alias("d"), F.col("rk").alias("r"))
    texts = rows.groupBy("template", "rk").agg(F.min(first).alias("first"))
    common = texts.groupBy("template").agg(
        F.count("*").alias("n"), F.min("first").alias("first")
    ).where(F.col("n") >= documents).select(
        F.col("template").cast("string").alias("t"), F.col("first.r").alias("r")
    )
    return rows.join(
        common, F.col("template").cast("string") == F.col("t")
    ).where("rk <> r").select("doc_id", "rk", "line")


def _strip(whole=None, most: float | None = None):
    """Takes the lines that go out of texts; with a filter, of the rows that it does not hold, which lose none. A text that
    would lose more than the share `most` of its bytes stays whole."""
    def run(batches):
        keep_only()
        for batch in slices(without_held(batches, whole) if whole else batches):
            texts, n_lines, n_dropped = [], [], []
            for text, gone in zip(
                batch.column("text").to_pylist(), [None] * len(batch) if whole else batch.column("gone").to_pylist()
            ):
                lines, kept = lines_of(text), text
                left = lines
                if gone:
                    gone = set(gone)
                    left = [x for x in lines if not ((p := parse(x)) and p[1] in gone)]
                    if most is not None and sum(map(len, left)) < (1 - most) * sum(map(len, lines)):
                        left = lines
                if len(left) < len(lines):
                    n_dropped.append(len(lines) - len(left))
                    kept = b"\n".join(left).decode("utf-8", "surrogatepass")
                else:
                    n_dropped.append(0)
                texts.append(kept)
                n_lines.append(len(lines))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"), pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()),
                    pa.array(n_dropped, pa.int64())
                ],
                ["row", "kept_text", "n_lines", "n_dropped"]
            )

    return run


def _dropped(docs: DataFrame, documents: int, most: float | None = None) -> DataFrame:
    """row (all columns of docs in one), kept_text, n_lines, n_dropped."""
    keyed = docs.select(
        F.xxhash64("text").alias("rk"), "doc_id", "text",
        F.struct(*(column(c) for c in docs.columns if c != "text")).alias("row")
    )
    gone = dropped_lines(
        keyed.select("rk", "doc_id", "text"), documents
    ).groupBy("rk", "doc_id").agg(F.collect_set("line").alias("gone"))
    gone = staged(gone.select(F.col("rk").alias("k"), F.col("doc_id").alias("d"), "gone"), heavy=True)
    touched = bloom_of(gone.select("k"))
    joined = rows_held(keyed, touched).join(
        gone, (F.col("rk") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d")), "left"
    ).select("row", "text", "gone")
    made = carrying(keyed.schema["row"].dataType, "kept_text string, n_lines long, n_dropped long")
    return joined.mapInArrow(_strip(most=most), made).unionByName(
        keyed.select("rk", "text", "row").mapInArrow(_strip(touched), made)
    )


def dedup_lines(docs: DataFrame, documents: int = DOCUMENTS) -> DataFrame:
    """The other columns of docs with kept_text, n_lines and n_dropped."""
    columns, added = [c for c in docs.columns if c != "text"], ["kept_text", "n_lines", "n_dropped"]
    own = [F.col(a).alias(free) for a, free in zip(added, free_names(added, columns))]
    return _dropped(docs, documents).select(*(F.col("row").getField(c).alias(c) for c in columns), *own)


def deduped_documents(docs: DataFrame, documents: int = DOCUMENTS, most: float | None = None) -> DataFrame:
    """The columns of docs, with the texts that are left (n_chars follows them). With `most`, a text that would lose more than
    that share of its bytes stays whole: nearly all of a near copy's lines recur, and what is left of it says little."""
    own = lambda c: F.col("row").getField(c)
    cut = F.when(F.col("n_dropped") > 0, F.length("kept_text").cast("long"))
    return _dropped(docs, documents, most).select(
        *(
            F.col("kept_text").alias(c) if c == "text" else cut.otherwise(own(c)).alias(c) if c == "n_chars"
            else own(c).alias(c) for c in docs.columns
        )
    )


def op3_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return finished(
        spark,
        lambda: dedup_lines(docs).select(
            "doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256")
        )
    )
