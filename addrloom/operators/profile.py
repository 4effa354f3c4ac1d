"""Field profiles, overlaps between columns of different tables, and what they suggest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import rules as R
from ..functions.text import blank, strip


def values(tables: dict[str, DataFrame]) -> DataFrame:
    """(file, field, value): non-blank stripped values of every column, unpivoted in one scan per table."""
    def one(name, df):
        columns = [c for c in df.columns if c.lower() not in ("unnamed: 0", "index", "")]
        wide = df.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in columns))
        long = wide.unpivot([], columns, "field", "value")
        return long.where(~blank(F.col("value"))).select(
            F.lit(name).alias("file"), "field", strip(F.col("value")).alias("value")
        )

    return reduce(DataFrame.unionByName, (one(n, d) for n, d in tables.items()))


def profile(long: DataFrame) -> DataFrame:
    return long.groupBy("file", "field").agg(
        F.count_distinct("value").alias("unique_count"), F.count("*").alias("non_null")
    )


def pairs(long: DataFrame, same_file: bool = False) -> DataFrame:
    """file_a, field_a, file_b, field_b, overlap, union_count, jaccard, containment_a, containment_b of fields with common values.

    Fields meet only where they share a value; the common values are counted by pair before anything else. The number of
    fields that share one value is bounded by the number of columns, not of rows."""
    different = long.distinct()
    sizes = different.groupBy("file", "field").agg(F.count("*").alias("n"))
    by_value = different.groupBy("value").agg(
        F.array_sort(F.collect_list(F.struct("file", "field"))).alias("k")
    ).where("size(k) > 1")
    met = by_value.select(
        F.explode(
            F.expr("flatten(transform(k, (x, i) -> transform(slice(k, i + 2, size(k)), y -> struct(x as a, y as b))))")
        ).alias("p")
    )
    met = met.groupBy("p.a", "p.b").agg(F.count("*").alias("overlap")).select(
        F.col("a.file").alias("file_a"), F.col("a.field").alias("field_a"), F.col("b.file").alias("file_b"),
        F.col("b.field").alias("field_b"), "overlap"
    )
    if not same_file:
        met = met.where("file_a <> file_b")
    for side in "ab":
        met = met.join(
            F.broadcast(
                sizes.select(
                    F.col("file").alias(f"file_{side}"), F.col("field").alias(f"field_{side}"),
                    F.col("n").alias(f"n_{side}")
                )
            ),
            [f"file_{side}", f"field_{side}"]
        )
    union = F.col("n_a") + F.col("n_b") - F.col("overlap")
    return met.select(
        "file_a", "field_a", "file_b", "field_b", "overlap", union.alias("union_count"),
        F.round(F.col("overlap") / union, 6).alias("jaccard"),
        F.round(F.col("overlap") / F.col("n_a"), 6).alias("containment_a"),
        F.round(F.col("overlap") / F.col("n_b"), 6).alias("containment_b")
    )


def sample_values(long: DataFrame, edges: DataFrame, most: int = 20) -> DataFrame:
    """The first common values of each pair, in order: a rank limit, which also holds task by task.

    Rows meet by value only: the pairs, of which there are no more than those of columns, go to where the values are."""
    found = long.distinct().groupBy("value").agg(F.collect_list(F.struct("file", "field")).alias("k")).where("size(k) > 1")
    common = found.select("value", "k", F.explode("k").alias("a")).select("value", "a", F.explode("k").alias("b")).select(
        F.col("a.file").alias("file_a"), F.col("a.field").alias("field_a"), F.col("b.file").alias("file_b"),
        F.col("b.field").alias("field_b"), "value"
    ).join(F.broadcast(edges), ["file_a", "field_a", "file_b", "field_b"])
    names = ["file_a", "field_a", "file_b", "field_b"]
    ranked = common.withColumn(
        "n", F.row_number().over(Window.partitionBy(*names).orderBy("value"))
    ).where(F.col("n") <= most)
    return ranked.groupBy(*names).agg(
        F.concat_ws(
            "|", F.transform(F.array_sort(F.collect_list(F.struct("n", "value"))), lambda x: x.value)
        ).alias("samples")
    )


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(
        F.concat_ws(".", "file_a", "field_a").alias("node"), F.concat_ws(".", "file_b", "field_b").alias("other")
    ).unionByName(
        edges.select(
            F.concat_ws(".", "file_b", "field_b").alias("node"), F.concat_ws(".", "file_a", "field_a").alias("other")
        )
    )


def degree_centrality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, degree, centrality (degree / (nodes - 1)) for all nodes."""
    names = nodes.select(F.concat_ws(".", "file", "field").alias("node"))
    degree = _ends(edges).groupBy("node").agg(F.count("*").alias("degree"))
    total = names.agg(F.count("*").alias("total"))
    rows = names.join(degree, "node", "left").na.fill(0).join(F.broadcast(total))
    return rows.select(
        "node", "degree",
        F.when(
            F.col("total") > 1, F.round(F.col("degree") / (F.col("total") - 1), 6)
        ).otherwise(0.0).alias("centrality")
    )


def communities(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, community): connected components named by their least node. The graph has one node per column, so its labels
    (not the rows) are what the driver gets."""
    ends = graph(nodes, edges).select("node", "other").collect()  # names of columns, in one job
    found = {r.node: r.node for r in ends}

    def top(x):
        while found[x] != x:
            found[x] = found[found[x]]
            x = found[x]
        return x

    for r in ends:
        if r.other is not None:
            a, b = sorted((top(r.node), top(r.other)))
            found[b] = a
    return nodes.sparkSession.createDataFrame([(n, top(n)) for n in sorted(found)], "node string, community string")


def ranked(edges: DataFrame, top: int = 20) -> DataFrame:
    return edges.orderBy(
        F.col("overlap").desc(), F.col("jaccard").desc(), "file_a", "field_a", "file_b", "field_b"
    ).limit(top)


def insight_high(edges: DataFrame) -> DataFrame:
    """Differently named fields with jaccard over 0.6: the five best."""
    return edges.where("field_a <> field_b and jaccard > 0.6").orderBy(
        F.col("jaccard").desc(), "file_a", "field_a", "file_b", "field_b"
    ).limit(5)


def insight_same_name(edges: DataFrame) -> DataFrame:
    return edges.where("field_a = field_b and jaccard > 0.8").orderBy(
        F.col("jaccard").desc(), "file_a", "field_a", "file_b", "field_b"
    ).limit(3)


def insight_foreign_key(edges: DataFrame) -> DataFrame:
    """Ten common values or more, other names, and one field (the first is tried first) over 0.9 contained in the other."""
    rows = edges.where("overlap >= 10 and field_a <> field_b and (containment_a > 0.9 or containment_b > 0.9)")
    a_in_b = F.col("containment_a") > 0.9
    name = lambda s: F.concat_ws(".", f"file_{s}", f"field_{s}")
    return rows.select(
        F.when(a_in_b, name("a")).otherwise(name("b")).alias("child"),
        F.when(a_in_b, name("b")).otherwise(name("a")).alias("parent"),
        F.when(a_in_b, F.col("containment_a")).otherwise(F.col("containment_b")).alias("containment"), "overlap"
    ).orderBy(F.col("containment").desc(), F.col("overlap").desc(), "child", "parent").limit(5)


def insight_central(centrality: DataFrame) -> DataFrame:
    return centrality.where("degree >= 2").orderBy(F.col("centrality").desc(), "node").limit(5)


def insight_counts(centrality: DataFrame) -> DataFrame:
    return centrality.agg(
        F.count_if(F.col("degree") > 0).alias("connected"), F.count_if(F.col("degree") == 0).alias("isolated")
    )


def insight_communities(found: DataFrame) -> DataFrame:
    """Communities that span two files or more: the five largest."""
    file = F.substring_index("node", ".", 1)
    return found.groupBy("community").agg(
        F.count("*").alias("n_fields"), F.count_distinct(file).alias("n_files")
    ).where("n_files >= 2").orderBy(F.col("n_fields").desc(), "community").limit(5)


def usage(edges: DataFrame) -> DataFrame:
    """What a relation serves, by the name of its first field."""
    name = F.lower("field_a")
    return edges.select(
        "file_a", "field_a", "file_b", "field_b",
        F.when(
            name.rlike("省|市|县|区|province|city|district"), "constraint"
        ).when(name.rlike("id|gid|编号|code"), "filter").otherwise("match").alias("use_for")
    )


def field_category(name: Column) -> Column:
    n = F.lower(name)
    return F.when(n.rlike("id|gid|编号|号码|code|uuid"), "identifier").when(
        n.rlike("省|市|县|区|街道|镇|乡|province|city|area|district"), "region"
    ).when(n.rlike("poi|name|名称|地址|address|location|标准化"), "address").otherwise("other")


def names_frame(spark: SparkSession, names: list[str]) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*map(F.lit, names))).alias("name"))


def field_types(names: DataFrame) -> DataFrame:
    """name, inferred_type, category, confidence by name alone."""
    n = F.lower(F.replace("name", F.lit(" "), F.lit("")))
    kind, category, sure = F.when(F.lit(False), ""), F.when(F.lit(False), ""), F.when(F.lit(False), 0.0)
    for group, weight in ((R.ADDRESS_FIELDS, 0.8), (R.ID_FIELDS, 0.7)):
        for label, parts in group.items():
            hit = n.rlike(R.any_of(parts))
            kind = kind.when(hit, "address" if weight == 0.8 else label)
            category, sure = category.when(hit, label), sure.when(hit, weight)
    return names.select(
        "name", kind.otherwise("text").alias("inferred_type"), category.otherwise("").alias("category"),
        sure.otherwise(0.5).alias("confidence")
    )


def refine_types(types: DataFrame, df: DataFrame, rid: str) -> DataFrame:
    """Types by name, overruled by the first ten rows: dates (over 70 %) always, numbers (over 80 %) where it was text."""
    columns = [c for c in df.columns if c != rid]
    first = df.orderBy(rid).limit(10).select(*(F.col(f"`{c}`").cast("string").alias(c) for c in columns))
    rows = first.unpivot([], columns, "name", "value").where("value is not null")
    shares = rows.groupBy("name").agg(
        F.avg(strip(F.col("value")).rlike(r"^-?[0-9]+(\.[0-9]+)?$").cast("int")).alias("numeric"),
        F.avg(F.col("value").rlike(r"^[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}").cast("int")).alias("dated")
    )
    out = types.join(shares, "name", "left")
    date, number = F.coalesce(F.col("dated") > 0.7, F.lit(False)), F.coalesce(
        (F.col("numeric") > 0.8) & (F.col("inferred_type") == "text"), F.lit(False)
    )
    return out.select(
        "name", F.when(date, "date").when(number, "numeric").otherwise(F.col("inferred_type")).alias("inferred_type"),
        "category", F.when(date, 0.8).when(number, 0.6).otherwise(F.col("confidence")).alias("confidence")
    )


def name_similarity(a: Column, b: Column) -> Column:
    """1 if equal, 0.7 if one holds the other, or else the share of a's letters that b has, of the longer length."""
    x, y = F.lower(a), F.lower(b)
    common = F.size(F.filter(F.split(x, ""), lambda c: y.contains(c)))
    return F.when(x == y, 1.0).when((x == "") | (y == ""), 0.0).when(y.contains(x) | x.contains(y), 0.7).otherwise(
        common / F.greatest(F.length(x), F.length(y))
    )


def related_fields(types: DataFrame) -> DataFrame:
    """Pairs of fields (source, name, inferred_type, category) of different sources with a score over 0.5. One row per column
    of a table: the pairs are of column names."""
    a, b = (
        types.select(*(F.col(c).alias(f"{c}_{s}") for c in ("source", "name", "inferred_type", "category")))
        for s in "ab"
    )
    score = F.when(
        (F.col("category_a") != "") & (F.col("category_a") == F.col("category_b")), 0.8
    ).when(F.col("inferred_type_a") == F.col("inferred_type_b"), 0.4).otherwise(0.0)
    score = F.least(F.lit(1.0), score + 0.3 * name_similarity(F.col("name_a"), F.col("name_b")))
    return a.join(b, F.col("source_a") < F.col("source_b")).select(
        "source_a", "name_a", "source_b", "name_b", F.round(score, 6).alias("score")
    ).where("score > 0.5")


def graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A row for each end of each edge: node, unique_count, other, overlap, jaccard; nodes without edges have a row of their own."""
    ends = edges.select(
        F.concat_ws(".", "file_a", "field_a").alias("n"), F.concat_ws(".", "file_b", "field_b").alias("other"),
        "overlap", "jaccard"
    )
    ends = ends.unionByName(ends.select(F.col("other").alias("n"), F.col("n").alias("other"), "overlap", "jaccard"))
    names = nodes.select(F.concat_ws(".", "file", "field").alias("node"), "unique_count")
    return names.join(ends, F.col("node") == F.col("n"), "left").drop("n")


def sampled_relations(long: DataFrame, most: int = 500) -> DataFrame:
    """The stricter analyser, on a sample: the first `most` different values of each field, by order. No fields of a leading
    underscore, no fields whose values are all numbers, pairs within a file too, at least three common values and jaccard of 0.1
    or more (to three digits)."""
    kept = long.where(~F.col("field").startswith("_")).distinct()
    first = F.row_number().over(Window.partitionBy("file", "field").orderBy("value"))
    kept = kept.withColumn("n", first).where(F.col("n") <= most).drop("n")
    words = kept.groupBy("file", "field").agg(
        F.min(F.col("value").rlike(r"^-?[0-9]+(\.[0-9]+)?$").cast("int")).alias("numeric")
    ).where("numeric = 0").select("file", "field")
    edges = pairs(kept.join(F.broadcast(words), ["file", "field"]), True)
    return edges.where("overlap >= 3 and jaccard >= 0.1").select(
        "file_a", "field_a", "file_b", "field_b", "overlap", F.round("jaccard", 3).alias("jaccard")
    )


def file_quality(df: DataFrame, columns: list[str], rid: str = "rid") -> DataFrame:
    """(field, filled): share of non-blank values, over all rows."""
    rows = df.agg(
        *(F.avg((~blank(F.col(c))).cast("int")).alias(c) for c in columns)
    ).unpivot([], columns, "field", "filled")
    return rows.select("field", F.round("filled", 6).alias("filled"))
