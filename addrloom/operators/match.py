"""Tiered linkage of a source table with an ordered list of targets.

Tables have rid, core, poi, pois (';'-separated) and district, and, where semantic scores are wanted, an embedding v of poi on
both sides. Each tier sees the rows that earlier ones left. As an exact tier's outcome for a row depends on no other row, these
are computed on their own and the first one counts; similarities are computed for the rows that they leave open.
"""

from __future__ import annotations

import uuid
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import rules as R, similarity, text as T
from ..sources.shared import drop, home, kept, looked_up
from . import nearest

LEVELS = {0: "EXACT", 1: "EXACT", 2: "EXACT", 3: "HIGH_CONFIDENCE", 4: "NEED_REVIEW"}
EXACT_TYPES = ("core_field_exact", "poi_exact", "poi_contains")


def _present(c: Column) -> Column:
    return T.strip(c) != ""


def exact_by(source: DataFrame, target: DataFrame, field: str) -> DataFrame:
    """(rid, target_rid, score): the first target row with the same trimmed value."""
    key = T.strip(F.col(field).cast("string")).alias("k")
    first = target.select(key, "rid").where("k <> '' and k <> 'nan'").groupBy("k").agg(F.min("rid").alias("target_rid"))
    return source.select("rid", key).where("k <> '' and k <> 'nan'").join(first, "k").select(
        "rid", "target_rid", F.lit(100.0).alias("score")
    )


def contained(source: DataFrame, target: DataFrame) -> DataFrame:
    """A target POI of two letters or more among the source's POIs: the one first met in the target; of its rows the last."""
    rows = target.select(
        T.strip(F.col("poi")).alias("k"), "rid"
    ).where("length(k) >= 2 and k <> 'nan'").groupBy("k").agg(
        F.min("rid").alias("at"), F.max("rid").alias("target_rid")
    )
    words = source.select(
        "rid", F.explode(F.split(F.coalesce("pois", F.lit("")), ";")).alias("k")
    ).select("rid", T.strip(F.col("k")).alias("k")).where("k <> ''")
    return words.join(rows, "k").groupBy("rid").agg(
        F.min_by("target_rid", "at").alias("target_rid"), F.lit(100.0).alias("score")
    )


def _named(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, F.when(_present(F.col("poi")), T.strip(F.col("poi")))).where(F.col(name).isNotNull())


def _closest(source: DataFrame, target: DataFrame, least: float) -> DataFrame:
    """(rid, a, district, target_rid, b, target_district, score): the target of the best ratio of at least `least`.

    Ratios depend on strings alone, so different strings are scored once; on ties the target's first row wins."""
    s, t = _named(source, "a").select("rid", "a", "district"), _named(target, "b")
    first = t.groupBy("b").agg(
        F.min_by(
            F.struct(F.col("rid").alias("target_rid"), F.col("district").alias("target_district")), "rid"
        ).alias("t")
    )
    pairs = similarity.candidates(s, t, least).join(first, "b")
    best = pairs.groupBy("a").agg(
        F.max_by(F.struct("t", "b", "score"), F.struct("score", -F.col("t.target_rid"))).alias("x")
    )
    return looked_up(s, best, "a").select(
        "rid", "a", "district", "x.t.target_rid", F.col("x.b").alias("b"), "x.t.target_district",
        F.col("x.score").alias("score")
    )


def _meaning(source: DataFrame, target: DataFrame) -> DataFrame:
    """Like _closest, by the cosine of the embeddings in hundredths; less where the strings have few letters in common."""
    s, t = _named(source, "a"), _named(target, "b")
    best = nearest.search(
        s.where("v is not null").select("rid", "v"), t.where("v is not null").select("rid", "v")
    ).where("similarity is not null")
    met = t.select(F.col("rid").alias("target_rid"), "b", F.col("district").alias("target_district")).join(
        best.select("target_rid").distinct(), "target_rid", "left_semi"
    )
    rows = looked_up(best.join(s.select("rid", "a", "district"), "rid"), met, "target_rid")
    overlap, full = T.char_overlap(F.col("a"), F.col("b")), F.col("similarity") * 100
    less = F.when(
        overlap < 0.3, R.THRESHOLDS["overlap_03"]
    ).when(overlap < 0.5, R.THRESHOLDS["overlap_05"]).otherwise(0.0)
    return rows.select(
        "rid", "a", "district", "target_rid", "b", "target_district", F.greatest(F.lit(0.0), full - less).alias("score")
    )


def scored(source: DataFrame, target: DataFrame, least: float) -> DataFrame:
    """(rid, target_rid, score, match_type, source_value, target_value, district, target_district): the best target of each
    source POI, by ratio, or by meaning where that scores no less and the ratio is not already 98 with like lengths.

    A ratio below `least` counts as none: it could not be accepted. Strings of very unlike lengths cost five; pairs with hardly
    a letter in common are left out."""
    t = R.THRESHOLDS
    kind = lambda c: F.concat(F.lit("fuzzy_"), F.floor(c).cast("int").cast("string"))
    found = _closest(source, target, least).withColumn("match_type", kind(F.col("score")))
    if "v" in source.columns and "v" in target.columns:
        meaning = _meaning(source, target).where("score > 0")
        label = F.when(
            F.col("score") >= 100 * t["semantic_strong"], "semantic_strong"
        ).when(F.col("score") >= 100 * t["semantic_weak"], "semantic_weak").otherwise("semantic")
        meaning = meaning.withColumn("match_type", label).withColumn("exactly", F.col("score")).withColumn(
            "score", F.round("score", 2)
        )
        settled = (F.col("score") >= t["high"]) & (T.length_ratio(F.col("a"), F.col("b")) >= 0.8)
        both = found.withColumn("exactly", F.when(settled, 1000.0).otherwise(F.col("score"))).unionByName(meaning)
        names = [c for c in found.columns if c != "rid"]
        best = both.groupBy("rid").agg(
            F.max_by(F.struct(*names), F.struct("exactly", F.col("match_type").startswith("semantic"))).alias("x")
        )
        found = best.select("rid", "x.*")
    a, b = F.col("a"), F.col("b")
    rows = found.withColumn(
        "score",
        F.when(T.length_ratio(a, b) < 0.6, F.greatest(F.lit(0.0), F.col("score") - 5)).otherwise(F.col("score"))
    )
    rows = rows.where((T.char_overlap(a, b) >= 0.2) & ((T.char_overlap(a, b) >= 0.3) | (F.col("score") >= t["high"])))
    return rows.select(
        "rid", "target_rid", "score", "match_type", a.alias("source_value"), b.alias("target_value"), "district",
        "target_district"
    )


def _districts(agree: bool) -> Column:
    known = F.coalesce(_present(F.col("district")) & _present(F.col("target_district")), F.lit(False))
    return known & (
        (F.col("district") == F.col("target_district")) if agree else (F.col("district") != F.col("target_district"))
    )


def _surely() -> Column:
    """Same district: 95 is enough; different ones: five more than the threshold, which no score reaches; else 98."""
    t = R.THRESHOLDS
    enough = F.when(_districts(True), F.col("score") >= t["high_same_district"]).when(
        _districts(False), F.col("score") >= t["high"] + t["mismatch_extra"]
    ).otherwise(F.col("score") >= t["high"])
    return F.coalesce(enough, F.lit(False))


def _maybe() -> Column:
    return F.col("score").between(R.THRESHOLDS["review_low"], R.THRESHOLDS["review_high"])


def _typed(sure: Column) -> Column:
    """A ratio that the district has made sure of says so."""
    return F.when(
        sure & _districts(True) & F.col("match_type").startswith("fuzzy"), F.concat(F.lit("district_"), "match_type")
    ).otherwise(F.col("match_type"))


def high_confidence(found: DataFrame) -> DataFrame:
    return found.where(_surely()).withColumn("match_type", _typed(F.lit(True)))


def need_review(found: DataFrame) -> DataFrame:
    return found.where(_maybe())


def tiers(source: DataFrame, target: DataFrame, keep=kept) -> DataFrame:
    """(rid, target_rid, score, tier, match_type): the first tier of each row that any tier matches.

    What the exact tiers find is written once; similarities are computed for the rows that it leaves open."""
    exact = [exact_by(source, target, "core"), exact_by(source, target, "poi"), contained(source, target)]
    parts = [
        p.select("rid", "target_rid", "score", F.lit(i).alias("tier"), F.lit(EXACT_TYPES[i]).alias("match_type")) for i,
        p in enumerate(exact)
    ]
    first = reduce(DataFrame.unionByName, parts).groupBy("rid").agg(
        F.min_by(F.struct("target_rid", "score", "tier", "match_type"), "tier").alias("x")
    )
    done = keep(first.select("rid", "x.*"))
    found = scored(source.join(done, "rid", "left_anti"), target, R.THRESHOLDS["review_low"])
    near = found.select(
        "rid", "target_rid", "score", F.when(_surely(), 3).when(_maybe(), 4).alias("tier"),
        _typed(_surely()).alias("match_type")
    ).where("tier is not null")
    return done.unionByName(near)


def waterfall(source: DataFrame, targets: list[DataFrame]) -> DataFrame:
    """rid, target (its place in the list), target_rid, score, level, match_type for every source row; unmatched rows have no
    target, a score of 0 and the type unmatched.

    Each target meets the rows that the ones before have left. Its outcome is written once, and so is the result, so that
    reports and layers over it do not match again."""
    work = f"{home(source.sparkSession)}/{uuid.uuid4().hex}"
    keep, parts, left = partial(kept, folder=work), [], source
    for i, target in enumerate(targets):
        parts.append(keep(tiers(left, target, keep).withColumn("target", F.lit(i))))
        if i + 1 < len(targets):
            left = keep(left.join(parts[-1].select("rid"), "rid", "left_anti"))
    columns = ["target", "target_rid", "score", "tier", "match_type"]
    first = reduce(DataFrame.unionByName, parts).select("rid", F.struct(*columns).alias("x"))
    names = reduce(
        lambda c, k: c.when(F.col("x.tier") == k, LEVELS[k]), list(LEVELS)[1:], F.when(F.col("x.tier") == 0, LEVELS[0])
    ).otherwise("UNMATCHED")
    kind = F.coalesce("x.match_type", F.lit("unmatched"))
    result = kept(source.select("rid").join(first, "rid", "left").select(
        "rid", "x.target", "x.target_rid", F.coalesce("x.score", F.lit(0.0)).alias("score"), names.alias("level"),
        kind.alias("match_type")
    ))
    drop(source.sparkSession, work)
    return result


def cascade(source: DataFrame, target: DataFrame) -> DataFrame:
    return waterfall(source, [target]).drop("target")


def statistics(result: DataFrame) -> DataFrame:
    n = lambda level: F.count_if(F.col("level") == level)
    counts = result.agg(
        F.count("*").alias("total"), n("EXACT").alias("exact"), n("HIGH_CONFIDENCE").alias("high_confidence"),
        n("NEED_REVIEW").alias("need_review"), n("UNMATCHED").alias("unmatched")
    )
    rate = lambda c: F.when(F.col("total") == 0, 0.0).otherwise(F.round(c / F.col("total") * 100, 2))
    auto = F.col("exact") + F.col("high_confidence")
    return counts.withColumns(
        {"auto_match": auto, "auto_rate": rate(auto), "match_rate": rate(auto + F.col("need_review"))}
    )


def target_details(result: DataFrame, targets: int) -> DataFrame:
    """Counts by target, also of those that matched nothing, with the rows still open before and after."""
    n = lambda level: F.count_if(F.col("level") == level)
    by = result.where("target is not null").groupBy("target").agg(
        n("EXACT").alias("exact"), n("HIGH_CONFIDENCE").alias("high_confidence"), n("NEED_REVIEW").alias("need_review")
    )
    every = result.sparkSession.range(targets).select(F.col("id").cast("int").alias("target"))
    rows = every.join(by, "target", "left").na.fill(0).withColumn(
        "matched", F.col("exact") + F.col("high_confidence") + F.col("need_review")
    )
    total = result.agg(F.count("*").alias("total"))
    before = F.coalesce(
        F.sum("matched").over(Window.partitionBy("total").orderBy("target").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)
    )
    rows = rows.join(F.broadcast(total)).withColumn("offered", F.col("total") - before)
    return rows.select(
        "target", "exact", "high_confidence", "need_review", "matched", "offered",
        F.when(F.col("offered") > 0, "完成").otherwise("无剩余记录").alias("status")
    )


#: match type -> (label, where its POI comes from); values of reports.
POI_TYPES = {
    "empty_left": ("源表POI为空", "empty"), "non_poi_left": ("源表为非地点类", "rule"), "no_poi_left": (
        "源表无可用POI主体", "step3"
    ), "no_poi_right": (
        "目标表无可用POI主体", "step3"
    ),
    "fuzzy_strong_poi": (
        "模糊强匹配", "step3"
    ), "semantic_strong_poi": (
        "语义强匹配", "step3"
    ), "semantic_weak_poi": ("语义弱匹配", "step3"), "fuzzy_weak_poi": ("模糊弱匹配", "step3"), "unmatched": ("未匹配", "step3"),
}


def poi_match(left: DataFrame, right: DataFrame, left_poi: str = "pois", right_poi: str = "poi") -> DataFrame:
    """rid, target_rid, kind, score (0 to 100) of each left row by its first POI: a strong partial ratio, or else a strong
    meaning (where both sides have an embedding v), or else the better of a weak meaning and a weak partial ratio.

    Right rows take part by their first POI without its numbers, unless it is the name of a region; on ties the first wins."""
    p = R.THRESHOLDS
    raw = T.first_poi(F.col(left_poi))
    rows = left.withColumn("raw", raw).withColumn("a", T.clean_poi(F.col("raw")))
    kind = F.when(F.col("raw") == "", "empty_left").when(
        T.is_pure_numeric(F.col("raw")) | T.is_device(F.col("raw")), "non_poi_left"
    ).when(F.col("a") == "", "no_poi_left")
    rows = rows.select("rid", "a", kind.alias("early"), *(["v"] if "v" in left.columns else []))
    whole = F.coalesce(F.col(right_poi).cast("string"), F.lit(""))
    clean = T.clean_poi(T.first_poi(whole))
    names = right.where(~T.is_admin_only(T.first_poi(whole))).withColumn(
        "b", F.when(clean == "", whole).otherwise(clean)
    ).where("b <> ''")
    first = names.groupBy("b").agg(F.min("rid").alias("target_rid"))
    asked = rows.where("early is null")
    pairs = similarity.partial_candidates(asked, first, p["poi_weak"]).join(first, "b")
    found = pairs.groupBy("a").agg(
        F.max_by(F.struct("target_rid", "score"), F.struct("score", -F.col("target_rid"))).alias("f")
    )
    out = looked_up(rows, found, "a", "left")
    if "v" in left.columns and "v" in right.columns:
        meaning = nearest.search(
            asked.where("v is not null").select("rid", "v"), names.where("v is not null").select("rid", "v")
        )
        out = out.join(meaning.select("rid", F.struct("target_rid", F.col("similarity")).alias("m")), "rid", "left")
    else:
        out = out.withColumn("m", F.lit(None).cast("struct<target_rid:long,similarity:double>"))
    any_right = F.broadcast(first.limit(1).agg(F.count("*").alias("n_right")))
    like, near = F.coalesce("f.score", F.lit(0.0)), F.coalesce("m.similarity", F.lit(0.0))
    weak = F.when(near >= p["semantic_weak"], F.round(near * 100, 2)).otherwise(0.0)
    found_kind = F.when(like >= p["poi_strong"], "fuzzy_strong_poi").when(
        near >= p["semantic_strong"], "semantic_strong_poi"
    ).when(
        (like >= p["poi_weak"]) & (like > weak), "fuzzy_weak_poi"
    ).when(weak > 0, "semantic_weak_poi").otherwise("unmatched")
    out = out.join(any_right).withColumn(
        "kind", F.coalesce("early", F.when(F.col("n_right") == 0, "no_poi_right"), found_kind)
    )
    fuzzy, semantic = F.col("kind").startswith("fuzzy"), F.col("kind").startswith("semantic")
    score = F.when(fuzzy, like).when(semantic, F.round(near * 100, 2)).otherwise(0.0)
    return out.select(
        "rid", F.when(fuzzy, F.col("f.target_rid")).when(semantic, F.col("m.target_rid")).alias("target_rid"), "kind",
        score.alias("score")
    )


def poi_report(
    left: DataFrame, right: DataFrame, left_file: str, right_file: str, left_poi: str = "pois", right_poi: str = "poi",
    address: str = "address", name: str = "name"
) -> DataFrame:
    """The nineteen columns of a POI matching, one row per left row; rows of files begin with 1, rids with 0. Columns that a side
    does not have (address, name, _record_id) are empty."""
    found = poi_match(left, right, left_poi, right_poi)
    text = lambda df, c: F.coalesce(
        F.col(f"`{c}`").cast("string"), F.lit("")
    ) if c in df.columns else F.lit("")
    a = left.select(
        F.col("rid").alias("ra"),
        *(
            text(left, c).alias(n) for c,
            n in (("_record_id", "源表记录ID"), (name, "源表名称"), (address, "源表标准化地址"), (left_poi, "源表POI原始"))
        )
    )
    b = right.select(
        F.col("rid").alias("rb"),
        *(
            text(right, c).alias(n) for c,
            n in (("_record_id", "目标表记录ID"), (name, "目标表名称"), (address, "目标表标准化地址"), (right_poi, "目标表POI原始"))
        )
    )
    rows = found.join(a, F.col("rid") == F.col("ra")).join(b, F.col("target_rid") == F.col("rb"), "left")
    hit = F.col("target_rid").isNotNull()
    of = lambda i: reduce(
        lambda c, k: c.when(F.col("kind") == k, POI_TYPES[k][i]), list(POI_TYPES)[1:],
        F.when(F.col("kind") == next(iter(POI_TYPES)), POI_TYPES[next(iter(POI_TYPES))][i])
    )
    other = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return rows.select(
        "源表记录ID", other("目标表记录ID"), F.lit(left_file).alias("源表文件"), (
            F.col("rid") + 1
        ).alias("源表行号"), "源表名称", "源表标准化地址", "源表POI原始", T.first_poi(F.col("源表POI原始")).alias("源表POI"),
        F.when(hit, right_file).otherwise("").alias("目标表文件"), (
            F.col("target_rid") + 1
        ).alias("目标表行号"), other("目标表名称"), other("目标表标准化地址"), other("目标表POI原始"),
        F.when(
            hit, T.first_poi(F.col("目标表POI原始"))
        ).otherwise("").alias("目标表POI"), of(0).alias("匹配类型"), F.col("kind").alias("匹配类型代码"), F.col("score").alias("匹配分数"), of(1).alias("POI来源"),
        F.when(hit, "是").otherwise("否").alias("是否匹配"),
    )


def breakdown(matched: DataFrame) -> DataFrame:
    total = matched.agg(F.count("*").alias("total"))
    return matched.groupBy("kind").agg(F.count("*").alias("n")).join(F.broadcast(total)).select(
        "kind", "n", F.round(F.col("n") / F.col("total") * 100, 2).alias("rate")
    )


def embedded(rows: DataFrame, column: str, encoder) -> DataFrame:
    """rows with v, the embedding of a text column. The encoder is a function from a frame of different texts (text) to one of
    (text, v), for instance by mapInPandas around a model that is loaded once per worker; blank texts get none."""
    key = T.strip(F.col(f"`{column}`").cast("string"))
    texts = rows.select(key.alias("text")).where("text <> ''").distinct()
    found = encoder(texts).select(F.col("text").alias("_text"), "v")
    return looked_up(rows, found, key == F.col("_text"), "left").drop("_text")
