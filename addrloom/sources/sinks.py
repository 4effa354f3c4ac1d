"""What leaves the engine: flat frames ready for CSV, layered results, merged levels, policies by size, and state."""

from __future__ import annotations

import io
import json
import os
import re
import struct
import zipfile
from functools import reduce
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from ..functions.text import level_label, strip
from .shared import children, write_bytes

PLAIN_ROWS, CSV_ROWS = 50_000, 100_000


def flat(df: DataFrame) -> DataFrame:
    """Columns by name, all as text: null is empty, nested values are JSON."""
    def one(f):
        c = F.col(f"`{f.name}`")
        return F.coalesce(
            F.to_json(c) if isinstance(f.dataType, (ArrayType, MapType, StructType)) else c.cast("string"), F.lit("")
        ).alias(f.name)

    return df.select(*(one(f) for f in sorted(df.schema.fields, key=lambda f: f.name)))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files with a header each, which begins with a byte order mark; no rows are an error."""
    if df.isEmpty():
        raise ValueError("no rows to write")
    out = flat(df)
    first = out.columns[0]
    out.withColumnRenamed(first, "\ufeff" + first).write.mode("overwrite").options(
        header=True, escape="\"", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)


#: (fill of the header, its letters, fill of the cells) by part of a layered result; fixed values.
COLOURS = {
    "source": ("FF93C5FD", "FF1E3A8A", "FFDBEAFE"), "match": ("FFFCD34D", "FF92400E", "FFFEF3C7"),
    "target": ("FF86EFAC", "FF065F46", "FFD1FAE5")
}
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def _letters(at: int) -> str:
    out, at = "", at + 1
    while at:
        at, rest = divmod(at - 1, 26)
        out = chr(65 + rest) + out
    return out


def _sheet(rows, styles: list[tuple[int, int]] | None = None) -> str:
    """XML of a sheet of text cells; styles has a style of the header's cell and one of the others for each column."""
    rows = [list(r) for r in rows]

    def cell(at: int, n: int, value) -> str:
        mark = f' s="{styles[at][n > 1]}"' if styles else ""
        if value is None:
            return f'<c r="{_letters(at)}{n}"{mark}/>' if mark else ""
        return f'<c r="{_letters(at)}{n}"{mark} t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'

    body = "".join(
        f'<row r="{n}">{"".join(cell(i, n, v) for i, v in enumerate(row))}</row>' for n, row in enumerate(rows, 1)
    )
    frozen = wide = ""
    if styles:
        frozen = '<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>'
        size = lambda i: min(2 + max(len(str(r[i])) for r in rows if r[i] is not None), 50)
        wide = "<cols>" + "".join(
            f'<col min="{i + 1}" max="{i + 1}" width="{size(i)}" customWidth="1"/>' for i in range(len(rows[0]))
        ) + "</cols>"
    return f'<worksheet xmlns="{_MAIN}">{frozen}{wide}<sheetData>{body}</sheetData></worksheet>'


def _styles() -> str:
    """Style 1 and 2 are the header and the cells of the first of COLOURS, and so on; style 0 is plain."""
    fills = "".join(
        f'<fill><patternFill patternType="solid"><fgColor rgb="{c}"/></patternFill></fill>' for head, _,
        cells in COLOURS.values() for c in (head, cells)
    )
    fonts = "".join(f'<font><b/><color rgb="{letters}"/></font>' for _, letters, _ in COLOURS.values())
    side = lambda s: f'<{s} style="thin"/>'
    forms = "".join(
        f'<xf fontId="{i + 1}" fillId="{2 * i + 2}" borderId="1" applyFill="1" applyFont="1"><alignment horizontal="center" vertical="center"/></xf><xf fontId="0" fillId="{2 * i + 3}" borderId="1" applyFill="1"/>'
        for i in range(len(COLOURS))
    )
    return (
        f'<styleSheet xmlns="{_MAIN}"><fonts count="{len(COLOURS) + 1}"><font/>{fonts}</fonts><fills count="{2 * len(COLOURS) + 2}"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>{fills}</fills>'
        f'<borders count="2"><border/><border>{side("left")}{side("right")}{side("top")}{side("bottom")}</border></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="{2 * len(COLOURS) + 1}"><xf/>{forms}</cellXfs></styleSheet>'
    )


def _book(sheets: dict[str, str], styled: bool) -> bytes:
    links = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    packed, kind = "http://schemas.openxmlformats.org/package/2006", "application/vnd.openxmlformats-officedocument.spreadsheetml"
    part = lambda name, what: f'<Override PartName="/xl/{name}.xml" ContentType="{kind}.{what}+xml"/>'
    parts = part("workbook", "sheet.main") + "".join(
        part(f"worksheets/sheet{i}", "worksheet") for i in range(1, len(sheets) + 1)
    ) + (part("styles", "styles") if styled else "")
    names = "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
    link = lambda i, what, target: f'<Relationship Id="rId{i}" Type="{links}/{what}" Target="{target}"/>'
    inner = "".join(
        link(i, "worksheet", f"worksheets/sheet{i}.xml") for i in range(1, len(sheets) + 1)
    ) + (link(len(sheets) + 1, "styles", "styles.xml") if styled else "")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(
            "[Content_Types].xml",
            f'<Types xmlns="{packed}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>{parts}</Types>'
        )
        z.writestr(
            "_rels/.rels",
            f'<Relationships xmlns="{packed}/relationships">{link(1, "officeDocument", "xl/workbook.xml")}</Relationships>'
        )
        z.writestr(
            "xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{packed}/relationships">{inner}</Relationships>'
        )
        z.writestr(
            "xl/workbook.xml", f'<workbook xmlns="{_MAIN}" xmlns:r="{links}"><sheets>{names}</sheets></workbook>'
        )
        for i, sheet in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", sheet)
        if styled:
            z.writestr("xl/styles.xml", _styles())
    return out.getvalue()


def _rows(df: DataFrame) -> list:
    """The header and the rows, which the driver needs for a workbook: more than PLAIN_ROWS are refused (`export` writes CSV)."""
    rows = [df.columns, *df.limit(PLAIN_ROWS + 1).toLocalIterator()]
    if len(rows) > PLAIN_ROWS + 1:
        raise ValueError("too many rows for a workbook")
    return rows


def workbook_bytes(df: DataFrame, sheet: str = "Sheet1") -> bytes:
    """A plain workbook of one sheet, all cells text."""
    return _book({sheet: _sheet(_rows(df))}, False)


def coloured_bytes(df: DataFrame, source_file: str = "") -> bytes:
    """A layered result as a workbook: source, match and target columns in colours of their own, and a sheet that explains them."""
    rows, first = _rows(df), {part: 2 * i + 1 for i, part in enumerate(COLOURS)}
    styles = [(first[part_of(c)], first[part_of(c)] + 1) for c in df.columns]
    legend = [("颜色", "说明"), ("蓝色", f"源表字段 {source_file}".strip()), ("黄色", "匹配依据字段"), ("绿色", "目标表字段")]
    return _book({"匹配结果": _sheet(rows, styles), "图例说明": _sheet(legend)}, True)


def export(df: DataFrame, path: str, columns: list[str] | None = None, source_file: str = "") -> str:
    """Writes what the size allows: a coloured workbook, a plain one, or CSV; gives the path with its suffix. Workbooks need a
    path that the driver can open."""
    df = chosen(df, columns)
    n = df.limit(CSV_ROWS + 1).count()
    if n > PLAIN_ROWS:  # a plain workbook would pass through the driver as well
        write_csv(df, path + ".csv")
        return path + ".csv"
    with open(path.removeprefix("file://") + ".xlsx", "wb") as file:
        file.write(coloured_bytes(df, source_file))
    return path + ".xlsx"


def chosen(df: DataFrame, columns: list[str] | None) -> DataFrame:
    """The named columns that exist; all, if none are named."""
    return df.select(*(f"`{c}`" for c in columns if c in df.columns)) if columns else df


#: By match type: what was compared, on the source's and the target's side (labels of the layered result).
MATCH_FIELDS = {
    "core_field_exact": ("{core}", "{core}"), "poi_exact": ("POI_结构化", "POI_结构化"),
    "poi_contains": ("标准化POI抽取 contains POI_结构化",) * 2, "fuzzy": ("POI_结构化",) * 2, "semantic": ("POI_结构化+语义",) * 2,
    "unmatched": ("匹配值", "匹配值")
}
LEVEL_TYPES = {
    "EXACT": ["core_field_exact", "poi_exact", "poi_contains"], "HIGH_CONFIDENCE": ["fuzzy", "semantic"],
    "NEED_REVIEW": ["fuzzy", "semantic"], "UNMATCHED": ["unmatched"]
}


def layered(
    result: DataFrame, level: str, source: DataFrame, source_name: str, targets: list[tuple[str, DataFrame]],
    core: str = "core"
) -> DataFrame:
    """Rows of one level of a waterfall (rid, target, target_rid, score, level, match_type): the source's columns, what was
    compared, score, type and level, the target's file and row, and each target's columns, under their prefixes.

    A type that a district has made sure of counts as semantic, as its label does not begin with fuzzy."""
    short = lambda name: name.rpartition(".")[0].replace("_标准化", "") if "." in name else name.replace("_标准化", "")
    own = short(source_name)
    text = lambda c: F.col(c).cast("string")
    a = source.select(
        F.col("rid").alias("_a"),
        F.struct(*(text(c).alias(c) for c in ("core", "poi", "pois") if c in source.columns)).alias("_s"),
        *(F.col(f"`{c}`").alias(f"[源:{own}]{c}") for c in source.columns if c != "v")
    )
    rows = result.where(F.col("level") == level).join(a, F.col("rid") == F.col("_a"))
    kind = F.when(
        F.col("match_type").isin("core_field_exact", "poi_exact", "poi_contains", "unmatched"), F.col("match_type")
    ).when(F.col("match_type").startswith("fuzzy"), "fuzzy").otherwise("semantic")
    rows = rows.withColumn("_kind", kind)
    given = {
        "core_field_exact": ("core", "core"), "poi_exact": ("poi", "poi"), "poi_contains": ("pois", "poi"),
        "fuzzy": ("poi", "poi"), "semantic": ("poi", "poi")
    }
    columns = [F.col(f"`{c}`") for c in a.columns if c.startswith("[源:")]
    labels = {k: tuple(x.format(core=core) for x in MATCH_FIELDS[k]) for k in LEVEL_TYPES[level]}

    def compared(side: int, value) -> dict:
        """Label -> value: of several types with one label each gives its own."""
        out: dict = {}
        for k, pair in labels.items():
            out.setdefault(pair[side], []).append(F.when(F.col("_kind") == k, value(k)))
        return {label: F.coalesce(*found) for label, found in out.items()}

    def from_source(k: str):
        c = F.col(f"_s.{given[k][0]}") if k in given else F.lit("")
        return F.substring(c, 1, 50) if k == "poi_contains" else strip(c)

    columns += [c.alias(f"【匹配源:{own}】{label}") for label, c in compared(0, from_source).items()]
    found, there = [], []
    for i, (name, target) in enumerate(targets):
        keyed = target.select(
            F.struct(*(F.col(f"`{c}`") for c in target.columns if c != "v")).alias(f"_t{i}"),
            F.col("rid").alias(f"_r{i}")
        )
        rows = rows.join(
            keyed, (F.col("target") == i) & (F.col("target_rid") == F.col(f"_r{i}")), "left"
        ) if level != "UNMATCHED" else rows
        there += [F.col(f"_t{i}").getField(c).alias(f"[目标:{short(name)}]{c}") for c in target.columns if c != "v"]
        if level != "UNMATCHED" or i == 0:
            value = lambda k, i=i: strip(
                F.col(f"_t{i}").getField(given[k][1]).cast("string")
            ) if k in given else F.lit("")
            found += [c.alias(f"【匹配目标:{short(name)}】{label}") for label, c in compared(1, value).items()]
    name = reduce(
        lambda c, i: c.when(F.col("target") == i, targets[i][0]), range(1, len(targets)),
        F.when(F.col("target") == 0, targets[0][0])
    )
    meta = [F.col("score").alias("匹配分数"), F.col("match_type").alias("匹配类型"), level_label(F.col("level")).alias("匹配层级")]
    end = [name.alias("目标表文件"), (F.col("target_rid") + 1).alias("目标表行号"), *there] if level != "UNMATCHED" else []
    return rows.select(*columns, *found, *meta, *end)


def write_layers(
    result: DataFrame, folder: str, source: DataFrame, source_name: str, targets: list[tuple[str, DataFrame]],
    core: str = "core"
) -> dict[str, str]:
    """Writes each level that has rows to a folder of its own below the given one, named after source, level and number of rows;
    gives level -> path. Other folders are left alone."""
    out = {}
    counts = {r.level: r.n for r in result.groupBy("level").agg(F.count("*").alias("n")).collect()}
    label = {"EXACT": "精确匹配", "HIGH_CONFIDENCE": "高置信度", "NEED_REVIEW": "需人工确认", "UNMATCHED": "未匹配"}
    safe = re.sub(r"[ /\\]", "_", source_name.rpartition(".")[0] or source_name).replace("_标准化", "")
    for level in LEVEL_TYPES:
        if counts.get(level):
            out[level] = f"{folder.rstrip('/')}/{safe}_{label[level]}_{counts[level]}条"
            write_csv(layered(result, level, source, source_name, targets, core), out[level])
    return out


#: Category of an export -> the patterns of the names of its files.
CATEGORIES = {"清洗结果": "_清洗", "标准化结果": "_标准化", "匹配结果": "精确匹配|高置信度|需人工确认", "未匹配数据": "未匹配", "关联分析结果": "关联"}


def category(name: Column) -> Column:
    """Which category of results a file or folder of this name is exported with; null for none."""
    stem = F.regexp_replace(name, r"\.csv$", "")
    ends = {"_清洗", "_标准化"}
    hit = lambda p: stem.endswith(p) if p in ends else stem.rlike(p)
    return reduce(
        lambda c, k: c.when(hit(CATEGORIES[k]), k), list(CATEGORIES)[1:], F.when(hit(CATEGORIES["清洗结果"]), "清洗结果")
    )


def export_categories(spark, folders: list[str], wanted: list[str], out: str) -> DataFrame:
    """(name, category, path): copies what the folders have of the wanted categories, file by file, to the folder `out`."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    names = []
    for folder in folders:
        where = path(folder)
        files = where.getFileSystem(conf)
        if files.exists(where):
            names += [(s.getPath().getName(), s.getPath().toString()) for s in files.listStatus(where)]
    listed = spark.createDataFrame(names, "name string, path string").withColumn(
        "category", category(F.col("name"))
    ).where(F.col("category").isin(*wanted)).orderBy("name")
    copied = []
    for r in listed.collect():  # a row for each file of results
        a, b = path(r.path), path(f"{out.rstrip('/')}/{r.name}")
        jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, conf)
        copied.append((r.name, r.category, b.toString()))
    return spark.createDataFrame(copied, "name string, category string, path string")


def merged(frames: dict[str, DataFrame], levels: list[str]) -> DataFrame:
    """All frames of the wanted levels, one below the other; columns that one lacks are null."""
    return reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True), (d for level, d in frames.items() if level in levels)
    )


def format_policy(rows: Column) -> Column:
    return F.when(rows > CSV_ROWS, "csv").when(rows > PLAIN_ROWS, "plain_excel").otherwise("excel")


def column_role(name: Column) -> Column:
    """Which part of a layered result a column belongs to."""
    return F.when(name.startswith("[源:"), "source").when(name.startswith("【匹配源:"), "match_source").when(
        name.startswith("【匹配目标:"), "match_target"
    ).when(name.startswith("[目标:"), "target").otherwise("meta")


def part_of(name: str) -> str:
    """The part of COLOURS that a column is shown in."""
    if name.startswith("[源:"):
        return "source"
    return "target" if name.startswith("[目标:") or name in ("目标表文件", "目标表行号") else "match"


def clipped(text: str, size: int) -> bytes:
    """At most so many bytes of a text, cut between letters."""
    return text.encode()[:size].decode("utf-8", "ignore").encode()


def dbf_type(values: list[str | None]) -> str:
    """N (whole numbers), F (numbers) or C (text), by what the values can be read as; blank ones say nothing."""
    given = [v for v in values if v not in (None, "")]
    if not values:
        return "C"

    def all_are(kind) -> bool:
        try:
            return bool([kind(v) for v in given]) or not given
        except ValueError:
            return False

    return "N" if all_are(int) else "F" if all_are(float) else "C"


def dbf_names(names: list[str]) -> list[str]:
    """Names of at most ten letters and ten bytes, cut between letters; repeated ones get a number in place of their end."""
    out: list[str] = []
    for name in names:
        base = clipped(name[:10], 10).decode()
        short, n = base, 1
        while short in out:
            short = clipped(base, 10 - len(str(n))).decode() + str(n)
            n += 1
        out.append(short)
    return out


def free_name(name: str, taken: set[str]) -> str:
    base, suffix = os.path.splitext(name)
    n = 0
    while (found := f"{base}_{n}{suffix}" if n else name) in taken:
        n += 1
    return found


def save_state(spark, path: str, state: dict) -> None:
    """JSON, written beside the target and moved, so that a reader never sees half of it."""
    text = json.dumps(state, ensure_ascii=False, indent=1, sort_keys=True)
    write_bytes(spark, path + ".part", text.encode())
    place = spark._jvm.org.apache.hadoop.fs.Path
    files = place(path).getFileSystem(spark._jsc.hadoopConfiguration())
    files.delete(place(path), False)
    if not files.rename(place(path + ".part"), place(path)):
        raise OSError(path)


def save_rows(df: DataFrame, folder: str, kind: str) -> None:
    """A state that is a table (relations, join exports): a version of its own, so readers of an earlier one are not disturbed."""
    spark = df.sparkSession
    versions = [int(n.rpartition("=")[2]) for n in children(spark, f"{folder}/{kind}")]
    df.write.json(f"{folder}/{kind}/version={max(versions, default=0) + 1}")
