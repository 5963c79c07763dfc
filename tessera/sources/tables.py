"""Readers and writers of documents, tables and marked-up text.

Schemas are always given. Spreadsheets, word-processor files, PDF and OCR are converted upstream; what follows the
conversion (positional columns, header binding, stitched rows, words to rows) is here. HTTP collection is out of scope.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W


def read_json_records(spark: SparkSession, path: str, record: str | T.StructType, field: str = "records") -> DataFrame:
    """The records of JSON documents, with ``ord``, their place in the document, and ``path``."""
    kind = record.simpleString() if isinstance(record, T.StructType) else T.StructType.fromDDL(record).simpleString()
    docs = spark.read.schema(f"{field} array<{kind}>").option("multiLine", True).json(path)
    return docs.select(F.input_file_name().alias("path"), F.posexplode(field).alias("ord", "r")).select("path", "ord", "r.*")


def write_json_sorted(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """JSON lines in a fixed order of rows and columns. For published layers of bounded size; big ones are Parquet."""
    df.select(*sorted(df.columns)).orderBy(*keys).coalesce(1).write.mode("overwrite").json(path)


def from_file_names(df: DataFrame, path: str, parts: Mapping[str, str]) -> DataFrame:
    """S3: columns out of the file name, each by a pattern's first group."""
    return df.withColumns({name: F.nullif(F.regexp_extract(path, pattern, 1), F.lit("")) for name, pattern in parts.items()})


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header line, in a given schema."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def write_csv(df: DataFrame, path: str, by: str | None = None) -> None:
    """CSV with a header line, in a folder for each value of ``by``."""
    writer = df.write.mode("overwrite").option("header", True).option("escape", '"')
    (writer.partitionBy(by) if by else writer).csv(path)


def positional(cells: str, names: Sequence[str]) -> list[Column]:
    """Columns by their place in a row of cells; a missing place is null."""
    return [F.try_element_at(cells, F.lit(k + 1)).alias(name) for k, name in enumerate(names)]


def html_rows(df: DataFrame, key: str, html: str, row: str = "tr", cell: str = "t[dh]") -> DataFrame:
    """(key, row_no, cells) of marked-up rows: tags stripped, white space folded."""
    clean = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", "")
    rows = df.select(key, F.posexplode(F.regexp_extract_all(clean, F.lit(rf"(?is)<{row}\b[^>]*>(.*?)</{row}>"), 1)).alias("row_no", "row"))
    cells = F.regexp_extract_all("row", F.lit(rf"(?is)<{cell}\b[^>]*>(.*?)</{cell}>"), 1)
    return rows.select(key, "row_no", F.transform(cells, strip_tags).alias("cells"))


def strip_tags(html: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(html, r"(?s)<[^>]+>", " "), "&nbsp;|　", " ")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def html_items(df: DataFrame, key: str, html: str, tag: str) -> DataFrame:
    """(key, pos, item) of each element of a tag, as text."""
    found = F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"), 1)
    return df.select(key, F.posexplode(found).alias("pos", "item")).withColumn("item", strip_tags(F.col("item")))


def nth_table(df: DataFrame, key: str, html: str, n: int) -> DataFrame:
    """The rows of each page's n-th table, from 0."""
    tables = F.regexp_extract_all(html, F.lit(r"(?is)<table\b[^>]*>(.*?)</table>"), 1)
    return html_rows(df.select(key, F.try_element_at(tables, F.lit(n + 1)).alias("table")).filter("table is not null"), key, "table")


def wide_enough(cells: str, least: int, header: str | None = None) -> Column:
    """Rows of enough cells that don't repeat the header."""
    wide = F.size(cells) >= least
    return wide & ~F.coalesce(F.try_element_at(cells, F.lit(1)).rlike(header), F.lit(False)) if header else wide


def words_to_rows(words: DataFrame, page: str, x: str, y: str, text: str, height: float = 3.0) -> DataFrame:
    """Positioned words as rows: words of one band of the page, joined from left to right."""
    band = F.round(F.col(y) / height).cast("long").alias("band")
    rows = words.groupBy(page, band).agg(F.sort_array(F.collect_list(F.struct(x, text))).alias("_w"))
    return rows.select(page, "band", F.array_join(F.transform("_w", lambda w: w[text]), "").alias(text))


def name_counts(words: DataFrame, page: str, order: str, x: str, y: str, text: str, names_end: float = 180.0, counts_end: float = 230.0, height: float = 3.0) -> DataFrame:
    """(page, band, name, count): words left of one line of the page joined as a name, and the first number between it and a second line.

    A band is the nearest multiple of its height, halves to the even one; its words are taken from top to bottom, then in
    order. Bands that have neither are left out; a missing name is '', a missing count null.
    """
    left = F.col(x) < names_end
    number = (F.col(x) >= names_end) & (F.col(x) < counts_end) & F.col(text).rlike(r"^\d{1,4}$")
    kept = words.filter(left | number).withColumn("band", F.bround(F.col(y) / height).cast("long"))
    place = F.struct(F.col(y).alias("y"), F.col(order).alias("o"), F.col(text).alias("t"))
    rows = kept.groupBy(page, "band").agg(F.sort_array(F.collect_list(F.when(left, place))).alias("_n"), F.min_by(F.when(number, F.col(text)), F.when(number, place)).alias("_c"))
    return rows.select(page, "band", F.array_join(F.transform("_n", lambda w: w["t"]), "").alias("name"), F.col("_c").cast("int").alias("count")).filter("name <> '' or count is not null")


def read_line_cache(spark: SparkSession, path: str) -> DataFrame:
    """(file, ord, x, y, text) of caches that hold a JSON array of recognised lines each; lines without text go, and a file that isn't there fails."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.from_json("value", "array<struct<x: double, y: double, text: string>>")).alias("ord", "line"))
    return lines.select("file", "ord", "line.x", "line.y", "line.text").filter("text is not null")


def laid_out(rows: DataFrame, cells: str, row_no: str, year: str, stage: str, layouts: Mapping[tuple[int, str | None], tuple[Mapping[str, int], int]], needed: str) -> DataFrame:
    """The columns of sheets whose layout depends on year and stage: (key columns, names), all trimmed text.

    A layout is (place of each name from 0, number of header rows) by (year, stage), or by (year, None) for the year's
    other stages; a name that the layout lacks is ''. Header rows, rows without ``needed`` and unknown years go.
    """
    columns = list(dict.fromkeys(name for places, _ in layouts.values() for name in places))
    out, header = {name: F.lit(None).cast("string") for name in columns}, F.lit(None).cast("int")
    # a year's general layout is tested last
    for (y, s), (places, first) in sorted(layouts.items(), key=lambda kv: kv[0][1] is not None):
        fits = (F.col(year) == y) if s is None else (F.col(year) == y) & (F.col(stage) == s)
        header = F.when(fits, first).otherwise(header)
        for name in columns:
            cell = F.coalesce(F.trim(F.get(cells, F.lit(places[name]))), F.lit("")) if name in places else F.lit("")
            out[name] = F.when(fits, cell).otherwise(out[name])
    made = rows.select(year, stage, row_no, header.alias("_h"), *[c.alias(n) for n, c in out.items()])
    return made.filter((F.col(row_no) >= F.col("_h")) & (F.col(needed) != "")).drop("_h")


def polygon(text: str) -> Column:
    """S16: "lng,lat;…|…" as rings of points; rings of fewer than three points go."""
    point = lambda p: F.transform(F.split(p, ","), lambda v: v.try_cast("double"))
    rings = F.transform(F.split(text, r"\|"), lambda r: F.filter(F.transform(F.split(r, ";"), point), lambda p: (F.size(p) == 2) & p[0].isNotNull() & p[1].isNotNull()))
    return F.filter(rings, lambda r: F.size(r) >= 3)


def bind_columns(df: DataFrame, synonyms: Mapping[str, Sequence[str]]) -> DataFrame:
    """Target columns from whichever of their header names the table has; null if none."""
    made = []
    for target, names in synonyms.items():
        held = [F.col(f"`{n}`") for n in names if n in df.columns]
        made.append((F.coalesce(*held) if held else F.lit(None).cast("string")).alias(target))
    return df.select(*made)


def table_kind(header: Column, rules: Sequence[tuple[Sequence[str], str]], default: str | None = None) -> Column:
    """The kind of the first rule all of whose keywords the header holds."""
    out = F.lit(default)
    for words, kind in reversed(rules):
        held = F.lit(True)
        for w in words:
            held = held & header.contains(w)
        out = F.when(held, kind).otherwise(out)
    return out


def json_fields(df: DataFrame, column: str, schema: str) -> DataFrame:
    """The fields of a JSON column beside the others."""
    return df.withColumn("_j", F.from_json(column, schema)).select(*df.columns, "_j.*")


class Catalogue:
    """Sources by name; what isn't listed can't be read, and what is listed has to be there."""

    def __init__(self, spark: SparkSession, root: str, tables: Sequence[str]):
        self.spark, self.root, self.tables = spark, root, tuple(tables)

    def path(self, table: str) -> str:
        if table not in self.tables:
            raise KeyError(f"{table} is not in the catalogue")
        return f"{self.root}/{table}.parquet"

    def missing(self) -> list[str]:
        fs = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return [t for t in self.tables if not fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(t)))]

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(self.path(table))


def ordered(df: DataFrame, partition: str, by: Sequence[str]) -> DataFrame:
    """``ord``, a row's place within a partition, for tables whose order means something."""
    return df.withColumn("ord", F.row_number().over(W.partitionBy(partition).orderBy(*by)) - 1)
