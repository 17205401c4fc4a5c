"""Sources.  All go through Spark's readers, so that any store Spark reads will do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def commented_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and # comments; a declared schema, so that nothing is inferred."""
    return spark.read.schema(schema).option("header", True).option("comment", "#").csv(path)


def quoted_csv(spark: SparkSession, path: str, schema: str, optional: bool = False) -> DataFrame:
    """UTF-8 CSV with quoted, perhaps multi-line fields; optional: no file gives no rows."""
    try:
        return spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).option("encoding", "UTF-8").csv(path)
    except AnalysisException:
        if not optional:
            raise
        return spark.createDataFrame([], schema)


def literal_series(spark: SparkSession, series: dict[str, list[float]]) -> DataFrame:
    """(series_id, t, value) of literal vectors."""
    rows = [(name, [float(v) for v in values]) for name, values in series.items()]
    df = spark.createDataFrame(rows, "series_id string, v array<double>")
    return df.select("series_id", F.posexplode("v").alias("_i", "value")).select("series_id", (F.col("_i") + 1).cast("long").alias("t"), "value")


def line_table(spark: SparkSession, path: str, pattern: str = "*.qmd") -> DataFrame:
    """(source_file, source_line, text) of all files below a folder; line numbers are exact."""
    files = whole_files(spark, path, pattern)
    lines = files.select(F.col("path").alias("source_file"), F.posexplode(F.split("text", "\n")).alias("_i", "text"))
    return lines.select("source_file", (F.col("_i") + 1).cast("int").alias("source_line"), "text")


def whole_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, text, trailing_newline) of all files below a folder; texts byte for byte."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    text = F.decode("content", "UTF-8")
    return raw.select("path", text.alias("text"), text.endswith("\n").alias("trailing_newline"))


def corpora(spark: SparkSession, path: str, patterns: tuple[str, ...] = ("*.qmd", "*.R", "*.js")) -> DataFrame:
    """(corpus, path, text): files of several kinds, kinds in the order given, paths sorted."""
    out = None
    for i, p in enumerate(patterns):
        part = whole_files(spark, path, p).select(F.lit(i).alias("_i"), F.lit(p.lstrip("*.")).alias("corpus"), "path", "text")
        out = part if out is None else out.unionByName(part)
    return out.orderBy("_i", "path").drop("_i")


def front_matter(text: Column, path: Column) -> dict[str, Column]:
    """title (pagetitle, else title, else the path) and description of a page's front matter."""
    matter = F.regexp_extract(text, r"(?s)\A---\r?\n(.*?)\r?\n---", 1)
    field = lambda key: F.nullif(F.regexp_replace(F.trim(F.regexp_extract(matter, rf"(?m)^{key}:[ \t]*(.*)$", 1)), "^[\"']|[\"']$", ""), F.lit(""))
    return {"title": F.coalesce(field("pagetitle"), field("title"), path), "description": field("description")}


LEDGER = "firstSeen string, activeMsByDevice map<string,bigint>, days array<string>, chapters array<string>, actsByDevice map<string,bigint>, maxDay int"
LEGACY = "firstSeen string, activeMs bigint, acts bigint, days array<string>, chapters array<string>, maxDay int"


def ledgers(df: DataFrame, document: str = "document", device: str = "device") -> DataFrame:
    """Adds ledger: a JSON document if it has the shape of one, an older one migrated, else the empty ledger."""
    from tallyloom.operators.ledger import migrated

    new, old = F.from_json(document, LEDGER), F.from_json(document, LEGACY)
    valid = new["firstSeen"].isNotNull() & new["activeMsByDevice"].isNotNull() & new["days"].isNotNull()
    older = old["firstSeen"].isNotNull() & old["activeMs"].isNotNull()
    empty = F.from_json(F.lit('{"firstSeen":null,"activeMsByDevice":{},"days":[],"chapters":[],"actsByDevice":{},"maxDay":0}'), LEDGER)
    return df.withColumn("ledger", F.when(valid, new).when(older, migrated(old, F.col(device))).otherwise(empty))


def process(spark: SparkSession, kind: str, n: int, seed: int) -> DataFrame:
    """(t, value): totals of two dice, heads of ten coins, or red beads out of fifty (a fifth are red)."""
    base = spark.range(n).select((F.col("id") + 1).alias("t"))
    if kind == "dice":
        return base.withColumn("value", (F.floor(F.rand(seed) * 6) + F.floor(F.rand(seed + 1) * 6) + 2).cast("double"))
    draws, p = {"coins": (10, 0.5), "beads": (50, 0.2)}[kind]
    each = base.withColumn("_i", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("_h", (F.rand(seed) < p).cast("int"))
    return each.groupBy("t").agg(F.sum("_h").cast("double").alias("value"))


def samples(spark: SparkSession, kind: str, n: int, seed: int, base: float = 1.0) -> DataFrame:
    """(id, value): normal, uniform (mean 0, variance 1), exponential or right-triangular draws."""
    from tallyloom.functions import normal

    u = F.rand(seed)
    drawn = {"normal": F.randn(seed), "uniform": normal.uniform_draw(u), "exponential": normal.exponential_draw(u), "triangular": normal.triangular_draw(u, base)}[kind]
    return spark.range(n).withColumn("value", drawn)
