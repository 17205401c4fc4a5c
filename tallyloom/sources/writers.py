"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def csv(df: DataFrame, path: str, empty_nulls: bool = True) -> None:
    """CSV with a header; nulls as nothing."""
    w = df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"')
    (w.option("nullValue", "").option("emptyValue", "") if empty_nulls else w).csv(path)


def csv_with_mark(df: DataFrame, path: str) -> None:
    """One CSV file's text after a byte order mark, for spreadsheets: a text source of its lines, in one task; meant
    for small results."""
    quoted = [F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in df.columns]
    head = df.sparkSession.createDataFrame([("\ufeff" + ",".join(f'"{c}"' for c in df.columns),)], "value string")
    body = df.select(F.concat_ws(",", *quoted).alias("value"))
    head.unionByName(body).coalesce(1).write.mode("overwrite").text(path)


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def json_document(df: DataFrame, key: str, entry: str) -> DataFrame:
    """One pretty-printed JSON object of (key, entry as JSON), for small results."""
    sorted_rows = F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col(entry).alias("e"))))
    pairs = F.map_from_entries(F.transform(sorted_rows, lambda r: F.struct(r["k"], F.from_json(r["e"], "map<string,string>"))))
    return df.agg(F.to_json(pairs, {"pretty": "true"}).alias("value"))


def text(files: DataFrame, root: str) -> None:
    """files(path, text) as files below root, byte for byte, without a newline of our own; null texts give no file.
    One document at a time passes through the driver, onto whatever store Spark's file systems reach."""
    sc = files.sparkSession.sparkContext
    for path, content in files.where("path is not null and text is not null").select("path", "text").toLocalIterator():
        to = sc._jvm.org.apache.hadoop.fs.Path(f"{root}/{path}")
        out = to.getFileSystem(sc._jsc.hadoopConfiguration()).create(to, True)
        try:
            out.write(bytearray(content.encode()))
        finally:
            out.close()


def download(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """One text of the rows' columns joined by tabs, in order; for small results."""
    line = F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    rows = F.array_sort(F.collect_list(F.struct(*order, line.alias("_line"))))
    return df.agg(F.array_join(F.transform(rows, lambda r: r["_line"]), "\n").alias("text"))
