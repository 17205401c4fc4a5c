"""What the operators share: reading tables, scratch tables in the shared folder, batches by bytes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The bytes that separate words: space and \x09-\x0D, as bytes.split() has them.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  Where it is unset, a session of one machine gets
    a folder of our own; on a cluster that is an error, since no machine's folder is shared."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="tallyloom-"))
    return sc.getCheckpointDir()


class Scratch:
    """Tables written to the shared folder and read again: they cut lineage and outlive lost executors.

    The shuffle files of a write are removed when the table is complete, so that the disk holds one step's
    shuffles at a time.  Tables that results are still read from stay until the application ends, when the whole folder
    goes.
    """

    _CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        path, files = self._path("")
        files.mkdirs(path)
        files.deleteOnExit(path)

    def _path(self, name: str):
        """A table's path and its file system."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def keep(self, df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
        path = f"{self.root}/{name}"
        before = self.spark.conf.get(self._CLEANUP, "false")
        self.spark.conf.set(self._CLEANUP, "true")
        try:
            df.write.option("compression", codec).parquet(path)
        finally:
            self.spark.conf.set(self._CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Remove a table that no later step reads."""
        path, files = self._path(name)
        files.delete(path, True)


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that a column of strings or binaries has about `most` bytes in each; one row at least."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i in range(n):
            if held and held + sizes[i] > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(sizes[i])
        yield batch.slice(start)


def sampled(rows: DataFrame, key: str, label: str, most: int) -> DataFrame:
    """About `most` rows of each label, all of a label that has no more: those whose key has a hash below a threshold that
    follows from the label's number of rows.  No row moves; only the labels' counts reach the driver, one row a label."""
    counts = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    large = {k: n for k, n in counts.items() if n > most}
    if not large:
        return rows
    place = F.shiftrightunsigned(F.xxhash64(key), 11) / F.lit(2.0**53)
    share = F.lit(1.0)
    for k, n in large.items():
        share = F.when(F.col(label).eqNullSafe(F.lit(k)), F.lit(most / n)).otherwise(share)
    return rows.where(place < share)


def words(text):
    """Column: the words [^\\x20\\x09-\\x0D]+ of a text, in order; null and empty texts have none."""
    spaced = F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES))
    return F.filter(F.split(spaced, " "), lambda w: w != "")
