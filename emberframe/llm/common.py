"""Helpers that the training-data operators share: table access, staged tables,
skew-proof joins on a key, and the word rule of the whole subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import ship

#: A word is a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)
#: A key with this share (1/HOT) of all rows or more counts as hot; there are at most HOT of them.
HOT = 1000
#: Rows of one Arrow batch: a batch of long texts has to fit a Python worker.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: str | None) -> list[bytes]:
    """bytes.split() parts at exactly \\x20 and \\x09-\\x0D."""
    return text.encode("utf-8", "replace").split() if text else []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where all run on one machine (tests) may it be unset."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        found = getattr(sc, "_emberframe_dir", None)
        if not found:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise RuntimeError("spark.checkpoint.dir isn't set: name a folder that driver and executors share")
            found = sc._emberframe_dir = tempfile.mkdtemp(prefix="emberframe-")
            sc.setCheckpointDir(found)
    return found.rstrip("/")


def fs_path(spark: SparkSession, path: str):  # noqa: ANN202
    """(the file system of a path, the path), as Spark sees them."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts the lineage, so that a lost
    executor costs a reread and no recomputation, and gives later scans their column pruning. The table goes when the session ends, or by release()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, p = fs_path(spark, path)
    fs.deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def release(df: DataFrame) -> None:
    """Remove a staged table that nothing reads any more."""
    fs, p = fs_path(df.sparkSession, df._staged)
    fs.delete(p, True)


def small_batches(spark: SparkSession) -> None:
    """Before Python workers get texts: bound the rows of an Arrow batch, so that whole texts of any length fit a worker, and give the workers the package."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def attach(rows: DataFrame, groups: DataFrame, key: list[str], size: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with groups, which has one row for a key and the number of rows with that key in column `size`.

    Keys with total / HOT rows or more (at most HOT of them, whatever the input: the proven bound) are
    broadcast; no other key is large enough to fill a task, so the rest is an ordinary shuffled join.
    """
    is_hot = F.col(size) * HOT >= F.lit(total)
    hot, cold = groups.where(is_hot), groups.where(~is_hot)
    rest = rows.join(F.broadcast(hot.select(*key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(rest.join(cold, key, how))


def one_row_each(rows: DataFrame, key: list[str], repeated: DataFrame) -> DataFrame:
    """rows without repeats of key. Only keys in `repeated` (distinct keys that may occur twice) are grouped;
    which of several rows with one key stays doesn't matter to the caller."""
    once = rows.join(repeated, key, "left_anti")
    others = [F.first(F.struct(*[c for c in rows.columns if c not in key])).alias("__rest")]
    more = rows.join(repeated, key, "left_semi").groupBy(*key).agg(*others)
    return once.unionByName(more.select(*key, "__rest.*").select(*rows.columns))


def crc_mod(col: str, mod: int) -> Column:
    return F.crc32(F.col(col).cast("string")) % mod
