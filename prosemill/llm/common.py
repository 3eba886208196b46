"""What the operators of this subpackage share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word definition used throughout: space and \t to \r.
WORD = r"[^\x20\x09-\x0D]+"
ROOT = str(Path(__file__).resolve().parents[2])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, read by Spark so that any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local session, whose executor is
    the driver, gets a folder of its own until it ends; on a cluster it is an error, as no folder of one machine would do."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    sc = spark.sparkContext
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.applicationId not in _OWN:
        _OWN[sc.applicationId] = made = tempfile.mkdtemp(prefix="prosemill-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
    return "file://" + _OWN[sc.applicationId]


#: Rows of a file of small rows.
FILE_ROWS = 250_000


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """df as a table in the shared folder, read back: cuts lineage, survives lost executors, is computed once. With rows, about
    as many as it has, it gets a file for each FILE_ROWS, however many partitions made it."""
    if rows is not None:
        df = df.coalesce(-(-max(rows, 1) // FILE_ROWS))
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/prosemill/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Most rows of a small table that is broadcast, and the share of all rows from which a key is hot; so there are at most HOT
#: hot keys, whatever the number of rows.
SMALL, HOT = 100_000, 1000


def joined_by_key(rows: DataFrame, classes: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """rows with the other columns of classes, which has one row for each value of key and in count how many of the total rows
    have it. Keys of more than a HOTth of the rows, HOT at most, are broadcast, so that no task has all rows of one."""
    if total <= SMALL:  # classes has no more rows than that
        return rows.join(F.broadcast(classes.drop(count)), key)
    hot = F.broadcast(classes.filter(F.col(count) * HOT > total).drop(count))
    return rows.join(hot, key).unionByName(rows.join(hot, key, "left_anti").join(classes.filter(F.col(count) * HOT <= total).drop(count), key))


def workers(spark: SparkSession) -> SparkSession:
    """Readies the session for this package's Python functions: workers can import it (on a cluster it is installed there),
    and batches have few enough rows and bytes for long texts, unless smaller ones are set."""
    for name, most in (("maxRecordsPerBatch", 2000), ("maxBytesPerBatch", 16 << 20)):
        now = re.sub(r"\D", "", spark.conf.get(f"spark.sql.execution.arrow.{name}"))
        if not 0 < int(now or 0) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    return spark


def n_words(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bits48(key: Column) -> Column:
    """48 hash bits of a key as a long from 0, the same in any engine that has MD5; null hashes as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 12), 16, 10).cast("long")


def learnable(key: Column) -> Column:
    """Rows that labels may be learnt from; the others, a third by hash of the id, are held out."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 3 != 1


def labelled(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(doc_id, text, label int) of at most rows labelled ids, those of the least hashes among the learnable ones, as a table.
    An id labelled more than once has its greatest label; null labels and ids don't count. The ids, bounded by rows, are
    broadcast."""
    ids = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & learnable(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # A repeated id gives one text, the least, so that the bound holds.
    out = docs.select(F.col("doc_id").alias("d_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), F.col("d_id") == F.col("doc_id"))
    return written(out.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label"), "labelled")
