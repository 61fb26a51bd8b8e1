"""What the corpus operators share: durable intermediate tables and column hygiene."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Upper bound, in rows, of a table that an operator may broadcast; it is always counted first.
BROADCAST_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine a temporary folder takes its place.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='repertoire-')}"
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may have ended; the folder is then left to the cluster's own cleaning
        pass


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the program ends."""
    path = f"{shared_dir(spark)}/repertoire-{uuid.uuid4().hex}/{name}"
    atexit.register(_remove, spark, path.rpartition("/")[0])
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: it cuts the lineage and survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if a count proves it small, else as it is (Spark then shuffles)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Bytes of an Arrow batch: texts are long, and a batch's arrays are held several times in a task.
BATCH_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Send this package to executors that may not have it on their path, and bound Arrow batches by
    bytes unless the session's configuration does so itself."""
    if getattr(spark, "_repertoire_shipped", False):
        return
    batch = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark.sparkContext.getConf().contains(batch):
        spark.conf.set(batch, str(BATCH_BYTES))
    if not spark.sparkContext.master.startswith("local["):
        root = Path(__file__).resolve().parents[1]
        target = os.path.join(tempfile.mkdtemp(prefix="repertoire-"), "repertoire_pkg.zip")
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, str(Path(root.name) / p.relative_to(root)))
        spark.sparkContext.addPyFile(target)
    spark._repertoire_shipped = True


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def quoted(df: DataFrame) -> list[Column]:
    """All columns of ``df`` in order, whatever their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


#: Rows of one key above which a join by that key broadcasts the key's row instead of gathering its rows.
HEAVY_ROWS = 100_000


def join_counted(df: DataFrame, counted: DataFrame, keys: list[str], rows: str, how: str = "inner") -> DataFrame:
    """Inner or left join with one row a key, where column ``rows`` counts the key's rows in ``df``: heavy keys, at
    most all rows / ``HEAVY_ROWS``, are broadcast so that no task gathers one; the others are shuffled by key."""
    heavy = counted.where(F.col(rows) > HEAVY_ROWS)
    if heavy.limit(1).isEmpty():
        return df.join(counted, keys, how)
    heavy = bounded(heavy)
    light = df.join(heavy, keys, "left_anti").join(counted.where(F.col(rows) <= HEAVY_ROWS), keys, how)
    return df.join(heavy, keys).unionByName(light)


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` minus input columns that bear the name of an output column."""
    lower = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in lower])
