"""Sharding by a two-pass external shuffle, in DataFrame functions only.

Pass one scatters records uniformly, by a seeded hash of their id, into parts, at most ``PARTS`` of them, and
inside a part into buckets that fit in memory. Pass two permutes each bucket by Fisher-Yates (Spark's
``shuffle`` of an array, which is seeded per partition; each partition holds its buckets in a fixed order,
so a rerun gives the same permutation) and the shards are written. The buckets' row counts, summed in
order, give each record its place in the global permutation, and equal stretches of places are the shards:
their row counts differ by one at most.

Defined results: a null text has size 8 and the crc of the empty string; records without id are
scattered by a hash of the whole row; repeated rows each keep a place of their own; an empty table
gives no rows; input columns named like an output column are replaced. Columns must be orderable. Rows that
are equal to the last column share a bucket: what repeats so often that it does not fit one must be made
apart (by an id) before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repertoire.llm._shared import bounded, fresh_path, quoted, text_or_empty, without, written

#: Overhead of a record besides its text, in bytes.
RECORD_OVERHEAD = 8
#: A bucket is permuted in memory; a part is the buckets of one reduce task.
BUCKET_BYTES, PART_BYTES, PARTS = 16 << 20, 16 << 20, 20_000


def _hash(df: DataFrame, id_col: str, seed: int) -> Column:
    whole_row = F.xxhash64(*quoted(df))
    return F.when(F.col(id_col).isNull(), whole_row).otherwise(F.xxhash64(F.lit(seed), F.col(id_col)))


def shuffled(
    df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shards: int = 24, seed: int = 20, bucket_bytes: int = BUCKET_BYTES, part_bytes: int = PART_BYTES
) -> DataFrame:
    """All columns of ``df`` plus ``size``, ``shard``, ``slot`` and ``place`` (the rank in the global permutation)."""
    df = without(df, "size", "shard", "slot", "place")
    size = F.octet_length(text_or_empty(text_col)) + F.lit(RECORD_OVERHEAD)
    total, rows = df.agg(F.coalesce(F.sum(size.cast("long")), F.lit(0)), F.count(F.lit(1))).first()
    parts = max(1, min(PARTS, -(-total // part_bytes)))
    inner = max(1, -(-total // (parts * bucket_bytes)))
    h = _hash(df, id_col, seed)
    part = F.pmod(h, F.lit(parts)).cast("int")
    bucket = F.pmod(F.xxhash64(F.lit(seed + 1), h), F.lit(inner)).cast("int")
    counts = df.select(part.alias("p"), bucket.alias("b")).groupBy("p", "b").agg(F.count(F.lit(1)).alias("n"))
    counts = written(counts, "bucket-rows")
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    # one row for each part, at most PARTS; inside a part its buckets
    heads = counts.groupBy("p").agg(F.sum("n").alias("n")).select("p", F.coalesce(F.sum("n").over(before.orderBy("p")), F.lit(0)).alias("head"))
    starts = counts.join(bounded(heads), "p").select("p", "b", (F.col("head") + F.coalesce(F.sum("n").over(before.partitionBy("p").orderBy("b")), F.lit(0))).alias("o"))
    row = F.struct(*quoted(df), size.cast("long").alias("size"))
    scattered = df.select(part.alias("p"), bucket.alias("b"), F.struct(F.xxhash64(F.lit(seed), F.col(id_col)).alias("k"), row.alias("r")).alias("x"))
    gathered = scattered.repartitionById(parts, F.col("p")).groupBy("p", "b").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    if inner > 1:
        gathered = gathered.sortWithinPartitions("b")
    permuted = gathered.select("p", "b", F.shuffle("xs", seed).alias("xs")).join(bounded(starts), ["p", "b"])
    spread = permuted.select("o", F.posexplode("xs").alias("i", "x")).select("x.r.*", (F.col("o") + F.col("i")).alias("place"))
    at = F.expr(f"place * {shards}L div {max(1, rows)}L")
    first = F.expr(f"((place * {shards}L div {max(1, rows)}L) * {max(1, rows)}L + {shards - 1}L) div {shards}L")
    return spread.select(*quoted(spread), at.cast("int").alias("shard"), (F.col("place") - first).alias("slot"))


def write_shards(df: DataFrame, path: str, **options) -> DataFrame:
    """Writes the shuffled records as ``path/shard=N``, in slot order within and over files by name (a task holds a
    stretch of the permutation), and returns them as they are read back."""
    out = shuffled(df, **options)
    out.sortWithinPartitions("shard", "slot").write.option("compression", "zstd").partitionBy("shard").parquet(path)
    return df.sparkSession.read.schema(out.schema).parquet(path)


def shard_report(df: DataFrame) -> DataFrame:
    """The query's columns: sizes, digests and places of all documents, read from the shards written."""
    written_shards = write_shards(df.select("doc_id", "text"), fresh_path(df.sparkSession, "shards"))
    return written_shards.select(
        "doc_id",
        "size",
        F.crc32(F.encode(text_or_empty(), "UTF-8")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
