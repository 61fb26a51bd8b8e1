"""Translation of batches."""

import pyarrow as pa
from pyspark.sql import functions as F

from repertoire.functions import sequences as seq
from repertoire.functions import tables


def test_a_batch_is_translated_at_once():
    texts = ["atggcnntt#aatg", "ttacat", None, "at", "", "a\u00e9gaar", "ATG"]
    code = tables.genetic_code()
    plain = [None if t is None else "".join("#" if "#" in t[i : i + 3] else code.get(t[i : i + 3], "X") for i in range(0, len(t) // 3 * 3, 3)) for t in texts]
    assert seq.translated(pa.array(texts)).to_pylist() == plain
    assert seq.translated(pa.array(texts).slice(1, 3)).to_pylist() == plain[1:4]
    assert seq.translated(pa.array([], pa.string())).to_pylist() == []


def test_translations_named_by_many_columns_stay_few_calls(spark):
    n, frame = F.col("n"), F.col("f")
    p = F.when(frame == 0, seq.translate_frame(n, 1)).when(frame == 1, seq.translate_frame(n, -2)).otherwise(seq.translate_frame(n, 3))
    x = spark.createDataFrame([(0, "atgGCNntt#aatg"), (1, "ttacat"), (2, "at"), (0, None), (2, "aaratgcc")], "f int, n string").withColumn("p", p)
    for _ in range(3):
        x = x.withColumn("p", F.concat(F.substr("p", F.lit(1), F.lit(2)), F.substr("p", F.lit(3), F.lit(99))))
    assert len(x._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    assert [r.p for r in x.collect()] == ["MAX#", "C", "", None, "XA"]
