"""Row-wise work of Arrow batches beside plain computations."""

import random
from hashlib import md5

from pyspark.sql import functions as F

from repertoire.functions import sequences as seq
from repertoire.functions import tables
from repertoire.operators import junctions


def _aligned(a, b):
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    n, d, table = len(short), len(long) - len(short), tables.blosum62()
    if not d:
        return short
    score = lambda g: [table.get(short[i] + long[i if i < g else i + d]) for i in range(n)]
    value = lambda g: -(10**9) if None in score(g) else sum(score(g))
    g = max(range(1, max(n - 1, 1) + 1), key=lambda g: (value(g), -g))
    return short[:g] + "." * d + short[g:]


def test_gaps_of_a_batch(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("ACDEFGHIKLMNPQRSTVWYBZ"[: rng.choice((20, 22))]) for _ in range(rng.randrange(8)))
    rows = [(word(), word()) for _ in range(400)]
    assert seq.gapped([a for a, _ in rows] + [None, "A"], [b for _, b in rows] + ["A", None], ".") == [*[_aligned(a, b) for a, b in rows], None, None]
    x = spark.createDataFrame([(a, b) for a, b in rows], "a string, b string").select(seq.align_with_gap(F.col("a"), F.col("b"), "-").alias("g"))
    assert "ArrowEvalPython" in x._jdf.queryExecution().optimizedPlan().toString()
    assert [r.g for r in x.collect()] == [_aligned(a, b).replace(".", "-") for a, b in rows]


def test_shuffled_letters_of_a_batch(spark):
    rows = [(7, "acg+tt+gca"), (8, "++"), (9, ""), (None, "ab+c"), (10, None)]
    x = spark.createDataFrame(rows, "k long, s string").select(junctions.shuffled_letters(F.col("s"), F.col("k")).alias("s"))
    assert "ArrowEvalPython" in x._jdf.queryExecution().optimizedPlan().toString()

    def plain(k, s):
        free = s.replace("+", "")
        order = sorted(range(len(free)), key=lambda i: md5((f"{k}:{i}" if k is not None else f"{i}").encode()).hexdigest())
        pool = [free[i] for i in order]
        return "".join("+" if c == "+" else pool.pop(0) for c in s)

    assert [r.s for r in x.collect()] == [None if s is None else plain(k, s) for k, s in rows]
