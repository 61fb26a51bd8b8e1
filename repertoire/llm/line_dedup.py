r"""Line deduplication by a sharded minimal perfect hash.

A line's key is the line without white space at its ends, A-Z in lower case; keys of at least ``LEAST_CHARS`` code
points that two or more documents hold lose all their lines, except in the smallest doc_id that holds them.

One pass hashes the distinct keys of every document to 128 bits; Spark reduces them to holders (rows, smallest
and largest id). Of the distinct hashes that more than one document holds, those with the same high bits are
a shard: a minimal perfect hash numbers them, and the numbers index arrays of fingerprints (the other 64 bits),
counts and owners. A second pass over the documents probes the arrays: a line goes if its fingerprint is there
and its document is not the owner. Lines that only one document holds need no entry, since no fingerprint is theirs.

Arrays of up to ``NEAR_KEYS`` keys, the most frequent ones, go to every task. Where there are more keys, the rest
stays on its shards and the documents' hashes are sent there: a key of these has fewer holders than any of the
first, so no shard gets a hot key, and what comes back is only what goes. Both ways give the same.

Defined results: a null or empty text is one empty line; rows that repeat a doc_id are one document, each
keeping or losing the same lines; rows without an id are one document that ranks behind all others; a line ends
at \n only, and other white space at its ends is not part of the key; the first line may go like any other; an
empty table gives no rows; input columns named like an output column are replaced. Ids must be integers.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from repertoire.llm._shared import quoted, ship, text_or_empty, without, written
from repertoire.llm._text import LOWER
from repertoire.llm.perfect_hash import PerfectHash

LEAST_CHARS = 10
WHITE = b" \t\n\v\f\r"
_LOWER = LOWER.tobytes()
#: Keys whose arrays every task gets (about 20 bytes each); a shard's keys and the hashes sent to it, on average.
NEAR_KEYS, SHARD_KEYS, SHARD_ROWS = 1 << 20, 1 << 17, 1 << 19
#: Rows of a batch that leaves a task.
ROWS = 1 << 16


def line_keys(text: bytes) -> list[bytes | None]:
    """The 16-byte hash of each line's key; None where the key is too short to count."""
    out: list[bytes | None] = []
    for line in text.translate(_LOWER).split(b"\n"):
        key = line.strip(WHITE)
        enough = len(key) >= LEAST_CHARS and (len(key) >= 4 * LEAST_CHARS or key.isascii() or len(key.decode("utf-8", "replace")) >= LEAST_CHARS)
        out.append(hashlib.blake2b(key, digest_size=16).digest() if enough else None)
    return out


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def _holders(batches):
    """(h, g, id) of the distinct keys of each document."""

    def send(ids, digests):
        h, g = _halves(digests)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(g.view(np.int64)), pa.array(ids, pa.int64())], names=["h", "g", "id"])

    ids, digests = [], []
    for b in batches:
        for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            own = list(dict.fromkeys(k for k in line_keys(text.as_buffer().to_pybytes()) if k is not None))
            digests += own
            ids += [doc] * len(own)
            if len(digests) >= ROWS:
                yield from send(ids, digests)
                ids, digests = [], []
    if digests:
        yield from send(ids, digests)


class Shard:
    """Fingerprints, counts and owners of keys, in the order of their perfect hash. Keys that share ``h`` with
    another stand aside."""

    __slots__ = ("hash", "fingerprints", "counts", "owners", "aside")

    def __init__(self, function: PerfectHash, fingerprints: np.ndarray, counts: np.ndarray, owners: np.ndarray, aside: dict):
        self.hash, self.fingerprints, self.counts, self.owners, self.aside = function, fingerprints, counts, owners, aside

    @classmethod
    def build(cls, h: np.ndarray, g: np.ndarray, counts: np.ndarray, owners: np.ndarray) -> Shard:
        _, first = np.unique(h, return_index=True)
        rest = np.setdiff1d(np.arange(len(h)), first)
        aside = {(int(h[i]), int(g[i])): (int(counts[i]), int(owners[i])) for i in rest}
        function = PerfectHash.build(h[first])
        order = np.empty(len(first), np.int64)
        order[function(h[first])] = first
        return cls(function, g[order], counts[order], owners[order], aside)

    def probe(self, h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, owner) of each key; a count of 0 where it is not here."""
        at = self.hash(h)
        count, owner = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        if len(self.fingerprints):
            here = (at >= 0) & (self.fingerprints[at] == g)
            count[here], owner[here] = self.counts[at[here]], self.owners[at[here]]
        for i in np.flatnonzero(count == 0) if self.aside else ():
            count[i], owner[i] = self.aside.get((int(h[i]), int(g[i])), (0, 0))
        return count, owner

    def row(self) -> tuple[bytes, bytes, bytes, str, bytes, bytes]:
        few = self.counts.astype(np.min_scalar_type(int(self.counts.max(initial=0))))
        aside = np.array([[*np.array(k, np.uint64).view(np.int64), *v] for k, v in self.aside.items()], np.int64)
        return self.hash.tobytes(), self.fingerprints.tobytes(), few.tobytes(), few.dtype.str, self.owners.tobytes(), aside.tobytes()

    @classmethod
    def of_row(cls, function: bytes, fingerprints: bytes, counts: bytes, kind: str, owners: bytes, aside: bytes) -> Shard:
        rest = np.frombuffer(aside, np.int64).reshape(-1, 4)
        keys = rest[:, :2].copy().view(np.uint64).tolist()
        others = {tuple(k): tuple(v) for k, v in zip(keys, rest[:, 2:].tolist(), strict=True)}
        return cls(PerfectHash.frombytes(function), np.frombuffer(fingerprints, np.uint64), np.frombuffer(counts, kind), np.frombuffer(owners, np.int64), others)


_SHARD = "shard long, function binary, fingerprints binary, counts binary, kind string, owners binary, aside binary"
_ARRAYS = ["function", "fingerprints", "counts", "kind", "owners", "aside"]


def _unsigned(column: pd.Series) -> np.ndarray:
    return column.to_numpy(np.int64).view(np.uint64)


def _build(key: tuple, keys: pd.DataFrame) -> pd.DataFrame:
    made = Shard.build(_unsigned(keys["h"]), _unsigned(keys["g"]), keys["n"].to_numpy(np.int64), keys["owner"].to_numpy(np.int64))
    return pd.DataFrame([(key[0], *made.row())], columns=["shard", *_ARRAYS])


def _shard_of(bits: int) -> Column:
    return F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long")


def index(keys: DataFrame, bits: int) -> DataFrame:
    """One row of arrays for each shard of ``keys`` (h, g, n, owner)."""
    return keys.withColumn("shard", _shard_of(bits)).groupBy("shard").applyInPandas(_build, _SHARD)


def _far(key: tuple, probes: pd.DataFrame, arrays: pd.DataFrame) -> pd.DataFrame:
    none = pd.DataFrame({"id": np.zeros(0, np.int64), "nameless": np.zeros(0, bool), "key": []})
    if not len(probes) or not len(arrays):
        return none
    shard = Shard.of_row(*arrays.iloc[0][_ARRAYS])
    h, g = _unsigned(probes["h"]), _unsigned(probes["g"])
    count, owner = shard.probe(h, g)
    goes = (count > 0) & (probes["nameless"].to_numpy(bool) | (owner != probes["id"].to_numpy(np.int64)))
    keys = np.stack((h[goes], g[goes]), 1)
    return pd.DataFrame({"id": probes["id"][goes], "nameless": probes["nameless"][goes], "key": [k.tobytes() for k in keys]})


def _kept(near, bits: int):
    """Text, lines and lines dropped of each document: ``near`` holds the arrays of this task, ``far`` what shards named."""

    @F.pandas_udf("text string, n_lines long, n_dropped long")
    def keep(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        shards = {s: Shard.of_row(*row) for s, *row in near.value}
        for texts, ids, nameless, far in batches:
            keys = [line_keys(text.encode("utf-8", "surrogatepass")) for text in texts]
            gone = [set(named) if named is not None else set() for named in far]
            some = [list(dict.fromkeys(k for k in own if k is not None)) for own in keys] if shards else []
            each = np.array([len(own) for own in some], np.int64)
            if each.sum():  # the keys of all documents of a batch are looked up at once
                every = [k for own in some for k in own]
                h, g = _halves(every)
                of = np.repeat(np.arange(len(some)), each)
                owner, count = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
                shard = (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
                for s in np.unique(shard):
                    if s in shards:
                        here = np.flatnonzero(shard == s)
                        count[here], owner[here] = shards[s].probe(h[here], g[here])
                for i in np.flatnonzero((count > 0) & (nameless.to_numpy(bool)[of] | (owner != ids.to_numpy(np.int64)[of]))):
                    gone[of[i]].add(every[i])
            out = []
            for text, own, drop in zip(texts, keys, gone, strict=True):
                dropped = sum(k in drop for k in own) if drop else 0
                if dropped:
                    text = "\n".join(line for line, k in zip(text.split("\n"), own, strict=True) if k not in drop)
                out.append((text, len(own), dropped))
            yield pd.DataFrame(out, columns=["text", "n_lines", "n_dropped"])

    return keep


def line_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", near_keys: int = NEAR_KEYS) -> DataFrame:
    """All columns of ``docs``, the text without the lines that an earlier document holds, plus ``n_lines`` (before) and
    ``n_dropped``."""
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} must be an integer column")
    spark = docs.sparkSession
    ship(spark)
    docs = without(docs, "n_lines", "n_dropped")
    plain = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    holders = plain.mapInArrow(_holders, "h long, g long, id long")
    found = holders.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("owner"), F.max("id").alias("last"), F.bool_or(F.col("id").isNull()).alias("nameless"))
    shared = found.where("n > 1 and owner is not null and (owner < last or nameless)").select("h", "g", "n", "owner")
    repeated = written(shared, "repeated-lines")
    steps = {r[0]: (r[1], r[2]) for r in repeated.groupBy(F.floor(F.log2("n")).alias("step")).agg(F.count(F.lit(1)), F.sum("n")).collect()}
    least, room = 0, near_keys  # the most frequent keys whose arrays fit
    for step in sorted(steps, reverse=True):
        room -= steps[step][0]
        if room < 0:
            least = 2 ** (step + 1)
            break
    near = repeated.where(F.col("n") >= least)
    bits = math.ceil(math.log2(max(1, sum(k for k, _ in steps.values()) / SHARD_KEYS)))
    arrays = spark.sparkContext.broadcast([tuple(r) for r in index(near, bits).collect()])
    keep = _kept(arrays, bits)
    row = docs.select(F.struct(*quoted(docs)).alias("__row"), F.col(id_col).cast("long").alias("__id"), text_or_empty(text_col).alias("__text"))
    if least:
        probed = sum(n for _, n in steps.values())
        far_bits = max(bits, math.ceil(math.log2(max(1, probed / SHARD_ROWS))))
        probes = holders.select(_shard_of(far_bits).alias("shard"), "h", "g", F.coalesce("id", F.lit(0)).alias("id"), F.col("id").isNull().alias("nameless"))
        shards = index(repeated.where(F.col("n") < least), far_bits)
        goes = probes.groupBy("shard").cogroup(shards.groupBy("shard")).applyInPandas(_far, "id long, nameless boolean, key binary")
        named = goes.groupBy("id", "nameless").agg(F.collect_set("key").alias("__far"))
        named = named.select(F.when(~F.col("nameless"), F.col("id")).alias("__of"), "__far")
        row = row.join(named, F.col("__id").eqNullSafe(F.col("__of")), "left")
    else:
        row = row.withColumn("__far", F.lit(None).cast("array<binary>"))
    done = row.select("__row", keep("__text", F.coalesce("__id", F.lit(0)), F.col("__id").isNull(), "__far").alias("__kept"))
    inside = lambda c: F.col("__row.`" + c.replace("`", "``") + "`").alias(c)
    columns = [F.col("__kept.text").alias(c) if c == text_col else inside(c) for c in docs.columns]
    return done.select(*columns, F.col("__kept.n_lines").alias("n_lines"), F.col("__kept.n_dropped").alias("n_dropped"))


def line_report(docs: DataFrame) -> DataFrame:
    """The query's columns: lines, lines dropped and the digest of what is kept."""
    out = line_dedup(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
