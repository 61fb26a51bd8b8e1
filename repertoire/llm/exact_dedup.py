r"""Exact deduplication with counting quotient filters.

Texts are compared after deleting every character of ``[\x20\x09-\x0D]``. Each partition builds counting
quotient filters of its 64-bit fingerprints, one for each block (the high bits): the next bits are the
quotient, which names a slot; the rest is the remainder, kept in that slot or, shifted, in the next free
one, so that equal quotients are a run of sorted remainders. Three bits a slot (occupied, continuation,
shifted) tell the runs apart, and every slot has a counter. Filters merge losslessly: their runs are read
back, sorted remainders merged, counters added. Fingerprints with a merged count above one go to byte
verification, which groups the normalised texts themselves; all others are unique without a look at a text.

Of equal texts stays the row with the most code points in its original text, then the smallest doc_id.

Defined results: null text counts as empty (all empty texts are one group); rows that repeat a doc_id
are members of their own and share its fate; a null doc_id ranks last; ids of any orderable type are
compared as such; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repertoire.llm._shared import bounded, join_counted, quoted, ship, text_or_empty, written

WHITE = r"[ \t-\r]"
#: Fingerprints that a merged block holds on average: bounds a merging task at any input size.
BLOCK_ROWS = 2_000_000
#: Share of a filter's slots that are used at most.
LOAD = 0.75
_FILTER = "block int, slots int, bits binary, remainders binary, counts binary"


class QuotientFilter:
    """A counting quotient filter over unsigned 64-bit fingerprints that share their top ``block_bits`` bits.

    ``occupied[s]``: some fingerprint has quotient s; ``continuation[s]``: slot s goes on with the run of slot
    s - 1; ``shifted[s]``: its remainder is not in its own slot. Remainders and counters are those of the used
    slots, in order of slots.
    """

    __slots__ = ("block_bits", "quotient_bits", "occupied", "continuation", "shifted", "remainders", "counts")

    def __init__(self, keys: np.ndarray, counts: np.ndarray | None = None, block_bits: int = 0):
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        counts = np.ones(len(keys), np.int64) if counts is None else counts[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        keys, self.counts = keys[first], np.add.reduceat(counts, first) if len(keys) else counts
        self.block_bits, self.quotient_bits = block_bits, max(1, int(len(keys) / LOAD).bit_length())
        rest = np.uint64(64 - block_bits - self.quotient_bits)
        quotient = ((keys >> rest) & np.uint64((1 << self.quotient_bits) - 1)).astype(np.int64)
        self.remainders = keys & np.uint64((1 << int(rest)) - 1)
        # linear probing in order: a remainder goes to its slot or behind the one before it
        at = np.arange(len(keys))
        slot = at + np.maximum.accumulate(quotient - at) if len(keys) else at
        size = (1 << self.quotient_bits) + len(keys)  # a run may reach over the last slot
        self.occupied, self.continuation, self.shifted = (np.zeros(size, bool) for _ in range(3))
        self.occupied[quotient] = True
        self.continuation[slot[1:]] = quotient[1:] == quotient[:-1]
        self.shifted[slot] = slot != quotient

    def __len__(self) -> int:
        return len(self.remainders)

    def keys(self, block: int) -> np.ndarray:
        """The fingerprints, sorted: the j-th run belongs to the j-th occupied quotient."""
        used = self.shifted | self.continuation
        # an unshifted first element sits in the slot of its own quotient
        used[np.flatnonzero(self.occupied)] = True
        starts = ~self.continuation[np.flatnonzero(used)]
        quotient = np.flatnonzero(self.occupied)[np.cumsum(starts) - 1] if len(self) else np.zeros(0, np.int64)
        rest = 64 - self.block_bits - self.quotient_bits
        high = np.uint64(int(block) << (64 - self.block_bits)) if self.block_bits else np.uint64(0)
        return high | (quotient.astype(np.uint64) << np.uint64(rest)) | self.remainders

    def row(self, block: int) -> tuple:
        bits = np.packbits(np.concatenate((self.occupied, self.continuation, self.shifted)))
        return block, self.quotient_bits, bits.tobytes(), self.remainders.tobytes(), self.counts.tobytes()

    @classmethod
    def of_row(cls, block_bits: int, slots: int, bits: bytes, remainders: bytes, counts: bytes) -> QuotientFilter:
        f = cls.__new__(cls)
        f.block_bits, f.quotient_bits = block_bits, slots
        f.remainders, f.counts = np.frombuffer(remainders, np.uint64), np.frombuffer(counts, np.int64)
        size = (1 << slots) + len(f.remainders)
        every = np.unpackbits(np.frombuffer(bits, np.uint8), count=3 * size).astype(bool)
        f.occupied, f.continuation, f.shifted = every[:size], every[size : 2 * size], every[2 * size :]
        return f

    @classmethod
    def merge(cls, parts: list[QuotientFilter], block: int) -> QuotientFilter:
        """The filter of all insertions into ``parts``, filters of one block; no count is lost."""
        return cls(np.concatenate([p.keys(block) for p in parts]), np.concatenate([p.counts for p in parts]), parts[0].block_bits)


def filters_of(keys: np.ndarray, counts: np.ndarray, bits: int) -> Iterator[tuple[int, QuotientFilter]]:
    """(block, filter) of fingerprints by their top ``bits`` bits."""
    block = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    order = np.argsort(block, kind="stable")
    edges = np.flatnonzero(np.concatenate(([True], np.diff(block[order]) != 0, [True]))) if len(block) else []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        part = order[a:b]
        yield int(block[part[0]]), QuotientFilter(keys[part], counts[part], bits)


def _build(bits: int):
    def build(batches):
        keys = [b.column(0).to_numpy(zero_copy_only=False).view(np.uint64) for b in batches]
        if keys:
            each, counts = np.unique(np.concatenate(keys), return_counts=True)
            rows = [f.row(block) for block, f in filters_of(each, counts.astype(np.int64), bits)]
            types = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[c.split()[0] for c in _FILTER.split(", ")])

    return build


def _repeated(bits: int):
    def merge(key: tuple, pieces: pd.DataFrame) -> pd.DataFrame:
        parts = [QuotientFilter.of_row(bits, *r) for r in zip(*(pieces[c] for c in ("slots", "bits", "remainders", "counts")), strict=True)]
        whole = QuotientFilter.merge(parts, key[0])
        some = whole.counts > 1
        return pd.DataFrame({"fp": whole.keys(key[0])[some].view(np.int64), "fp_count": whole.counts[some]})

    return merge


def repeated_fingerprints(fingerprints: DataFrame, rows: int) -> DataFrame:
    """(fp, fp_count) of the 64-bit fingerprints that occur more than once, through merged filters."""
    bits = max(5, (max(1, rows // BLOCK_ROWS)).bit_length())
    filters = fingerprints.mapInArrow(_build(bits), _FILTER)
    return filters.groupBy("block").applyInPandas(_repeated(bits), "fp long, fp_count long")


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of ``docs``."""
    ship(docs.sparkSession)
    norm = F.regexp_replace(text_or_empty(text_col), WHITE, "")
    ids = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"), norm.alias("norm"))
    signed = written(
        ids.select("doc_id", F.length("text").alias("points"), F.xxhash64("norm").alias("fp"), F.sha2("norm", 256).alias("text_sha256")), "signatures"
    )
    rows = signed.count()
    repeated = written(repeated_fingerprints(signed.select("fp"), rows), "repeated")
    known = bounded(repeated.select("fp"))
    # byte verification: only texts whose fingerprint repeats, grouped by their bytes
    suspects = ids.select("doc_id", F.length("text").alias("points"), "norm", F.xxhash64("norm").alias("fp")).join(known, "fp", "left_semi")
    sizes = suspects.groupBy("norm", "points").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id"))
    best = F.min(F.struct((-F.col("points")).alias("longest"), F.col("doc_id").isNull().alias("nameless"), "doc_id"))
    groups = sizes.groupBy("norm").agg(F.sum("n").alias("group_size"), best.alias("best"))
    verified = written(
        groups.where("group_size > 1").select(F.sha2("norm", 256).alias("text_sha256"), F.col("best.doc_id").alias("keep_id"), "group_size"), "groups"
    )
    joined = join_counted(signed, bounded(verified), ["text_sha256"], "group_size", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that repeat another's text; columns as given."""
    flags = written(exact_groups(docs, id_col=id_col, text_col=text_col).where("not kept").select("doc_id").distinct(), "dropped")
    return docs.join(bounded(flags.select(F.col("doc_id").alias(id_col))), id_col, "left_anti").select(*quoted(docs))
