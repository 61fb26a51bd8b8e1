r"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z became a-z. A benchmark item gives its windows
of ten consecutive words; an item of one to nine words is one window. Windows of one length share a
table: the shift of a block of two words says how far the search may jump, a shift of zero leads to
the bucket of windows with that last block, and a direct comparison (hashes, then the words' bytes)
confirms each occurrence. A document is cut into stretches of window ends and all stretches of a
batch jump in step, so that long texts need no more steps than short ones.

The benchmark is split into shards of bounded text; each shard is one pass over the documents with a
broadcast table, and the passes are joined by document. One shard is the usual case.

Defined results: null or wordless texts have no words and no hits (items_sha256 is that of the empty
string); items without words match nothing; equal windows count for each of their items; repeated
document rows each give a row; repeated item_ids count once; empty tables give no rows or no hits.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repertoire.llm._shared import bounded, quoted, ship, text_or_empty, written
from repertoire.llm._text import ALNUM, Words, chunks, mix64, utf8, word_hashes

WINDOW = 10
#: Benchmark text of one pass, in bytes: bounds what is collected and broadcast.
SHARD_BYTES = 8 << 20
#: Window ends that one cursor visits.
STRETCH = 512
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _block(hashes: np.ndarray, last: np.ndarray, width: int) -> np.ndarray:
    return hashes[last] if width == 1 else mix64(hashes[last - 1] * np.uint64(3) ^ hashes[last])


class WindowTable:
    """Wu-Manber tables of all windows of one length."""

    def __init__(self, length: int, windows: dict[tuple[bytes, ...], list[str | None]]):
        self.length, self.width = length, min(2, length)
        self.words = list(windows)
        self.items = [list(set(v)) for v in windows.values()]
        flat = word_hashes(b" ".join(b" ".join(w) for w in self.words), ALNUM).hash
        self.hashes = flat.reshape(len(self.words), length)
        size = 1 << max(12, (8 * len(self.words) * length).bit_length())
        self.mask = np.uint64(size - 1)
        self.shift = np.full(size, length - self.width + 1, dtype=np.int64)
        rows = np.arange(len(self.words)) * length
        for j in range(self.width - 1, length):
            at = (_block(flat, rows + j, self.width) & self.mask).astype(np.int64)
            np.minimum.at(self.shift, at, length - 1 - j)
        suffix = _block(flat, rows + length - 1, self.width)
        self.order = np.argsort(suffix, kind="stable")
        self.keys, first = np.unique(suffix[self.order], return_index=True)
        self.first = np.append(first, len(suffix))

    def ends(self, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Last-word positions whose shift is zero, found by jumping."""
        start, stop = first[:-1] + self.length - 1, first[1:]
        count = np.maximum(0, -(-(stop - start) // STRETCH))
        text = np.repeat(np.arange(len(start)), count)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        at = start[text] + nth * STRETCH
        upto = np.minimum(at + STRETCH, stop[text])
        found = []
        while len(at):
            jump = self.shift[(_block(hashes, at, self.width) & self.mask).astype(np.int64)]
            zero = jump == 0
            if zero.any():
                found.append(at[zero])
            at = at + np.maximum(jump, 1)
            on = at < upto
            at, upto = at[on], upto[on]
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def occurrences(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(last-word position, window number) of every confirmed occurrence."""
        ends = self.ends(w.hash, w.first)
        if not len(ends):
            return ends, ends
        key = _block(w.hash, ends, self.width)
        slot = np.searchsorted(self.keys, key)
        ok = slot < len(self.keys)
        ok[ok] = self.keys[slot[ok]] == key[ok]
        ends, slot = ends[ok], slot[ok]
        count = self.first[slot + 1] - self.first[slot]
        at = np.repeat(ends, count)
        nth = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
        window = self.order[np.repeat(self.first[slot], count) + nth]
        same = np.ones(len(at), dtype=bool)
        for j in range(self.length):
            same[same] = w.hash[at[same] - self.length + 1 + j] == self.hashes[window[same], j]
        at, window = at[same], window[same]
        sure = [all(w.bytes_of(e - self.length + 1 + j) == x for j, x in enumerate(self.words[p])) for e, p in zip(at, window, strict=True)]
        sure = np.array(sure, dtype=bool)
        return at[sure], window[sure]


def window_tables(items: list[tuple[str | None, str | None]], size: int = WINDOW) -> list[WindowTable]:
    """Tables of the windows of (item_id, text) pairs, one for each window length."""
    by_length: dict[int, dict] = defaultdict(lambda: defaultdict(list))
    for item, text in items:
        w = word_hashes((text or "").encode(), ALNUM)
        words = [w.bytes_of(i) for i in range(len(w.start))]
        if words:
            n = min(size, len(words))
            for i in range(len(words) - n + 1):
                by_length[n][tuple(words[i : i + n])].append(item)
    return [WindowTable(n, dict(x)) for n, x in sorted(by_length.items())]


def _spans(hit: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]


def _search(tables):
    def search(batches):
        found_in = tables.value
        for b in batches:
            raw, offsets = utf8(b.column(1))
            n_words, spans, items = [], [], []
            for _, _, part, offs in chunks(raw, offsets):
                w = Words(part, offs, ALNUM)
                steps = np.zeros(len(w.hash) + 1, np.int64)
                of: dict[int, set] = defaultdict(set)
                for t in found_in:
                    at, window = t.occurrences(w)
                    np.add.at(steps, at - t.length + 1, 1)
                    np.add.at(steps, at + 1, -1)
                    text = np.searchsorted(w.first, at, "right") - 1
                    for d, p in set(zip(text.tolist(), window.tolist(), strict=True)):
                        of[d].update(t.items[p])
                hit = np.cumsum(steps)[:-1] > 0
                for d in range(len(offs) - 1):
                    a, z = w.first[d], w.first[d + 1]
                    n_words.append(int(z - a))
                    items.append(sorted(of[d], key=lambda x: (x is None, x)) if d in of else [])
                    spans.append(_spans(hit[a:z]) if d in of else [])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n_words, pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))],
                names=["doc_id", "n_words", "spans", "items"],
            )

    return search


def contamination(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """(doc_id, n_words, n_hit, spans of hit words, items) for every row of ``docs``; benchmark items without
    an id are searched too and stand as one null at the end of ``items``."""
    spark = docs.sparkSession
    ship(spark)
    tests = benchmark.select(F.col("item_id").cast("string").alias("item"), text_or_empty().alias("text"))
    size = tests.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(1, -(-size // shard_bytes))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, spans array<struct<start:int,end:int>>, items array<string>"
    texts = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    passes = []
    for k in range(shards):
        rows = tests.where(F.pmod(F.xxhash64("item", "text"), F.lit(shards)) == k).collect()  # at most about shard_bytes
        tables = spark.sparkContext.broadcast(window_tables([(r.item, r.text) for r in rows], window))
        keyed = texts if shards == 1 else texts.select(F.struct("doc_id", F.xxhash64("text").alias("h")).alias("doc_id"), "text")
        passes.append(keyed.mapInArrow(_search(tables), schema.replace(f"doc_id {kind}", f"doc_id struct<doc_id:{kind},h:bigint>") if shards > 1 else schema))
    if shards == 1:
        found = passes[0]
    else:
        every = passes[0]
        for p in passes[1:]:
            every = every.unionAll(p)
        found = every.groupBy("doc_id", "n_words").agg(
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
            F.expr(f"count(*) div {shards}").alias("times"),
        )
        found = found.select(F.col("doc_id.doc_id").alias("doc_id"), "n_words", "spans", "items", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    hit = F.expr(
        "aggregate(spans, named_struct('n', 0L, 'upto', 0), (s, x) -> named_struct('n', s.n + greatest(0, x.end - greatest(x.start, s.upto)), "
        "'upto', greatest(s.upto, x.end)), s -> s.n)"
    )
    return found.select("doc_id", "n_words", hit.alias("n_hit"), "spans", "items")


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The query's columns."""
    found = contamination(docs, benchmark)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that hold a benchmark window; columns as given."""
    bad = contamination(docs, benchmark, id_col=id_col, text_col=text_col).where("n_hit > 0")
    bad = written(bad.select(F.col("doc_id").alias(id_col)).distinct(), "contaminated")
    return docs.join(bounded(bad), id_col, "left_anti").select(*quoted(docs))


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
