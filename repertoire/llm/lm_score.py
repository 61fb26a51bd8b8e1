r"""Language-model scoring: context-tree weighting over bytes, beside a word-frequency base.

A text is A-Z lower-cased and read as its words ``[^\x20\x09-\x0D]+``; the byte model reads them with
one blank after each but the last and a line end after the last, so that it too pays for words, their
borders and the end. Its score is the log10 probability of those bytes; the base is the add-one
frequency of words and ends. Both learn only from texts whose crc32(doc_id as text) mod 7 is not 2.

1. Every partition counts its grams (five context bytes and a byte) and its words (64-bit hashes) and
   sends them, summed, in blocks: grams by their last two context bytes, words by hash. Merged blocks
   are a table in the shared folder.
2. Each block weights its nodes of depth two and more; its roots, at most 65,280 in all, give depths
   zero and one.
3. The most frequent grams and words, at most ``TABLE_ROWS`` of each, are broadcast with their log
   probabilities and counts; documents are scored with them in one scan. What is not in the tables
   (rare and new grams and words) is sent to its block, looked up there exactly, and added by document.

White space counts as one blank between words: no word or border is lost by it. ``bits_per_byte`` is the code
length of the bytes that the model reads.

Defined results: null or empty text is the end alone; a null doc_id is not held out; repeated rows each
give a row; without training texts every byte has probability 1/256 and every count is 0; an empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repertoire.llm import ctw
from repertoire.llm._shared import ship, text_or_empty, written
from repertoire.llm._text import NOT_SPACE, Words, chunks, mix64, utf8

FOLDS, HELD_OUT = 7, 2
TABLE_ROWS = 500_000
#: Blocks that counts are dealt to: one for ``BLOCK_BYTES`` of training text, within these bounds. Grams are dealt by
#: two bytes of context, so more blocks than there are pairs of bytes would stay empty.
BLOCKS, BLOCK_BYTES = (64, 16_384), 32 << 20
#: A text of more bytes is read in pieces, each with the bytes before it as context.
LONG_TEXT = 1 << 20
#: Distinct keys that a task holds before it sends them.
HOLD_ROWS = 3_000_000
GRAM, WORD = 0, 1
END_WORD = np.uint64(0x1B873593CC9E2D51)
LN10 = np.log(10.0)


def _letters(w: Words, a: int, z: int, at: np.ndarray, out: np.ndarray) -> None:
    """Copies words a to z to their places in a stream."""
    size = w.end[a:z] - w.start[a:z]
    step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[step + np.repeat(at, size)] = w.low[step + np.repeat(w.start[a:z], size)]


def _pieces(i: int, w: Words, depth: int):
    """One long text, run by run of words."""
    upto = np.cumsum(w.end - w.start + 1)
    lead, a = np.zeros(0, np.uint8), 0
    while a < len(upto):
        done = upto[a - 1] if a else 0
        z = max(a + 1, int(np.searchsorted(upto, done + LONG_TEXT, "right")))
        out = np.full(len(lead) + int(upto[z - 1] - done), 32, np.uint8)
        out[: len(lead)] = lead
        _letters(w, a, z, upto[a:z] - (w.end[a:z] - w.start[a:z] + 1) - done + len(lead), out)
        hashes = w.hash[a:z]
        if z == len(upto):
            out[-1] = 10
            hashes = np.append(hashes, END_WORD)
        yield i, out, np.array([0, len(out)]), hashes, np.array([0, len(hashes)]), len(lead)
        lead, a = out[-depth:].copy(), z


def _streams(raw: np.ndarray, offsets: np.ndarray, depth: int):
    """Run by run of texts: (first text, byte stream, its text starts, word hashes with ends, their text starts, bytes of
    the stream that are only context). A long text comes in several runs of its own."""
    for i, _, part, offs in chunks(raw, offsets):
        w = Words(part, offs, NOT_SPACE)
        n = len(offs) - 1
        if len(part) > LONG_TEXT and n == 1 and len(w.start):
            yield from _pieces(i, w, depth)
            continue
        words = np.diff(w.first)
        # bytes of each word and one separator after it; a text without words is one line end
        length = w.end - w.start + 1
        text = np.repeat(np.arange(n), words)
        size = np.bincount(text, length, n).astype(np.int64)
        size[words == 0] = 1
        begin = np.concatenate(([0], np.cumsum(size)))
        empty_before = np.concatenate(([0], np.cumsum(words == 0)))[:-1]
        out = np.full(int(begin[-1]), 32, np.uint8)
        _letters(w, 0, len(length), np.cumsum(length) - length + empty_before[text], out)
        out[begin[1:] - 1] = 10
        first = w.first + np.arange(n + 1)
        hashes = np.full(len(w.hash) + n, END_WORD)
        hashes[np.arange(len(w.hash)) + text] = w.hash
        yield i, out, begin, hashes, first, 0


def _block_of(kind: int, keys: np.ndarray, blocks: int) -> np.ndarray:
    x = (keys >> np.uint64(8)) & np.uint64(0xFFFF) if kind == GRAM else keys
    return (mix64(x + np.uint64(17)) % np.uint64(blocks)).astype(np.int32)


def _split(kind: int, keys: np.ndarray, blocks: int, *columns: np.ndarray):
    """(block, keys, columns...) with the block's share of each array."""
    block = _block_of(kind, keys, blocks)
    order = np.argsort(block, kind="stable")
    edge = np.flatnonzero(np.concatenate(([True], np.diff(block[order]) != 0, [True]))) if len(keys) else []
    for a, z in zip(edge[:-1], edge[1:], strict=True):
        part = order[a:z]
        yield int(block[part[0]]), keys[part], *(c[part] for c in columns)


_COUNTS = pa.schema([("kind", pa.int32()), ("block", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])


def _count(depth: int, blocks: int):
    def run(batches):
        held: dict[int, list] = {GRAM: [], WORD: []}
        amount = 0

        def send():
            nonlocal amount
            rows = []
            for kind, parts in held.items():
                if parts:
                    keys, counts = ctw.merge_counts(*(np.concatenate(x) for x in zip(*parts, strict=True)))
                    rows += [(kind, b, k.tobytes(), c.tobytes()) for b, k, c in _split(kind, keys, blocks, counts)]
                parts.clear()
            amount = 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _COUNTS, strict=True)], schema=_COUNTS)

        for b in batches:
            for _, stream, begin, words, _, lead in _streams(*utf8(b.column(0)), depth):
                for kind, keys in ((GRAM, ctw.grams(stream, begin, depth)[lead:]), (WORD, words)):
                    u, c = np.unique(keys, return_counts=True)
                    held[kind].append((u, c))
                    amount += len(u)
                if amount > HOLD_ROWS:
                    for kind, parts in held.items():
                        held[kind] = [ctw.merge_counts(*(np.concatenate(x) for x in zip(*parts, strict=True)))]
                    amount = sum(len(p[0][0]) for p in held.values())
                    if amount > HOLD_ROWS // 2:
                        yield from send()
        yield from send()

    return run


def _merge(key: tuple, pieces: pd.DataFrame) -> pd.DataFrame:
    keys = np.concatenate([np.frombuffer(x, np.uint64) for x in pieces["keys"]])
    counts = np.concatenate([np.frombuffer(x, np.int64) for x in pieces["counts"]])
    keys, counts = ctw.merge_counts(keys, counts)
    out = {"kind": [key[0]], "block": [key[1]], "keys": [keys.tobytes()], "counts": [counts.tobytes()], "tokens": [int(counts.sum())], "size": [len(keys)]}
    return pd.DataFrame(out)


_MERGED = "kind int, block int, keys binary, counts binary, tokens long, size long"


def _histogram(batches):
    for b in batches:
        for kind, counts in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True):
            c, n = np.unique(np.floor(8 * np.log2(np.frombuffer(counts, np.int64))).astype(np.int32), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), kind, np.int32)), pa.array(c), pa.array(n.astype(np.int64))], names=["kind", "step", "n"])


def _roots(depth: int):
    def run(batches):
        for b in batches:
            for keys, counts in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                found = ctw.Block(np.frombuffer(keys, np.uint64), np.frombuffer(counts, np.int64), depth).roots()
                level, ident, w, z, o = zip(*found, strict=True)
                short = [i & ((256 << v) - 1) for v, i in zip(level, ident, strict=True)]
                columns = [pa.array(level, pa.int32()), pa.array(short, pa.int64()), pa.array(w), pa.array(z), pa.array(o)]
                yield pa.RecordBatch.from_arrays(columns, names=["level", "ident", "w", "z", "o"])

    return run


def _frequent(depth: int, top, steps: dict[int, int]):
    """Of each block, the keys above the frequency step, with log probability (grams) or count (words)."""

    def run(batches):
        for b in batches:
            for kind, keys, counts in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                k, c = np.frombuffer(keys, np.uint64), np.frombuffer(counts, np.int64)
                often = np.floor(8 * np.log2(c)).astype(np.int32) >= steps[kind]
                if not often.any():
                    continue
                value = ctw.Block(k, c, depth).log_probabilities(k[often], top.value) if kind == GRAM else c[often].astype(np.float64)
                columns = [pa.array([kind], pa.int32()), pa.array([k[often].tobytes()], pa.binary()), pa.array([value.astype(np.float64).tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["kind", "keys", "values"])

    return run


_tables: dict = {}


def _table(shared, kind: int):
    """The broadcast arrays as a hash table, built once in a worker."""
    key = (shared.value[0], kind)
    if key not in _tables:
        for old in [k for k in _tables if k[0] != key[0]]:
            del _tables[old]
        keys, values = shared.value[1][kind]
        _tables[key] = (ctw.Table(keys), values)
    return _tables[key]


_SCORED = "rid long, doc_id {kind}, n_tokens long, n_bytes long, n_known long, base double, ln_p double, rare binary, rare_n binary, rare_kind binary"


def _score(depth: int, shared, tokens: int, distinct: int):
    def run(batches):
        rid = TaskContext.get().partitionId() << 40
        low = np.log10(tokens + distinct + 1.0)
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                s = b.slice(at, 1024)
                raw, offsets = utf8(s.column(1))
                n = len(offsets) - 1
                out = {"n": np.zeros(n, np.int64), "bytes": np.zeros(n, np.int64), "known": np.zeros(n, np.int64), "base": np.zeros(n), "ln": np.zeros(n)}
                rare: list = [(b"", b"", b"")] * n
                for i, stream, begin, words, first, lead in _streams(raw, offsets, depth):
                    m = len(begin) - 1
                    left = []
                    grams = ctw.grams(stream, begin, depth)[lead:]
                    begin = np.maximum(begin - lead, 0)
                    out["bytes"][i : i + m] += np.diff(begin)
                    for kind, keys, edge in ((GRAM, grams, begin), (WORD, words, first)):
                        text = np.repeat(np.arange(m), np.diff(edge))
                        table, values = _table(shared, kind)
                        row = table.find(keys)
                        there = row >= 0
                        value = np.where(there, values[np.maximum(row, 0)] if len(values) else 0.0, 0.0)
                        if kind == GRAM:
                            out["ln"][i : i + m] += np.bincount(text, value, m)
                        else:
                            out["n"][i : i + m] += np.diff(edge)
                            out["known"][i : i + m] += np.bincount(text[there], minlength=m)
                            out["base"][i : i + m] += np.bincount(text, np.where(there, np.log10(value + 1) - low, 0.0), m)
                        miss = np.flatnonzero(~there)
                        left.append((text[miss], keys[miss], np.full(len(miss), kind, np.uint8)))
                    t, k, kinds = (np.concatenate(x) for x in zip(*left, strict=True))
                    if len(t):
                        order = np.lexsort((k, kinds, t))
                        t, k, kinds = t[order], k[order], kinds[order]
                        new = np.concatenate(([True], (t[1:] != t[:-1]) | (k[1:] != k[:-1]) | (kinds[1:] != kinds[:-1])))
                        head = np.flatnonzero(new)
                        times = np.diff(np.append(head, len(t))).astype(np.int32)
                        for d, a, z in _spans(t[head]):
                            found = (k[head[a:z]].tobytes(), times[a:z].tobytes(), kinds[head[a:z]].tobytes())
                            rare[i + d] = tuple(x + y for x, y in zip(rare[i + d], found, strict=True))
                keys, times, kinds = zip(*rare, strict=True)
                columns = [pa.array(np.arange(rid, rid + n)), s.column(0), pa.array(out["n"]), pa.array(out["bytes"]), pa.array(out["known"]), pa.array(out["base"]), pa.array(out["ln"]),
                           pa.array(keys, pa.binary()), pa.array(times, pa.binary()), pa.array(kinds, pa.binary())]
                rid += n
                yield pa.RecordBatch.from_arrays(columns, names=["rid", "doc_id", "n_tokens", "n_bytes", "n_known", "base", "ln_p", "rare", "rare_n", "rare_kind"])

    return run


def _spans(sorted_ids: np.ndarray):
    edge = np.flatnonzero(np.concatenate(([True], sorted_ids[1:] != sorted_ids[:-1], [True])))
    for a, z in zip(edge[:-1], edge[1:], strict=True):
        yield int(sorted_ids[a]), int(a), int(z)


def _send_rare(blocks: int):
    """(rid, rare keys) -> for each block of a batch its (keys, rids, times)."""

    def run(batches):
        for b in batches:
            rids, rows = b.column(0).to_numpy(), []
            parts = [(np.frombuffer(k, np.uint64), np.frombuffer(n, np.int32), np.frombuffer(t, np.uint8)) for k, n, t in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
            if not parts:
                continue
            keys, times, kinds = (np.concatenate(x) for x in zip(*parts, strict=True))
            rid = np.repeat(rids, [len(p[0]) for p in parts])
            for kind in (GRAM, WORD):
                at = kinds == kind
                rows += [(kind, k, x.tobytes(), r.tobytes(), t.tobytes()) for k, x, r, t in _split(kind, keys[at], blocks, rid[at], times[at])]
            if rows:
                types = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["kind", "block", "keys", "rids", "times"])

    return run


def _look_up(depth: int, top, tokens: int, distinct: int):
    def run(key: tuple, asked: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"rid": np.zeros(0, np.int64), "ln_p": np.zeros(0), "base": np.zeros(0), "known": np.zeros(0, np.int64)})
        if not len(asked):
            return empty
        kind = int(key[0])
        keys = np.concatenate([np.frombuffer(x, np.uint64) for x in asked["keys"]])
        rids = np.concatenate([np.frombuffer(x, np.int64) for x in asked["rids"]])
        times = np.concatenate([np.frombuffer(x, np.int32) for x in asked["times"]])
        held = np.frombuffer(block["keys"].iloc[0], np.uint64) if len(block) else np.zeros(0, np.uint64)
        counts = np.frombuffer(block["counts"].iloc[0], np.int64) if len(block) else np.zeros(0, np.int64)
        fresh, number = np.unique(keys, return_inverse=True)
        ln, base, known = np.zeros(len(keys)), np.zeros(len(keys)), np.zeros(len(keys), np.int64)
        if kind == GRAM:
            ln = ctw.Block(held, counts, depth).log_probabilities(fresh, top.value)[number] * times
        else:
            row = np.minimum(np.searchsorted(held, fresh), max(0, len(held) - 1))
            c = np.where(held[row] == fresh, counts[row], 0) if len(held) else np.zeros(len(fresh), np.int64)
            base = ((np.log10(c + 1.0) - np.log10(tokens + distinct + 1.0))[number]) * times
            known = np.where(c[number] > 0, times, 0).astype(np.int64)
        order = np.argsort(rids, kind="stable")
        head = np.flatnonzero(np.concatenate(([True], np.diff(rids[order]) != 0)))
        add = lambda x: np.add.reduceat(x[order], head)
        return pd.DataFrame({"rid": rids[order][head], "ln_p": add(ln), "base": add(base), "known": add(known)})

    return run


def lm_scores(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", depth: int = ctw.DEPTH, table_rows: int = TABLE_ROWS, blocks: int | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for every row of ``docs``;
    ``blocks`` follows the size of the training texts unless it is given."""
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    held = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))
    texts = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"), held.alias("held_out"))
    if blocks is None:
        size = texts.where("not held_out").agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        blocks = min(max(BLOCKS[0], size // BLOCK_BYTES), BLOCKS[1])
    counted = texts.where("not held_out").select("text").mapInArrow(_count(depth, blocks), "kind int, block int, keys binary, counts binary")
    merged = written(counted.groupBy("kind", "block").applyInPandas(_merge, _MERGED), "counts")
    totals = {r[0]: (r[1], r[2]) for r in merged.groupBy("kind").agg(F.sum("tokens"), F.sum("size")).collect()}
    tokens, distinct = totals.get(WORD, (0, 0))
    # at most 8 * 64 frequency steps for each kind
    steps_seen = merged.select("kind", "block", "keys", "counts").mapInArrow(_histogram, "kind int, step int, n long").groupBy("kind", "step").agg(F.sum("n")).collect()
    steps = {}
    for k in (GRAM, WORD):
        room, steps[k] = table_rows, 1 << 30
        for _, step, n in sorted((r for r in steps_seen if r[0] == k), key=lambda r: -r[1]):
            room -= n
            if room < 0:
                break
            steps[k] = step
    grams = merged.where(F.col("kind") == GRAM)
    # depth-one nodes: at most 256 * 255
    rooted = grams.select("kind", "block", "keys", "counts").mapInArrow(_roots(depth), "level int, ident long, w double, z double, o double")
    rooted = rooted.groupBy("level", "ident").agg(F.sum("w"), F.sum("z"), F.sum("o")).orderBy("level", "ident").collect()
    top = spark.sparkContext.broadcast(ctw.Top([tuple(r) for r in rooted]))
    often = merged.select("kind", "block", "keys", "counts").mapInArrow(_frequent(depth, top, steps), "kind int, keys binary, values binary").collect()
    arrays = {}
    for k in (GRAM, WORD):
        own = [r for r in often if r[0] == k]
        keys = np.concatenate([np.frombuffer(r[1], np.uint64) for r in own]) if own else np.zeros(0, np.uint64)
        arrays[k] = (keys, np.concatenate([np.frombuffer(r[2], np.float64) for r in own]) if own else np.zeros(0))
    shared = spark.sparkContext.broadcast((np.random.default_rng().integers(1 << 62), arrays))
    scored = written(texts.select("doc_id", "text").mapInArrow(_score(depth, shared, tokens, distinct), _SCORED.format(kind=kind)), "scores")
    asked = scored.where("octet_length(rare) > 0").select("rid", "rare", "rare_n", "rare_kind").mapInArrow(_send_rare(blocks), "kind int, block int, keys binary, rids binary, times binary")
    found = asked.groupBy("kind", "block").cogroup(merged.groupBy("kind", "block")).applyInPandas(_look_up(depth, top, tokens, distinct), "rid long, ln_p double, base double, known long")
    found = found.groupBy("rid").agg(F.sum("ln_p").alias("l"), F.sum("base").alias("b"), F.sum("known").alias("k"))
    joined = scored.select("rid", "doc_id", "n_tokens", "n_bytes", "n_known", "base", "ln_p").join(found, "rid", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return joined.select(
        "doc_id",
        F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False)).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + zero("k")).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + zero("b")).alias("base_score"),
        ((F.col("ln_p") + zero("l")) / LN10).alias("score"),
        (-(F.col("ln_p") + zero("l")) / np.log(2.0) / F.col("n_bytes")).alias("bits_per_byte"),
    )
