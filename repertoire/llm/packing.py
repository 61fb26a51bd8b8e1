r"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of its documents in a seeded order. A round fills one window of ``window`` ids:
each queue is owed ``window`` times its target share, sends the whole ids of what it is owed, and carries
the rest, its deficit, into the next round. Documents are cut where a round ends, so that each full window
holds the target proportions, within two ids a queue. Queues of less than ``LEAST`` ids a window share one
queue, where their documents stand in seeded order, so at most ``window / LEAST`` queues take turns.

The deficits have a closed form, so no state passes from task to task. Shares hold for a phase, until the
first queue runs dry; then those left share its part in their proportions. In a phase of N ids in which
queue q sends n_q, and P_q is sent by queues before it, R_q(y) = y * P_q div N of the first y ids come from
these, and queue q has sent C_q(y) = R_{q+1}(y) - R_q(y): less than one id from what it is owed, and never
less than before. A document's place in its queue (a distributed running sum) thus gives its pieces.

The running sum is taken over range partitions of bounded size: sums inside each partition plus the sums
of the partitions before.

Ids are those of the ``tokenizers`` file, without special tokens, then an end id. The same merges are
applied through tiktoken, which is faster; texts with the string of a special token, and very long
ones, take the slower path.

Defined results: a null text is empty and gives the end id alone; a null source is the source '';
shares are normalised over the sources there are, one that is not named gets its share of all ids, and
one whose share is 0 is sent after all others have run dry; repeated rows are each packed; rows without
doc_id are packed like others; an empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import zlib
from fractions import Fraction
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repertoire.llm._shared import bounded, ship, text_or_empty, written

WINDOW = 2048
END_ID = 1
TOKENIZER = "byte_bpe_50k.json"
#: A queue that is owed fewer ids a window shares one queue with others like it.
LEAST = 4
#: Rows of a range partition of the running sum, and partitions beyond which these grow instead.
RANGE_ROWS, RANGES = 100_000, 20_000
#: Texts of more characters are left to the tokenizers library.
LONG_TEXT = 1_000_000


def _merges(path: str, pattern: str, encoding):
    """(strings of the special tokens, the file's merges as an ``encoding``)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"] for t in spec["added_tokens"]}
    # byte-level vocabularies name bytes by printable characters: the printable Latin-1 ones name themselves
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(b): b for b in plain}
    letter.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))})
    ranks = {bytes(letter[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return special, encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@cache
def _encoder(name: str):
    """text -> ids, for a tokenizer file given by path or by name among the public ones."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    path = name if os.path.isabs(name) else public_tokenizers.path(name)
    special, fast = _merges(path, public_tokenizers.PATTERN, tiktoken.Encoding)
    slow: list = []  # read only if a text needs it

    def encode(text: str) -> list[int]:
        if len(text) > LONG_TEXT or any(s in text for s in special):
            if not slow:
                slow.append(Tokenizer.from_file(path))
            return slow[0].encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def _tokenize(name: str, end_id: int):
    def run(batches):
        encode = _encoder(name)
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            # a few hundred texts at a time, so that ids of long texts do not pile up
            for at in range(0, b.num_rows, 512):
                s = b.slice(at, 512)
                ids, n = [], []
                for text in s.column(2).to_pylist():
                    x = encode(text)
                    x.append(end_id)
                    n.append(len(x))
                    ids.append(np.array(x, "<u2" if max(x) < 1 << 16 else "<u4").tobytes())
                rid = pa.array(np.arange(row, row + s.num_rows))
                row += s.num_rows
                yield pa.RecordBatch.from_arrays(
                    [rid, s.column(0), s.column(1), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], names=["rid", "doc_id", "queue", "n", "ids"]
                )

    return run


def tokenized(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """A written table (rid, doc_id, queue, n, ids), rid unique; ids are little-endian and unsigned, of 16 bits
    where all of a document fit."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("queue"), text_or_empty(text_col).alias("text"))
    return written(rows.mapInArrow(_tokenize(tokenizer, end_id), f"rid long, doc_id {kind}, queue string, n long, ids binary"), "tokens")


def running_sum(df: DataFrame, order: list[str], value: str, out: str, rows: int) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over all rows before, in the order of unique keys ``order``."""
    ranged = df.repartitionByRange(max(1, min(RANGES, -(-rows // RANGE_ROWS))), *order).withColumn("__p", F.spark_partition_id())
    ranged = written(ranged, "ranges")
    # one row for each range partition, at most RANGES
    parts = ranged.groupBy("__p").agg(F.sum(value).alias("__s"))
    starts = parts.select("__p", F.coalesce(F.sum("__s").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__o"))
    before = Window.partitionBy("__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn("__b", F.coalesce(F.sum(value).over(before), F.lit(0)))
    return summed.join(bounded(starts), "__p").withColumn(out, F.col("__o") + F.col("__b")).drop("__p", "__o", "__b")


def _part(a: np.ndarray, b: int, c: int, up: bool = False) -> np.ndarray:
    """a * b div c (rounded up on request) without overflow."""
    most = int(a.max()) if len(a) else 0
    if most * b + c < 1 << 63:
        x = a * b
        return -(-x // c) if up else x // c
    return np.array([-(-v * b // c) if up else v * b // c for v in a.tolist()], np.int64)


class Rounds:
    """All rounds in closed form, from the ids and integer weights of the queues.

    Phases: (first id, ids, and for each queue its ids sent before, ids to send, ids of queues before it).
    """

    def __init__(self, ids: list[int], weights: list[int], window: int = WINDOW):
        self.window, self.phases = window, []
        left, sent, at = list(ids), [0] * len(ids), 0
        while any(left):
            owed = weights if any(n and w for n, w in zip(left, weights, strict=True)) else left
            active = [q for q, n in enumerate(left) if n and owed[q]]
            dry = min(active, key=lambda q: Fraction(left[q], owed[q]))
            take = [left[dry] * owed[q] // owed[dry] if q in active else 0 for q in range(len(ids))]
            before = np.concatenate(([0], np.cumsum(np.array(take, object)))).tolist()
            self.phases.append((at, sum(take), list(sent), take, before))
            at += sum(take)
            left = [n - t for n, t in zip(left, take, strict=True)]
            sent = [n + t for n, t in zip(sent, take, strict=True)]

    def _sent(self, phase: tuple, q: int, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sent by queues before q, sent by q) of the first y ids of a phase."""
        _, total, _, _, before = phase
        low = _part(y, before[q], total)
        return low, _part(y, before[q + 1], total) - low

    def pieces(self, q: int, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """(document, start in it, length, place in the stream) of the documents that begin at ``first`` in queue q."""
        out = [np.zeros((4, 0), np.int64)]
        for phase in self.phases:
            begin, total, sent, take, _ = phase
            a, z = np.maximum(first - sent[q], 0), np.minimum(first + n - sent[q], take[q])
            doc = np.flatnonzero(a < z)
            if not len(doc):
                continue
            a, z = a[doc], z[doc]
            if q == 0:  # may send less than an id a round: the round of every id itself
                size = z - a
                each = np.repeat(np.arange(len(doc)), size)
                x = a[each] + np.arange(len(each)) - np.repeat(np.cumsum(size) - size, size)
                window = (begin + _part(x + 1, total, take[q], up=True) - 1) // self.window
                new = np.flatnonzero(np.concatenate(([True], (each[1:] != each[:-1]) | (window[1:] != window[:-1]))))
                each, window = each[new], window[new]
            else:
                low = (begin + _part(np.maximum(a - 1, 0), total, take[q])) // self.window
                high = (begin + np.minimum(_part(z + 1, total, take[q]), total - 1)) // self.window
                size = high - low + 1
                each = np.repeat(np.arange(len(doc)), size)
                window = low[each] + np.arange(len(each)) - np.repeat(np.cumsum(size) - size, size)
            y0 = np.clip(window * self.window - begin, 0, total)
            y1 = np.clip((window + 1) * self.window - begin, 0, total)
            (low0, own0), (low1, own1) = self._sent(phase, q, y0), self._sent(phase, q, y1)
            s, e = np.maximum(a[each], own0), np.minimum(z[each], own1)
            some = s < e
            each, s, e = each[some], s[some], e[some]
            place = begin + y0[some] + low1[some] - low0[some] + s - own0[some]
            out.append(np.stack([doc[each], s + sent[q] - first[doc[each]], e - s, place]))
        return tuple(np.concatenate(out, 1))


def queued(tokens: DataFrame, *, window: int = WINDOW, shares: dict[str, float] | None = None, seed: int = 5) -> tuple[DataFrame, Rounds]:
    """((rid, queue number, first), rounds): the place of each document in its queue. Queue 0 is shared by all
    sources that are owed less than ``LEAST`` ids a window, the last one by those of share 0."""
    totals = tokens.groupBy("queue").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    totals = written(totals, "queues")
    rows, total = totals.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    share = F.col("tokens") / F.lit(max(1, total))
    for name, wanted in (shares or {}).items():
        share = F.when(F.col("queue") == name, F.lit(float(wanted))).otherwise(share)
    weighed = totals.select("queue", "tokens", share.alias("share"))
    whole = weighed.agg(F.coalesce(F.sum("share"), F.lit(0.0))).first()[0] or 1.0
    own = F.col("share") * F.lit(float(window)) >= F.lit(LEAST * whole)
    large = weighed.where(own).orderBy("queue").collect()  # at most window / LEAST rows
    few = weighed.where(~own & (F.col("share") > 0)).agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("share"), F.lit(0.0))).first()
    last = weighed.where("share <= 0").agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    none = [n for n, w in (shares or {}).items() if not w > 0]
    exact = lambda tokens, share: tokens if shares is None else max(1, round(share / whole * 2**40))
    ids = [few[0], *(r.tokens for r in large), last]
    weights = [exact(*few), *(exact(r.tokens, r.share) for r in large), 0]
    numbers = tokens.sparkSession.createDataFrame([(r.queue, i) for i, r in enumerate(large, 1)] + [(n, len(large) + 1) for n in none], "queue string, q int")
    meta = tokens.select("rid", "queue", "n", F.xxhash64(F.lit(seed), "doc_id").alias("h"))
    meta = meta.join(F.broadcast(numbers), "queue", "left").select("rid", F.coalesce("q", F.lit(0)).alias("q"), "n", "h")
    summed = running_sum(meta, ["q", "h", "rid"], "n", "g", rows)
    first = F.element_at(F.array(*[F.lit(sum(ids[:i])).cast("long") for i in range(len(ids))]), F.col("q") + 1)
    return summed.select("rid", "q", (F.col("g") - first).alias("first")), Rounds(ids, weights, window)


_PIECES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def _cut(rounds: Rounds, with_ids: bool):
    def run(batches):
        for b in batches:
            n, queue, first = (b.column(i).to_numpy() for i in (1, 3, 4))
            found = []
            for q in np.unique(queue).tolist():
                own = np.flatnonzero(queue == q)
                doc, *rest = rounds.pieces(q, first[own], n[own])
                found.append(np.stack([own[doc], *rest]))
            doc, start, length, place = np.concatenate(found, 1) if found else np.zeros((4, 0), np.int64)
            ids = [np.frombuffer(x, "<u2" if len(x) == 2 * k else "<u4") for x, k in zip(b.column(2).to_pylist(), n.tolist(), strict=True)]
            cut = [ids[d][s : s + k].astype("<u4").tobytes() for d, s, k in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)]
            columns = [b.column(0).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array([zlib.crc32(c) for c in cut], pa.int64()),
                       pa.array(n[doc]), pa.array(place // rounds.window), pa.array(place % rounds.window)]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(cut, pa.binary())] if with_ids else []), names=_PIECES + (["ids"] if with_ids else []))

    return run


def packed(docs: DataFrame, *, window: int = WINDOW, with_ids: bool = False, shares: dict[str, float] | None = None, **options) -> DataFrame:
    """One row for each piece of a document; ``with_ids`` adds its ids (unsigned 32-bit, little-endian).
    ``shares`` are target shares of the sources (default: their shares of all ids)."""
    tokens = tokenized(docs, **options)
    places, rounds = queued(tokens, window=window, shares=shares)
    places = written(places, "places")
    placed = tokens.select("rid", "doc_id", "n", "ids").join(bounded(places), "rid").select("doc_id", "n", "ids", "q", "first")
    kind = tokens.schema["doc_id"].dataType.simpleString()
    schema = ", ".join([f"doc_id {kind}", *(f"{c} long" for c in _PIECES[1:]), *(["ids binary"] if with_ids else [])])
    return placed.mapInArrow(_cut(rounds, with_ids), schema)
