r"""Phrase collocations from generalised suffix automata.

Texts are lower-cased (A-Z), split at ``[.,;:!?\x0A-\x0D]`` into pieces and these into words ``[^\x20\x09]+``. Everything
is counted for each language. A phrase of two to ``DEPTH`` words with at least ``LEAST`` occurrences is a candidate;
of its cuts into two parts with l and r occurrences, the one with the lowest score floor(2000000 a / (l + r))
counts. A candidate goes if one longer by a word, which holds it, has at least 80 % of its occurrences: counts
never rise with length, so a longer one that has them passes through one that is longer by a word.

Every task builds automata of its shards, runs of texts of one language: a state is a class of phrases that end at the
same places, its suffix link the class of the longest phrase that ends at more places. States of bounded depth are the
nodes of the compacted tree of the reversed texts, so they are built by sorting, with links and counts of end positions,
and enumerate all phrases of up to ``DEPTH`` words with their counts; the root counts all words. Spark adds up the
counts of all shards. Whatever a candidate drops by a word at its front is its suffix link, and at its end its
prefix: these two maxima over the counted table decide subsumption.

Rare phrases are most of what a shard holds. Words and pairs of a candidate occur as often as it, so one pass before
counts hashes of words and pairs, and those with too few occurrences end a run of words; a second one counts
hashes of the longer phrases of these runs. The filters of the others are bit sets of bounded size, which let
through more where they are full; exact counts of the phrases themselves decide after them.

Defined results: a null text is empty, a null language ``und``; repeated rows count again; ids are not used; a text
of any length is cut between words, with the ``DEPTH - 1`` words before the cut as context that is not counted again;
an empty table gives no rows. Arithmetic is decimal beyond 64 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repertoire.llm._shared import ship, written
from repertoire.llm._text import LOWER, mix64

DEPTH, LEAST, SUBSUMED, TOP = 4, 30, 80, 2000
ENDS = b".,;:!?\n\v\f\r"
_TABLE = bytes(ord(";") if c in ENDS else LOWER[c] for c in range(256))
#: Bytes of a shard; keys that a task holds before it sends them; keys of a block of the filter, before merging.
SHARD_BYTES, HOLD_KEYS, BLOCK_KEYS = 2 << 20, 1 << 20, 4_000_000
#: Bits of the filter: at least, at most, and for each key that can be frequent.
LEAST_BITS, MOST_BITS, KEY_BITS = 20, 27, 8
#: Hash of a pair's first word.
_FIRST = np.uint64(0x9E3779B97F4A7C15)


class SuffixAutomaton:
    """States of the phrases of up to ``depth`` words of a sequence, with ``length`` (of the longest phrase), ``link``,
    ``count`` (of counted end positions) and ``end`` (one of them).

    ``codes`` are word numbers; a phrase does not cross a position where ``reach``, the number of words up to and with
    the position that it may hold, starts again at 1; positions of reach 0 hold no word. State 0 is the root.
    """

    __slots__ = ("length", "link", "count", "end")

    def __init__(self, codes: np.ndarray, reach: np.ndarray, counted: np.ndarray, depth: int = DEPTH):
        reach = np.minimum(reach, depth)
        at = np.flatnonzero(reach > 0)
        # rank of the last 1, 2, 4, ... words, read backwards; what lies beyond the reach ranks as 0
        rank, span = np.where(reach > 0, codes.astype(np.int64) + 1, 0), 1
        while span < depth:
            before = np.zeros(len(rank), np.int64)
            before[span:] = rank[:-span]
            before[reach <= span] = 0
            # a rank of span words that was cut short stays within the reach: reach - span words are left there
            _, rank = np.unique(rank * (int(rank.max(initial=0)) + 1) + before, return_inverse=True)
            rank, span = rank + 1, 2 * span
        order = at[np.argsort(rank[at], kind="stable")]
        n, r = len(order), reach[order]
        same = np.ones(n, bool)  # the first k words are those of the entry before
        if n:
            same[0] = False
        first = []
        for k in range(1, depth + 1):
            back = np.where(r >= k, codes[order - np.minimum(k - 1, order)], -1)
            same = same & (back == np.concatenate(([-1], back[:-1]))) & (r >= k) & (np.concatenate(([0], r[:-1])) >= k)
            first.append((r >= k) & ~same)
        weight = counted[order].astype(np.int64)
        length, link, count, end = [np.zeros(1, np.int64)], [np.full(1, -1)], [np.array([weight.sum()])], [np.full(1, -1)]
        above, states = np.zeros(n, np.int64), 1  # the state above each entry
        for k in range(1, depth + 1):
            inside = np.flatnonzero(r >= k)
            if not len(inside):
                break
            group = np.cumsum(first[k - 1])[inside] - 1
            groups = int(group[-1]) + 1
            start = inside[np.flatnonzero(np.diff(group, prepend=-1))]
            if k < depth:  # one way on, and no place where the phrase cannot go on: the longer phrase has its places
                deeper = np.bincount(group, weights=first[k][inside], minlength=groups)
                stops = np.bincount(group, weights=r[inside] == k, minlength=groups)
                state = ~((deeper == 1) & (stops == 0))
            else:
                state = np.ones(groups, bool)
            number = np.where(state, states + np.cumsum(state) - 1, -1)
            length.append(np.full(int(state.sum()), k))
            link.append(above[start[state]])
            count.append(np.bincount(group, weights=weight[inside], minlength=groups).astype(np.int64)[state])
            end.append(order[start[state]])
            own = number[group]
            above[inside] = np.where(own >= 0, own, above[inside])
            states += int(state.sum())
        self.length, self.link, self.count, self.end = (np.concatenate(x).astype(np.int64) for x in (length, link, count, end))

    def phrases(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(end, words, count) of every phrase: of a state, those longer than its link's."""
        shortest = np.where(self.link >= 0, self.length[self.link] + 1, 0)
        each = self.length - shortest + 1
        state = np.repeat(np.arange(len(each)), each)
        words = np.arange(len(state)) - np.repeat(np.cumsum(each) - each, each) + shortest[state]
        some = self.count[state] > 0
        return self.end[state][some], words[some], self.count[state][some]


def _stretches(text: bytes, size: int, context: int) -> Iterator[tuple[bytes, int]]:
    """The text in parts of about ``size`` bytes that end between words; each begins with the last ``context`` words
    (or ends of pieces) of the one before, and says how many these are."""
    at, before = 0, b""
    while at < len(text):
        to = min(at + size, len(text))
        if to < len(text):
            to = text.rfind(b" ", at, to) + 1 or text.find(b" ", to) + 1 or len(text)
        part = before + text[at:to]
        yield part, len(before.split())
        before, at = b"".join(w + b" " for w in part.rsplit(None, context)[-context:]), to


def _shards(batches, size: int, depth: int) -> Iterator[tuple[str, list[bytes], np.ndarray]]:
    """(language, tokens with ``;`` between pieces, whether a position is counted) of runs of texts of a language."""
    held: dict[str, list] = {}
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            raw = text.as_buffer().to_pybytes().translate(_TABLE).replace(b"\t", b" ").replace(b";", b" ; ")
            for part, lead in _stretches(raw, size, depth - 1):
                tokens = part.split()
                counted = np.ones(len(tokens) + 1, bool)
                counted[:lead] = False
                counted[-1] = False
                tokens.append(b";")
                own = held.setdefault(lang, [[], [], 0])
                own[0] += tokens
                own[1].append(counted)
                own[2] += len(part)
                if own[2] >= size:
                    yield lang, own[0], np.concatenate(own[1])
                    del held[lang]
    for lang, own in held.items():
        yield lang, own[0], np.concatenate(own[1])


def _coded(lang: str, tokens: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """(words, codes, reach, hash of each word): words by number; reach counts the words of the piece so far."""
    packed = pa.array(tokens, pa.binary()).dictionary_encode()
    words, codes = packed.dictionary.to_pylist(), packed.indices.to_numpy().astype(np.int64)
    word = np.ones(len(words), bool)
    if b";" in words:
        word[words.index(b";")] = False
    hashes = mix64(pd.util.hash_array(np.array(words, object), categorize=False) ^ pd.util.hash_array(np.array([lang], object))[0]) if words else np.zeros(0, np.uint64)
    return words, codes, _reach(~word[codes], np.zeros(len(codes), bool)), hashes


def _reach(gap: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """Words since the last gap, or since a break, which lies before its position."""
    at = np.arange(len(gap))
    start = np.maximum.accumulate(np.where(gap, at + 1, np.where(breaks, at, 0))) if len(gap) else at
    return np.where(gap, 0, at - start + 1)


def _spans(hashes: np.ndarray, codes: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """(words, hashes) of the phrases of 1 to ``most`` words that end at each position (any value where there is none)."""
    h = hashes[codes]
    found = h
    yield 1, found
    for words in range(2, most + 1):
        found = mix64(np.concatenate((h[:1], found[:-1])) * _FIRST + h)
        yield words, found


_KEYS = pa.schema([("block", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


def _count_keys(blocks: int, least: int, shard_bytes: int, spans: range, near=None, hold: int = HOLD_KEYS):
    """Counts, up to ``least``, of the hashes of phrases of so many words, by block; of those whose words and pairs are in
    ``near`` if it is given. A block is the low bits of its hashes, which go on as their upper halves."""
    kind = np.min_scalar_type(least)

    def send(keys, counts):
        block = (keys % np.uint64(blocks)).astype(np.int32)
        order = np.argsort(block, kind="stable")
        edges = np.flatnonzero(np.diff(block[order], prepend=-1)).tolist() + [len(order)]
        short, few = (keys >> np.uint64(32)).astype(np.uint32)[order], np.minimum(counts, least).astype(kind)[order]
        rows = [(int(block[order[a]]), short[a:z].tobytes(), few[a:z].tobytes()) for a, z in pairwise(edges)]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _KEYS, strict=True)], schema=_KEYS)

    def run(batches):
        parts, amount = [], 0
        for lang, tokens, counted in _shards(batches, shard_bytes, spans[-1]):
            _, codes, reach, hashes = _coded(lang, tokens)
            reach = _frequent_reach(near, codes, reach, hashes) if near is not None else reach
            for words, keys in _spans(hashes, codes, spans[-1]):
                keys = keys[counted & (reach >= words)] if words in spans else ()
                if len(keys):
                    u, c = np.unique(keys, return_counts=True)
                    parts.append((u, c))
                    amount += len(u)
            if amount > hold:
                parts = [_merged(parts)]
                amount = len(parts[0][0])
                if amount > hold // 2:
                    yield send(*parts[0])
                    parts, amount = [], 0
        if parts:
            yield send(*_merged(parts))

    return run


def _bits_of(least: int, size: int):
    """The bit set of a block's frequent keys, ``size`` bits."""

    def build(key: tuple, pieces: pd.DataFrame) -> pd.DataFrame:
        kind = np.min_scalar_type(least)
        keys, counts = _merged([(np.frombuffer(k, np.uint32), np.frombuffer(c, kind).astype(np.int64)) for k, c in zip(pieces["keys"], pieces["counts"], strict=True)])
        bits = np.zeros(size, bool)
        for at in _places(keys[counts >= least], size):
            bits[at] = True
        return pd.DataFrame({"block": [key[0]], "bits": [np.packbits(bits).tobytes()]})

    return build


def _places(keys: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Two bits of a block for each key, the upper half of a hash."""
    for turn in (1, 2):
        yield (mix64(keys.astype(np.uint64) + np.uint64(turn << 32)) % np.uint64(size)).astype(np.int64)


def frequent_filter(texts: DataFrame, words: int, least: int, shard_bytes: int, spans: range, near=None):
    """A broadcast (size, bits): whether a phrase of so many words may have ``least`` occurrences."""
    log = min(MOST_BITS, max(LEAST_BITS, (2 * words // least * KEY_BITS).bit_length()))
    blocks = 1 << min(log - 8, max(0, (2 * words // BLOCK_KEYS).bit_length()))
    size = (1 << log) // blocks
    keys = texts.mapInArrow(_count_keys(blocks, least, shard_bytes, spans, near), "block int, keys binary, counts binary")
    found = keys.groupBy("block").applyInPandas(_bits_of(least, size), "block int, bits binary")
    bits = np.zeros((blocks, size // 8), np.uint8)
    for r in found.collect():  # at most 2 ** MOST_BITS bits in all
        bits[r[0]] = np.frombuffer(r[1], np.uint8)
    return texts.sparkSession.sparkContext.broadcast((blocks, size, bits))


def _may(near, keys: np.ndarray) -> np.ndarray:
    blocks, size, bits = near.value
    block = (keys % np.uint64(blocks)).astype(np.int64)
    out = np.ones(len(keys), bool)
    for at in _places(keys >> np.uint64(32), size):
        out &= (bits[block, at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
    return out


def _frequent_reach(near, codes: np.ndarray, reach: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The words of a run that ends at each position, where rare words are gaps and rare pairs break it."""
    rare = ~_may(near, hashes)[codes]
    apart = np.zeros(len(codes), bool)
    inside = np.flatnonzero(reach > 1)
    _, pairs = list(_spans(hashes, codes, 2))[1]
    apart[inside] = ~_may(near, pairs[inside])
    return _reach((reach == 0) | rare, apart)


_COUNTED = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("n", pa.int64())])


def _enumerate(near, longer, depth: int, shard_bytes: int):
    """(lang, phrase, words, n) of the phrases of each shard's automaton; '' of 0 words counts all words."""

    def run(batches):
        for lang, tokens, counted in _shards(batches, shard_bytes, depth):
            _, codes, reach, hashes = _coded(lang, tokens)
            total = int((counted & (reach > 0)).sum())
            if not total:
                continue
            found = SuffixAutomaton(codes, _frequent_reach(near, codes, reach, hashes), counted, depth)
            end, length, count = found.phrases()
            passed = length < 3
            for k, keys in _spans(hashes, codes, depth):
                if k > 2:
                    own = np.flatnonzero(length == k)
                    passed[own] = _may(longer, keys[end[own]])
            passed &= length > 0
            end, length, count = end[passed], length[passed], count[passed]
            text = [b" ".join(tokens[e - k + 1 : e + 1]).decode("utf-8", "replace") for e, k in zip(end.tolist(), length.tolist(), strict=True)]
            columns = [pa.array([lang] * (len(text) + 1), pa.string()), pa.array(["", *text], pa.string())]
            columns += [pa.array(np.append(0, length).astype(np.int32)), pa.array(np.append(total, count).astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, schema=_COUNTED)

    return run


def phrase_counts(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", depth: int = DEPTH, least: int = LEAST, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(lang, phrase, words, n): all phrases of up to ``depth`` words with at least ``least`` occurrences, and '' with the
    number of all words of the language."""
    ship(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    near = frequent_filter(texts, size // 6, least, shard_bytes, range(1, 3))
    longer = frequent_filter(texts, size // 6, least, shard_bytes, range(3, depth + 1), near) if depth > 2 else None
    found = texts.mapInArrow(_enumerate(near, longer, depth, shard_bytes), "lang string, phrase string, words int, n long")
    return found.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("words") == 0))


def _wide(c: str) -> Column:
    return F.col(c).cast("decimal(20,0)")


def collocations(
    docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", depth: int = DEPTH, least: int = LEAST, subsumed: int = SUBSUMED, top: int = TOP, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's first ``top`` phrases."""
    counts = written(phrase_counts(docs, text_col=text_col, lang_col=lang_col, depth=depth, least=least, shard_bytes=shard_bytes), "phrases")
    return ranked_phrases(counts, depth=depth, subsumed=subsumed, top=top)


def ranked_phrases(counts: DataFrame, *, depth: int = DEPTH, subsumed: int = SUBSUMED, top: int = TOP) -> DataFrame:
    """``collocations`` from a table of ``phrase_counts``."""
    candidates = counts.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"))
    prefix = F.substring_index("phrase", " ", -1)  # the last word; what stands before it is the prefix
    drop_last = F.substring(F.col("phrase"), F.lit(1), F.length("phrase") - F.length(prefix) - 1)
    suffix_link = F.substring(F.col("phrase"), F.length(F.substring_index("phrase", " ", 1)) + 2, F.length("phrase"))
    held = candidates.where("words > 2").select("lang", F.explode(F.array(suffix_link, drop_last)).alias("phrase"), "a")
    held = held.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = candidates.join(held, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (_wide("longer") * 100 < _wide("a") * subsumed))
    cuts = left.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("cut"))
    one = F.expr("substring_index(phrase, ' ', cut)")
    cuts = cuts.select("lang", "phrase", "a", "cut", one.alias("one"), F.substring(F.col("phrase"), F.length(one) + 2, F.length("phrase")).alias("two"))
    parts = counts.where("words between 1 and " + str(depth - 1))
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("one"), F.col("n").alias("l")), ["lang", "one"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("two"), F.col("n").alias("r")), ["lang", "two"])
    score = F.expr("(cast(a as decimal(20,0)) * cast(2000000 as decimal(7,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    lowest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("c"))
    ranked = lowest.select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    # first of parts of a language, then of these, so that no task sorts all phrases of a language
    parts_of = max(1, math.isqrt(counts.count() // max(1, top)))
    order = (F.desc("score"), F.desc("a"), "phrase")
    for by in (["lang", F.pmod(F.xxhash64("phrase"), F.lit(parts_of))], ["lang"]):
        ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top)
    words = counts.where("words = 0").select("lang", "n")
    return ranked.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
