r"""Document quality by a linear-chain conditional random field over lines.

Every line (between ``\n``) is good or bad. Its emission sums weights of binned line features - shares
of letters, capitals, digits, symbols, stops, blanks and distinct, repeated or capitalised words, the
lengths of line and words, its ending, whether it repeats in the document - of the line itself and of
the lines before and after it. Forward-backward over the document gives each line's marginal; their
mean, weighted with line lengths, is passed through a logistic calibration and is the score.

The field is trained on a bounded sample of labelled documents (``TRAIN_DOCS`` rows of each label, the
first by a hash of the id), whose lines all take the document's label. Only rows whose
crc32(doc_id as text) mod 5 is not 0 are learnt from. Scoring reads every whole text.

Defined results: null or empty text is one empty line and gets the score that such a line gets; null
labels are ignored, equal ids in the labels count once (the lowest label); without any label of one
kind every score is 0.5 (or the single label's side: 0 or 1); an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repertoire.llm._shared import bounded, quoted, ship, text_or_empty, written
from repertoire.llm._text import NOT_SPACE, Words, chunks, mix64, utf8

#: Labelled documents of each label that the field is fitted on, at most.
TRAIN_DOCS = 1500
THRESHOLD = 0.3
FOLDS = 5

_EDGES = np.array([0.001, 0.01, 0.03, 0.06, 0.1, 0.15, 0.22, 0.35, 0.5, 0.7, 0.85, 0.95])
FEATURES, BINS = 14, len(_EDGES) + 1


def _class(members: bytes, more: slice | None = None) -> np.ndarray:
    out = np.zeros(256, dtype=np.int64)
    out[list(members)] = 1
    if more is not None:
        out[more] = 1
    return out


_UPPER = _class(bytes(range(65, 91)))
_LETTER = _class(bytes(range(65, 91)) + bytes(range(97, 123)), slice(128, 256))
_DIGIT = _class(b"0123456789")
_SYMBOL = _class(b"#$%&*|@^~<>{}[]\\=+_!/\"")
_STOP = _class(b".,;:?'")
_BLANK = _class(b" \t\r\x0b\x0c")


def _lines(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first line of each text)."""
    breaks = np.flatnonzero(raw == 10)
    key = np.sort(np.concatenate((offsets[1:] * 2, breaks * 2 + 1)))
    ends, broken = key >> 1, key & 1
    starts = np.concatenate(([0], (ends + broken)[:-1]))
    inside = np.searchsorted(breaks, offsets)
    first = inside + np.arange(len(offsets))
    return starts, ends, first


def line_bins(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bins of each line and feature, line lengths in bytes, first line of each text)."""
    starts, ends, first = _lines(raw, offsets)
    n = np.maximum(ends - starts, 1).astype(float)

    def total(table: np.ndarray) -> np.ndarray:
        upto = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(table[raw], out=upto[1:])
        return (upto[ends] - upto[starts]).astype(float)

    letters = total(_LETTER)
    w = Words(raw, offsets, NOT_SPACE)
    line = np.searchsorted(starts, w.start, "right") - 1
    count = len(starts)
    words = np.maximum(np.bincount(line, minlength=count), 1).astype(float)
    again = np.zeros(len(w.hash), bool)
    if len(w.hash) > 1:
        again[1:] = (w.hash[1:] == w.hash[:-1]) & (line[1:] == line[:-1])
    by_line = np.unique(mix64(line.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ w.hash, return_index=True)[1]
    distinct = np.bincount(line[by_line], minlength=count)
    capital = np.bincount(line[_UPPER[raw[w.start]] > 0], minlength=count) if len(line) else np.zeros(count)
    odd_end = np.bincount(line[_SYMBOL[raw[w.end - 1]] > 0], minlength=count) if len(line) else np.zeros(count)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    content = np.zeros(count, np.uint64)
    np.add.at(content, line, mix64(w.hash))
    same = mix64(content) ^ mix64(text.astype(np.uint64) + np.uint64(1))
    _, inverse, times = np.unique(same, return_inverse=True, return_counts=True)
    length = ends - starts
    last = np.where(length > 0, raw[np.maximum(ends - 1, 0)] if len(raw) else 0, 0)
    ending = np.where(length == 0, 0, np.where(np.isin(last, list(b".?!")), 1, np.where(_LETTER[last] > 0, 2, 3)))
    ratios = [
        letters / n, total(_UPPER) / np.maximum(letters, 1), total(_DIGIT) / n, total(_SYMBOL) / n, total(_STOP) / n, total(_BLANK) / n,
        distinct / words, np.bincount(line[again], minlength=count) / words, capital / words, odd_end / words,
    ]
    bins = np.empty((count, FEATURES), np.int16)
    for k, r in enumerate(ratios):
        bins[:, k] = np.searchsorted(_EDGES, r, "right")
    bins[:, 10] = np.minimum(np.log2(length + 1), BINS - 1)
    bins[:, 11] = np.minimum((n - total(_BLANK)) / words, BINS - 1)
    bins[:, 12] = ending
    bins[:, 13] = np.minimum(times[inverse] - 1, 3)
    return bins, np.maximum(length, 1), first


class Field:
    """A two-state linear chain: emissions of 'good' against 'bad', and transition scores."""

    def __init__(self, here: np.ndarray, before: np.ndarray, after: np.ndarray, bias: float, steps: np.ndarray, a: float = 1.0, b: float = 0.0):
        self.here, self.before, self.after, self.bias, self.steps, self.a, self.b = here, before, after, bias, steps, a, b

    @classmethod
    def zero(cls) -> Field:
        z = lambda: np.zeros((FEATURES, BINS))
        return cls(z(), z(), z(), 0.0, np.zeros((2, 2)))

    def emissions(self, bins: np.ndarray, first: np.ndarray) -> np.ndarray:
        # feature by feature: no array of lines times features is made
        e, prev, nxt = np.full(len(bins), self.bias), np.zeros(len(bins)), np.zeros(len(bins))
        for k in range(FEATURES):
            b = bins[:, k]
            e += self.here[k, b]
            prev += self.before[k, b]
            nxt += self.after[k, b]
        e[1:] += prev[:-1]
        e[:-1] += nxt[1:]
        begins, stops = first[:-1], first[1:] - 1
        e[begins[begins > 0]] -= prev[begins[begins > 0] - 1]
        inner = stops[stops < len(e) - 1]
        e[inner] -= nxt[inner + 1]
        return e

    def chain(self, e: np.ndarray, first: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(marginal of 'good' of each line, pair marginals summed over all texts with a weight for each).

        All texts advance together, longest first, so each step is one vector operation.
        """
        length = np.diff(first)
        order = np.argsort(-length, kind="stable")
        begin, length = first[:-1][order], length[order]
        steps = int(length[0]) if len(length) else 0
        active = np.searchsorted(-length, -np.arange(1, steps + 1), "right")
        fwd = np.zeros((len(e), 2))
        for t in range(steps):
            k = active[t]
            at = begin[:k] + t
            if t:
                x = fwd[at - 1][:, :, None] + self.steps
                fwd[at] = np.logaddexp(x[:, 0], x[:, 1])
            fwd[at, 1] += e[at]
        z = np.empty(len(length))
        stop = begin + length - 1
        z_sorted = np.logaddexp(fwd[stop, 0], fwd[stop, 1])
        z[order] = z_sorted
        back = np.zeros((len(e), 2))
        pairs = np.zeros((2, 2))
        for t in range(steps - 2, -1, -1):
            k = active[t + 1]
            at = begin[:k] + t
            nxt = back[at + 1].copy()
            nxt[:, 1] += e[at + 1]
            x = self.steps[None] + nxt[:, None, :]
            back[at] = np.logaddexp(x[:, :, 0], x[:, :, 1])
            if weight is not None:
                pairs += (np.exp(fwd[at][:, :, None] + x - z_sorted[:k, None, None]) * weight[order[:k], None, None]).sum(0)
        good = np.exp(np.minimum(fwd[:, 1] + back[:, 1] - np.repeat(z, np.diff(first)), 0.0))
        return good, pairs

    def quality(self, bins: np.ndarray, length: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Length-weighted mean marginal of each text."""
        good = self.chain(self.emissions(bins, first), first)[0]
        weight = np.add.reduceat(length.astype(float), first[:-1])
        return np.add.reduceat(good * length, first[:-1]) / weight

    def score(self, q: np.ndarray) -> np.ndarray:
        x = np.clip(q, 1e-6, 1 - 1e-6)
        return 1 / (1 + np.exp(-np.clip(self.a * np.log(x / (1 - x)) + self.b, -30, 30)))


def _gradient(bins: np.ndarray, first: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = np.ones(len(d), bool)
    inside[first[:-1]] = False
    out = [np.zeros((FEATURES, BINS)) for _ in range(3)]
    follow = np.flatnonzero(inside)
    for k in range(FEATURES):
        out[0][k] = np.bincount(bins[:, k], d, BINS)
        out[1][k] = np.bincount(bins[follow - 1, k], d[follow], BINS)
        out[2][k] = np.bincount(bins[follow, k], d[follow - 1], BINS)
    return tuple(out)


def fit(bins: np.ndarray, length: np.ndarray, first: np.ndarray, label: np.ndarray, *, rounds: int = 60, rate: float = 0.15, ridge: float = 1e-4) -> Field:
    """Penalised conditional likelihood by Adam; texts of either label weigh the same in all."""
    f = Field.zero()
    lines = np.diff(first)
    y = np.repeat(label.astype(float), lines)
    share = np.where(label == 1, 0.5 / max(1, (label == 1).sum()), 0.5 / max(1, (label == 0).sum()))
    per_line = np.repeat(share / lines, lines)  # long texts count like short ones
    stay = np.zeros((2, 2))
    for c in (0, 1):
        stay[c, c] = (share * (lines - 1) / lines)[label == c].sum()
    params = [f.here, f.before, f.after, np.zeros(1), f.steps]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for i in range(1, rounds + 1):
        f.bias = float(params[3][0])
        good, expected = f.chain(f.emissions(bins, first), first, share / lines)
        d = (y - good) * per_line
        grads = [*_gradient(bins, first, d), np.array([d.sum()]), stay - expected]
        for k, (p, g) in enumerate(zip(params, grads, strict=True)):
            g = g - ridge * p
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            p += rate * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.99**i)) + 1e-8)
    f.bias = float(params[3][0])
    q = np.clip(f.quality(bins, length, first), 1e-6, 1 - 1e-6)
    x = np.log(q / (1 - q))
    a, b = 1.0, 0.0
    for _ in range(25):  # Newton steps of the logistic calibration, with a pull towards the identity
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        r, w = (label - p) * share, p * (1 - p) * share + 1e-9
        g = np.array([(r * x).sum() - 1e-2 * (a - 1), r.sum() - 1e-2 * b])
        h = np.array([[(w * x * x).sum() + 1e-2, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-2]])
        step = np.linalg.solve(h, g)
        a, b = a + step[0], b + step[1]
    f.a, f.b = float(max(a, 1e-3)), float(b)
    return f


def _fold(id_col: str) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(FOLDS))


def _train(batches):
    bins, length, lines, label = [], [], [], []
    for b in batches:
        raw, offsets = utf8(b.column(0))
        for i, j, part, offs in chunks(raw, offsets):
            x, n, first = line_bins(part, offs)
            bins.append(x)
            length.append(n)
            lines.append(np.diff(first))
            label.append(np.asarray(b.column(1).to_pylist()[i:j]))
    if not bins:
        return
    first = np.concatenate(([0], np.cumsum(np.concatenate(lines))))
    f = fit(np.concatenate(bins), np.concatenate(length), first, np.concatenate(label))
    flat = np.concatenate([f.here.ravel(), f.before.ravel(), f.after.ravel(), [f.bias], f.steps.ravel(), [f.a, f.b]])
    yield pa.RecordBatch.from_arrays([pa.array([flat.tolist()], pa.list_(pa.float64()))], names=["w"])


def _unpack(w: list[float]) -> Field:
    x, n = np.asarray(w), FEATURES * BINS
    parts = [x[i * n : (i + 1) * n].reshape(FEATURES, BINS) for i in range(3)]
    rest = x[3 * n :]
    return Field(*parts, float(rest[0]), rest[1:5].reshape(2, 2), float(rest[5]), float(rest[6]))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", train_docs: int = TRAIN_DOCS) -> Field | float:
    """The fitted field; a constant score if the labels are all of one kind or none."""
    known = labels.where("quality in (0, 1)").groupBy(F.col("doc_id").alias(id_col)).agg(F.min("quality").alias("label"))
    known = known.where(_fold(id_col) != 0)
    some = None
    for kind in (0, 1):
        part = known.where(F.col("label") == kind).orderBy(F.xxhash64(F.lit(7), F.col(id_col)), id_col).limit(train_docs)
        some = part if some is None else some.unionAll(part)
    some = written(some, "training-ids")
    texts = docs.select(F.col(id_col), text_or_empty(text_col).alias("text")).join(F.broadcast(some), id_col)
    sample = written(texts.select("text", F.col("label").cast("int").alias("label"), F.col(id_col).alias("k")), "training-texts")
    kinds = [r[0] for r in sample.select("label").distinct().collect()]
    if len(kinds) < 2:
        return float(kinds[0]) if kinds else 0.5
    fitted = sample.orderBy("k", "text").coalesce(1).select("text", "label").mapInArrow(_train, "w array<double>").first()
    return _unpack(fitted.w)


def _score(field: Field | float):
    def score(batches):
        for b in batches:
            raw, offsets = utf8(b.column(1))
            out = np.empty(len(offsets) - 1)
            if isinstance(field, float):
                out[:] = field
            else:
                for i, j, part, offs in chunks(raw, offsets):
                    out[i:j] = field.score(field.quality(*line_bins(part, offs)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.clip(out, 0.0, 1.0))], names=["doc_id", "score"])

    return score


def quality_scores(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""
    ship(docs.sparkSession)
    field = train(docs, labels, id_col=id_col, text_col=text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(_score(field), f"doc_id {kind}, score double")
    return scored.select("doc_id", (F.coalesce(_fold("doc_id"), F.lit(-1)) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def quality_filter(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that the classifier rejects; columns as given."""
    bad = quality_scores(docs, labels, id_col=id_col, text_col=text_col).where("predicted = 0")
    bad = written(bad.select(F.col("doc_id").alias(id_col)).distinct(), "rejected")
    return docs.join(bounded(bad), id_col, "left_anti").select(*quoted(docs))
