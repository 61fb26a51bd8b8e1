r"""Fill-in-the-middle transformation.

A text is cut into units by a ``Split`` pre-tokenizer of the tokenizers library (no vocabulary, no training):
the matches of a regular expression, isolated, with their offsets in code points. The number of offsets is n;
two ranks of units, drawn by a hash of the document's id, name the offsets at which the prefix and the middle
end. Spark then builds the output from the slices, so a text is never copied by Python.

Texts are pre-tokenized in stretches of ``STRETCH`` code points; the last unit of a stretch may go on, so
it begins the next one, and a unit that fills a stretch makes the next stretch twice as long. Memory is thus
eight bytes a unit plus one stretch.

Defined results: a null text is empty; an empty text, and one that holds a marker, stays plain; a
null id is hashed as the empty string; repeated rows with one id are cut at the same ranks; an empty table gives no rows;
input columns named like an output column are replaced. Formats are undone exactly: no marker begins inside
another, and texts that hold one stay plain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repertoire.llm._shared import quoted, ship, text_or_empty, without

#: White space and the word behind it, or white space that no word follows.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Per cent of the texts that are transformed, and of these the per cent in order suffix, prefix, middle.
RATE, SPM_RATE = 50, 80
SEED = 42
#: Code points given to the pre-tokenizer at once.
STRETCH = 1 << 18


def unit_ends(text: str, splitter, stretch: int = STRETCH) -> np.ndarray:
    """The offset, in code points, at which each unit of ``text`` ends."""
    parts, at, size = [], 0, stretch
    while at < len(text):
        piece = text[at : at + size]
        ends = np.fromiter((end for _, (_, end) in splitter.pre_tokenize_str(piece)), np.int64)
        last = at + len(piece) == len(text)
        if not last and len(ends) == 1:
            size *= 2
            continue
        ends = ends if last else ends[:-1]
        parts.append(ends + at)
        at, size = at + int(ends[-1]), stretch
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _cuts(pattern: str):
    @F.pandas_udf("n long, first long, second long")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        from tokenizers import Regex
        from tokenizers.pre_tokenizers import Split

        splitter = Split(Regex(pattern), behavior="isolated")
        for texts, h1, h2 in batches:
            out = np.zeros((len(texts), 3), np.int64)
            for i, (text, a, b) in enumerate(zip(texts, h1, h2, strict=True)):
                ends = unit_ends(text, splitter)
                n = len(ends)
                ranks = sorted((a % (n + 1), b % (n + 1)))
                out[i] = n, *(ends[r - 1] if r else 0 for r in ranks)
            yield pd.DataFrame(out, columns=["n", "first", "second"])

    return cut


def _draw(id_col: str, seed: int, group: int) -> Column:
    """The group-th run of eight hex digits of the document's hash, as an unsigned number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * group - 7, 8), 16, 10).cast("long")


def fill_in_middle(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", pattern: str = UNIT, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE
) -> DataFrame:
    """All columns of ``docs`` plus ``n`` (units), ``form`` (plain, psm or spm), ``prefix_chars``, ``middle_chars`` (null
    if plain) and ``output``, the formatted text. ``pattern`` must match every text from end to end."""
    ship(docs.sparkSession)
    docs = without(docs, "n", "form", "prefix_chars", "middle_chars", "output")
    text = text_or_empty(text_col)
    cut = _cuts(pattern)(text, _draw(id_col, seed, 1), _draw(id_col, seed, 2))
    marked = F.lit(False)
    for m in (PREFIX, SUFFIX, MIDDLE):
        marked |= F.contains(text, F.lit(m))
    plain = (text == "") | marked | (_draw(id_col, seed, 3) % 100 >= rate)
    form = F.when(plain, "plain").when(_draw(id_col, seed, 4) % 100 < spm_rate, "spm").otherwise("psm")
    row = docs.select(*quoted(docs), F.struct(cut.alias("c"), form.alias("form")).alias("__fim"))
    c = lambda name: F.col(f"__fim.c.{name}")
    form, first, length = F.col("__fim.form"), c("first"), c("second") - c("first")
    part = lambda start, size: F.substring(text, (start + 1).cast("int"), size.cast("int"))
    prefix, middle, suffix = part(F.lit(0), first), part(first, length), part(c("second"), F.length(text))
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    moved = form != "plain"
    return row.select(
        *quoted(docs),
        c("n").alias("n"),
        form.alias("form"),
        F.when(moved, first).alias("prefix_chars"),
        F.when(moved, length).alias("middle_chars"),
        F.when(form == "spm", spm).when(form == "psm", psm).otherwise(text).alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from."""
    head = F.substring_index(output, MIDDLE, 1)
    middle = F.substring(output, F.length(head) + 1 + len(MIDDLE), F.length(output))

    def parts(one: str, two: str) -> tuple[Column, Column]:
        a = F.substring_index(head, two, 1)
        return F.substring(a, F.lit(1 + len(one)), F.length(a)), F.substring(head, F.length(a) + 1 + len(two), F.length(head))

    suffix, prefix = parts(SUFFIX, PREFIX)
    p, s = parts(PREFIX, SUFFIX)
    return F.when(form == "spm", F.concat(prefix, middle, suffix)).when(form == "psm", F.concat(p, middle, s)).otherwise(output)


def fim_report(docs: DataFrame) -> DataFrame:
    """The query's columns: sizes and digests of the output and of the text rebuilt from it."""
    out = fill_in_middle(docs.select("doc_id", "text"))
    return out.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
