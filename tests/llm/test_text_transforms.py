"""Fill-in-the-middle, collocations and line deduplication against brute force, and their edge cases."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from repertoire.llm import collocations, fill_middle, line_dedup
from repertoire.llm.perfect_hash import PerfectHash

SCHEMA = "doc_id long, text string, lang string, n string, form string, rank string, id string, key string, n_lines string, `a.b` string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WHITE = "\x20\x09-\x0d"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "n", "f", "r", "i", "k", "l", "ab") for i, t, lang in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and ids, rows without an id, markers and white space of all kinds."""
    rng = random.Random(5)
    words = ["the", "of", "Über", "x", "<S", "<", "S>", "end.", "a;b", "été,", "İ", "\U0001f600", "\x00q", "no\x0bw", " "]
    lines = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 9))) for _ in range(40)]
    texts = [None, "", " \t\n", "one", "a <P> b", "<M>", "\n\n\n", "x" * 50_000, "Shared line of text\n\tshared LINE of text \nown"]
    texts += ["\n".join(rng.choice(lines) for _ in range(rng.randint(1, 12))) for _ in range(70)]
    rows = [(i, t, rng.choice(["en", "de", None, ""])) for i, t in enumerate(texts)]
    rows += [(9, texts[9], "en"), (10, "another text under a known id\n" + lines[0], "de"), (None, texts[12], "en"), (None, lines[1] + "\nonly here and nowhere else", "en")]
    return frame(spark, rows).cache()


def docs_of(df):
    return [(r.doc_id, r.text or "", r.lang) for r in df.collect()]


# fill-in-the-middle


def test_unit_ends_in_stretches():
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    splitter = Split(Regex(fill_middle.UNIT), behavior="isolated")
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice("ab \n\t\x0bé\U0001f600\x00") for _ in range(rng.randint(0, 60)))
        want = [m.end() for m in re.finditer(rf"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+", text)]
        for stretch in (1, 3, 7, 1000):
            assert fill_middle.unit_ends(text, splitter, stretch).tolist() == want


def by_hand(doc_id, text):
    units = re.findall(rf"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+", text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if text == "" or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_matches_by_hand(odd):
    out = fill_middle.fill_in_middle(odd.withColumn("clash", F.lit(1)))
    assert out.columns == ["doc_id", "text", "lang", "rank", "id", "key", "n_lines", "a.b", "clash", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = out.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == odd.count() and {r.form for r in got} == {"plain", "spm", "psm"}
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == by_hand(r.doc_id, r.text or "")
        assert r.back == (r.text or "")


def test_fill_in_middle_report_and_empty_table(odd):
    r = fill_middle.fim_report(odd.where("doc_id = 3")).first()
    assert r.restored_sha256 == hashlib.sha256(b"one").hexdigest()
    assert fill_middle.fim_report(odd.limit(0)).count() == 0


# collocations


def pieces_of(text):
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", text.translate(LOWER))]


def brute_collocations(docs, least, top, depth=4, subsumed=80):
    counts, total = collections.defaultdict(collections.Counter), collections.Counter()
    for _, text, lang in docs:
        lang = "und" if lang is None else lang
        for words in pieces_of(text):
            total[lang] += len(words)
            for i in range(len(words)):
                for k in range(1, min(depth, len(words) - i) + 1):
                    counts[lang][tuple(words[i : i + k])] += 1
    out = {}
    for lang, found in counts.items():
        some = {p: f for p, f in found.items() if len(p) > 1 and f >= least}
        rows = []
        for p, a in some.items():
            if any(len(q) > len(p) and 100 * f >= subsumed * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, f in some.items()):
                continue
            score, _, x, y = min((2000000 * a // (found[p[:i]] + found[p[i:]]), i, found[p[:i]], found[p[i:]]) for i in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), x, y))
        for rank, (score, a, p, x, y) in enumerate(sorted(rows)[:top], 1):
            out[lang, rank] = (p.decode(), -a, x, y, total[lang], -score)
    return out


def test_automaton_counts_all_phrases():
    rng = np.random.default_rng(2)
    for depth in (1, 2, 3, 4, 5):
        for _ in range(60):
            codes = rng.integers(0, rng.integers(1, 5), rng.integers(0, 40))
            gap, breaks, counted = rng.random(len(codes)) < 0.1, rng.random(len(codes)) < 0.1, rng.random(len(codes)) < 0.8
            reach = collocations._reach(gap, breaks)
            auto = collocations.SuffixAutomaton(codes, reach, counted, depth)
            ends = collections.defaultdict(list)
            for p in range(len(codes)):
                for k in range(0 if reach[p] else 1, min(depth, reach[p]) + 1):
                    ends[tuple(codes[p - k + 1 : p + 1])].append(p)
            want = {s: int(counted[e].sum()) for s, e in ends.items() if counted[e].any()}
            got = {tuple(codes[e - k + 1 : e + 1]) if k else (): c for e, k, c in zip(*auto.phrases(), strict=True)}
            assert got == want
            # one state for each set of end positions, and links to the longest suffix that ends at more places
            assert len(auto.length) == 1 + len({tuple(e) for s, e in ends.items() if s})
            for k, link, end in zip(auto.length, auto.link, auto.end, strict=True):
                if k:
                    s = tuple(codes[end - k + 1 : end + 1])
                    up = next(s[i:] for i in range(1, k + 1) if i == k or ends[s[i:]] != ends[s])
                    assert auto.length[link] == len(up)


@pytest.mark.parametrize("shard_bytes", [40, 700, 1 << 20])
def test_collocations_match_brute_force(odd, shard_bytes):
    got = {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in collocations.collocations(odd, least=3, top=40, shard_bytes=shard_bytes).collect()}
    want = brute_collocations(docs_of(odd), 3, 40)
    assert got == want and len(got) > 60


def test_a_full_filter_only_costs_time(odd, monkeypatch):
    monkeypatch.setattr(collocations, "MOST_BITS", 8)
    got = {(r.lang, r["rank"]): r.phrase for r in collocations.collocations(odd, least=3, top=40).collect()}
    assert got == {k: v[0] for k, v in brute_collocations(docs_of(odd), 3, 40).items()}


def test_collocations_of_nothing(odd, spark):
    assert collocations.collocations(odd.limit(0)).count() == 0
    assert collocations.collocations(frame(spark, [(1, None, None), (2, " . ", "en")]), least=1).count() == 0


def test_products_beyond_64_bits(spark):
    counts = spark.createDataFrame([("en", "", 0, 9 * 10**18), ("en", "a", 1, 8 * 10**18), ("en", "b", 1, 10**18), ("en", "a b", 2, 9 * 10**17)], "lang string, phrase string, words int, n long")
    r = collocations.ranked_phrases(counts).first()
    assert (r.score, r.l, r.r) == (2000000 * 9 * 10**17 // (9 * 10**18), 8 * 10**18, 10**18)


# lines


def brute_lines(docs, least=10):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    rank = lambda i: (i is None, i or 0)
    holders = collections.defaultdict(set)
    for i, text, _ in docs:
        for line in text.split("\n"):
            if len(key(line)) >= least:
                holders[key(line)].add(i)
    keeper = {k: min(h, key=rank) for k, h in holders.items() if len(h) > 1}
    out = collections.Counter()
    for i, text, _ in docs:
        lines = text.split("\n")
        kept = [x for x in lines if key(x) not in keeper or keeper[key(x)] == i]
        out[i, "\n".join(kept), len(lines), len(lines) - len(kept)] += 1
    return out


@pytest.mark.parametrize("near", [0, 7, 1 << 20])
def test_lines_match_brute_force(odd, near, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 8)
    out = line_dedup.line_dedup(odd, near_keys=near)
    assert out.columns == ["doc_id", "text", "lang", "n", "form", "rank", "id", "key", "a.b", "n_lines", "n_dropped"]
    got = out.collect()
    assert collections.Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got) == brute_lines(docs_of(odd))
    assert sum(r.n_dropped for r in got) > 100


def test_lines_of_nothing_and_ids_that_are_no_integers(odd):
    assert line_dedup.line_report(odd.limit(0)).count() == 0
    with pytest.raises(TypeError):
        line_dedup.line_dedup(odd.withColumn("doc_id", F.col("doc_id").cast("string")))


def test_perfect_hash_is_a_bijection():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 63, 1000, 30_000):
        keys = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        f = PerfectHash.frombytes(PerfectHash.build(keys).tobytes())
        assert sorted(f(keys).tolist()) == list(range(len(keys)))
        assert (f(keys ^ np.uint64(1 << 63)) < max(1, len(keys))).all()


def test_shard_keeps_keys_that_share_half_of_their_hash():
    h, g = np.array([5, 5, 9, 5], np.uint64), np.array([1, 2, 3, 7], np.uint64)
    made = line_dedup.Shard.build(h, g, np.array([2, 3, 400, 5]), np.array([-10, 20, 30, 40]))
    back = line_dedup.Shard.of_row(*made.row())
    count, owner = back.probe(np.array([5, 5, 9, 5, 5, 8], np.uint64), np.array([1, 2, 3, 7, 3, 3], np.uint64))
    assert count.tolist() == [2, 3, 400, 5, 0, 0] and owner[:4].tolist() == [-10, 20, 30, 40]
