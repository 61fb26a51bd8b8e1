"""The corpus pipeline, stage by stage, against brute force and on odd inputs."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from repertoire.llm import quality

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, kept string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None, "x", "y") for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
    vocabulary = [word() for _ in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = [(i, text(rng.randint(5, 80)), f"s{i % 3}") for i in range(60)]
    rows += [(100 + i, rows[i][1].replace(" ", "  "), "s0") for i in range(5)]
    for i in range(6):
        copy = rows[20 + i][1].split()
        copy[-1] = "changed"
        rows.append((200 + i, " ".join(copy), None))
    tests = [(f"q{i}", text(14)) for i in range(3)] + [(None, text(12)), ("none", None), ("short", "alpha beta gamma")]
    rows += [(300 + i, f"{text(9)} {t} {text(4)}", "s1") for i, (_, t) in enumerate(tests) if t]
    rows += [(400, None, None), (401, "", "s2"), (402, " \n", "s2"), (None, text(9), "s1"), (0, rows[0][1], "s0"), (403, "word " * 40_000, "s2")]
    path = tmp_path_factory.mktemp("corpus")
    frame(spark, rows).coalesce(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(tests, "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    labels = [(i, int(i % 7 != 3), 0) for i in range(40)] + [(1, None, 0), (1, 0, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def docs_of(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def kept(df):
    return collections.Counter((r.doc_id, r.text) for r in df.collect())


def test_stages_are_the_contracted_ones():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontamination", "packing"]
    assert all(f.__doc__ for _, f in corpus_pipeline.STAGES)


def test_quality_stage_follows_the_scores(spark, folder):
    docs = docs_of(spark, folder)
    scores = quality.quality_scores(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect()
    bad = {r.doc_id for r in scores if r.predicted == 0}
    got = corpus_pipeline.keep_good(spark, docs, folder)
    assert got.columns == docs.columns
    assert kept(got) == collections.Counter((r.doc_id, r.text) for r in docs.collect() if r.doc_id is None or r.doc_id not in bad)


def test_exact_stage(spark, folder):
    docs = docs_of(spark, folder)
    groups = collections.defaultdict(list)
    for r in docs.collect():
        groups[re.sub(r"[\x20\x09-\x0D]", "", r.text or "")].append(r)
    stay = {min(g, key=lambda r: (-len(r.text or ""), r.doc_id is None, r.doc_id or 0)).doc_id for g in groups.values()}
    got = corpus_pipeline.drop_exact_copies(spark, docs, folder)
    assert got.columns == docs.columns
    assert kept(got) == collections.Counter((r.doc_id, r.text) for r in docs.collect() if r.doc_id is None or r.doc_id in stay)


def test_near_stage(spark, folder):
    docs = docs_of(spark, folder)
    sets = {}
    for r in docs.where("doc_id is not null").collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate(LOWER))
        sets[r.doc_id] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if a < b and sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    got = corpus_pipeline.drop_near_copies(spark, docs, folder)
    assert got.columns == docs.columns and len(set(label.values())) < len(label) - 5
    assert kept(got) == collections.Counter((r.doc_id, r.text) for r in docs.collect() if r.doc_id is None or label[r.doc_id] == r.doc_id)


def test_decontamination_stage(spark, folder):
    docs = docs_of(spark, folder)
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = {tuple(w[i : i + min(10, len(w))]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect() for w in [words(r.text)] if w for i in range(len(w) - min(10, len(w)) + 1)}
    hit = lambda w: any(tuple(w[i : i + n]) in windows for n in {len(x) for x in windows} for i in range(len(w) - n + 1))
    got = corpus_pipeline.drop_contaminated(spark, docs, folder)
    bad = {r.doc_id for r in docs.collect() if hit(words(r.text))}
    assert got.columns == docs.columns and {300, 301, 302, 303} <= bad
    assert kept(got) == collections.Counter((r.doc_id, r.text) for r in docs.collect() if r.doc_id is None or r.doc_id not in bad)


def test_pipeline_packs_what_the_stages_keep(spark, folder):
    docs = docs_of(spark, folder)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder).checkpoint()
    want = collections.Counter(r.doc_id for r in docs.collect())
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert collections.Counter(r.doc_id for r in pieces if r.start == 0) == want
    total = sum(r.length for r in pieces)
    assert sorted(x for r in pieces for x in range(r.sequence_id * 2048 + r.offset, r.sequence_id * 2048 + r.offset + r.length)) == list(range(total))


def test_stages_take_empty_tables(spark, folder):
    none = docs_of(spark, folder).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, none, folder)
        assert got.count() == 0 and (name == "packing" or got.columns == none.columns)
    assert none.withColumn("x", F.lit(1)).count() == 0
