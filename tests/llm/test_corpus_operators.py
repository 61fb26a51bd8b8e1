"""Edge cases and brute-force checks of the corpus operators."""

import collections
import hashlib
import html
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from repertoire.llm import _shared, chat, ctw, decontam, exact_dedup, html_extract, lm_score, near_dedup, packing, quality, sharding, warc
from repertoire.llm._text import ALNUM, NOT_SPACE, word_hashes
from repertoire.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, size string, rid string, kept string, __p string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, texts, first=0):
    """Documents with extra columns whose names clash with those of the operators."""
    rows = [(first + i, t, "en", f"src{i % 3}" if i % 5 else None, None, "x", "y", "z", "k", "p") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, copies, and a row that repeats."""
    rng = random.Random(3)
    words = ["the", "of", "then", "über", "Ément", "42", "x", "erin", "thnd", "ofst"]
    body = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 120))) for _ in range(60)]
    texts = [None, "", " \t\n", "a", "A", "a b", "a  b\n", *body, *[b.upper() for b in body[:5]], *[b.replace(" ", "\n") for b in body[:9]], "word " * 30_000, "n" * 70_000]
    df = frame(spark, texts)
    return df.unionByName(df.where("doc_id in (9, 10)")).unionByName(df.where("doc_id = 12").withColumn("doc_id", F.lit(None).cast("long"))).cache()


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def rows(df):
    return [r.asDict() for r in df.collect()]


# 1 exact dedup


def test_exact_groups_match_brute_force(odd, none):
    got = rows(exact_dedup.exact_groups(odd))
    docs = [(r.doc_id, r.text or "") for r in odd.collect()]
    groups = collections.defaultdict(list)
    for i, t in docs:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append((i, t))
    want = []
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))[0]
        want += [(i, keep, len(members), i == keep, hashlib.sha256(norm.encode()).hexdigest()) for i, _ in members]
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r[c] for c in ("doc_id", "keep_id", "group_size", "kept", "text_sha256")) for r in got), key=key) == sorted(want, key=key)
    assert exact_dedup.exact_groups(none).count() == 0
    kept = exact_dedup.exact_dedup(odd)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.where("doc_id is not null").collect()} == {r["keep_id"] for r in got if r["keep_id"] is not None}


@pytest.mark.parametrize("bits", [0, 5])
def test_quotient_filters_merge_without_loss(bits):
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 64, 500, dtype=np.uint64)[rng.integers(0, 500, 3000)]
    keys[:900] = (keys[:900] >> np.uint64(30)) | np.uint64(7 << 60)  # long runs and clusters
    blocks = collections.defaultdict(list)
    for part in np.array_split(keys, 7):
        for block, f in exact_dedup.filters_of(part, np.ones(len(part), np.int64), bits):
            row = f.row(block)
            blocks[block].append(exact_dedup.QuotientFilter.of_row(bits, *row[1:]))
            assert blocks[block][-1].keys(block).tolist() == sorted(set(part[part >> np.uint64(64 - bits) == block].tolist() if bits else part.tolist()))
    got = {}
    for block, parts in blocks.items():
        whole = exact_dedup.QuotientFilter.merge(parts, block)
        got |= dict(zip(whole.keys(block).tolist(), whole.counts.tolist(), strict=True))
    assert got == collections.Counter(keys.tolist())


def test_exact_groups_of_text_ids_and_heavy_copies(spark, monkeypatch):
    monkeypatch.setattr(_shared, "HEAVY_ROWS", 5)
    rows = [(f"d{i:02d}", "same  text" if i % 3 else f"own {i}") for i in range(30)] + [(None, "own 0"), ("a", "sametext"), ("b", None)]
    got = {r.doc_id: r for r in exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got["d04"].keep_id == "d01" and got["d04"].group_size == 21 and not got["a"].kept and got["d01"].kept
    assert got["d00"].keep_id == "d00" and got[None].keep_id == "d00" and got["b"].kept and got["b"].group_size == 1


# 2 decontamination


def brute_contamination(docs, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = collections.defaultdict(set)
    for item, text in items:
        w = split(text)
        if w:
            n = min(10, len(w))
            for i in range(len(w) - n + 1):
                windows[tuple(w[i : i + n])].add(item)
    out = {}
    for i, text in docs:
        w = split(text)
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in windows:
                    hit |= set(range(j, j + n))
                    found |= windows[tuple(w[j : j + n])]
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("shard_bytes", [1 << 20, 60])
def test_contamination_matches_brute_force(spark, odd, none, shard_bytes):
    texts = [r.text for r in odd.where("doc_id between 7 and 40").collect()]
    items = [("1", " ".join((texts[3] or "").split()[2:30])), ("2", "über ément"), ("10", None), ("3", "X"), ("4", ""), ("5", "over the " * 9), ("6", "Über-Ément!"), ("7", texts[8])]
    bench = spark.createDataFrame(items, "item_id string, text string")
    found = decontam.contamination(odd, bench, shard_bytes=shard_bytes)
    got = collections.Counter((r.doc_id, r.n_words, r.n_hit, len(r["items"]), decontam.items_digest(r["items"])) for r in found.collect())
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    want = collections.Counter((i, *brute_contamination([(i, t)], items)[i][:4]) for i, t in docs)
    assert got == want
    assert decontam.contamination(none, bench).count() == 0
    assert decontam.contamination(odd, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontam.decontaminate(odd, bench).columns == odd.columns


# 3 WARC


def test_warc_round_trip(spark):
    page = "<html>" + "ü" * 200
    data = [(1, "http://a.b/x y\n", page), (2, "http://a.b/2", page), (3, None, None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (0, "u", "z\r\n\r\n" * 40_000), (2, "http://a.b/2", page), (None, "u", page)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.warc_round_trip(pages).collect()), key=str)
    want = []
    for i, _, text in data:
        raw = (text or "").encode()
        first = min(j for j, _, t in data if t == text and j is not None) if len(raw) >= 100 else i
        revisit = len(raw) >= 100 and i != first
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert got == sorted(want, key=str)
    assert warc.warc_round_trip(pages.limit(0)).count() == 0


def test_warc_is_deterministic_and_rolls(spark):
    from repertoire.llm._shared import fresh_path

    rng = random.Random(5)
    pages = spark.createDataFrame([(i, f"u{i}", "".join(rng.choice("abcdefgh") for _ in range(3000))) for i in range(300)], "page_id long, url string, html string")
    runs = []
    for df in (pages, pages.repartition(5)):
        m = warc.write_warc(df.coalesce(1), fresh_path(spark, "warc"), roll_bytes=60_000, partition_bytes=400_000).collect()
        runs.append(sorted((r.final, r.records, r.bytes, r.sha256) for r in m))
    assert runs[0] == runs[1] and len(runs[0]) > 3 and sum(r[1] for r in runs[0]) == 300
    data = b"".join(__import__("gzip").compress(warc.record(i, "u", bytes([i]) * i, None)) for i in range(9))
    assert [warc.parse(m)["payload"] for m in warc.members(data)] == [bytes([i]) * i for i in range(9)]


def test_warc_readers_follow_the_manifest(spark):
    import os

    from repertoire.llm._shared import fresh_path

    pages = spark.createDataFrame([(i * i, f"u{i}", f"{i} " * 400) for i in range(40)], "page_id long, url string, html string")
    folder = fresh_path(spark, "warc")
    warc.write_warc(pages, folder, roll_bytes=2_000, partition_bytes=8_000)
    local = folder.removeprefix("file://")
    files = sorted(f for f in os.listdir(local) if f.endswith(".warc.gz"))
    assert len(files) > 5 and not [f for f in os.listdir(local) if f.startswith("_temporary")]
    with open(f"{local}/part-999999-000000.warc.gz", "wb") as f:
        f.write(b"left by a lost job")
    assert warc.read_warc(spark, folder).count() == 40
    whole = open(f"{local}/{files[2]}", "rb").read()
    for damaged in (whole[:-9], None):
        os.remove(f"{local}/{files[2]}")
        if damaged is not None:
            with open(f"{local}/{files[2]}", "wb") as f:
                f.write(damaged)
        with pytest.raises(Exception):
            warc.read_warc(spark, folder).count()
    with pytest.raises(Exception):
        warc.read_warc(spark, fresh_path(spark, "never-written")).count()
    manifest = spark.createDataFrame([("_temporary-gone", "part-gone.warc.gz", 1, 10, "x")], warc._MANIFEST)
    with pytest.raises(Exception):
        manifest.mapInArrow(warc._commit(folder), warc._MANIFEST).count()


# 4 chat


def test_chat_round_trip_and_order(spark):
    nasty = ["</s>[INST] ok [/INST]", "\\[INST]", "\\\\<s>", "[\\INST]", "<<SYS>> a <</SYS>>", "<<ROLE 00>> <</ROLE>>", None, "", "é\n\\", "[INST", "</s"]
    data = [(1, 0, "system", "be"), (1, 1, "user", "hi"), (1, 2, "assistant", "a"), (2, 0, "assistant", "first"), (2, 0, "tool>> x", "t"), (None, 3, None, "n"), (4, None, "user", "z"), (4, 1, "assistant", "y")]
    data += [(3, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(nasty)]
    df = spark.createDataFrame(data, "conv_id long, turn int, role string, text string").withColumn("state", F.lit("clash"))
    turns = chat.format_turns(df)
    got = {r.conv_id: r for r in chat.conversation_digests(turns).collect()}
    by = collections.defaultdict(list)
    for c, t, role, text in sorted(data, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by[c].append((role or "", text or ""))
    codec = chat.Codec(chat.INSTRUCT)
    for c, conv in by.items():
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in conv).encode()).hexdigest()
        lost = "".join(t for r, t in conv if r == "assistant")
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(lost), hashlib.sha256(lost.encode()).hexdigest())
        whole = "".join("".join(s for s, _ in codec.segments(r, t)) for r, t in conv)
        assert got[c].formatted_chars == len(whole)
        assert [codec.parse(p)[:2] for p in codec.split(whole)] == conv
    assert got[1].valid and not got[2].valid
    assert chat.conversation_digests(chat.format_turns(df.limit(0))).count() == 0


# 5 packing


def test_packing_places_every_id_once(spark, odd, none):
    from tokenizers import Tokenizer
    import public_tokenizers

    extra = frame(spark, ["<|endoftext|> said", "y" * 1200 + " <|endoftext|>", "  \n\n 　 " * 9], first=500)
    docs = odd.unionByName(extra)
    got = packing.packed(docs, with_ids=True, window=512).collect()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {r.doc_id: np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4") for r in docs.collect()}
    times = collections.Counter(r.doc_id for r in docs.collect())
    pieces = collections.defaultdict(list)
    sequences = collections.defaultdict(list)
    for r in got:
        x = ids[r.doc_id]
        assert r.doc_tokens == len(x) and r["ids"] == x[r.start : r.start + r.length].tobytes() and zlib.crc32(r["ids"]) == r.ids_crc32
        pieces[r.doc_id] += range(r.start, r.start + r.length)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(list(range(len(x))) * times[k]) for k, x in ids.items()}
    for k, s in sequences.items():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at == 512 or k == max(sequences)
    assert packing.packed(none).count() == 0


def windows(packed, docs, window):
    """ids of each source in each window, and the ids of each source."""
    source = {r.doc_id: r.source or "" for r in docs.select("doc_id", "source").collect()}
    held, total = collections.defaultdict(collections.Counter), collections.Counter()
    for r in packed.select("doc_id", "length", "sequence_id").collect():
        held[r.sequence_id][source[r.doc_id]] += r.length
        total[source[r.doc_id]] += r.length
    return [held[k] for k in range(len(held))], total


def test_packing_holds_the_mixture_in_every_window(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held, total = windows(packing.packed(docs), docs, 2048)
    whole = sum(total.values())
    small = {q for q, n in total.items() if n * 2048 < packing.LEAST * whole}
    assert len(held) > 100 and len(total) > 10
    for w in held[:-1]:
        assert sum(w.values()) == 2048
        assert all(abs(w[q] - 2048 * n / whole) < 2 for q, n in total.items() if q not in small)
        assert abs(sum(w[q] for q in small) - 2048 * sum(total[q] for q in small) / whole) < 2


def test_packing_with_target_shares(spark):
    docs = spark.createDataFrame([(i, "then the of " * (5 + i % 7), "abcd"[i % 9 // 3] if i % 50 else "d") for i in range(1500)], "doc_id long, text string, source string")
    held, total = windows(packing.packed(docs, window=256, shares={"a": 0.5, "b": 0.25, "c": 0.0, "none": 0.3}), docs, 256)
    d = total["d"] / sum(total.values())
    want = {"a": 0.5 / (0.75 + d), "b": 0.25 / (0.75 + d), "d": d / (0.75 + d)}
    dry = int(min(total[q] / want[q] for q in want) // 256)
    assert all(abs(w[q] - 256 * want[q]) < 2 for w in held[:dry] for q in want) and dry > 10
    left = [w for w in held if not w["a"] and w["b"]]
    assert left and all(set(w) <= {"b", "c", "d"} for w in left)
    first_c = next(k for k, w in enumerate(held) if w["c"])
    assert all(set(w) == {"c"} for w in held[first_c + 1 :]) and sum(map(len, (set(w) & {"c"} for w in held))) > 5
    assert sum(sum(w.values()) for w in held) == sum(total.values()) and all(sum(w.values()) == 256 for w in held[:-1])


def test_rounds_cover_every_queue_once():
    rng = random.Random(1)
    for _ in range(60):
        ids = [rng.choice([0, 1, 40]), *(rng.randint(400, 5000) for _ in range(rng.randint(1, 9))), rng.choice([0, 300])]
        rounds = packing.Rounds(ids, rng.choice([[*ids[:-1], 0], [1, *(rng.randint(20, 60) for _ in ids[2:]), 0]]), 256)
        seen = np.zeros(sum(ids), int)
        for q, n in enumerate(ids):
            cuts = np.unique([0, *(rng.randrange(n) for _ in range(9))]) if n else np.zeros(0, int)
            for _, _, length, place in zip(*rounds.pieces(q, cuts, np.diff(np.append(cuts, n))), strict=True):
                seen[place : place + length] += 1
        assert (seen == 1).all()


@pytest.mark.parametrize("shard_bytes", [decontam.SHARD_BYTES, 40])
def test_decontamination_searches_items_without_id(spark, shard_bytes):
    words = lambda p: " ".join(f"{p}{i}" for i in range(12))
    docs = spark.createDataFrame([(1, "x " + words("a")), (2, words("b") + " y " + words("a")), (3, "z")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, words("a")), (None, words("a") + " q"), ("k", words("b")), ("m", words("a"))], "item_id string, text string")
    got = {r.doc_id: (r.n_hit, r["items"]) for r in decontam.contamination(docs, bench, shard_bytes=shard_bytes).collect()}
    assert got == {1: (12, ["m", None]), 2: (24, ["k", "m", None]), 3: (0, [])}
    digests = {r.doc_id: (r.n_items, r.items_sha256) for r in decontam.contamination_report(docs, bench).collect()}
    assert digests[2] == (3, decontam.items_digest(["k", "m"])) and digests[1] == (2, decontam.items_digest(["m"]))


# 6 HTML


def test_extraction_induces_the_wrapper(spark):
    def page(i, body):
        return f'<html><head><title>t{i}</title></head><body><div id="top">Same notice here</div><nav><a href=1>{i}</a></nav><div class=main><h1>H{i}</h1>{body}</div><div class="comments"><p>me {i} too</p></div><footer>f{i}</footer></body></html>'

    data = [(i, f"http://h.example/{i}", page(i, f"<p>One {i} &amp; &eacute;\n two<br>three<p>Four<b>teen</b> {i} <i>x</i><script>no()</script>")) for i in range(12)]
    data += [(50, None, None), (51, "bad url", ""), (52, "http://lone.example", "<p>just &lt;this&gt;</p>"), (53, "http://h.example/t", "<body><div class=main><p>cut off &am")]
    got = {r.page_id: r for r in html_extract.extract_text(spark.createDataFrame(data, "page_id long, url string, html string").withColumn("path", F.lit(1))).collect()}
    assert got[3].text == "H3\nOne 3 & é two three\nFourteen 3 x"
    assert got[50].text == "" and got[51].text == "" and got[52].text == "just <this>" and got[53].text == "cut off &am"
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert html_extract.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def _texts(spark, data):
    return {r.page_id: r.text for r in html_extract.extract_text(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}


def test_extraction_keeps_all_varying_blocks(spark):
    def page(i, words):
        return f"<html><body><article><h1>Title {i}</h1><div class=body><p>{words}</p></div><div class=end><p>End {i}</p></div></article><div class=next><a href=x>next {i}</a></div></body></html>"

    data = [(i, f"http://a.example/{i}", page(i, f"word{i} " * 200)) for i in range(12)]
    data.append((50, "http://lone.example/", "<body><p>Intro</p><pre>" + "x " * 2000 + "</pre></body>"))
    got = _texts(spark, data)
    assert got[3] == "Title 3\n" + " ".join(["word3"] * 200) + "\nEnd 3"
    assert got[50].startswith("Intro\nx x")


def test_extraction_drops_constant_blocks_of_small_hosts(spark):
    page = lambda i: f"<body><div class=main><h1>H{i}</h1><p>Text {i}</p><div class=x>{'The same words ' * 20}</div><p>More {i}</p></div></body>"
    data = [(i, f"http://two.example/{i}", page(i)) for i in range(2)] + [(10 + i, f"http://many.example/{i}", page(i)) for i in range(20)]
    data += [(40, "http://copy.example/1", page(1)), (41, "http://copy.example/2", page(1))]
    got = _texts(spark, data)
    assert got[0] == "H0\nText 0\nMore 0" and got[13] == "H3\nText 3\nMore 3"
    assert got[40] == got[41] and got[40].startswith("H1\nText 1\nThe same words")


def test_extraction_counts_hosts_of_long_pages_exactly(spark):
    long = "".join(f"<h2>head {{0}} {k}</h2><p>part {{0}} {k}</p>" for k in range(1200))
    pages = [f"<body><div class=x>{'Same notice ' * 9000}</div><div class=main>{long.format(i)}</div></body>" for i in range(12)]
    frame = spark.createDataFrame([(i, f"http://l.example/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    want = ["\n".join(f"head {i} {k}\npart {i} {k}" for k in range(1200)) for i in range(12)]
    for n in (1, 3):
        assert [r.text for r in html_extract.extract_text(frame.repartition(n, "page_id")).orderBy("page_id").collect()] == want
    assert html_extract.host_wrappers(frame).first().pages == 12


def test_extraction_reads_roles_not_words(spark):
    story = "<h1>Head</h1><p>First words of it</p><p class='reply-intro'>More words</p>"
    pages = [
        f"<html><body class='single has-sidebar'><article>{story}</article></body></html>",
        f"<body><article class='post comments-open'>{story}</article></body>",
        f"<body><div class='no-share'><div>{story}</div></div></body>",
        f"<body><div class='widget-area'><article>{story}</article></div><div class='site-footer'>foot</div><section class=comments><p>me too</p></section></body>",
        f"<body><header><p>site</p></header><article><header><h1>Head</h1></header>{story[13:]}<footer>tags</footer></article></body>",
        f"<head><title>t</title><body><svg><path>{story}",
        f"<body>{story}<p>go <a href='x>link</a>",
        f"<body>{'<div>' * 10_000}{story}{'</div>' * 10_000}</body>",
        f"<body>{story}{'<font>' * 5000}<p></body>",
        f"<body>{''.join(f'<div class={chr(97 + i % 26)}><span>' for i in range(3000))}{story}</body>",
    ]
    got = _texts(spark, [(i, f"http://host{i}.example/", p) for i, p in enumerate(pages)])
    want = "Head\nFirst words of it\nMore words"
    assert [got[i] for i in range(len(pages))] == [want] * 6 + [want + "\ngo link"] + [want] * 3


def test_extraction_drops_constant_lines_and_stale_slots(spark):
    def page(i, motto):
        return f"<body><div>{motto}</div><div class=m><h1>H{i}</h1><p>Text {i}</p><p>Read this every time</p><p>More {i}</p></div></body>"

    data = [(i, f"http://big.example/{i}", page(i, f"motto {i % 3}")) for i in range(30)]
    data += [(100 + i, f"http://five.example/{i}", page(i, "one motto")) for i in range(5)]
    got = _texts(spark, data)
    assert all(got[i] == f"H{i}\nText {i}\nMore {i}" for i in range(30))
    assert all(got[100 + i] == f"H{i}\nText {i}\nMore {i}" for i in range(5))


class _Tree:
    """A DOM of well-formed markup by the standard parser, with simple tree matching by the book."""

    def __init__(self, page):
        from xml.etree import ElementTree

        self.root = ElementTree.fromstring(page)

    @staticmethod
    def label(n):
        return n.tag, n.get("class", "")

    @classmethod
    def match(cls, a, b, pairs):
        if cls.label(a) != cls.label(b):
            return 0
        xs, ys = list(a), list(b)
        m = [[(0, [])] * (len(ys) + 1) for _ in range(len(xs) + 1)]
        for i, x in enumerate(xs, 1):
            for j, y in enumerate(ys, 1):
                own = []
                s = cls.match(x, y, own)
                m[i][j] = max(m[i - 1][j], m[i][j - 1], (m[i - 1][j - 1][0] + s, m[i - 1][j - 1][1] + own) if s else (0, []), key=lambda t: t[0])
        pairs.append((a, b))
        pairs += m[-1][-1][1]
        return 1 + m[-1][-1][0]


@pytest.mark.parametrize("layout", ["article", "divs", "table"])
def test_extraction_equals_tree_matching_of_all_pages(spark, layout):
    rng = random.Random(layout)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    line = lambda: " ".join(word() for _ in range(8))
    fixed = [line() for _ in range(3)]

    def page():
        body = [line() for _ in range(rng.randint(2, 5))]
        if layout == "article":
            return f"<html><body><div class='x'>{fixed[0]}</div><article><h1>{line()}</h1>{''.join(f'<p>{t}</p>' for t in body)}<p>{fixed[1]}</p></article><p>{fixed[2]}</p></body></html>"
        if layout == "divs":
            return f"<html><body><div><div class='t'>{fixed[0]}</div>{''.join(f'<div class=\'c\'><p>{t}</p></div>' for t in body)}<div class='c'><p>{fixed[1]}</p></div></div><div>{fixed[2]}</div></body></html>"
        return f"<html><body><table><tr><td class='l'>{fixed[0]}</td><td class='r'><h2>{line()}</h2>{''.join(f'<p>{t}</p>' for t in body)}</td></tr><tr><td>{fixed[2]}</td></tr></table></body></html>"

    pages = [page() for _ in range(8)]
    trees = [_Tree(p) for p in pages]
    got = _texts(spark, [(i, f"http://{layout}.example/{i}", p) for i, p in enumerate(pages)])
    for i, t in enumerate(trees):
        # a node is template if on the other pages a matched node of this or of another sibling run has its text
        same = collections.Counter()
        for other in trees:
            pairs = []
            t.match(t.root, other.root, pairs)
            texts = {(t.label(b), (b.text or "").strip()) for _, b in pairs} | {(t.label(b), (b.text or "").strip()) for b in other.root.iter()}
            for n in t.root.iter():
                same[n] += (t.label(n), (n.text or "").strip()) in texts
        want = [n.text.strip() for n in t.root.iter() if (n.text or "").strip() and same[n] < len(trees)]
        assert got[i] == "\n".join(want)


# 7 language model


@pytest.mark.parametrize("table_rows", [3_000_000, 40])
def test_lm_scores_match_brute_force(spark, odd, none, table_rows):
    docs = odd.where("doc_id is not null").unionByName(frame(spark, [" ".join(f"then{i % 977} of" for i in range(140_000)), " " * 1_200_000], first=9000))
    got = sorted(lm_score.lm_scores(docs, table_rows=table_rows, blocks=3).collect(), key=lambda r: r.doc_id)
    data = sorted((r.doc_id, b" ".join((r.text or "").encode().lower().split()) + b"\n") for r in docs.collect())
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in data]
    count = collections.Counter(w for (_, t), h in zip(data, held, strict=True) if not h for w in [*t.split(), b"\n"])
    n, v = sum(count.values()), len(count)
    stream = lambda ts: (np.frombuffer(b"".join(ts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in ts]))))
    keys, counts = np.unique(ctw.grams(*stream([t for (_, t), h in zip(data, held, strict=True) if not h]), ctw.DEPTH), return_counts=True)
    block = ctw.Block(keys, counts)
    roots = collections.defaultdict(lambda: np.zeros(3))
    for b, i, *x in block.roots():
        roots[b, i & ((256 << b) - 1)] += x
    top = ctw.Top([(b, i, *x) for (b, i), x in roots.items()])
    for r, (i, t), h in zip(got, data, held, strict=True):
        words = [*t.split(), b"\n"]
        assert (r.doc_id, r.held_out, r.n_tokens, r.train_tokens) == (i, h, len(words), n)
        assert r.n_known == sum(count[w] > 0 for w in words)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words), abs=1e-6)
        assert r.score == pytest.approx(block.log_probabilities(ctw.grams(*stream([t]), ctw.DEPTH), top).sum() / math.log(10), rel=1e-9, abs=1e-6)
        assert r.bits_per_byte == pytest.approx(-r.score * math.log2(10) / len(t))
    assert lm_score.lm_scores(none).count() == 0
    context = ctw.grams(*stream([b"then the of\n"]), ctw.DEPTH) >> np.uint64(8)
    for c in context:
        assert np.exp(block.log_probabilities((c << np.uint64(8)) | np.arange(256, dtype=np.uint64), top)).sum() == pytest.approx(1)


def test_context_trees_by_the_definition():
    """P_w by recursion over all nodes of a small text; what a further bit multiplies it by is the bit's probability."""
    text, depth = b"the then of\nthe of\n", 3
    seen = collections.defaultdict(lambda: [0, 0])  # (context bytes, nearest last; bits so far) -> zeros, ones

    def steps(context, byte):
        for k in range(8):
            bits = f"{byte:08b}"[:k]
            yield bits, byte >> (7 - k) & 1, [(context[len(context) - d :], bits) for d in range(depth + 1)]

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(context, bits):
        own = kt(*seen[context, bits])
        if len(context) == depth:
            return own
        below = [weighted(c, bits) for c in sorted({c for c, b in list(seen) if b == bits and len(c) == len(context) + 1 and c.endswith(context)})]
        return float(np.logaddexp(math.log(0.5) + own, math.log(0.5) + sum(below)))

    lines = [x + b"\n" for x in text.split(b"\n")[:-1]]
    for line in lines:
        padded = b"\n" * depth + line
        for i in range(len(line)):
            for _, bit, nodes in steps(padded[i : i + depth], line[i]):
                for node in nodes:
                    seen[node][bit] += 1
    raw, first = np.frombuffer(b"".join(lines), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in lines])))
    keys, counts = np.unique(ctw.grams(raw, first, depth), return_counts=True)
    block = ctw.Block(keys, counts, depth)
    roots = collections.defaultdict(lambda: np.zeros(3))
    for b, i, *x in block.roots():
        roots[b, i & ((256 << b) - 1)] += x
    top = ctw.Top([(b, i, *x) for (b, i), x in roots.items()])
    for key, got in zip(keys.tolist(), block.log_probabilities(keys, top), strict=True):
        context, want = bytes(key >> 8 * j & 255 for j in range(depth, 0, -1)), 0.0
        for bits, bit, nodes in steps(context, key & 255):
            before = weighted(b"", bits)
            for node in nodes:
                seen[node][bit] += 1
            want += weighted(b"", bits) - before
            for node in nodes:
                seen[node][bit] -= 1
        assert got == pytest.approx(want, abs=1e-8)


def test_kt_estimates_follow_the_sequential_rule():
    logp, a, b = 0.0, 0, 0
    for bit in [0, 1, 1, 0, 1, 1, 1]:
        logp += math.log(((b if bit else a) + 0.5) / (a + b + 1))
        a, b = a + (not bit), b + bit
    assert ctw.log_kt(np.array([float(a)]), np.array([float(b)]))[0] == pytest.approx(logp, abs=1e-9)


# 8 sharding


def test_shards_are_even_and_repeatable(spark, odd, none):
    got = sharding.shard_report(odd)
    back = collections.defaultdict(list)
    for r in got.collect():
        back[r.shard].append(r.slot)
    sizes = [len(back[s]) for s in range(24)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(back[s]) == list(range(len(back[s]))) for s in back)
    texts = collections.Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in odd.collect())
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in got.collect()) == texts
    place = lambda df: sorted((str(r.doc_id), r.place) for r in sharding.shuffled(df.where("doc_id < 80").dropDuplicates(["doc_id"]), bucket_bytes=20_000, part_bytes=60_000).collect())
    assert place(odd) == place(odd.repartition(7)) and len({p for _, p in place(odd)}) == len(place(odd))
    assert sharding.shard_report(none).count() == 0


def test_shards_are_written_in_the_order_of_their_slots(spark, odd):
    from repertoire.llm._shared import fresh_path

    path = fresh_path(spark, "shards")
    back = sharding.write_shards(odd, path, shards=5, part_bytes=40_000)
    assert back.count() == odd.count() and set(back.columns) == {*odd.columns, "size", "shard", "slot", "place"}
    for n in range(5):
        shard = spark.read.parquet(f"{path}/shard={n}").select("slot", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i"))
        slots = [r.slot for r in shard.orderBy("f", "i").collect()]  # files in order of their names
        assert slots == list(range(len(slots)))


# 9 near dedup


def brute_components(docs, size, threshold=80):
    sets = {}
    for i, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + size]) for j in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    if threshold is None:
        return sets, label
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    return sets, label


def test_near_groups_match_brute_force(spark, odd, none):
    rng = random.Random(9)
    texts = []
    for _ in range(25):
        base = [f"w{rng.randint(0, 40)}" for _ in range(rng.randint(2, 90))]
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = f"n{rng.randint(0, 9)}"
            texts.append(" ".join(copy))
    docs = odd.where("doc_id is not null").unionByName(frame(spark, texts, first=1000))
    data = {r.doc_id: r.text for r in docs.collect()}
    for size in (2, 5):
        sets, label = brute_components(data.items(), size)
        for r in near_dedup.near_groups(docs, shingle=size).collect():
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), label[r.doc_id], label[r.doc_id] == r.doc_id)
    assert near_dedup.near_groups(none).count() == 0
    assert near_dedup.near_dedup(odd).columns == odd.columns


def exact_links(docs, size):
    """Links of all texts of a table by an inverted index over whole shingle sets."""
    sets, _ = brute_components(docs, size, threshold=None)
    alike = collections.defaultdict(list)
    for i, s in sets.items():
        if s:
            alike[frozenset(s)].append(i)
    order = collections.Counter(g for s in alike for g in s)
    index, links = collections.defaultdict(list), [(ids[0], i) for ids in alike.values() for i in ids[1:]]
    for s, ids in alike.items():
        first = sorted(s, key=lambda g: (order[g], g))[: len(s) - -(-len(s) * 4 // 5) + 1]
        for t in {t for g in first for t in index[g]}:
            if 100 * len(s & t) >= 80 * len(s | t):
                links.append((ids[0], alike[t][0]))
        for g in first:
            index[g].append(s)
    return links


@pytest.mark.parametrize("size", [2, 5])
def test_near_groups_equal_an_exact_join(spark, size):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    data = {r.doc_id: r.text for r in docs.collect()}
    label = {i: i for i in data}

    def root(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for a, b in exact_links(data.items(), size):
        a, b = root(a), root(b)
        label[max(a, b)] = min(a, b)
    assert {r.doc_id: r.component_id for r in near_dedup.near_groups(docs, shingle=size).collect()} == {i: root(i) for i in data}


def test_near_groups_confirm_what_a_refuted_pair_hides(spark):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for k in range(60):  # a chain of drifting texts: candidates at a similarity of a half, links at 0.8
        for _ in range(3):
            base[rng.randrange(120)] = f"n{k}.{rng.randint(0, 99)}"
        texts.append(" ".join(base))
    rng.shuffle(texts)
    _, label = brute_components(enumerate(texts), 2)
    assert {r.doc_id: r.component_id for r in near_dedup.near_groups(frame(spark, texts), shingle=2).collect()} == label


def test_near_groups_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "UNIT_ROWS", 6)
    monkeypatch.setattr(near_dedup, "UNIT_SHINGLES", 300)
    monkeypatch.setattr(_shared, "HEAVY_ROWS", 5)
    rng = random.Random(2)
    base = [f"w{i}" for i in range(40)]
    texts = [" ".join(base[: rng.randint(30, 40)] + [f"x{rng.randint(0, 3)}"]) for _ in range(40)]
    texts += [base[0]] * 12 + [""] * 9
    docs = frame(spark, texts)
    _, label = brute_components(enumerate(texts), 2)
    assert {r.doc_id: r.component_id for r in near_dedup.near_groups(docs, shingle=2).collect()} == label


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 99), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 99: 99, 100: 99}
    assert connected_components(edges.limit(0)).count() == 0


# 10 quality


def test_quality_is_learnt_from_the_training_fold(spark, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scored = quality.quality_scores(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in scored if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in scored)
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.95
    lied = labels.withColumn("quality", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in quality.quality_scores(docs, lied).collect()}
    assert all(again[r.doc_id] == r.score for r in scored)
    assert quality.quality_scores(none, labels).count() == 0


def test_quality_of_odd_texts_and_labels(spark, odd):
    labels = spark.createDataFrame([(7, 1), (8, 1), (9, None), (None, 0), (7, 1)], "doc_id long, quality int")
    assert {r.score for r in quality.quality_scores(odd, labels).collect()} == {1.0}
    assert {r.score for r in quality.quality_scores(odd, labels.limit(0)).collect()} == {0.5}
    two = spark.createDataFrame([(i, i % 2) for i in range(5, 60)], "doc_id long, quality int")
    got = quality.quality_scores(odd, two).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert quality.quality_filter(odd, two).columns == odd.columns


def test_chain_matches_enumeration():
    rng = np.random.default_rng(4)
    e, first = rng.normal(size=7), np.array([0, 3, 4, 7])
    f = quality.Field.zero()
    f.steps = rng.normal(size=(2, 2))
    good, pairs = f.chain(e, first, np.array([1.0, 2.0, 0.5]))
    want, total = np.zeros(7), np.zeros((2, 2))
    for k, (a, z) in enumerate(zip(first[:-1], first[1:], strict=True)):
        states = [[(s >> j) & 1 for j in range(z - a)] for s in range(1 << (z - a))]
        w = np.exp([sum(e[a + j] for j in range(z - a) if y[j]) + sum(f.steps[y[j], y[j + 1]] for j in range(z - a - 1)) for y in states])
        for y, p in zip(states, w / w.sum(), strict=True):
            want[a:z] += p * np.array(y)
            for j in range(z - a - 1):
                total[y[j], y[j + 1]] += p * [1.0, 2.0, 0.5][k]
    assert np.allclose(good, want) and np.allclose(pairs, total)


# helpers


def test_words_are_those_of_the_pattern():
    text = "Über x-1\tA\x0b\x1f z y  \n\r q9"
    raw = text.encode()
    for letters, pattern in ((NOT_SPACE, r"[^\x20\x09-\x0D]+"), (ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        w = word_hashes(raw, letters)
        assert [w.bytes_of(i).decode() for i in range(len(w.start))] == re.findall(pattern, text.translate(LOWER))
    assert html.unescape("&eacute") == "é"


# articles that other versions, roles in names and constant headings must not take away


def extracted(spark, htmls, host="http://h.example/"):
    df = spark.createDataFrame([(i, f"{host}{i}", h) for i, h in enumerate(htmls)], "page_id long, url string, html string")
    return {r.page_id: r.text for r in html_extract.extract_text(df).collect()}


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))


def test_print_versions_keep_their_articles(spark):
    rng = random.Random(1)
    pages, want = [], []
    for i in range(10):
        paragraphs = [sentence(rng, 9) for _ in range(3)]
        for title in (f"Story {i}", f"Print: story {i}"):
            pages.append(f"<html><body><nav>Home News</nav><div class='wrap'><h1>{title}</h1>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "</div><footer>imprint</footer></body></html>")
            want.append("\n".join([title, *paragraphs]))
    assert extracted(spark, pages) == dict(enumerate(want))


def test_recurring_dialogue_is_content(spark):
    rng = random.Random(2)
    lines = ["yes of course", "no not now", "who is there", "come in then"]
    bodies = [[rng.choice(lines) for _ in range(8)] for _ in range(12)]
    pages = [f"<body><div><h1>Scene {i}</h1>" + "".join(f"<p>{x}</p>" for x in b) + "</div></body>" for i, b in enumerate(bodies)]
    got = extracted(spark, pages)
    for i, b in enumerate(bodies):
        assert all(x in got[i].split("\n") for x in b if sum(x in o for o in bodies) < 11) and got[i].startswith(f"Scene {i}")


def test_names_in_an_article_are_no_roles_but_comments(spark):
    rng = random.Random(3)
    inner = lambda i: f"<article class='post'><h1>T{i}</h1><div class='market-share'>{sentence(random.Random(i), 8)}</div><section class='search'><p>{sentence(random.Random(i + 99), 8)}</p></section><div class='comments'><p>{sentence(rng, 5)}</p></div></article>"
    for n in (1, 12):
        got = extracted(spark, [f"<body>{inner(i)}<div class='discussion'><p>{sentence(rng, 9)}</p></div></body>" for i in range(n)])
        assert got == {i: f"T{i}\n{sentence(random.Random(i), 8)}\n{sentence(random.Random(i + 99), 8)}" for i in range(n)}


def test_constant_headings_between_varying_blocks_stay(spark):
    rng = random.Random(4)
    parts = [[sentence(rng, 7) for _ in range(3)] for _ in range(15)]
    pages = [f"<body><h2>Site</h2><main><h1>Dish {i}</h1><p>{a}</p><h2>Ingredients</h2><p>{b}</p><h2>Method</h2><p>{c}</p><p>Share this page</p><h2>More</h2></main></body>" for i, (a, b, c) in enumerate(parts)]
    got = extracted(spark, pages)
    assert got == {i: f"Dish {i}\n{a}\nIngredients\n{b}\nMethod\n{c}" for i, (a, b, c) in enumerate(parts)}


def test_archive_ranges_hold_wherever_ids_lie(spark, monkeypatch):
    monkeypatch.setattr(warc, "CELLS", 50)
    even = list(range(2000))
    for ids in (even, [*even, 10**15], [1 << 62, *range(-(1 << 62), -(1 << 62) + 900), -(1 << 63), (1 << 63) - 1, *range(7, 1000, 3)], [5] * 900 + even, [None] * 700 + even):
        df = spark.createDataFrame([(i, "u", f"{k:0100d}") for k, i in enumerate(ids)], "page_id long, url string, html string")
        got, parts = warc.with_ranges(df, 2000)
        rows = got.collect()
        assert len(rows) == len(ids)
        sizes = collections.Counter(r.part for r in rows)
        assert max(sizes) < parts and len(sizes) >= len(ids) * 100 / 2000 / 2
        alone = [p for p in sizes if {r.page_id for r in rows if r.part == p} <= {5, None}]
        assert all(sizes[p] <= (40 if p not in alone else 60) for p in sizes)
        spans = sorted((min(r.page_id for r in g), max(r.page_id for r in g), p) for p in sizes if (g := [r for r in rows if r.part == p and r.page_id is not None]))
        assert all(a[1] <= b[0] and a[2] != b[2] for a, b in zip(spans, spans[1:]))
        assert [p for *_, p in spans] == sorted(p for *_, p in spans) or 5 in ids
