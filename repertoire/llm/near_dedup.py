r"""Near-duplicate detection: an inverted join over MinHash signature coordinates.

1. A text's set is its distinct word shingles (64-bit hashes); texts with equal sets form a class, and
   classes are all that is compared. A class has a signature of ``COORDINATES`` minima.
2. Each class is posted under its coordinate-value pairs. Pairs that no other class has are skipped,
   and so are classes left with fewer postings than the match threshold. The rest keep a prefix:
   their rarest postings, as many as a match of ``MATCHES`` coordinates cannot avoid.
3. Below each posted pair, collisions are counted over the whole signatures, which skips the long lists
   of common values. Matches of ``MATCHES`` or more, of sizes that allow the threshold, are candidates;
   of these a spanning forest leaves the task.
4. Candidates form groups by connected components. Every class of a group is compared with the group's
   first on their full sets (100 * intersection >= threshold * union): as many pairs as classes.
5. Groups in which a pair was refuted are open: their lists are counted again, between classes not yet
   linked only. Where candidates are left, the classes of both sides are compared on their full sets inside
   tasks, the fewer asking the many, until they are linked; one link for each join leaves a task.
6. Connected components of the confirmed links name the groups.

Lists and groups above ``UNIT_ROWS`` classes or ``UNIT_SHINGLES`` shingles are split into blocks, and every
pair of blocks is a unit of its own: memory is bounded and no pair is lost. A pair at the threshold of 0.8 has fewer than 16 of 32 equal
coordinates with probability 3e-5; that is the only loss. Shingles are compared as 64-bit hashes.

Defined results: null or wordless texts have an empty set (size 0) and are linked with nothing; a text
of fewer words than a shingle is one shingle; rows that repeat a doc_id each give a row; rows without
doc_id are in no component and stay; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repertoire.llm._shared import bounded, join_counted, quoted, ship, text_or_empty, written
from repertoire.llm._text import NOT_SPACE, Words, chunks, mix64, utf8
from repertoire.llm.components import connected_components

COORDINATES, MATCHES = 32, 16
SHINGLE, THRESHOLD = 5, 80
UNIT_ROWS, UNIT_SHINGLES = 4096, 4_000_000
#: Links of one batch that leaves a task.
SEND_LINKS = 100_000
_ODD = mix64(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * np.uint64(0x8CB92BA72F3D8DD7)) | np.uint64(1)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, size: int):
    """The sorted distinct shingle hashes of each text, text by text."""
    for _, _, part, offs in chunks(raw, offsets):
        w = Words(part, offs, NOT_SPACE)
        h = mix64(w.hash + np.uint64(1))
        n = len(h)
        whole = np.zeros(max(0, n - size + 1), np.uint64)
        for j in range(size):
            whole = mix64(whole * np.uint64(3) ^ h[j : n - size + 1 + j]) if len(whole) else whole
        for a, z in zip(w.first[:-1], w.first[1:], strict=True):
            if z - a >= size:
                s = np.sort(whole[a : z - size + 1])
                yield s[np.concatenate(([True], s[1:] != s[:-1]))]
            elif z > a:
                x = np.zeros(1, np.uint64)
                for j in range(a, z):
                    x = mix64(x * np.uint64(5) ^ h[j : j + 1])
                yield x ^ np.uint64(z - a)
            else:
                yield np.zeros(0, np.uint64)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(texts, COORDINATES) minima; all texts must have shingles."""
    flat = np.concatenate(sets)
    begin = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), COORDINATES), np.int32)
    for k in range(COORDINATES):
        x = (flat ^ _ODD[k]) * _ODD[COORDINATES + k]
        x ^= x >> np.uint64(29)
        x *= _ODD[k]
        out[:, k] = (np.minimum.reduceat(x, begin) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return out


def _sketch(size: int):
    def sketch(batches):
        for b in batches:
            raw, offsets = utf8(b.column(1))
            count = np.zeros(len(offsets) - 1, np.int64)
            one, two = np.zeros(len(count), np.uint64), np.zeros(len(count), np.uint64)
            sig: list = [None] * len(count)
            held, at, amount = [], [], 0

            def flush():
                nonlocal held, at, amount
                if held:
                    for i, row in zip(at, signatures(held), strict=True):
                        sig[i] = row.tolist()
                held, at, amount = [], [], 0

            for i, s in enumerate(shingle_sets(raw, offsets, size)):
                count[i] = len(s)
                if len(s):
                    one[i], two[i] = mix64(s).sum(), mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum()
                    held.append(s)
                    at.append(i)
                    amount += len(s)
                    if amount > 200_000:
                        flush()
            flush()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(count), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(sig, pa.list_(pa.int32()))],
                names=["doc_id", "n_shingles", "s1", "s2", "sig"],
            )

    return sketch


def _sets(size: int):
    def sets(batches):
        for b in batches:
            raw, offsets = utf8(b.column(1))
            found = pa.array([s.tobytes() for s in shingle_sets(raw, offsets, size)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), found], names=["id", "shingles"])

    return sets


def _bridges(ids: np.ndarray, labels: np.ndarray, near) -> list[tuple[int, int]]:
    """Links that join the groups which ``labels`` name into the components of a graph, one for each join. The graph is
    given by ``near(i, rest)``: which of ``rest`` are linked to i.

    Members of the largest group need not ask, since all others ask them; who has asked is not asked again; and
    nobody is asked by a group that it has been joined to.
    """
    names, group, size = np.unique(labels, return_inverse=True, return_counts=True)
    if len(names) < 2:
        return []
    root = np.arange(len(names))
    links, asked = [], np.zeros(len(ids), bool)
    order = np.argsort(size[group], kind="stable")
    for i in order[group[order] != size.argmax()].tolist():
        asked[i] = True
        own = root[group[i]]
        rest = np.flatnonzero(~asked & (root[group] != own))
        hit = rest[near(i, rest)] if len(rest) else rest
        if len(hit):
            for r, at in zip(*np.unique(root[group[hit]], return_index=True), strict=True):
                links.append((int(ids[i]), int(ids[hit[at]])))
                root[root == r] = own
            if (root == own).all():
                break
    return links


def _runs(batches):
    """Tables of whole runs of equal keys in column 0, from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        t = pa.Table.from_batches(held).combine_chunks()
        key = t.column(0).to_numpy()
        if key[0] == key[-1]:
            held = t.to_batches()
            continue
        cut = int(np.flatnonzero(key != key[-1])[-1]) + 1
        yield t.slice(0, cut)
        held = t.slice(cut).to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


_LINKS = pa.schema([("unit", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def _batch(unit: list, links: list) -> pa.RecordBatch:
    x = np.concatenate(links).astype(np.int64).reshape(-1, 2)
    of = np.repeat(np.array(unit, np.int64), [len(v) for v in links])
    return pa.RecordBatch.from_arrays([pa.array(of), pa.array(x.min(1)), pa.array(x.max(1))], schema=_LINKS)


def _collide(matches: int, threshold: int):
    """(unit, id, size, sig, label) rows sorted by unit -> pairs of labels that candidates of every unit join."""

    def collide(batches):
        units, links, amount = [], [], 0
        for t in _runs(batches):
            unit, size, label = (t.column(i).to_numpy() for i in (0, 2, 4))
            flat = t.column(3).combine_chunks()
            flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
            sig = flat.flatten().to_numpy().reshape(len(unit), COORDINATES)
            edge = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1], [True])))
            count = np.diff(edge)
            begin = edge[:-1]
            two = begin[count == 2]
            sizes = np.minimum(size[two], size[two + 1]) * 100 >= threshold * np.maximum(size[two], size[two + 1])
            two = two[sizes & (label[two] != label[two + 1]) & ((sig[two] == sig[two + 1]).sum(1) >= matches)]
            units += unit[two].tolist()
            links += list(np.stack([label[two], label[two + 1]], 1)[:, None, :])
            amount += len(two)
            for first, n in zip(begin[count > 2], count[count > 2], strict=True):
                own, big = sig[first : first + n], size[first : first + n]

                def near(i, rest, own=own, big=big):
                    fits = np.minimum(big[rest], big[i]) * 100 >= threshold * np.maximum(big[rest], big[i])
                    fits[fits] = (own[rest[fits]] == own[i]).sum(1) >= matches
                    return fits

                found = _bridges(label[first : first + n], label[first : first + n], near)
                if found:
                    units.append(int(unit[first]))
                    links.append(np.array(found, np.int64))
                    amount += len(found)
                if amount >= SEND_LINKS:
                    yield _batch(units, links)
                    units, links, amount = [], [], 0
        if amount:
            yield _batch(units, links)

    return collide


def _confirm(threshold: int):
    def confirm(batches):
        """(a, b, shingles of a, shingles of b) -> (a, b, whether they are linked)."""
        for b in batches:
            sure = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                one, two = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                at = np.minimum(np.searchsorted(two, one), len(two) - 1)
                common = int(np.count_nonzero(two[at] == one))
                sure.append(100 * common >= threshold * (len(one) + len(two) - common))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sure, pa.bool_())], names=["a", "b", "linked"])

    return confirm


def _compare(threshold: int):
    """(unit, id, shingles, label) rows sorted by unit -> forest of every unit's links between different labels."""

    def compare(batches):
        for t in _runs(batches):
            unit, ids, sets, labels = t.column(0).to_numpy(), t.column(1).to_numpy(), t.column(2).to_pylist(), t.column(3).to_numpy()
            edge = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1], [True])))
            units, links = [], []
            for a, z in zip(edge[:-1], edge[1:], strict=True):
                own = [np.frombuffer(s, np.uint64) for s in sets[a:z]]
                size = np.array([len(s) for s in own])
                first = np.concatenate(([0], np.cumsum(size)))
                _, code = np.unique(np.concatenate(own), return_inverse=True)
                mark = np.zeros(int(code.max()) + 1 if len(code) else 1, bool)

                def near(i, rest, first=first, code=code, size=size, mark=mark):
                    out = np.minimum(size[rest], size[i]) * 100 >= threshold * np.maximum(size[rest], size[i])
                    some = rest[out]
                    if len(some):
                        mine = code[first[i] : first[i + 1]]
                        mark[mine] = True
                        if len(some) * 2 > len(size):
                            common = np.add.reduceat(mark[code].astype(np.int64), first[:-1])[some]
                        else:
                            common = np.array([np.count_nonzero(mark[code[first[j] : first[j + 1]]]) for j in some])
                        mark[mine] = False
                        out[out] = 100 * common >= threshold * (size[some] + size[i] - common)
                    return out

                found = _bridges(ids[a:z], labels[a:z], near)
                if found:
                    units.append(int(unit[a]))
                    links.append(np.array(found, np.int64))
            if links:
                yield _batch(units, links)

    return compare


def _units(members: DataFrame, key: str, weight: str | None = None) -> DataFrame:
    """Adds ``unit``: one for each key, or one for each pair of blocks of a key with more than ``UNIT_ROWS`` rows, or
    ``UNIT_SHINGLES`` of ``weight``. Such keys are at most all rows / ``UNIT_ROWS``, all shingles / ``UNIT_SHINGLES``."""
    parts = F.count(F.lit(1)) * 2 / F.lit(UNIT_ROWS)
    if weight:
        parts = F.greatest(parts, F.sum(weight) * 2 / F.lit(UNIT_SHINGLES))
    large = members.groupBy(key).agg(F.ceil(parts).cast("int").alias("__b")).where("__b > 2")
    large = bounded(written(large, "large-lists"))
    joined = members.join(large, key, "left").withColumn("__b", F.coalesce("__b", F.lit(1)))
    other = joined.withColumn("__o", F.explode(F.sequence(F.lit(0), F.col("__b") - 1)))
    own = F.pmod(F.xxhash64("id"), F.col("__b"))
    unit = F.when(F.col("__b") == 1, F.xxhash64(key)).otherwise(F.xxhash64(key, F.least(own, "__o"), F.greatest(own, "__o")))
    return other.withColumn("unit", unit).drop("__b", "__o")


def near_groups(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: int = THRESHOLD, matches: int = MATCHES
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``; ids are integers."""
    ship(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    sketched = written(texts.mapInArrow(_sketch(shingle), "doc_id long, n_shingles long, s1 long, s2 long, sig array<int>"), "sketches")
    named = sketched.where("n_shingles > 0 and doc_id is not null")
    classes = named.groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("docs"), F.first("sig").alias("sig"))
    classes = written(classes, "classes")
    pair = F.shiftleft(F.col("k").cast("long"), 32) + F.pmod(F.col("v").cast("long"), F.lit(1 << 32))
    posted = classes.select("id", F.posexplode("sig").alias("k", "v")).select("id", pair.alias("key"))
    common = posted.groupBy("key").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    listed = join_counted(posted, common, ["key"], "f").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("f", "key"))).alias("p")).where(F.size("p") >= matches)
    prefix = listed.select("id", F.explode(F.slice("p", F.lit(1), F.size("p") - F.lit(matches - 1))).alias("x")).select("id", F.col("x.key").alias("key"))
    lists = written(_units(written(prefix, "postings"), "key").select("unit", "id"), "lists")
    sized = classes.select("id", "n_shingles", "sig")
    rows = lists.join(sized, "id").select("unit", "id", "n_shingles", "sig", F.col("id").alias("label"))
    found = rows.repartition("unit").sortWithinPartitions("unit", "id").mapInArrow(_collide(matches, threshold), "unit long, a long, b long")
    groups = written(connected_components(found).where("node <> component"), "candidates")
    checked = written(_confirmed(texts, groups.select(F.col("component").alias("a"), F.col("node").alias("b")), named, shingle, threshold), "confirmed")
    linked = checked.where("linked").select(F.col("b").alias("node"), F.col("a").alias("component"))
    opened = checked.where("not linked").select(F.col("a").alias("component")).distinct()
    if not opened.limit(1).isEmpty():
        open_groups = groups.join(bounded(written(opened, "open")), "component", "left_semi")
        ids = open_groups.select(F.col("node").alias("id")).unionAll(open_groups.select(F.col("component").alias("id")).distinct())
        labelled = ids.join(linked.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("label"))
        labelled = bounded(written(labelled, "open-classes"))
        rows = lists.join(labelled, "id").join(sized, "id").select("unit", "id", "n_shingles", "sig", "label")
        rest = rows.repartition("unit").sortWithinPartitions("unit", "id").mapInArrow(_collide(matches, threshold), "unit long, a long, b long")
        near = connected_components(rest).select(F.col("node").alias("label"), F.col("component").alias("group"))
        members = written(labelled.join(bounded(near), "label").select("id", "group", "label"), "members")
        full = written(_full_sets(texts, members.select("id"), named, shingle), "open-sets")
        full = full.join(bounded(members), "id").withColumn("w", F.octet_length("shingles") / 8)
        units = _units(full, "group", "w").select("unit", "id", "shingles", "label")
        more = units.repartition("unit").sortWithinPartitions("unit", "id").mapInArrow(_compare(threshold), "unit long, a long, b long")
        more = written(more.select("a", "b"), "more-confirmed")
        if not more.limit(1).isEmpty():
            linked = connected_components(checked.where("linked").select("a", "b").unionByName(more)).where("node <> component")
    linked = linked.withColumnRenamed("node", "id")
    label = classes.select("s1", "s2", "n_shingles", "docs", "id").join(linked, "id", "left").where("docs > 1 or component is not null")
    label = written(label.select("s1", "s2", "n_shingles", "docs", F.coalesce("component", "id").alias("c")), "labels")
    member = sketched.select("doc_id", "n_shingles", "s1", "s2")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id"))
    keys = ["s1", "s2", "n_shingles"]
    grouped = member.where("n_shingles > 0")
    out = join_counted(grouped, bounded(label), keys, "docs", "left").drop("docs")
    out = out.unionByName(member.where("n_shingles = 0").withColumn("c", F.lit(None).cast("long")))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _full_sets(texts: DataFrame, nodes: DataFrame, named: DataFrame, shingle: int) -> DataFrame:
    """(id, shingles) of the texts of some ids, read again; an id that comes more than once may have several sets,
    any of which links it."""
    chosen = bounded(nodes.select(F.col("id").alias("doc_id")).distinct())
    full = texts.join(chosen, "doc_id", "left_semi").mapInArrow(_sets(shingle), "id long, shingles binary")
    return full.dropDuplicates(["id", "shingles"]) if _repeats(named) else full


def _confirmed(texts: DataFrame, pairs: DataFrame, named: DataFrame, shingle: int, threshold: int) -> DataFrame:
    """(a, b, linked) of pairs of ids, each b once, by the full sets of their texts."""
    nodes = written(pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).distinct(), "nodes")
    full = written(_full_sets(texts, nodes, named, shingle), "sets")
    sizes = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("__rows"))
    roots = full.select(F.col("id").alias("a"), F.col("shingles").alias("x")).join(sizes, "a")
    both = pairs.join(full.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    both = join_counted(both, roots, ["a"], "__rows")
    checked = both.select("a", "b", "x", "y").mapInArrow(_confirm(threshold), "a long, b long, linked boolean")
    return checked.groupBy("a", "b").agg(F.max("linked").alias("linked")) if _repeats(named) else checked


def _repeats(named: DataFrame) -> bool:
    """Whether a doc_id comes more than once."""
    return not named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).isEmpty()


def near_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` with one document (the smallest id) of each group of near-duplicates; columns as given."""
    gone = written(near_groups(docs, id_col=id_col, text_col=text_col, shingle=shingle, threshold=threshold).where("not kept").select("doc_id").distinct(), "near-copies")
    return docs.join(bounded(gone.select(F.col("doc_id").alias(id_col))), id_col, "left_anti").select(*quoted(docs))
