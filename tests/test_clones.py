"""Clone calling against all pairs of groups, and its growth on one large family."""

import collections
import itertools
import random

from repertoire.functions import tables
from repertoire.operators import clones

SCHEMA = "read_id long, epitope string, subject string, va string, ja string, vb string, jb string, nuc_a string, nuc_b string, qual_a int, qual_b int, new_a string, new_b string, log10_p double"


def miss(a, b):
    return sum(not tables.base_overlap(x, y) for x, y in zip(a, b, strict=True))


def one_clone(x, y):
    if x["key"] > y["key"]:
        x, y = y, x
    if any(set(x[g].split(";")).isdisjoint(y[g].split(";")) for g in clones.GENE_COLUMNS):
        return False
    for same, other, q in (("nuc_a", "nuc_b", "qb"), ("nuc_b", "nuc_a", "qa")):
        if x[same] == y[same] and len(x[other]) == len(y[other]):
            m = miss(x[other], y[other])
            low = x if x[q] < y[q] else y
            new = None if None in (x["new"], y["new"]) else miss(x["new"], y["new"]) if len(x["new"]) == len(y["new"]) else 9
            p = min((v["log10_p"] for v in (x, y) if v["log10_p"] is not None), default=0)
            if m == 0 or (m == 1 and min(x[q], y[q]) < 20 and low["size"] == 1 and (new is None or new <= 1 or p < -15)):
                return True
    return False


def test_components_are_those_of_all_pairs(spark, monkeypatch):
    rng = random.Random(8)
    found = 0
    for most_forms in (64, 4):
        monkeypatch.setattr(clones, "MOST_FORMS", most_forms)
        rows = []
        for i in range(420):
            base = rng.choice(["acgtac", "acgttc", "acg"])
            pick = lambda n, s=base: "".join(rng.choice("acgtnwr") if rng.random() < n else c for c in s)
            sets = [";".join(sorted({rng.choice("xyz") for _ in range(rng.randint(1, 2))})) for _ in range(4)]
            rows.append((i, "e", rng.choice("st"), *sets, pick(0.1), pick(0.25), rng.choice([5, 15, 15, 30]), rng.choice([5, 15, 30]), rng.choice(["a", "c", "ac"]), rng.choice(["g", "t"]), rng.choice([-20.0, -3.0, -3.0])))
        groups = clones.read_groups(spark.createDataFrame(rows, SCHEMA)).cache()
        labels = {r.node: r.component for r in clones.components(clones.merge_edges(groups), groups.select("node")).collect()}
        every = [r.asDict() for r in groups.collect()]
        root = {g["node"]: g["node"] for g in every}

        def find(i, root=root):
            while root[i] != i:
                i = root[i]
            return i

        for x, y in itertools.combinations(every, 2):
            if x["subject"] == y["subject"] and one_clone(x, y):
                root[max(find(x["node"]), find(y["node"]))] = min(find(x["node"]), find(y["node"]))
        assert labels == {i: find(i) for i in root}
        found += len(every) - len(set(labels.values()))
    assert found > 100


def test_edges_grow_with_a_family_not_with_its_pairs(spark):
    rng = random.Random(1)
    base = "".join(rng.choice("acgt") for _ in range(40))

    def family(n):
        rows = []
        for i in range(n):  # errors of one receptor: half of the groups are poor singletons, gene calls vary
            k = rng.randrange(40)
            nuc = base[:k] + rng.choice("acgt") + base[k + 1 :]
            rows.append((i, "e", "s", f"V1;V{i % 9}", "J1", "V2", f"J{i % 5};J9", nuc, base, 10 + i % 20, 30, "a", "c", -3.0))
        groups = clones.read_groups(spark.createDataFrame(rows, SCHEMA)).cache()
        edges = clones.merge_edges(groups)
        return groups.count(), edges.count(), edges

    n, few, _ = family(500)
    m, many, edges = family(2000)
    assert many < 12 * m and many / few < 1.5 * m / n
    assert "CartesianProduct" not in edges._jdf.queryExecution().toString()
    side = next(clones._sides(clones.read_groups(spark.createDataFrame([(i, "e", "s", "V", "J", "V", "J", base, base[:k] + c + base[k + 1 :], 10, 10, "a", "c", -3.0) for i, (k, c) in enumerate(itertools.product(range(40), "acgt"))], SCHEMA))))
    rows = clones._by_genes(side.select("*", clones.F.explode("forms").alias("form")).drop("forms", "other"))
    near = clones.near_forms(rows, clones.F.lit(True))
    per_form = collections.Counter(r.form for r in near.collect())
    assert max(per_form.values()) <= 3 * 40
