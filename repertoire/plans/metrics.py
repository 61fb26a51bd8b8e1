"""Queries of gene probabilities, metric tables, written tables, random pairs and trees, each beside the SQL that states it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repertoire.functions import sequences
from repertoire.operators import clustering, distance, diversity, junctions, motifs, neighbors, permutation, reports, trees, usage
from repertoire.operators import reads as parsing
from repertoire.operators.graph import _ready
from repertoire.plans import fixtures, germline, oracles
from repertoire.plans import reports as queries_of_reports
from repertoire.plans.base import clones, genes, r, reads
from repertoire.plans.fixtures import ctes
from repertoire.plans.oracles import DIST_EPITOPE
from repertoire.sources import contracts, paired, tables

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


# gene probabilities

_BACK_GENES = """bv as (select chain_id, unnest(list_distinct([v_rep, 'VA' || ((chain_id * 2) % 7)])) gene from background), bj as (select chain_id, unnest(list_distinct([j_rep, 'JA' || ((chain_id + 1) % 3)])) gene from background),
  nb as (select count(*) n from background), pv as (select gene, count(*) / any_value(n) p from bv, nb where gene <> 'VA6' group by gene), pj as (select gene, count(*) / any_value(n) p from bj, nb group by gene)"""


def _background_genes(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Background pseudo-probabilities of V and J genes; the background has never seen one V gene."""
    k = F.col("chain_id")
    name = lambda p, c, m: F.concat(F.lit(p), (c % m).cast("string"))
    b = fixtures.frame(spark, d, "background").select(F.array("v_rep", name("VA", k * 2, 7)).alias("V"), F.array("j_rep", name("JA", k + 1, 3)).alias("J"))
    return {"V": usage.pseudo_probabilities(b, [], "V").where("gene <> 'VA6'"), "J": usage.pseudo_probabilities(b, [], "J")}


@query(f"""{ctes('clones', 'genes', 'background')}, {_BACK_GENES}, h as (select epitope, unnest(list_distinct([va1, va2])) gene from clones), s as (select epitope, count(*) t from clones group by epitope),
  l as (select epitope, va1 gene, count(*) n from clones group by all), hp as (select epitope, gene, count(*) n from h group by all)
  select s.epitope, g.gene, round(coalesce(l.n, 0) / t, 7) label_prob, round(coalesce(hp.n, 0) / t, 7) pseudoprob, round(case when pv.p is null then 1 else coalesce(hp.n, 0) / t / pv.p end, 6) pseudoprob_enrich
  from s join (select gene from genes where chain = 'A') g on true left join l on l.epitope = s.epitope and l.gene = g.gene left join hp on hp.epitope = s.epitope and hp.gene = g.gene left join pv on pv.gene = g.gene""")
def gene_probabilities(spark, d):
    """Label and pseudo-probabilities of every V gene in every repertoire, and their enrichment over a background."""
    x = usage.gene_probabilities(clones(spark, d), "va_genes", "va1", _background_genes(spark, d)["V"], genes(spark, d).where("chain = 'A'"))
    return x.select("epitope", "gene", r("label_prob", 7).alias("label_prob"), r("pseudoprob", 7).alias("pseudoprob"), r("pseudoprob_enrich").alias("pseudoprob_enrich"))


@query(f"""{ctes('clones', 'background')}, {_BACK_GENES}, {germline._EVENTS.format(text='varchar')}, p as (select organism, chain, tag, key, n / sum(n) over (partition by organism, chain, tag) p from ev),
  rc as (select clone_id, concat('o', clone_id % 3) o, clone_id % 8 v, clone_id % 6 j, clone_id % 10 vj, [va1, va2] vs, [ja, 'JA' || ((clone_id * 2 + 1) % 3)] js from clones),
  t as (select clone_id, vs, js, case when o = 'o2' then 1 else coalesce(a.p, 0) * coalesce(b.p, 0) * coalesce(c.p, 0) end pa from rc left join p a on a.organism = o and a.chain = 'A' and a.tag = 'v_trim' and a.key = v::varchar
    left join p b on b.organism = o and b.chain = 'A' and b.tag = 'j_trim' and b.key = j::varchar left join p c on c.organism = o and c.chain = 'A' and c.tag = 'vj_insert' and c.key = vj::varchar),
  w as (select clone_id, pa, (select coalesce(max(pv.p), 0) from pv where list_contains(vs, pv.gene)) vp, (select coalesce(max(pj.p), 0) from pj where list_contains(js, pj.gene)) jp from t)
  select clone_id, round(pa, 9) cdr3a_prob, round(vp, 9) va_rep_prob, round(jp, 9) ja_rep_prob, round(pa * vp * jp, 10) a_prob from w""")
def receptor_probabilities(spark, d):
    """K6, M-7, B3: probabilities of a chain's junction and genes and their product, as a verb of an analysis."""
    k = F.col("clone_id")
    x = clones(spark, d).select("clone_id", "va_genes", "ja_genes", F.concat(F.lit("o"), (k % 3).cast("string")).alias("organism"), (k % 8).alias("v_trim"), (k % 6).alias("j_trim"), (k % 10).alias("vj_insert"))
    x = x.transform(paired.compute_probs(germline.tagged_events(spark, d), "A", _background_genes(spark, d)))
    return x.select("clone_id", *[r(c, 9).alias(c) for c in ("cdr3a_prob", "va_rep_prob", "ja_rep_prob")], r("a_prob", 10).alias("a_prob"))


@query()
def repertoire_places(spark, d):
    """Repertoires in the order of the leaves of a tree over the divergences of their gene usage."""
    x = usage.segment_divergence(clones(spark, d), {"VA": "va1", "JA": "ja", "VB": "vb1", "JB": "jb"})
    return clustering.leaf_places(x, "epitope1", "epitope2", "jsd")


# words of insertions


@query(f"""{ctes('reads')}, q as (select read_id, va, substr(nuc_a, 1, 5) || '+' || substr(nuc_a, 6, 4) || '+' || substr(nuc_a, 10, 7) s from reads), l as (select read_id, s, unnest(range(1, length(s) + 1)) i from q),
  f as (select read_id, s, i, row_number() over (partition by read_id order by i) - 1 k from l where s[i] <> '+'), o as (select read_id, s[i] x, row_number() over (partition by read_id order by md5(read_id || ':' || k)) - 1 k from f),
  sh as (select read_id, string_agg(coalesce(x, '+'), '' order by i) s from (select l.read_id, l.i, o.x from l left join f on f.read_id = l.read_id and f.i = l.i left join o on o.read_id = f.read_id and o.k = f.k) group by read_id),
  b as (select va, 'real' kind, s from q union all select va, 'rand', sh.s from sh join q using (read_id)), w as (select va, kind, substr(s, i, 3) word from (select va, kind, s, unnest(range(1, length(s) - 1)) i from b)),
  c as (select va, kind, word, count(*) n from w where not contains(word, '+') group by all)
  select * from (select va, kind, word, n, row_number() over (partition by va, kind order by n desc, word) place from c) where place <= 10""")
def insertion_words(spark, d):
    """The ten most frequent three-letter words of insertions for each gene, real and with letters in shuffled order."""
    s = F.concat(F.substr("nuc_a", F.lit(1), F.lit(5)), F.lit("+"), F.substr("nuc_a", F.lit(6), F.lit(4)), F.lit("+"), F.substr("nuc_a", F.lit(10), F.lit(7)))
    x = reads(spark, d).select("read_id", "va", s.alias("s"))
    return usage.top_words(x, ["va"], {"real": F.col("s"), "rand": junctions.shuffled_letters(F.col("s"), F.col("read_id"))}, 3)


# random receptors by place


@query(f"""{ctes('background', 'clones')}, a as (select chain_id, cdr3, row_number() over (order by md5('1:' || chain_id), chain_id) place from background),
  b as (select clone_id, cdr3b, row_number() over (order by md5('2:' || clone_id), clone_id) place from clones) select place, chain_id, cdr3, clone_id, cdr3b from a join b using (place)""")
def random_pairs(spark, d):
    """Alpha chains of the background and beta chains of clones, each in a seeded order, paired by place."""
    _ready(spark)
    a = fixtures.frame(spark, d, "background").select("chain_id", "cdr3")
    return tables.paired_random(a, clones(spark, d).select("clone_id", "cdr3b"), ids=("chain_id", "clone_id")).select("place", "chain_id", "cdr3", "clone_id", "cdr3b")


# tables as written


_HITS = "case when read_id % 4 = 0 then va || '*01:90;' || 'VA' || (read_id % 7) || '*01:90;VA9*01:40' end"


@query(f"""{ctes('reads')}, x as (select read_id, nuc_a, epitope, subject, case when read_id % 5 = 0 then '-' when read_id % 4 <> 0 then case when read_id % 3 = 0 then va else va || '*01' end end g, {_HITS} hits, read_id % 7 h, va,
    case when read_id % 6 = 1 then '9.9' end q from reads),
  l as (select *, case when hits is not null then list_sort(list_distinct([va || '*01', 'VA' || h || '*01'])) when g is null or g = '-' then null else [g] end gs from x),
  e as (select read_id, unnest(gs) gene from l), k as (select read_id, gene, case when gene like '%*%' and gene <> 'VA3*01' then 'R' || (cast(gene[3] as int) % 3) else gene end rep, case when gene like '%*%' and gene <> 'VA3*01' then 'C' || (cast(gene[3] as int) % 2) else gene end cr from e),
  m as (select read_id, string_agg(distinct rep, ';' order by rep) reps, string_agg(distinct cr, ';' order by cr) crs from k group by read_id)
  select l.read_id::varchar id, epitope, subject, coalesce(array_to_string(gs, ';'), '-') va_genes, coalesce(nullif(g, '-'), gs[1], '-') va_gene, coalesce(case when coalesce(nullif(g, '-'), gs[1]) like '%*%' and coalesce(nullif(g, '-'), gs[1]) <> 'VA3*01' then 'R' || (cast(coalesce(nullif(g, '-'), gs[1])[3] as int) % 3) else coalesce(nullif(g, '-'), gs[1]) end, '-') va_rep,
    coalesce(reps, '-') va_reps, coalesce(crs, '-') va_countreps, coalesce(q, rtrim(repeat('60.', length(nuc_a)), '.')) cdr3a_quals, coalesce(hits, '-') va_blast_hits, 'OK' status, cast({len(contracts.PARSED_SEQS)} as int) columns from l left join m using (read_id)""")
def parsed_seqs_table(spark, d):
    """A table with some fields given and the others derived, written in the order of its contract and read back."""
    k = F.col("read_id")
    gene = F.when(k % 5 == 0, "-").when(k % 4 != 0, F.when(k % 3 == 0, F.col("va")).otherwise(F.concat("va", F.lit("*01"))))
    hits = F.when(k % 4 == 0, F.concat("va", F.lit("*01:90;VA"), (k % 7).cast("string"), F.lit("*01:90;VA9*01:40")))
    x = reads(spark, d).select(
        k.cast("string").alias("id"), "epitope", "subject", gene.alias("va_gene"), hits.alias("va_blast_hits"), F.col("nuc_a").alias("cdr3a_nucseq"),
        F.when(k % 6 == 1, "9.9").alias("cdr3a_quals"), F.lit("OK").alias("status"),
    )
    n = F.substr("gene", F.lit(3), F.lit(1)).cast("int")
    classes = spark.range(10).where("id <> 3").select(F.concat(F.lit("VA"), F.col("id").cast("string"), F.lit("*01")).alias("gene"))
    classes = classes.select("gene", F.concat(F.lit("R"), (n % 3).cast("string")).alias("rep"), F.concat(F.lit("C"), (n % 2).cast("string")).alias("count_rep"))
    x = contracts.derived_qualities(contracts.derived_genes(x, "va", classes), "a")
    columns = contracts.contract("parsed_seqs")
    back = _written(spark, x, columns)
    shown = ["id", "epitope", "subject", "va_genes", "va_gene", "va_rep", "va_reps", "va_countreps", "cdr3a_quals", "va_blast_hits", "status"]
    return back.select(*[F.coalesce(c, F.lit("-")).alias(c) for c in shown], F.lit(len(back.columns)).alias("columns"))


def _written(spark: SparkSession, df: DataFrame, columns: list[str]) -> DataFrame:
    """A table written by its contract in the shared folder, and read back."""
    _ready(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    contracts.write_contract(df, path, columns, optional=columns)
    return contracts.read_contract(spark, path, columns)


@query(f"""{ctes('clones')} select clone_id::varchar clone_id, epitope, 'S' || subject subject, cdr3a, cdr3b, coalesce(nullif(array_to_string(list_sort(list_distinct([va1, va2])), ';'), ''), '-') va_genes,
  case when clone_id % 9 = 0 then '-' else clone_id || ';' || (clone_id + 1) end members, clone_size::varchar clone_size, cast({len(contracts.PARSED_SEQS) + len(contracts.PROBABILITIES) + 2} as int) columns from clones""")
def clones_table(spark, d):
    """Clones in the columns that a table of sequences with probabilities leads to, written and read back."""
    k = F.col("clone_id")
    members = F.when(k % 9 != 0, F.array(k.cast("string"), (k + 1).cast("string")))
    x = clones(spark, d).select(k.cast("string").alias("clone_id"), "epitope", F.concat(F.lit("S"), F.col("subject").cast("string")).alias("subject"), "cdr3a", "cdr3b", "va_genes", members.alias("members"), "clone_size")
    columns = contracts.contract("clones", before=contracts.contract("probs"))
    back = _written(spark, x, columns)
    shown = ["clone_id", "epitope", "subject", "cdr3a", "cdr3b", "va_genes", "members", "clone_size"]
    return back.select(*[F.coalesce(c, F.lit("-")).alias(c) for c in shown], F.lit(len(back.columns)).alias("columns"))


# qualities of junctions


_FULL = "case when read_id % 13 = 0 then 'xxxxxxxxxxxx' when read_id % 5 = 0 then 'ttt' || substr(nuc_a, 8, 9) when read_id % 5 = 1 then substr(nuc_a, 5, 4) || 'x' || substr(nuc_a, 10, 7) else substr(nuc_a, 5, 12) end"
_TURNED = lambda s: f"reverse(translate({s}, 'acgtwskmyrn', 'tgcawsmkryn'))"


@query(f"""{ctes('reads')}, x as (select read_id, case when read_id % 7 = 0 then nuc_a || substr(nuc_a, 5, 12) else nuc_a end nuc, case when read_id % 2 = 0 then {_FULL} else {_TURNED(_FULL)} end pt from reads),
  y as (select *, list_transform(range(1, length(nuc) + 1), lambda i: (read_id * 7 + i * i) % 41) q from x), s as (select read_id, false back, nuc, q, pt from y union all select read_id, true, {_TURNED('nuc')}, list_reverse(q), pt from y),
  w as (select read_id, back, i, q[i:i + 11] v, list_min(q[i:i + 11]) m from s, range(1, 60) t(i) where substr(nuc, i, 12) = pt), wb as (select read_id, v from (select *, row_number() over (partition by read_id order by back, m desc, i) k from w) where k = 1),
  pc as (select read_id, back, a, k, q[instr(nuc, substr(pt, a, k)):instr(nuc, substr(pt, a, k)) + k - 1] v from s, range(1, 13) t(a), range(1, 13) u(k) where a + k <= 13 and contains(nuc, substr(pt, a, k)) and read_id not in (select read_id from wb)),
  pb as (select * from (select *, row_number() over (partition by read_id order by k desc, back, a) o from pc) where o = 1)
  select read_id, array_to_string(case when wb.v is not null then wb.v when a is null then list_transform(range(12), lambda i: 60) else list_concat(list_transform(range(a - 1), lambda i: 60), list_concat(pb.v, list_transform(range(13 - a - k), lambda i: 60))) end, '.') quals
  from x left join wb using (read_id) left join pb using (read_id)""")
def junction_qualities(spark, d):
    """Qualities of junctions on either strand, at the best of several places, and of the largest part that is in the read."""
    k, n = F.col("read_id"), F.col("nuc_a")
    cut = lambda i, j: F.substr("nuc_a", F.lit(i), F.lit(j))
    part = F.when(k % 13 == 0, "x" * 12).when(k % 5 == 0, F.concat(F.lit("ttt"), cut(8, 9))).when(k % 5 == 1, F.concat(cut(5, 4), F.lit("x"), cut(10, 7))).otherwise(cut(5, 12))
    x = reads(spark, d).select(k, F.when(k % 7 == 0, F.concat(n, cut(5, 12))).otherwise(n).alias("nuc"), F.when(k % 2 == 0, part).otherwise(sequences.reverse_complement(part)).alias("part"))
    x = x.withColumn("q", F.transform(F.sequence(F.lit(1), F.length("nuc")), lambda i: (k * 7 + i * i) % 41))
    found = parsing.junction_qualities(F.upper("nuc"), F.col("q"), F.col("part"))
    return x.select("read_id", F.array_join(F.transform(found, lambda q: q.cast("string")), ".").alias("quals"))


# motifs

_NAMED = (
    ("^CAV", "^CAV", 40.0, 3.0), ("LF$", "LF$", 39.0, 0.5), ("AV", "AV", 38.0, 0.4), ("C.V", "C[A-Z]V", 37.0, 2.0), ("r", "[KR]", 36.0, 0.2), ("V.r", "V[A-Z]*[KR]", 35.0, 4.0),
    ("r.", "[KR][A-Z]", 34.0, 0.3), ("e", "[DE]", 33.0, 1.0), ("e.", "[DE][A-Z]", 32.0, 0.1), ("Ve", "V[A-Z]*[DE]", 31.0, 5.0), ("Z", "Z", 30.0, 0.1),
)


@query(f"""{ctes('clones')}, m(shown, pattern, chi, ex) as (values {', '.join(map(str, _NAMED))}), f as (select epitope, shown, chi + length(epitope) % 3 chi, ex, clone_id from clones join m on regexp_matches(cdr3a, pattern)),
  n as (select epitope, shown, chi, ex, count(*) n from f group by all), o as (select x.epitope, x.shown, y.shown other from f x join f y on x.epitope = y.epitope and x.clone_id = y.clone_id and x.shown <> y.shown
    join n nx on nx.epitope = x.epitope and nx.shown = x.shown join n ny on ny.epitope = y.epitope and ny.shown = y.shown where not (nx.ex < 1 and ny.ex > 1) group by x.epitope, x.shown, y.shown having count(*) >= 0.8 * max(greatest(nx.n, ny.n))),
  w as (select n.*, row_number() over (partition by epitope order by chi desc, shown) k, coalesce((select list(other) from o where o.epitope = n.epitope and o.shown = n.shown), []) others from n),
  g as (select epitope, 0 k, cast([] as varchar[]) kept from (select distinct epitope from w) union all select g.epitope, w.k, case when list_has_any(g.kept, w.others) then g.kept else list_append(g.kept, w.shown) end from g join w on w.epitope = g.epitope and w.k = g.k + 1),
  z as (select epitope, unnest(arg_max(kept, k)) shown from g group by epitope) select epitope, shown, n from z join n using (epitope, shown)""")
def motifs_kept(spark, d):
    """Motifs left beside those of higher chi-squared that the same clones match; a motif that is expected rarely is
    kept beside one that is expected often."""
    c = clones(spark, d)
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("shown"), F.lit(p).alias("pattern"), F.lit(x).alias("chi"), F.lit(e).alias("expected")) for s, p, x, e in _NAMED])).alias("m")
    m = c.select("epitope").distinct().select("epitope", each).select("epitope", "m.shown", "m.pattern", (F.col("m.chi") + F.length("epitope") % 3).alias("chi_squared"), "m.expected")
    return motifs.drop_redundant_sets(m, motifs.matched_sets(m, c, ["epitope"], "cdr3a"), ["epitope"], expected="expected")


# metrics

_WHOLE_CLONES = queries_of_reports._GRID_CLONES.replace("substr(cdr3a, 1, 4) cdr3a, substr(cdr3b, 1, 4) cdr3b", "cdr3a, cdr3b")


@query(f"{ctes('genes', 'clones')}, {DIST_EPITOPE}, {_WHOLE_CLONES} {queries_of_reports._grid_sql()}")
def sharing_grid_whole(spark, d):
    """Sharing between subjects by equal whole receptors, by genes alone and by distance."""
    x = diversity.sharing_grid(clones(spark, d), genes(spark, d))
    return x.select("mode", "chains", "epitope", "overlap", "total", r("diversity", 5).alias("diversity"), "subject_pairs", "sharing_pairs", "top3")


_AUC = f"""own as (select b.epitope, wtd from (select clone_id, wtd from nbr where chains = 'AB') x join clones b using (clone_id)), rnd as ({queries_of_reports.SQL['random_nbrdist']}),
  pts as (select epitope, round(wtd, 4) v, 1 own from own union all select ref_epitope, wtd_nbrdist, 0 from rnd), lv as (select epitope, v, sum(own) p, sum(1 - own) q from pts group by all),
  au as (select epitope, cast(sum(q * coalesce(pb, 0)) as double) / (sum(p) * sum(q)) auc from (select *, sum(p) over (partition by epitope order by v rows between unbounded preceding and 1 preceding) pb from lv) group by epitope)"""


@query(f"""{ctes('genes', 'clones')}, {DIST_EPITOPE}, near as (select * from both_ways where subject1 <> subject2), {oracles.nbr('')}, {_AUC}, {_WHOLE_CLONES}, grid as ({queries_of_reports._grid_sql()}),
  zs as ({queries_of_reports.SQL['subject_distance_tests']}), ds as (select epitope, chains, exp(-pow(dist / (25 / 1.298::double * length(chains)), 2)) k from dist),
  dv as (select epitope, chains, count(*) / sum(k) v from ds group by all), cl as (select epitope, sum(same) / sum(n * (n - 1)) p from (select epitope, subject, sum(clone_size * (clone_size - 1)) same, sum(clone_size) n from clones group by all) group by epitope),
  t as (select epitope, count(distinct subject) subjects, count(*) clones, cast(sum(clone_size) as bigint) as reads from clones group by epitope)
  select epitope, subjects, clones, reads, round(1 - cl.p, 8) clonality, round(da.v, 3) tcrdiv_a, round(db.v, 3) tcrdiv_b, round(dc.v, 3) tcrdiv_ab,
    case when ga.diversity > 0 then round(1 / ga.diversity, 7) else 0 end pshare_a, case when gb.diversity > 0 then round(1 / gb.diversity, 7) else 0 end pshare_b, case when gc.diversity > 0 then round(1 / gc.diversity, 7) else 0 end pshare_ab,
    round(auc, 5) auroc, round(-z, 3) heterogeneity
  from t left join cl using (epitope) left join (select * from dv where chains = 'A') da using (epitope) left join (select * from dv where chains = 'B') db using (epitope) left join (select * from dv where chains = 'AB') dc using (epitope)
  left join (select * from grid where mode = 'receptor' and chains = 'A') ga using (epitope) left join (select * from grid where mode = 'receptor' and chains = 'B') gb using (epitope) left join (select * from grid where mode = 'receptor' and chains = 'AB') gc using (epitope)
  left join au using (epitope) left join (select epitope, z from zs where level = 'within' and chains = 'AB') using (epitope)""")
def metric_table(spark, d):
    """One row for each repertoire with the metrics of six analyses; no sharing counts 0, other gaps are null."""
    c, g = clones(spark, d), genes(spark, d)
    clonality = diversity.clonality(c).select("epitope", (1 - F.col("p")).alias("clonality"))
    gauss = diversity.gaussian_diversity(c, g).where("same_subject")
    shared = diversity.sharing_grid(c, g).where("mode = 'receptor' and diversity > 0").withColumn("p", 1 / F.col("diversity"))
    own = distance.nearest_scores(c, g, 10, chains=("AB",))
    every = own.select("ref_epitope", "wtd_nbrdist", F.lit(True).alias("own")).unionAll(queries_of_reports.random_scores(spark, d, ("AB",)).select("ref_epitope", "wtd_nbrdist", F.lit(False)))
    auc = neighbors.roc_area(every, ["ref_epitope"], r("wtd_nbrdist", 4), F.col("own")).select(F.col("ref_epitope").alias("epitope"), F.col("auc").alias("auroc"))
    z = permutation.distance_tests(distance.permuted_sums(permutation.subject_labels(c, 6), g, "labels", 7)).where("level = 'within' and chains = 'AB'").select("epitope", (-F.col("z")).alias("heterogeneity"))
    sources = [clonality, reports.by_chains(gauss, "diversity", "tcrdiv"), reports.by_chains(shared, "p", "pshare"), auc, z]
    x = reports.metric_table(usage.totals(c), sources, zero=("pshare_a", "pshare_b", "pshare_ab"))
    digits = {"clonality": 8, "tcrdiv_a": 3, "tcrdiv_b": 3, "tcrdiv_ab": 3, "pshare_a": 7, "pshare_b": 7, "pshare_ab": 7, "auroc": 5, "heterogeneity": 3}
    return x.select("epitope", "subjects", "clones", "reads", *[r(k, n).alias(k) for k, n in digits.items()])


# trees


_STEPS = ", ".join(f"u{i + 1} as (select g, x, y, min(v) v from (select a.g, a.x, b.y, greatest(a.v, b.v) v from u{i} a join u{i} b on a.g = b.g and a.y = b.x) group by g, x, y)" for i in range(7))


def _groups(spark: SparkSession, d: str, *columns: str) -> distance.Groups:
    """Distances of chain A within each subject of an epitope."""
    return distance.Groups(clones(spark, d).withColumn("g", F.concat_ws(":", "epitope", F.col("subject").cast("string"))), genes(spark, d), "g", with_columns=columns)


@query(f"""{ctes('genes', 'clones')}, {DIST_EPITOPE}, p as (select epitope || ':' || subject1 g, id1 x, id2 y, dist v from both_ways where chains = 'A' and subject1 = subject2), ids as (select distinct g, x from p),
  u0 as (select * from p union all select g, x, x, 0 from ids), {_STEPS} select g, x id, cast(count(*) - 1 as bigint) n, round(sum(v), 4) total from u7 group by g, x having count(*) > 1""")
def single_linkage_totals(spark, d):
    """Single-linkage trees of subjects' repertoires, as the summed heights at which a clone meets the others: the
    largest step of the path between them whose largest step is smallest."""
    return clustering.single_totals(_groups(spark, d), "g").select("g", "id", "n", r("total", 4).alias("total"))


@query()
def drawn_tree(spark, d):
    """Edges of trees by geometric means of distances, with centres, scores and sizes."""
    x = clustering.drawn_trees(_groups(spark, d, "score", "clone_size"), "g", "geometric", score="score", size="clone_size")
    return x.select("g", "parent", "child", *[r(c, 5).alias(c) for c in ("parent_height", "child_height", "centre", "parent_centre", "score")], "size", "cluster")
