"""DuckDB SQL that states the driver queries independently: sequence arithmetic on exploded positions."""

from __future__ import annotations

from repertoire.functions import tables
from repertoire.plans.fixtures import ctes


def _values(table: dict) -> str:
    return ", ".join(f"('{k}', {v})" for k, v in table.items())


_SUB = f"sub(k, d) as (values {_values(tables.substitution_distance())})"
_CODE = f"code(k, aa) as (values {', '.join(f"('{k}', '{v}')" for k, v in tables.genetic_code().items())})"
_MATCH = "bases(k) as (values " + ", ".join(f"('{a}{b}')" for a in tables.IUPAC for b in tables.IUPAC if tables.base_overlap(a, b)) + ")"
_PROPS = "props(aa, charge, ges, hp) as (values " + ", ".join(f"('{a}', {tables.CHARGE.get(a, 0.0)}, {-tables.GES[a]}, {tables.HP[a]})" for a in tables.AMINO_ACIDS) + ")"

_VD = f"""{_SUB},
gp as (select a.chain, a.gene gene1, b.gene gene2, a.loops x, b.loops y, unnest(range(1, length(a.loops) + 1)) i from genes a join genes b on a.chain = b.chain),
vd as (select chain, gene1, gene2, cast(sum(case when substr(x, i, 1) = substr(y, i, 1) then 0 when substr(x, i, 1) = '.' or substr(y, i, 1) = '.' then 4 else d end) as double) dist
       from gp left join sub on k = substr(x, i, 1) || substr(y, i, 1) group by chain, gene1, gene2)"""

# half of all pairs of an epitope, chains A and B exploded by position, and their sum
_DIST = f"""{_VD},
long as (select clone_id, epitope, subject, 'A' chain, cdr3a s, va1 v1, va2 v2 from clones union all select clone_id, epitope, subject, 'B', cdr3b, vb1, vb2 from clones),
vs as (select distinct chain, v1, v2 from long),
vv as (select a.chain, a.v1, a.v2, b.v1 w1, b.v2 w2, min(dist) dist from vs a join vs b on a.chain = b.chain
       join vd on vd.chain = a.chain and vd.gene1 in (a.v1, a.v2) and vd.gene2 in (b.v1, b.v2) group by all),
pp as (select a.chain, a.epitope, a.clone_id id1, b.clone_id id2, a.subject subject1, b.subject subject2, a.v1, a.v2, b.v1 w1, b.v2 w2,
         case when length(a.s) <= length(b.s) then a.s else b.s end x, case when length(a.s) <= length(b.s) then b.s else a.s end y
       from long a join long b on a.chain = b.chain and {{pair}} and a.clone_id < b.clone_id),
px as (select *, length(x) n, length(y) - length(x) dl, least(6, 3 + (length(x) - 5) // 2) gap from pp),
pe as (select *, unnest(range(1, n + 1)) i from px),
pd as (select chain, epitope, id1, id2, subject1, subject2, v1, v2, w1, w2, dl, sum(coalesce(d, 0)) s
       from pe left join sub on ((i > 3 and i <= gap) or (i > gap and i <= n - 2)) and k = substr(x, i, 1) || substr(y, case when i <= gap then i else i + dl end, 1)
       group by all),
one as (select pd.chain chains, epitope, id1, id2, subject1, subject2, cast(3 * s + 12 * dl as double) + vv.dist dist from pd join vv on vv.chain = pd.chain
        and vv.v1 = pd.v1 and vv.v2 = pd.v2 and vv.w1 = pd.w1 and vv.w2 = pd.w2),
dist as (select * from one union all
         select 'AB', min(epitope), id1, id2, min(subject1), min(subject2), sum(dist) from one group by id1, id2),
both_ways as (select chains, epitope, id1, id2, subject1, subject2, dist from dist union all select chains, epitope, id2, id1, subject2, subject1, dist from dist)"""
_DIST_EPITOPE = _DIST.format(pair="a.epitope = b.epitope")
_DIST_ALL = _DIST.format(pair="true")

_NBR = """nn as (select *, row_number() over (partition by id1, chains{by} order by dist) rn, count(*) over (partition by id1, chains{by}) n from near),
nk as (select *, greatest(1, n // 10) k from nn),
nbr as (select id1 clone_id, chains{by}, sum(dist) / max(k) nbrdist, sum(dist * (1.0::double - (rn - 1.0::double) / k)) / ((max(k) + 1) / 2.0::double) wtd from nk where rn <= k group by id1, chains{by})"""
_NBR_OWN = f"near as (select * from both_ways where subject1 <> subject2),\n{_NBR.format(by='')}"

_RANK = """cnt as (select {keys}, v, count(*) e from vals group by {keys}, v),
rk as (select {keys}, v, e, coalesce(sum(e) over (partition by {keys} order by v rows between unbounded preceding and 1 preceding), 0) l, sum(e) over (partition by {keys}) t,
         lag(v) over (partition by {keys} order by v) ln, lead(v) over (partition by {keys} order by v) un from cnt),
ranked as (select {keys}, v, case when un is null then 100.0::double when ln is null then 0.0::double else 100.0::double * (l + (v - ln) / (un - ln) * (1 + e)) / t end rank from rk)"""

_VA = "(select clone_id, epitope, va1 rep from clones union select clone_id, epitope, va2 from clones)"
_VB = "(select clone_id, epitope, vb1 rep from clones union select clone_id, epitope, vb2 from clones)"
_TUP = "tup as (select seq_id, file, epitope, g1, g2, case when g1 = g2 then g1 else g1 || ',' || g2 end tuple from tuples)"
_TUP_SORTED = "tup as (select seq_id, file, epitope, least(g1, g2) a, greatest(g1, g2) b, case when g1 = g2 then g1 else least(g1, g2) || ',' || greatest(g1, g2) end tuple from tuples)"


def _sharing(overlap: str) -> str:
    return f"""ov as ({overlap}),
sz as (select epitope, subject, count(*) n from clones group by all),
sp as (select a.epitope, a.subject s1, b.subject s2, a.n * b.n total, coalesce(ov.overlap, 0) overlap from sz a join sz b on a.epitope = b.epitope and a.subject < b.subject
       left join ov on ov.epitope = a.epitope and ov.subject1 = a.subject and ov.subject2 = b.subject),
sr as (select *, row_number() over (partition by epitope order by overlap desc, total desc) r from sp)
select epitope, cast(sum(overlap) as bigint) overlap, cast(sum(total) as bigint) total, round(case when sum(overlap) > 0 then sum(total) / sum(overlap) else 0 end, 5) diversity,
  count(*) subject_pairs, cast(sum(case when overlap > 0 then 1 else 0 end) as bigint) sharing_pairs, string_agg(cast(overlap as varchar), ' ' order by r) filter (where r <= 3) top3 from sr group by epitope"""


# frequencies after one allocation of tuples (epitope, a, b, n) by a bias (epitope, rep, p)
def _allocate(name: str, counts: str, bias: str) -> str:
    return f"""{name} as (select epitope, rep, sum(case when w1 + coalesce(w2, 0) = 0 then n * 1.0::double / k else n * w / (w1 + coalesce(w2, 0)) end) / max(t) p from (
  select c.epitope, c.rep, c.n, c.k, c.t, coalesce(b0.p, 0) w, coalesce(b1.p, 0) w1, case when c.k = 2 then coalesce(b2.p, 0) end w2
  from (select epitope, unnest(case when a = b then [a] else [a, b] end) rep, a, b, n, case when a = b then 1 else 2 end k, sum(n) over (partition by epitope) t0,
          (select sum(n) from {counts} z where z.epitope = {counts}.epitope) t from {counts}) c
  left join {bias} b0 on b0.epitope = c.epitope and b0.rep = c.rep left join {bias} b1 on b1.epitope = c.epitope and b1.rep = c.a
  left join {bias} b2 on b2.epitope = c.epitope and b2.rep = c.b) group by epitope, rep)"""


def _uniform(name: str, counts: str) -> str:
    return f"{name} as (select epitope, rep, 1.0::double / count(*) over (partition by epitope) p from (select epitope, a rep from {counts} union select epitope, b from {counts}))"


def _jsd(p: str, q: str) -> str:
    part = lambda v: f"case when {v} > 0 then {v} * log2({v}) else 0 end"
    return f"""select epitope, (hp + hq) / 2 - hm jsd, case when hp + hq < 0 then 2 * ((hp + hq) / 2 - hm) / -(hp + hq) else 0 end jsd_normed from (
  select epitope, sum({part("x")}) hp, sum({part("y")}) hq, sum({part("((x + y) / 2)")}) hm
  from (select coalesce(p.epitope, q.epitope) epitope, coalesce(p.p, 0) x, coalesce(q.p, 0) y from {p} p full join {q} q on p.epitope = q.epitope and p.rep = q.rep) group by epitope)"""


_FG_BG = f"""{_TUP_SORTED},
fg as (select epitope, a, b, count(*) n from tup group by all),
bg as (select e.epitope, a, b, n from (select a, b, count(*) n from tup where file = 'FO' group by all), (select distinct epitope from tup) e),
{_uniform("uf", "fg")}, {_uniform("ub", "bg")}, {_allocate("f0", "fg", "uf")}, {_allocate("b0", "bg", "ub")}"""
_ROUNDS = ", ".join(f"{_allocate(f'b{i}', 'bg', f'f{i - 1}')}, {_allocate(f'f{i}', 'fg', f'b{i}')}" for i in range(1, 6))
_USE = f"""va as {_VA},
use as (select epitope, rep, count(*) / sum(count(*)) over (partition by epitope) p from va group by epitope, rep)"""

_ATOMS = {**{a: a for a in tables.AMINO_ACIDS}, **tables.RESIDUE_GROUPS}
_SEEDS = f"""first(fs, fp) as (values {", ".join(f"('{k}', '{v}')" for k, v in {**_ATOMS, "^": "^"}.items())}),
last(ls, lp) as (values {", ".join(f"('{k}', '{v}')" for k, v in {**_ATOMS, "$": "$"}.items())}),
seeds as (select fs || repeat('.', cast(g as bigint)) || ls shown, fp || repeat('[A-Z]', cast(g as bigint)) || lp pattern
          from (select fs, fp, ls, lp, unnest(range(0, case when fs = '^' or ls = '$' then 8 else 6 end)) g from first, last))"""
_SUPPORT = f"""{_SEEDS},
fs as (select epitope, cdr3a, count(*) c from clones group by all),
sup as (select epitope, shown, cast(sum(c) as bigint) n from fs join seeds on regexp_matches(cdr3a, pattern) group by all)"""
_FOUR = "four(shown, pattern) as (values ('A', 'A[A-Z][KR]'), ('B', '^CAV[DE]'), ('C', '[NQ][A-Z]LF$'), ('D', '[KR]'))"

_MEANS = f"""{_PROPS},
letters as (select clone_id, epitope, 'A' chains, unnest(string_split(cdr3a, '')) aa from clones union all select clone_id, epitope, 'B', unnest(string_split(cdr3b, '')) from clones),
per as (select clone_id, epitope, chains, count(*) length, sum(charge) charge, sum(ges) ges, sum(hp) hp from letters join props using (aa) group by all),
pab as (select * from per union all select clone_id, epitope, 'AB', sum(length), sum(charge), sum(ges), sum(hp) from per group by clone_id, epitope),
means as (select epitope, chains, avg(length) length, avg(charge) charge, avg(ges) ges, avg(hp) hp from pab group by epitope, chains)"""
_CLONALITY = """sub_ as (select epitope, subject, sum(clone_size * (clone_size - 1)) same, sum(clone_size) n from clones group by all),
clonality as (select epitope, sum(same) / sum(n * (n - 1)) p from sub_ group by epitope)"""


def _translate(name: str, strand: str, offset: int) -> str:
    return f"""{name} as (select read_id, coalesce(string_agg(coalesce(aa, 'X'), '' order by i), '') p from (
  select read_id, i, substr(s, cast({offset} + 3 * i + 1 as bigint), 3) k from (select read_id, s, unnest(range(0, (length(s) - {offset}) // 3)) i from (select read_id, {strand} s from reads))) left join code using (k) group by read_id)"""


_REV = "reverse(translate(nuc_a, 'acgtwskmyrn', 'tgcawsmkryn'))"
_THREE = "m(shown, pattern) as (values ('A.K', 'A[A-Z][KR]'), ('^CAVd', '^CAV[DE]'), ('n.LF$', '[NQ][A-Z]LF$'))"
_FILES = "fn as (select file, epitope tag, g1 key, count(*) n from tuples group by all), f as (select file, tag, key, n / sum(n) over (partition by file, tag) p from fn)"
_PSEUDO = """pf as (select file, key rep, p from f where tag = 'N'), pg as (select rep, file from (select distinct rep from pf), (select distinct file from pf)),
pm as (select rep, case when count(*) <= 2 then avg(coalesce(p, 0)) else median(coalesce(p, 0)) end p from pg left join pf using (rep, file) group by rep),
ps as (select rep, p / least(1.0::double, sum(p) over ()) p from pm)"""
_CONTIGS = """contigs as (select 'ct' || (l_orderkey % 997) ct, l_orderkey % 997 k, 'bc' || (l_orderkey % 4999) bc, l_linenumber % 5 <> 0 productive, case when l_partkey % 2 = 0 then 'TRA' else 'TRB' end chain,
  'V' || (l_partkey % 5) v, 'J' || (l_suppkey % 3) j, case when l_suppkey % 9 = 0 then 'None' else 'CA' || (l_partkey % 7) end cdr3, 'tgt' || (l_suppkey % 3) nt, cast(l_quantity as bigint) umis from lineitem)"""
_C2 = "(select *, 'JA' || ((clone_id * 2 + 1) % 3) ja2 from clones)"
# read groups as receptors with two V and two J genes a chain
_RECEPTORS = """rc as (select read_id id, epitope, subject, nuc_a a, nuc_b b, [va, 'VA' || ((read_id * 5 + 1) % 7)] va, [ja, 'JA' || ((read_id * 2 + 1) % 3)] ja,
  [vb, 'VB' || ((read_id * 3 + 1) % 5)] vb, [jb, 'JB' || ((read_id * 3 + 1) % 4)] jb from reads)"""

#: Parts that other modules' SQL is made of.
VD, DIST_EPITOPE, DIST_ALL, FG_BG, ROUNDS, SUPPORT, jsd, sharing = _VD, _DIST_EPITOPE, _DIST_ALL, _FG_BG, _ROUNDS, _SUPPORT, _jsd, _sharing


def nbr(by: str) -> str:
    """Neighbour scores of the pairs ``near``, by further columns."""
    return _NBR.format(by=by)


ORACLES = {
    "quality_min_filter": f"{ctes('reads')} select read_id, qual - 3 least from reads where qual - 3 >= 20",
    "cdr3_filter_status": f"""{ctes('clones')} select clone_id, case when s = '' then 'OK' else s end status from (select clone_id,
      concat_ws(';', case when length(cdr3a) not between 9 and 13 then 'a_length' end, case when length(cdr3b) not between 9 and 14 then 'b_length' end,
      case when not regexp_full_match(cdr3a, '[ACDEFGHIKLMNPQRSTVWY]+') then 'a_residue' end) s from clones)""",
    "seq_revcomp_translate": f"""{ctes('reads')}, {_CODE}, {_translate('t1', 'nuc_a', 0)}, {_translate('t2', _REV, 1)}
      select read_id, {_REV} revcomp, t1.p p1, t2.p m2 from reads join t1 using (read_id) join t2 using (read_id)""",
    "seq_mismatch_iupac": f"""{ctes('reads')}, {_MATCH}, ref as (select subject, epitope, arg_min(nuc_a, read_id) ref from reads group by all),
      px as (select read_id, nuc_a, ref, unnest(range(1, length(nuc_a) + 1)) i from reads join ref using (subject, epitope))
      select read_id, cast(sum(case when k is null then 1 else 0 end) as int) mismatches from px left join bases on k = substr(nuc_a, i, 1) || substr(ref, i, 1) group by read_id""",
    "seq_property_sums": f"""{ctes('clones')}, {_PROPS} select clone_id, round(cast(sum(charge) as double), 4) + 0.0::double charge, round(cast(sum(ges) as double), 4) + 0.0::double ges,
      round(cast(sum(hp) as double), 4) + 0.0::double hp from (select clone_id, unnest(string_split(cdr3b, '')) aa from clones) join props using (aa) group by clone_id""",
    "cdr3_properties": f"{ctes('clones')}, {_MEANS} select epitope, chains, round(length, 5) length, round(charge, 5) charge, round(ges, 5) ges, round(hp, 5) hp from means",
    "cdr3_length_histogram": f"{ctes('clones')} select epitope, cast(length(cdr3b) as int) as value, count(*) n from clones group by all",
    "v_region_distance": f"{ctes('genes')}, {_VD} select chain, gene1, gene2, dist from vd",
    "cdr3_pairs_in_band": f"""{ctes('genes', 'clones')}, {_DIST_EPITOPE} select id1, id2, cast(3 * s + 12 * dl as double) dist from pd where chain = 'A' and 3 * s + 12 * dl <= 19""",
    "receptor_pairs_within": f"{ctes('genes', 'clones')}, {_DIST_EPITOPE} select chains, id1, id2, dist from dist where dist <= 25 / 1.298::double * length(chains)",
    "receptor_distance_sums": f"""{ctes('genes', 'clones')}, {_DIST_EPITOPE} select epitope, chains, subject1 = subject2 same_subject, count(*) pairs, round(avg(dist), 6) mean_dist from both_ways group by all""",
    "nbrdist_10": f"{ctes('genes', 'clones')}, {_DIST_EPITOPE}, {_NBR_OWN} select clone_id, chains, round(nbrdist, 4) nbrdist, round(wtd, 4) wtd_nbrdist from nbr",
    "nbrdist_rank": f"""{ctes('genes', 'clones')}, {_DIST_EPITOPE}, {_NBR_OWN},
      vals as (select clone_id, epitope, chains, round(wtd, 4) v from nbr join clones using (clone_id)), {_RANK.format(keys='epitope, chains')}
      select clone_id, chains, v wtd_nbrdist, round(rank, 4) rank from vals join ranked using (epitope, chains, v)""",
    "avg_nbrdist": f"{ctes('genes', 'clones')}, {_DIST_EPITOPE}, {_NBR_OWN} select epitope, chains, round(avg(nbrdist), 4) mean_nbrdist from nbr join clones using (clone_id) group by all",
    "auc_vs_others": f"""{ctes('genes', 'clones')}, {_DIST_ALL}, near as (select b.*, c.epitope ref from both_ways b join clones c on c.clone_id = b.id2 where subject1 <> subject2),
      {_NBR.format(by=', ref')}, sc as (select chains, ref ref_epitope, round(wtd, 4) s, c.epitope = ref own from nbr join clones c using (clone_id)),
      bins as (select chains, ref_epitope, s, sum(case when own then 1 else 0 end) p, sum(case when own then 0 else 1 end) n from sc group by all),
      run as (select *, coalesce(sum(p) over (partition by chains, ref_epitope order by s rows between unbounded preceding and 1 preceding), 0) b from bins)
      select chains, ref_epitope, round(cast(sum(b * n) as double) / (sum(p) * sum(n)), 5) auc from run group by chains, ref_epitope""",
    "score_rank": f"""{ctes('clones')}, vals as (select clone_id, epitope, round(score, 6) v from clones), {_RANK.format(keys='epitope')}
      select clone_id, round(rank, 4) rank from vals join ranked using (epitope, v)""",
    "score_auc": f"""{ctes('clones')}, bins as (select epitope, round(score, -2) s, sum(case when clone_size > 2 then 1 else 0 end) p, sum(case when clone_size > 2 then 0 else 1 end) n from clones group by all),
      run as (select *, coalesce(sum(p) over (partition by epitope order by s rows between unbounded preceding and 1 preceding), 0) b from bins)
      select epitope, round(cast(sum(b * n) as double) / (sum(p) * sum(n)), 6) auc from run group by epitope""",
    "repertoire_distance": f"""{ctes('genes', 'clones')}, {_DIST_ALL}, near as (select b.*, c.epitope ref from both_ways b join clones c on c.clone_id = b.id2),
      {_NBR.format(by=', ref')} select c.epitope, ref ref_epitope, chains, round(avg(wtd), 4) mean_wtd from nbr join clones c using (clone_id) group by all""",
    "clonality_simpson": f"{ctes('clones')}, {_CLONALITY} select epitope, round(p, 9) p, round(case when p = 0 then 0 else 1 / p end, 4) diversity, round(1 - p, 9) evenness from clonality",
    "clonality_subjects": f"{ctes('clones')}, {_CLONALITY} select epitope, subject, cast(n as bigint) as reads, round(case when n > 1 then same / (n * (n - 1)) else 0 end, 9) p from sub_",
    "tcrdiv_gaussian": f"""{ctes('genes', 'clones')}, {_DIST_EPITOPE}, g as (select epitope, chains, subject1 = subject2 same, exp(-pow(dist / (25 / 1.298::double * length(chains)), 2)) k from dist),
      h as (select epitope, chains, k, unnest(case when same then [true] else [true, false] end) same_subject from g)
      select epitope, chains, same_subject, round(sum(k), 4) overlap, cast(count(*) as double) pairs, round(count(*) / sum(k), 4) diversity from h group by all""",
    "gaussian_shannon": f"""{ctes('genes', 'clones')}, {_DIST_EPITOPE}, g as (select epitope, chains, id1, avg(exp(-pow(dist / (25 / 1.298::double * length(chains)), 2))) k from both_ways group by all)
      select epitope, chains, round(avg(-ln(k)), 5) entropy, round(pow(2.0::double, avg(-ln(k))), 4) diversity, count(*) n from g group by all""",
    "gene_sharing": f"""{ctes('clones')}, {_sharing("select a.epitope, a.subject subject1, b.subject subject2, count(*) overlap from {_C2} a join {_C2} b on a.epitope = b.epitope and a.subject < b.subject and (a.ja in (b.ja, b.ja2) or a.ja2 in (b.ja, b.ja2)) and (a.va1 in (b.va1, b.va2) or a.va2 in (b.va1, b.va2)) group by all".replace("{_C2}", _C2))}""",
    "threshold_sharing": f"""{ctes('genes', 'clones')}, {_DIST_EPITOPE},
      {_sharing("select epitope, least(subject1, subject2) subject1, greatest(subject1, subject2) subject2, count(*) overlap from dist where chains = 'B' and subject1 <> subject2 and dist <= 25 / 1.298::double group by all")}""",
    "exact_sharing": f"""{ctes('reads')}, {_RECEPTORS} select id clone_id, exists (select 1 from rc y where y.epitope = x.epitope and y.a = x.a and y.b = x.b and y.subject <> x.subject
      and list_has_any(x.va, y.va) and list_has_any(x.ja, y.ja) and list_has_any(x.vb, y.vb) and list_has_any(x.jb, y.jb)) is_shared from rc x""",
    "cross_reactivity": f"""{ctes('reads')}, {_RECEPTORS}, k as (select distinct a, list_sort(list_distinct(va)) va from rc), m as (select distinct k.a, k.va, y.epitope, y.subject from k join rc y on y.a = k.a and list_has_any(k.va, y.va)),
      w as (select a, va, count(distinct subject) n_subjects_any, count(distinct epitope) n_epitopes, string_agg(distinct epitope, ';' order by epitope) epitopes from m group by all),
      o as (select a, va, epitope, count(distinct subject) n_subjects from m group by all)
      select x.id clone_id, n_subjects, n_subjects_any, n_epitopes, epitopes from (select id, epitope, a, list_sort(list_distinct(va)) va from rc) x join w using (a, va) join o using (a, va, epitope)""",
    "rep_counts": f"{ctes('clones')}, va as {_VA} select epitope, rep, count(*) n from va group by all",
    "label_rep": f"""{ctes('clones')}, va as {_VA}, c as (select epitope, rep, count(*) n from va group by all)
      select clone_id, arg_max(rep, (n, rep)) as label from va join c using (epitope, rep) group by clone_id""",
    "label_ranks": f"""{ctes('clones')}, vb as {_VB}, c as (select epitope, rep, count(*) n from vb group by all), l as (select clone_id, epitope, arg_max(rep, (n, rep)) as label from vb join c using (epitope, rep) group by all)
      select epitope, label, count(*) n, cast(row_number() over (partition by epitope order by count(*) desc, label desc) as int) rank from l group by epitope, label""",
    "rep_pair_counts": f"""{ctes('clones')}, g as (select * from (select distinct epitope, va1 from clones) join (select distinct epitope, jb from clones) using (epitope))
      select g.epitope, g.va1, g.jb, count(clone_id) n from g left join clones c on c.epitope = g.epitope and c.va1 = g.va1 and c.jb = g.jb group by all""",
    "usage_entropy": f"{ctes('clones')}, {_USE} select epitope, round(-sum(p * log2(p)), 6) entropy, round(pow(2.0::double, -sum(p * log2(p))), 5) effective from use group by epitope",
    "mutual_information": f"""{ctes('clones')}, j as (select epitope, va1, jb, count(*) n from clones group by all), k as (select epitope, n, sum(n) over (partition by epitope, va1) a, sum(n) over (partition by epitope, jb) b,
      sum(n) over (partition by epitope) t from j) select epitope, round(sum(n / t * log2(n * t / (a * b))), 8) mi from k group by epitope""",
    "jsd_normed": f"""{ctes('clones')}, {_USE}, q as (select e.epitope, rep, p from (select rep, count(*) / sum(count(*)) over () p from va where rep <> 'VA3' group by rep), (select distinct epitope from clones) e)
      select epitope, round(jsd, 8) jsd, round(jsd_normed, 8) jsd_normed from ({_jsd('use', 'q')})""",
    "gene_enrichment": f"""{ctes('clones')}, {_USE}, q as (select rep, count(*) / sum(count(*)) over () b from va group by rep)
      select epitope, rep, round(p, 8) p, round(b, 8) background, round(p / b, 7) enrich from use join q using (rep)""",
    "tuple_counts_distinct": f"{ctes('tuples')}, {_TUP_SORTED}, u as (select seq_id, any_value(file) file, any_value(tuple) tuple from tup group by seq_id) select file, tuple, count(*) n from u group by all",
    "ambiguous_allocation": f"{ctes('tuples')}, {_FG_BG} select epitope, rep, round(p, 8) p from f0",
    "jsd_allocation_5iter": f"{ctes('tuples')}, {_FG_BG}, {_ROUNDS} " + " union all ".join(f"select epitope, {i} as round, round(jsd_normed, 7) jsd_normed from ({_jsd(f'f{i}', f'b{i}')})" for i in range(1, 6)),
    "freqs_unique_nonunique": f"""{ctes('tuples')}, {_TUP}, x as (select file, unnest(case when g1 = g2 then [g1] else [g1, g2] end) rep, case when g1 = g2 then 1 else 0 end u from tup)
      select file, rep, count(*) n, cast(sum(u) as bigint) n_unique from x group by all""",
    "vj_log_enrichment": f"""{ctes('clones')}, a as (select va1, count(*) na from clones group by all), b as (select jb, count(*) nb from clones group by all), j as (select va1, jb, count(*) n from clones group by all),
      g as (select va1, jb, coalesce(n, 0) n, na * nb / (select count(*) from clones)::double e from a cross join b left join j using (va1, jb))
      select va1, jb, n, round(e, 5) expected, round(ln((case when n > 0 then n else least(e, 0.25::double) end) / e), 6) log_enrich from g""",
    "kmer_topk": f"{ctes('reads')}, k as (select substr(nuc_a, i, 3) kmer from (select nuc_a, unnest(range(1, length(nuc_a) - 1)) i from reads)) select kmer, count(*) n from k group by kmer order by n desc, kmer limit 10",
    "share_by_length": f"{ctes('clones')} select epitope, cast(length(cdr3b) as int) length, vb1 as label, count(*) n, round(count(*) / sum(count(*)) over (partition by epitope, length(cdr3b)), 7) share from clones group by epitope, length(cdr3b), vb1",
    "subject_epitope_cube": f"{ctes('clones')} select subject, epitope, count(*) clones, cast(sum(clone_size) as bigint) as reads, arg_max(clone_id, (clone_size, -clone_id)) top_clone from clones group by cube (subject, epitope)",
    "summary_table": f"""{ctes('clones')}, {_MEANS}, {_CLONALITY}, t as (select epitope, count(distinct subject) subjects, count(*) clones, cast(sum(clone_size) as bigint) as reads from clones group by epitope)
      select t.epitope, subjects, clones, reads, round(p, 9) p, round(length, 5) length, round(charge, 5) charge from t left join clonality using (epitope) left join (select * from means where chains = 'AB') using (epitope)""",
    "clone_calling": f"""{ctes('reads')}, {_MATCH},
      rd as (select read_id, epitope, subject, va || ';VA' || (read_id % 7) va, ja, vb, jb || ';JB' || (read_id % 4) jb, nuc_a, nuc_b, qual,
             substr(nuc_a, 13, 6) || ' ' || substr(nuc_b, 10, cast(read_id % 2 + 5 as int)) nw, -10 - cast(read_id % 8 as int) lp from reads),
      gr as (select concat_ws('|', epitope, subject, va, ja, vb, jb, nuc_a, nuc_b) key, epitope, subject, va, ja, vb, jb, nuc_a, nuc_b, count(*) size, max(qual) q, min(read_id) fr, min(nw) nw, min(lp) lp from rd group by all),
      cand as (select a.key a, b.key b, a.nuc_a || a.nuc_b x, b.nuc_a || b.nuc_b y, a.q qa, b.q qb, case when a.q < b.q then a.size else b.size end low, a.nw nx, b.nw ny, least(a.lp, b.lp) lp
               from gr a join gr b on a.epitope = b.epitope and a.subject = b.subject and list_has_any(string_split(a.va, ';'), string_split(b.va, ';')) and list_has_any(string_split(a.ja, ';'), string_split(b.ja, ';'))
               and list_has_any(string_split(a.vb, ';'), string_split(b.vb, ';')) and list_has_any(string_split(a.jb, ';'), string_split(b.jb, ';'))
               and a.key < b.key and length(a.nuc_a) = length(b.nuc_a) and length(a.nuc_b) = length(b.nuc_b) and (a.nuc_a = b.nuc_a or a.nuc_b = b.nuc_b)),
      nm as (select a, b, sum(case when k is null then 1 else 0 end) nm from (select a, b, nx, ny, unnest(range(1, length(nx) + 1)) i from cand where length(nx) = length(ny))
             left join (select k from bases union all select '  ') on k = substr(nx, i, 1) || substr(ny, i, 1) group by a, b),
      ce as (select a, b, qa, qb, low, lp, x, y, unnest(range(1, length(x) + 1)) i from cand),
      ed as (select a, b from (select a, b, any_value(qa) qa, any_value(qb) qb, any_value(low) low, any_value(lp) lp, sum(case when k is null then 1 else 0 end) mm from ce left join bases on k = substr(x, i, 1) || substr(y, i, 1) group by a, b)
             left join nm using (a, b) where mm = 0 or (mm = 1 and least(qa, qb) < 20 and low = 1 and (coalesce(nm, 9) <= 1 or lp < -15))),
      e2 as (select a, b from ed union select b, a from ed),
      reach(a, b) as (select key, key from gr union select reach.a, e2.b from reach join e2 on e2.a = reach.b),
      comp as (select a key, min(b) c from reach group by a),
      cl as (select epitope, subject, c, arg_max(fr, (size, q, key)) rep, arg_max(q, (size, q, key)) rq, cast(sum(size) as bigint) clone_size, string_agg(cast(fr as varchar), ';' order by fr) members from gr join comp using (key) group by all)
      select cast(rep as varchar) || '.clone' clone_id, epitope, subject, clone_size, members from cl where clone_size > 1 or rq >= 20""",
    "pair_enrichment_tails": f"""{ctes('clones')}, c as (select v.epitope, v.va1, j.jb, count(clone_id) n from (select distinct epitope, va1 from clones) v join (select distinct epitope, jb from clones) j on v.epitope = j.epitope
      left join clones x on x.epitope = v.epitope and x.va1 = v.va1 and x.jb = j.jb group by all),
      m as (select *, sum(n) over (partition by epitope)::double t, sum(n) over (partition by epitope, va1)::double a, sum(n) over (partition by epitope, jb)::double b from c),
      k as (select *, unnest(range(cast(greatest(0, a + b - t) as bigint), cast(least(a, b) as bigint) + 1))::double k from m),
      p as (select *, exp((lgamma(a + 1) - lgamma(k + 1) - lgamma(a - k + 1)) + (lgamma(t - a + 1) - lgamma(b - k + 1) - lgamma(t - a - b + k + 1)) - (lgamma(t + 1) - lgamma(b + 1) - lgamma(t - b + 1))) p from k)
      select epitope, va1, jb, n, round(least(1, sum(case when k >= n then p else 0 end)), 8) enriched, round(least(1, sum(case when k <= n then p else 0 end)), 8) depleted from p group by epitope, va1, jb, n""",
    "fisher_shared_clonal": f"""{ctes('clones')}, c as (select epitope, sum((clone_size > 2 and score > 0)::int) w, sum((clone_size > 2 and score <= 0)::int) x, sum((clone_size <= 2 and score > 0)::int) y, sum((clone_size <= 2 and score <= 0)::int) z from clones group by all),
      m as (select *, (w + x + y + z)::double t, (w + x)::double a, (w + y)::double b from c),
      k as (select *, unnest(range(cast(greatest(0, a + b - t) as bigint), cast(least(a, b) as bigint) + 1))::double k from m),
      p as (select *, exp((lgamma(a + 1) - lgamma(k + 1) - lgamma(a - k + 1)) + (lgamma(t - a + 1) - lgamma(b - k + 1) - lgamma(t - a - b + k + 1)) - (lgamma(t + 1) - lgamma(b + 1) - lgamma(t - b + 1))) p from k), o as (select epitope, p own from p where k = w)
      select epitope, cast(w as bigint) a, cast(x as bigint) b, cast(y as bigint) c, cast(z as bigint) e, round(least(1, sum(case when ln(p) <= ln(own) + 1e-7 then p else 0 end)), 8) p from p join o using (epitope) group by epitope, w, x, y, z""",
    "gene_classes": f"""{ctes('genes')}, bl(k, sc) as (values {_values({f"{k}": v for k, v in tables.blosum62().items()})}),
      pr as (select a.gene a, b.gene b, unnest(string_split(a.loops, '')) p, unnest(string_split(b.loops, '')) q from genes a join genes b on a.chain = b.chain and length(a.loops) = length(b.loops) and a.gene <> b.gene),
      nb as (select a, b from pr left join bl on k = p || q group by a, b having sum(case when p <> q then 1 else 0 end) <= 2 and sum(case when p <> q and coalesce(sc, -9) < 1 then 1 else 0 end) = 0),
      reach(a, b) as (select gene, gene from genes union select reach.a, nb.b from reach join nb on nb.a = reach.b), mm as (select a gene, min(b) mm1_rep from reach group by a)
      select gene, min(gene) over (partition by chain, loops) rep, mm1_rep from genes join mm using (gene)""",
    "clone_gene_consensus": f"""{ctes('tuples')}, {_TUP}, x as (select seq_id // 8 order_id, unnest(case when g1 = g2 then [g1] else [g1, g2] end) g from tup), c as (select order_id, g, count(*) n from x group by all),
      m as (select *, max(n) over (partition by order_id) m from c) select order_id, string_agg(g, ';' order by g) genes from m where n = m group by order_id""",
    "average_scores": f"""{ctes('reads')} select subject, round(coalesce(avg(case when read_id % 3 <> 0 then cast(qual as double) end), 9.6::double), 6) score from reads group by subject""",
    "clonality_fraction": f"""{ctes('clones')}, m as (select clone_id, clone_size, max(clone_size) over (partition by epitope) m from clones)
      select clone_id, round(case when m > 1 then (pow(clone_size::double, 1 / 3.0::double) - 1) / (pow(m::double, 1 / 3.0::double) - 1) else 0 end, 8) fraction from m""",
    "nonzero_probability": f"""{ctes('clones')} select clone_id, epitope, case when score > 0 then score else min(case when score > 0 then score end) over (partition by epitope) end score from clones""",
    "score_correlations": f"""{ctes('clones')}, x as (select epitope, length(cdr3b)::double x, score y from clones), k as (select *, rank() over (partition by epitope order by x) + (count(*) over (partition by epitope, x) - 1) / 2 rx,
      rank() over (partition by epitope order by y) + (count(*) over (partition by epitope, y) - 1) / 2 ry from x)
      select epitope, round(corr(x, y), 6) pearson, round(corr(rx, ry), 6) spearman, round(regr_slope(y, x), 6) slope, round(regr_intercept(y, x), 6) intercept from k group by epitope""",
    "score_mean_sdev_median": f"{ctes('clones')} select epitope, round(avg(score), 6) mean, round(stddev_pop(score), 6) sdev, round(median(score), 6) median from clones group by epitope",
    "empirical_cdf": f"{ctes('clones')} select distinct epitope, cast(length(cdr3a) as int) len, round(cume_dist() over (partition by epitope order by length(cdr3a)), 8) cdf from clones",
    "kde_grid": f"""{ctes('clones')}, s as (select epitope, stddev_samp(length(cdr3b)) * pow(count(*)::double, -0.2::double) h, count(*) t from clones group by epitope),
      g as (select c.epitope, length(cdr3b) v, h, t, i from clones c join s on s.epitope = c.epitope, range(0, 100) r(i))
      select epitope, cast(i as int) i, round(sum(exp(-pow((i * 30.0::double / 99 - v) / h, 2) / 2) / (h * sqrt(2 * pi()))) / max(t), 8) density from g group by epitope, i""",
    "rank_sum_test": f"""{ctes('clones')}, x as (select epitope, round(score, 0) v, clone_size > 2 f from clones), k as (select *, rank() over (partition by epitope order by v) + (count(*) over (partition by epitope, v) - 1) / 2 r,
      count(*) over (partition by epitope, v) c from x), s as (select epitope, sum(case when f then r end) r, sum(case when f then 1.0::double else 0 end) a, count(*)::double t, sum(c::double * c - 1) ties from k group by epitope)
      select epitope, round(r - a * (a + 1) / 2, 3) u, round((r - a * (a + 1) / 2 - a * (t - a) / 2) / sqrt(a * (t - a) / 12 * (t + 1 - ties / (t * (t - 1)))), 6) z from s""",
    "min_other_score": f"""{ctes('clones')}, m as (select subject, epitope, round(avg(score), 5) s from clones group by all)
      select a.subject, a.epitope, min(b.s) least, arg_min(b.epitope, (b.s, b.epitope)) other from m a join m b on a.subject = b.subject and a.epitope <> b.epitope group by all""",
    "motif_seed_support": f"{ctes('clones')}, {_SUPPORT} select epitope, shown, n from sup where n >= 10",
    "motif_scores": f"""{ctes('clones', 'background')}, {_SUPPORT}, bs as (select cdr3, count(*) c from background group by all), bk as (select shown, sum(c) b from bs join seeds on regexp_matches(cdr3, pattern) group by all),
      t as (select epitope, count(*) total from clones group by all),
      s as (select epitope, shown, n, coalesce(b, 0) * total / (select count(*) from background)::double e from sup join t using (epitope) left join bk using (shown) where n >= 10)
      select epitope, shown, n, round(e, 6) expected, round(pow(n - greatest(0.25::double, e), 2) / greatest(0.25::double, e), 5) chi_squared from s
      where n > 2 * e and pow(n - greatest(0.25::double, e), 2) / greatest(0.25::double, e) > 2""",
    "motif_matches": f"""{ctes('clones')}, m(shown, pattern) as (values ('A.K', 'A[A-Z][KR]'), ('^CAVd', '^CAV[DE]'), ('n.LF$', '[NQ][A-Z]LF$'))
      select epitope, shown, clone_id from clones join m on regexp_matches(cdr3a, pattern)""",
    "motif_overlap_distance": f"""{ctes('clones')}, {_FOUR}, f as (select epitope, shown, clone_id from clones join four on regexp_matches(cdr3a, pattern)), n as (select epitope, shown, count(*) n from f group by all),
      c as (select a.epitope, a.shown shown1, b.shown shown2, count(*) c from f a join f b on a.epitope = b.epitope and a.clone_id = b.clone_id and a.shown < b.shown group by all)
      select c.epitope, shown1, shown2, round(1 - c / greatest(x.n, y.n)::double, 7) dist from c join n x on x.epitope = c.epitope and x.shown = shown1 join n y on y.epitope = c.epitope and y.shown = shown2""",
    "pwm": f"""{ctes('clones')}, l as (select epitope, length(cdr3a) length, i - 1 pos, substr(cdr3a, i, 1) letter from (select epitope, cdr3a, unnest(range(1, length(cdr3a) + 1)) i from clones)),
      c as (select epitope, length, pos, letter, count(*) n from l group by all), g as (select epitope, length, pos, unnest(string_split('{tables.AMINO_ACIDS}', '')) letter from (select distinct epitope, length, pos from c))
      select epitope, cast(length as int) length, cast(pos as int) pos, letter, round(coalesce(n, 0) / sum(coalesce(n, 0)) over (partition by epitope, length, pos), 8) freq from g left join c using (epitope, length, pos, letter)""",
    "consensus": f"""{ctes('clones')}, l as (select epitope, length(cdr3b) length, i, substr(cdr3b, i, 1) letter from (select epitope, cdr3b, unnest(range(1, length(cdr3b) + 1)) i from clones)),
      c as (select epitope, length, i, letter, count(*) n from l group by all), t as (select epitope, length, i, arg_max(letter, (n, letter)) letter, max(n) / sum(n) s from c group by all)
      select epitope, cast(length as int) length, string_agg(case when s >= 0.75 then upper(letter) when s >= 0.4 then lower(letter) else '.' end, '' order by i) consensus from t group by epitope, length""",
    "medoids": f"""{ctes('genes', 'clones')}, {_DIST.format(pair="a.epitope = b.epitope and a.subject = b.subject")},
      m as (select epitope || ':' || cast(subject1 as varchar) g, id1, round(avg(dist), 6) m from both_ways where chains = 'A' group by all)
      select g, arg_min(id1, (m, id1)) medoid, round(min(m), 5) mean_dist from m group by g""",
    "permutation_within_subjects": f"""{ctes('genes', 'clones')}, {_DIST_EPITOPE},
      slots as (select epitope, subject, row_number() over (partition by epitope order by subject, clone_id) slot from clones),
      reps as (select epitope, clone_id, rep, row_number() over (partition by epitope, rep order by md5('1:' || cast(rep as varchar) || ':' || cast(clone_id as varchar)), clone_id) slot from clones, range(1, 11) t(rep)),
      dealt as (select epitope, 0 rep, clone_id, subject from clones union all select r.epitope, r.rep, r.clone_id, s.subject from reps r join slots s using (epitope, slot)),
      pm as (select d.epitope, x.rep, avg(dist) m from dist d join dealt x on x.clone_id = d.id1 join dealt y on y.clone_id = d.id2 and y.rep = x.rep and y.subject = x.subject where chains = 'A' group by all),
      o as (select epitope, m observed from pm where rep = 0), s as (select epitope, avg(m) mean, stddev_pop(m) sd, sum(case when m < observed then 1 else 0 end) / count(*) p from pm join o using (epitope) where rep > 0 group by epitope)
      select epitope, round(observed, 5) observed, round(mean, 5) mean, round((observed - mean) / sd, 5) z, round(p, 5) p from s join o using (epitope)""",
    "gene_names": rf"""{ctes('clones')} select clone_id, split_part(va1 || '*01', '*', 1) gene, cast(regexp_extract(va1, '(\d+)', 1) as int) number,
      rpad(repeat(' ', (8 - length(va1)) // 2) || va1, 8, ' ') padded, rtrim(vb1 || ' ' || chr(13) || chr(10), ' ' || chr(13) || chr(10)) stripped from clones""",
    "score_scalars": f"""{ctes('clones')}, s as (select clone_id, epitope, score, abs(score) / 1e5 p, avg(score) over (partition by epitope) m, stddev_pop(score) over (partition by epitope) sd, floor(score / 1000) k from clones)
      select clone_id, round(case when score > 0 then log10(score) else -100 end, 6) log10, cast(case when p > 0 then trunc(log10(p)) else -99 end as int) exponent,
        round(case when sd = 0 then 0 else (score - m) / sd end, 6) + 0.0::double z, round(case when k = 0 then 0 else 1 / k end, 8) + 0.0::double inverse,
        case when p < 0.001 then '***' when p < 0.01 then '**' when p < 0.05 then '*' else '' end stars from s""",
    "top_hit_genes": f"""{ctes('clones')} select clone_id, case when clone_id % 3 > clone_id % 2 then va1 when clone_id % 3 < clone_id % 2 then va2 || '*02'
      else least(va1, va2 || '*02') || ';' || greatest(va1, va2 || '*02') end genes from clones""",
    "gapped_alignment": f"""{ctes('clones')}, blosum(k, d) as (values {_values(tables.blosum62())}),
      p as (select clone_id, case when length(cdr3a) <= length(cdr3b) then cdr3a else cdr3b end x, case when length(cdr3a) <= length(cdr3b) then cdr3b else cdr3a end y from clones),
      g as (select *, length(x) n, length(y) - length(x) dl, unnest(range(1, length(x))) g from p), e as (select *, unnest(range(1, n + 1)) i from g),
      s as (select clone_id, x, dl, g, sum(d) s from e join blosum on k = substr(x, i, 1) || substr(y, case when i <= g then i else i + dl end, 1) group by all),
      b as (select clone_id, x, dl, arg_max(g, (s, -g)) g from s group by all)
      select clone_id, case when dl = 0 then x else substr(x, 1, g) || repeat('.', dl) || substr(x, g + 1) end aligned from b""",
    "loop_qualities": f"""{ctes('reads')}, p as (select read_id, nuc_a, length(nuc_a) n, substr(nuc_a, 5, 9) f, reverse(translate(substr(nuc_a, 5, 9), 'acgtn', 'tgcan')) b from reads),
      q as (select read_id, n, instr(nuc_a, case when read_id % 2 = 0 then f else b end) i, instr(nuc_a, case when read_id % 2 = 0 then b else f end) j from p)
      select read_id, array_to_string(case when i > 0 then list_transform(range(i, i + 9), lambda x: (read_id + x) % 40) else list_reverse(list_transform(range(j, j + 9), lambda x: (read_id + x) % 40)) end, '.') quals from q""",
    "fake_chains": f"{ctes('clones')} select count(distinct va1 || ' ' || cdr3a) = 1 is_fake from clones",
    "subset_rows": f"""{ctes('reads')}, g as (select *, dense_rank() over (order by epitope) g from reads), s as (select *, dense_rank() over (partition by epitope order by subject) s from g where g <= 3),
      n as (select *, row_number() over (partition by epitope, subject order by read_id) n from s where s <= 3) select read_id id, epitope, subject from n where n <= 15""",
    "common_columns": f"{ctes('clones', 'background')} select clone_id, cdr3a from clones union all select chain_id, cdr3 from background",
    "converted_rows": f"""{ctes('clones')}, c as (select va1, clone_size, case when clone_id % 11 = 0 then null when clone_id % 13 = 0 then 'CAF' when clone_id % 17 = 0 then 'CAXXXXF' else cdr3a end s
        from clones)
      select case when s is null then 'missing_field' when length(s) <= 5 then 'short_cdr3' when s like '%X%' then 'bad_residue' when va1 in ('VA5', 'VA6') then 'unknown_gene' else 'OK' end status,
        count(*) n, cast(sum(clone_size) as bigint) reads from c group by 1""",
    "trim_distribution": f"""{ctes('reads')}, c as (select least(read_id % 30, 20) length, sum(qual) n from reads group by 1) select length, round(n / sum(n) over (), 8) p from c""",
    "averaged_distributions": f"{ctes('tuples')}, {_FILES}, s as (select tag, key, sum(p) p from f group by all) select tag, key, round(p / sum(p) over (partition by tag), 8) p from s",
    "pseudo_probabilities": f"{ctes('tuples')}, {_FILES}, {_PSEUDO} select rep, round(p, 8) p from ps",
    "protein_probabilities": f"""{ctes('tuples')}, {_FILES}, {_PSEUDO} select seq_id id, round(greatest(coalesce(a.p, 0), coalesce(b.p, 0)) / (seq_id % 7 + 1), 8) p
      from tuples left join ps a on a.rep = g1 left join ps b on b.rep = g2""",
    "germline_bases": f"""{ctes('reads')}, e as (select va, nuc_a s, unnest(range(1, length(nuc_a) + 1)) pos from reads), c as (select va, pos, substr(s, pos, 1) base, count(*) n from e group by all)
      select va, cast(pos as int) pos, arg_max(base, (n, base)) base, round(max(n) / sum(n), 8) share from c group by va, pos""",
    "voted_frames": f"{ctes('reads')}, c as (select subject, qual % 20 % 3 + 1 frame, count(*) n from reads group by all) select subject, arg_max(frame, (n, frame)) frame from c group by subject",
    "background_sample": f"""{ctes('background')}, s as (select *, row_number() over (partition by v_rep, j_rep order by md5('1:' || cast(chain_id as varchar)), chain_id) n from background)
      select chain_id, v_rep, j_rep, cdr3 from s where n <= 10""",
    "motif_top_genes": f"""{ctes('clones')}, {_THREE}, c as (select epitope, shown, va1, count(*) n from clones join m on regexp_matches(cdr3a, pattern) group by all),
      p as (select *, row_number() over (partition by epitope, shown order by n desc, va1) i from c) select epitope, shown, string_agg(va1 || ':' || n, ',' order by i) genes from p where i <= 3 group by epitope, shown""",
    "motif_match_plus": f"""{ctes('genes', 'clones')}, {_DIST_EPITOPE}, {_THREE}, f as (select epitope, shown, clone_id from clones join m on regexp_matches(cdr3a, pattern)),
      near as (select id1, id2 from pd where chain = 'A' and dl = 0 and 3 * s <= 19 union all select id2, id1 from pd where chain = 'A' and dl = 0 and 3 * s <= 19),
      every as (select epitope, shown, clone_id, clone_id matcher, 0 d from f union all select epitope, shown, id2, id1, 1 from f join near on id1 = clone_id)
      select epitope, shown, clone_id, arg_min(matcher, (d, matcher)) matcher from every group by epitope, shown, clone_id""",
    "pwm_relative_entropy": f"""{ctes('clones', 'background')}, l as (select 0 b, length(cdr3a) length, cdr3a s from clones union all select 1, length(cdr3), cdr3 from background),
      e as (select *, unnest(range(1, length + 1)) i from l), c as (select b, length, i, substr(s, i, 1) a, count(*) n from e where contains('{tables.AMINO_ACIDS}', substr(s, i, 1)) group by all),
      w as (select *, n / sum(n) over (partition by b, length, i) w from c)
      select cast(x.length as int) length, cast(x.i - 1 as int) pos, round(sum(x.w * log2(x.w / greatest(coalesce(y.w, 0), 1e-3))), 6) + 0.0::double relent
      from w x left join w y on y.b = 1 and y.length = x.length and y.i = x.i and y.a = x.a where x.b = 0 group by x.length, x.i""",
    "mutual_rank": f"""{ctes('genes', 'clones')}, {_DIST_ALL}, near as (select b.*, c.epitope ref from both_ways b join clones c on c.clone_id = b.id2 where subject1 <> subject2 and chains = 'AB'),
      {_NBR.format(by=', ref')}, sc as (select clone_id, c.epitope, ref, round(wtd, 4) v from nbr join clones c using (clone_id)),
      k as (select x.clone_id, x.epitope, x.ref, x.v, sum(case when y.v < x.v then 1 else 0 end) l, sum(case when y.v = x.v then 1 else 0 end) e, count(*) t,
              max(case when y.v < x.v then y.v end) ln, min(case when y.v > x.v then y.v end) un from sc x join sc y on y.ref = x.ref and y.epitope = y.ref group by all)
      select epitope, ref ref_epitope, round(avg(case when un is null then 100 when ln is null then 0 else 100 * (l + (v - ln) / (un - ln) * (1 + e)) / t end), 4) rank from k group by all""",
    "contig_chains": f"""with {_CONTIGS} select ct clonotype, case when chain = 'TRA' then 'A' else 'B' end chain, v || '*01' v, j || '*01' j, cdr3, nt cdr3_nt, cast(sum(umis) as bigint) umis, count(distinct bc) cells
      from contigs where productive and cdr3 <> 'None' group by all""",
    "clonotype_barcodes": f"with {_CONTIGS} select ct clonotype, count(distinct bc) size, string_agg(distinct bc, ',' order by bc) barcodes from contigs group by ct",
    "umi_discrepancies": f"""with {_CONTIGS}, a as (select ct || '_' || chain id, sum(umis) u from contigs group by 1),
      b as (select ct || '_' || chain || case when k % 11 = 0 then '_other' else '' end id, sum(umis) + case when k % 7 = 0 then 1 else 0 end u from contigs group by k, 1)
      select coalesce(a.id, b.id) consensus_id, cast(a.u as bigint) contig_umis, cast(b.u as bigint) consensus_umis from a full join b on a.id = b.id where a.u is distinct from b.u""",
}
