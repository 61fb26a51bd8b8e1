"""Driver queries of the corpus operators, and the SQL oracles of those that SQL can express (the pipeline is a
module at the repository's top)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from repertoire.llm import chat, collocations, decontam, exact_dedup, fill_middle, html_extract, line_dedup, lm_score, near_dedup, packing, quality, sharding, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(table(spark, sf_dir, "pages"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.format_turns(chat.with_control_case(spark, table(spark, sf_dir, "conversations")))
    return chat.conversation_digests(turns).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_text(table(spark, sf_dir, "pages"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_scores(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_report(table(spark, sf_dir, "documents"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"), shingle=2)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.fim_report(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
with n as (select doc_id, length(coalesce(text, '')) points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') norm from documents),
best as (select norm, count(*) group_size, arg_min(doc_id, (-points, doc_id)) keep_id from n group by norm)
select n.doc_id, b.keep_id, cast(b.group_size as bigint) group_size, n.doc_id = b.keep_id as kept, sha256(n.norm) text_sha256
from n join best b on n.norm = b.norm
"""

_WORDS = (
    r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
OP2_SQL = f"""
with d as (select doc_id, {_WORDS} ws from documents),
b as (select cast(item_id as varchar) item_id, {_WORDS} ws from benchmark),
starts as (select item_id, ws, least(10, len(ws)) l, unnest(range(1, cast(len(ws) - least(10, len(ws)) + 2 as bigint))) i from b where len(ws) > 0),
win as (select distinct item_id, l, array_to_string(ws[i:i + l - 1], ' ') w from starts),
dw as (select doc_id, l, i, array_to_string(ws[i:i + l - 1], ' ') w
       from (select doc_id, ws, l, unnest(range(1, cast(len(ws) - l + 2 as bigint))) i from d, (select distinct l from win) where len(ws) >= l)),
hits as (select doc_id, i, dw.l, item_id from dw join win using (l, w)),
pos as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + l)) p from hits) group by doc_id),
its as (select doc_id, count(*) n_items, string_agg(item_id, ',' order by item_id) ids from (select distinct doc_id, item_id from hits) group by doc_id)
select d.doc_id, cast(len(d.ws) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items,
       sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join pos using (doc_id) left join its using (doc_id)
"""

OP3_SQL = """
with p as (select page_id, strlen(coalesce(html, '')) n, sha256(coalesce(html, '')) h from pages),
f as (select h, min(page_id) first from p group by h)
select page_id, cast(n as bigint) payload_bytes, h payload_digest, case when n >= 100 and page_id <> first then 'revisit' else 'response' end record_type,
       case when n >= 100 and page_id <> first then first end refers_to
from p join f using (h)
"""

# a turn grows by one character for each backslash and each control string in its text, and by its markers
_MARKS = "('<<SYS>>'), ('<</SYS>>'), ('[INST]'), ('[/INST]'), ('<s>'), ('</s>'), ('<<ROLE'), ('<</ROLE>>')"
OP4_SQL = f"""
with c as (select conv_id, turn, coalesce(role, '') role, coalesce(text, '') text from conversations
           union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
m as (select mark from (values {_MARKS}) t(mark)),
t as (select conv_id, turn, role, text,
        length(text) + length(text) - length(replace(text, chr(92), ''))
        + (select cast(sum((length(text) - length(replace(text, mark, ''))) // length(mark)) as bigint) from m)
        + case role when 'system' then 17 when 'user' then 15 when 'assistant' then 9 else 20 + 2 * strlen(role) end chars,
        coalesce(lag(role) over (partition by conv_id order by turn, role, text), '') || '>' || role step from c)
select conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) turns_sha256,
       cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) loss_sha256, cast(sum(chars) as bigint) formatted_chars,
       bool_and(step in ('>system', '>user', 'system>user', 'user>assistant', 'assistant>user')) and last(role order by turn, role, text) in ('assistant', 'user') as valid
from t group by conv_id
"""

OP11_SQL = r"""
with d as (select doc_id, coalesce(text, '') t, sha256('42:' || cast(doc_id as varchar)) h from documents),
x as (select doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') u,
      cast('0x' || substr(h, 1, 8) as bigint) h1, cast('0x' || substr(h, 9, 8) as bigint) h2, cast('0x' || substr(h, 17, 8) as bigint) h3,
      cast('0x' || substr(h, 25, 8) as bigint) h4 from d),
f as (select doc_id, t, u, len(u) n, h1 % (len(u) + 1) a, h2 % (len(u) + 1) b,
      case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 50 then 'plain'
           when h4 % 100 < 80 then 'spm' else 'psm' end form from x),
s as (select doc_id, t, n, form, array_to_string(u[:least(a, b)], '') p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') m,
      array_to_string(u[greatest(a, b) + 1:], '') s from f)
select doc_id, cast(n as bigint) n, form, case when form <> 'plain' then cast(length(p) as bigint) end prefix_chars,
       case when form <> 'plain' then cast(length(m) as bigint) end middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) output_sha256,
       sha256(t) restored_sha256
from s
"""

OP12_SQL = r"""
with p as (select coalesce(lang, 'und') lang,
             unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) piece
           from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') x from p),
total as (select lang, sum(len(x)) n from w group by lang),
g as (select lang, k, unnest([array_to_string(x[i:i + k - 1], ' ') for i in range(1, cast(len(x) - k + 2 as bigint))]) phrase
      from w, (values (1), (2), (3), (4)) t(k) where len(x) >= k),
f as (select lang, phrase, k, count(*) a from g group by lang, phrase, k having count(*) >= 30),
c as (select * from f where k > 1),
gone as (select distinct c.lang, c.phrase from c join c o on c.lang = o.lang and o.k > c.k and 100 * o.a::hugeint >= 80 * c.a::hugeint
         and contains(' ' || o.phrase || ' ', ' ' || c.phrase || ' ')),
cut as (select lang, phrase, a, i, array_to_string(string_split(phrase, ' ')[:i], ' ') one, array_to_string(string_split(phrase, ' ')[i + 1:], ' ') two
        from (select *, unnest(range(1, k)) i from c anti join gone using (lang, phrase))),
scored as (select cut.lang, cut.phrase, cut.a, i, x.a l, y.a r, cast(2000000::hugeint * cut.a // (x.a + y.a) as bigint) score
           from cut join f x on x.lang = cut.lang and x.phrase = one join f y on y.lang = cut.lang and y.phrase = two),
best as (select lang, phrase, a, unnest(min(struct_pack(score := score, i := i, l := l, r := r))) from scored group by lang, phrase, a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from best)
select lang, rank, phrase, a, l, r, cast(n as bigint) n, score from ranked join total using (lang) where rank <= 2000
"""

OP13_SQL = r"""
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) i from documents),
k as (select doc_id, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') key from l),
f as (select key, min(doc_id) keeper from k where length(key) >= 10 group by key having count(distinct doc_id) > 1),
m as (select doc_id, i, line, keeper is not null and keeper <> doc_id as goes from k left join f using (key))
select doc_id, count(*) n_lines, count(*) filter (where goes) n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not goes), '')) kept_sha256
from m group by doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_decontamination": op2_decontamination,
        "op3_warc": op3_warc,
        "op4_chat": op4_chat,
        "op5_packing": op5_packing,
        "op6_html_extract": op6_html_extract,
        "op7_lm_score": op7_lm_score,
        "op8_sharding": op8_sharding,
        "op9_near_dedup": op9_near_dedup,
        "op10_quality": op10_quality,
        "op11_fill_in_middle": op11_fill_in_middle,
        "op12_collocations": op12_collocations,
        "op13_line_dedup": op13_line_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": OP1_SQL,
        "op2_decontamination": OP2_SQL,
        "op3_warc": OP3_SQL,
        "op4_chat": OP4_SQL,
        "op11_fill_in_middle": OP11_SQL,
        "op12_collocations": OP12_SQL,
        "op13_line_dedup": OP13_SQL,
    }
