"""Receptor tables projected from the driver's star-schema tables, the same in Spark and in DuckDB.

The driver's data hold no receptors, so every analysis runs on this projection of whole tables:
``clones`` from customer, ``reads`` from orders, ``tuples`` from lineitem, ``background`` from part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("customer", "orders", "lineitem", "part", "supplier", "nation", "documents")

# V genes by chain with three loops; '.' marks alignment gaps
GENES = """select chain, gene, concat(substr(m, 1, 6), ' ', substr(m, 7, 4), ' ', substr(m, 11, 5)) loops
from (select chain, concat('V', chain, cast(n as {text})) gene,
             translate(md5(concat('V', chain, cast(n as {text}))), '0123456789abcdef', '.CDEFGHIKLMNPQRS') m
      from (values ('A', 0), ('A', 1), ('A', 2), ('A', 3), ('A', 4), ('A', 5), ('A', 6), ('B', 0), ('B', 1), ('B', 2), ('B', 3), ('B', 4)) t(chain, n)) g"""

CLONES = """select clone_id, epitope, subject, clone_size, score,
  concat('CAV', substr(h, 1, cast(3 + clone_id % 7 as int)), 'LF') cdr3a, concat('CAS', substr(h, 10, cast(3 + clone_id % 9 as int)), 'YF') cdr3b,
  concat('VA', cast(clone_id % 7 as {text})) va1, concat('VA', cast((clone_id * 3 + 1) % 7 as {text})) va2,
  concat('VB', cast(clone_id % 5 as {text})) vb1, concat('VB', cast((clone_id * 2 + 3) % 5 as {text})) vb2,
  concat('JA', cast(clone_id % 3 as {text})) ja, concat('JB', cast(clone_id % 4 as {text})) jb
from (select c_custkey clone_id, c_mktsegment epitope, c_nationkey % 5 subject, cast(1 + c_custkey % 4 as bigint) clone_size, c_acctbal score,
             translate(md5(cast(c_custkey as {text})), '0123456789abcdef', 'ACDEFGHIKLMNPQRS') h from customer) c"""

# sequencing reads: short clonal nucleotide strings with errors, qualities and gene calls
READS = """select o_orderkey read_id, concat('E', cast(o_custkey % 3 as {text})) epitope, concat('S', cast(o_custkey % 40 as {text})) subject,
  concat('VA', cast(o_custkey % 7 as {text})) va, concat('JA', cast(o_custkey % 3 as {text})) ja,
  concat('VB', cast(o_custkey % 5 as {text})) vb, concat('JB', cast(o_custkey % 4 as {text})) jb,
  case when o_orderkey % 11 = 0 then concat(substr(na, 1, 11), 'n', substr(na, 13)) when o_orderkey % 7 = 0 then concat(substr(na, 1, 14), 't', substr(na, 16)) else na end nuc_a,
  nb nuc_b, cast(10 + o_orderkey % 50 as int) qual, o_orderpriority priority
from (select o_orderkey, o_custkey, o_orderpriority,
        translate(md5(concat('a', cast(o_custkey % 120 as {text}))), '0123456789abcdef', 'acgtacgtacgtacgt') na,
        translate(md5(concat('b', cast(o_custkey % 120 as {text}))), '0123456789abcdef', 'acgtacgtacgtacgt') nb from orders) o"""

# ambiguous gene calls of background sequences
TUPLES = """select l_orderkey * 8 + l_linenumber seq_id, concat('F', l_linestatus) file,
  concat('G', cast(least(l_partkey % 12, l_suppkey % 12) as {text})) g1, concat('G', cast(greatest(l_partkey % 12, l_suppkey % 12) as {text})) g2,
  l_returnflag epitope from lineitem"""

# background chains for motif searches
BACKGROUND = """select p_partkey chain_id, concat('VA', cast(p_partkey % 7 as {text})) v_rep, concat('JA', cast(p_partkey % 3 as {text})) j_rep,
  concat('CAV', substr(translate(md5(concat('n', cast(p_partkey as {text}))), '0123456789abcdef', 'ACDEFGHIKLMNPQRS'), 1, cast(3 + p_partkey % 7 as int)), 'LF') cdr3
from part"""

ALL = {"genes": GENES, "clones": CLONES, "reads": READS, "tuples": TUPLES, "background": BACKGROUND}


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture table as a DataFrame over the Parquet files."""
    text = ALL[name].format(text="string")
    for table in TABLES:
        if f"from {table}" in text:
            text = text.replace(f"from {table}", f"from parquet.`{sf_dir}/{table}.parquet`")
    return spark.sql(text)


def ctes(*names: str) -> str:
    """The fixture tables as the start of a DuckDB WITH clause."""
    return "with recursive " + ",\n".join(f"{n} as ({ALL[n].format(text='varchar')})" for n in names)
