"""Registered queries: one Spark builder and (where SQL can say it) one DuckDB oracle per operator.

Every builder reads the driver's tables through ``plans.adapters`` and runs over whole tables.
Output columns are normalised the same way on both sides: floating values are rounded half-to-even
at 6 places (``rint(x * 1e6) / 1e6``, bit-identical to DuckDB's ``round_even``), integers are BIGINT.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable, Dict, Optional

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: Optional[str]
    operators: str


REGISTRY: Dict[str, Query] = {}


def register(name: str, operators: str, sql: Optional[str] = None):
    def deco(fn):
        REGISTRY[name] = Query(name, fn, sql, operators)
        return fn
    return deco


def finish(df: DataFrame) -> DataFrame:
    """Normalise output types for comparison: doubles at 6 places half-even, integers as BIGINT."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = (F.rint(c.cast("double") * F.lit(1e6)) / F.lit(1e6)).alias(f.name)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint").alias(f.name)
        cols.append(c)
    return df.select(*cols)


# --- SQL building blocks (DuckDB) -------------------------------------------------------------

def R6(x: str) -> str:
    return f"(round_even(({x})::DOUBLE * 1000000.0::DOUBLE, 0) / 1000000.0::DOUBLE)"


VIEWS = {
    "feat": """
  select '1' as seq_id, concat('LT', cast(p_partkey as varchar)) as locus_tag, p_type as type,
         case when p_partkey % 5 = 0 then null else p_brand end as gene,
         cast(p_partkey*1000 + 1 as bigint) as start_pos, cast(p_partkey*1000 + p_size*18 as bigint) as end_pos,
         cast(p_size*18 as bigint) as feat_length, p_name as product
  from part""",
    "ins": """
  select '1' as seq_id, case when l_linestatus = 'F' then 'control' else 'test' end as condition,
         cast(l_partkey*1000 + 1 + (l_orderkey*37 + l_linenumber*11) % 1000 as bigint) as position,
         cast(l_quantity as bigint) as cnt
  from lineitem""",
    "coords": """
  select condition, seq_id, 'sf' as source, 'misc_feature' as type, position as "start", position as "end",
         case when condition = 'control' then '.' else cast(cnt as varchar) end as score,
         '.' as strand, '.' as phase, 'note=insertion;' as attributes
  from ins""",
    "pool": """
  select cast(l_partkey as varchar) as entity_id,
         concat('rep', cast(l_linenumber % 3 as varchar), '_MP_',
                case when l_linestatus = 'F' then 'control' else 'test' end) as sample,
         case when l_linestatus = 'F' then 'control' else 'test' end as condition,
         cast(sum(l_quantity) as bigint) as cnt
  from lineitem group by 1, 2, 3""",
    "attr": """
  select event_id, concat('ID=', cast(event_id as varchar), ';type=', event_type,
         ';k=v=w;flag;type=', upper(event_type), ';') as attributes
  from events""",
    "sites": """
  select seq_id, condition, position, cast(sum(cnt) as bigint) as reads, count(*) as "rows"
  from ins group by 1, 2, 3""",
    "ctot": """
  select condition, count(*) as cond_sites, cast(sum(reads) as bigint) as cond_reads from sites group by 1""",
    "conds": """
  select unnest(['control', 'test']) as condition""",
    "hits": """
  select f.*, c.condition, s.position, s.reads, s."rows",
         (s.position between f.start_pos and f.end_pos) as within_cds
  from feat f cross join conds c
  left join sites s on s.seq_id = f.seq_id and s.condition = c.condition
                   and s.position > f.start_pos and s.position < f.end_pos""",
    "tot": """
  select seq_id, locus_tag, type, gene, start_pos, end_pos, feat_length, product, condition,
         cast(coalesce(sum(case when within_cds then reads end), 0) as bigint) as total_reads,
         cast(coalesce(sum(case when within_cds then "rows" end), 0) as bigint) as n_rows,
         count(case when within_cds then 1 end) as unique_sites,
         min(case when within_cds then position end) as first_pos,
         max(case when within_cds then position end) as last_pos
  from hits group by all""",
    "scores": """
  select t.seq_id, t.locus_tag, t.type, t.gene, t.start_pos, t.end_pos, t.feat_length, t.product, t.condition,
         t.total_reads, t.n_rows, t.unique_sites,
         (t.unique_sites::DOUBLE / (t.feat_length / 1000.0::DOUBLE)) / (c.cond_sites / 1000000.0::DOUBLE) as nim_score,
         (t.total_reads::DOUBLE / (t.feat_length / 1000.0::DOUBLE)) / (c.cond_reads / 1000000.0::DOUBLE) as nrm_score,
         coalesce(100.0::DOUBLE * (t.first_pos - t.start_pos) / nullif(t.feat_length, 0)::DOUBLE, 0.0) as first_insert_pct,
         coalesce(100.0::DOUBLE * (t.last_pos - t.start_pos) / nullif(t.feat_length, 0)::DOUBLE, 0.0) as last_insert_pct
  from tot t left join ctot c on c.condition = t.condition""",
    "merged": """
  select c.seq_id, c.locus_tag, c.type, c.gene, c.start_pos, c.end_pos, c.feat_length, c.product,
         c.total_reads as total_reads_control, c.n_rows as n_rows_control, c.unique_sites as unique_sites_control,
         c.nim_score as nim_score_control, c.nrm_score as nrm_score_control,
         c.first_insert_pct as first_insert_pct_control, c.last_insert_pct as last_insert_pct_control,
         t.total_reads as total_reads_test, t.n_rows as n_rows_test, t.unique_sites as unique_sites_test,
         t.nim_score as nim_score_test, t.nrm_score as nrm_score_test,
         t.first_insert_pct as first_insert_pct_test, t.last_insert_pct as last_insert_pct_test
  from (select * from scores where condition = 'control') c
  join (select * from scores where condition = 'test') t
    on c.seq_id is not distinct from t.seq_id and c.locus_tag is not distinct from t.locus_tag
   and c.type is not distinct from t.type and c.gene is not distinct from t.gene
   and c.start_pos is not distinct from t.start_pos and c.end_pos is not distinct from t.end_pos
   and c.feat_length is not distinct from t.feat_length and c.product is not distinct from t.product""",
    "cmp": """
  select m.*,
         case when nim_score_control = 0 then 0.0
              when nim_score_test is null or nim_score_control is null then null
              when nim_score_test / nim_score_control <= 0 then 0.0
              else ln(nim_score_test / nim_score_control) / ln(2.0::DOUBLE) end as fold_change,
         (case when nim_score_test is null then null
               else rank() over (order by nim_score_test)::DOUBLE / count(nim_score_test) over () end)
       - (case when nim_score_control is null then null
               else rank() over (order by nim_score_control)::DOUBLE / count(nim_score_control) over () end)
           as pctl_rank
  from merged m""",
}

VIEW_ORDER = ["feat", "ins", "coords", "pool", "attr", "sites", "ctot", "conds", "hits", "tot", "scores",
              "merged", "cmp"]


def with_views(body: str, *extra: tuple, materialized: bool = False) -> str:
    """All base views as CTEs (DuckDB inlines only those referenced) plus query-specific ones (``materialized``:
    computed once, for long chains)."""
    parts = [f"{n} AS ({VIEWS[n]}\n)" for n in VIEW_ORDER]
    parts += [f"{n} AS {'MATERIALIZED ' if materialized else ''}({q}\n)" for n, q in extra]
    return "WITH " + ",\n".join(parts) + "\n" + body
