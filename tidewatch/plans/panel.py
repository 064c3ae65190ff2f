"""Panels derived from the star-schema tables.

The statements below run unchanged in Spark SQL and in the checking engine, so
both sides of a comparison start from the same rows. Money is summed in whole
cents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PANEL_SQL = """
with m as (
  select l_partkey, year(l_shipdate)*12+month(l_shipdate) as mi,
         sum(cast(floor(l_extendedprice*(1-l_discount)*100) as bigint)) as spend,
         sum(cast(l_quantity as bigint)) as qty,
         sum(case when l_returnflag='R' then 1 else 0 end) as ret
  from {lineitem} group by 1,2),
c as (
  select l_partkey, mi, sum(spend) over w as cs, sum(qty) over w as cq, sum(ret) over w as cr
  from m window w as (partition by l_partkey order by mi rows between unbounded preceding and current row)),
b as (
  select c.*, p_name, p_type, p_size, cast(floor(p_retailprice*p_size*4) as bigint) as app,
         min(mi) over (partition by l_partkey) as mi0
  from c join {part} on p_partkey=l_partkey)
select case when l_partkey%10=9 then concat('PRJ_',lpad(cast(l_partkey as string),12,'0'))
            else concat('N',lpad(cast(l_partkey as string),8,'0')) end as project_id,
       upper(p_name) as project_name,
       case p_type when 'STANDARD' then 'Railways' when 'PROMO' then 'Power' when 'SMALL' then 'Coal'
                   when 'LARGE' then 'Petroleum' when 'ECONOMY' then 'Road Transport And Highways'
                   else null end as sector,
       cast(mi as int) as month_idx,
       concat(lpad(cast(cast(floor((mi-1)/12) as int) as string),4,'0'),'-',lpad(cast((mi-1)%12+1 as string),2,'0')) as reporting_month,
       cast(app as double)/100 as approved_cost,
       case when cr>=3 then floor(cast(app as double)*(100+6*floor(cr/3))/100)/100 end as revised_cost,
       floor(cast(cs as double)/1000)/100 as expenditure,
       case when (l_partkey+mi)%8<>0 then floor(cast(cs as double)*10/app)/100 end as financial_progress,
       case when mi>=2000*12+1 then least(floor(cast(cq as double)*100/12)/100,cast(100 as double)) end as physical_progress,
       case when (l_partkey+mi)%3<>0 then cast(2*cast(floor(cr/2) as int) as double) end as schedule_deviation,
       cast(mi0+p_size as int) as orig_completion_idx,
       case when cr>=2 then cast(mi0+p_size+2*cast(floor(cr/4) as int) as int) end as rev_completion_idx
from b
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_sql(spark: SparkSession, sf_dir: str, text: str, *tables: str) -> DataFrame:
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in tables})


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, PANEL_SQL, "lineitem", "part")


def dealt_panel(spark: SparkSession, sf_dir: str, parts: int) -> DataFrame:
    """The same rows, computed in so many partitions whatever shuffles have."""
    lines = table(spark, sf_dir, "lineitem").repartition(parts, "l_partkey")
    return spark.sql(PANEL_SQL, lineitem=lines, part=table(spark, sf_dir, "part"))
