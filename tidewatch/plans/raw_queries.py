"""Normaliser and canonicalisation queries over the raw cells fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import dates as Dt
from tidewatch.functions import documents as Doc
from tidewatch.functions import identity as I
from tidewatch.functions import text as T
from tidewatch.functions.numbers import EMPTY_MARKS, NUMBER_IN_TEXT, PLAIN_NUMBER, normalize_money, normalize_progress, to_number
from tidewatch.operators import canonical as Cn
from tidewatch.operators import quality as Q
from tidewatch.plans import checks as C
from tidewatch.plans.panel import run_sql, table
from tidewatch.plans.raw_cells import RAW_SQL
from tidewatch.plans.registry import query


def cells(spark, sf):
    return run_sql(spark, sf, RAW_SQL, "lineitem", "part")


def raw(spark, sf):
    return Cn.normalize_cells(cells(spark, sf))


def canon(spark, sf):
    return Cn.canonical_panel(raw(spark, sf))


# ---- checking SQL --------------------------------------------------------

def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def clean(e: str) -> str:
    return f"trim(regexp_replace(coalesce({e},''),{lit(T.SPACE_CLASS + '+')},' ','g'))"


def bare(e: str) -> str:
    return f"trim(regexp_replace({clean(e)},{lit('[' + chr(92) + '[' + chr(92) + '](){}]')},'','g'))"


def marks(e: str) -> str:
    return f"{e} in ({','.join(lit(m) for m in EMPTY_MARKS)})"


def code(e: str) -> str:
    return f"nullif(upper(regexp_extract({e},{lit(T.PROJECT_CODE)},0)),'')"


def title(e: str) -> str:
    out = clean(e)
    for p in T.TITLE_NOISE:
        out = f"trim(regexp_replace({out},{lit(p)},'','g'))"
    return clean(out)


def sector(e: str) -> str:
    whens = " ".join(f"when contains(s,{lit(k)}) then {lit(v)}" for k, v in T.SECTOR_TITLES)
    return (f"(select case when length(s)>=3 then case {whens} end end from (select "
            f"trim(regexp_replace(upper(regexp_replace({e},'[^a-zA-Z\\s&]',' ','g')),'\\s+',' ','g')) as s))")


def parse(e: str) -> str:
    return f"case when regexp_matches(replace({e},',',''),{lit(PLAIN_NUMBER)}) then try_cast(replace({e},',','') as double) end"


def rounded2(e: str) -> str:
    return f"cast(printf('%.2f',{e}) as double)"


def progress(e: str) -> str:
    return (f"(select case when p>=0 and p<=100 then {rounded2('p')} end from (select case when v>0 and v<1 then v*100.0::double else v end as p from ("
            f"select case when not {marks('s')} then {parse('s')} end as v from (select {bare(f'trim(replace({clean(e)},{lit(chr(37))},{lit(str())}))')} as s))))")


def money(e: str) -> str:
    return (f"(select case when not {marks('s')} then {rounded2('v')} end from (select s, coalesce({parse('b')}, "
            f"try_cast(replace(regexp_extract(b,{lit(NUMBER_IN_TEXT)},0),',','') as double)) as v from (select s, "
            f"trim(regexp_replace(regexp_replace(s,'[₹ ]','','g'),'(?i)rs\\.?|crore','','g')) as b from (select {bare(e)} as s))))")


_MN = "case lower({w}) " + " ".join(f"when '{k}' then '{v}'" for k, v in Dt.MONTH_NUMBERS.items()) + " end"


def _x(p, g):
    return f"regexp_extract(s,{lit(p)},{g})"


def _ym(y, m):
    return f"case when {y}<>'' and try_cast({m} as int) between 1 and 12 then {y}||'-'||lpad(cast(try_cast({m} as int) as varchar),2,'0') end"


def month(e: str) -> str:
    iso, num = r"^(\d{4})[-/](\d{1,2})$", r"^(\d{1,2})[-/](\d{4})$"
    w4, w2 = r"^([A-Za-z]+)[\s,-]+(\d{4})$", r"^([A-Za-z]+)[\s,-]+(\d{2})$"
    inn, innw = r"(\d{1,2})[/](\d{4})", rf"(?i)({Dt.FULL_MONTHS})[\s,]+(20\d{{2}})"
    yy = f"nullif({_x(w2, 2)},'')"
    cent = f"(case when cast({yy} as int)<70 then '20' else '19' end||{yy})"
    parts = [_ym(_x(iso, 1), _x(iso, 2)), _ym(_x(num, 2), _x(num, 1)),
             _ym(_x(w4, 2), _MN.format(w=_x(w4, 1))), _ym(cent, _MN.format(w=_x(w2, 1))),
             _ym(_x(inn, 2), _x(inn, 1)), _ym(_x(innw, 2), _MN.format(w=_x(innw, 1)))]
    return f"(select case when not {marks('s')} then coalesce({', '.join(parts)}) end from (select {bare(e)} as s))"


def derived(*fields: str) -> str:
    parts = "||'|'||".join(f"regexp_replace(upper(coalesce({f},'')),'[^A-Z0-9]','','g')" for f in fields)
    return f"'PRJ_'||upper(substr(sha256({parts}),1,12))"


def project_id(c, n, *rest):
    return (f"coalesce({code(c)},{code(n)},case when length({clean(n)})>=3 and not regexp_matches({clean(n)},'^\\d+$') "
            f"then {derived(n, *rest)} end,'')")


C.fragment("cells", (), RAW_SQL.format(lineitem="lineitem", part="part"))
C.fragment("mfl", ("cells",), """
select raw_record_id, f, list_filter(list_transform(string_split(v, chr(10)), lambda x: trim(x)), lambda x: x<>'') as ls
from (select raw_record_id, 'doc' as f, doc_cell as v from cells union all select raw_record_id, 'cost', cost_cell from cells)""")
C.fragment("mfr(raw_record_id, f, i, o, r, a)", ("mfl",), """
select raw_record_id, f, 0, null::varchar, null::varchar, null::varchar from mfl
union all
select l.raw_record_id, l.f, i+1,
  case when k='plain' and o is null then x else o end,
  case when k='paren' or (k='plain' and o is not null and r is null) then x else r end,
  case when k='ahead' or (k='plain' and o is not null and r is not null and a is null) then x else a end
from (select m.*, l.ls[i+1] as x, case when l.ls[i+1] like '{%' or l.ls[i+1] like '[%' then 'ahead'
        when l.ls[i+1] like '(%)' then 'paren' else 'plain' end as k
      from mfr m join mfl l using (raw_record_id, f) where i < len(l.ls)) l""")
C.fragment("mf", ("mfr(raw_record_id, f, i, o, r, a)", "mfl"), """
select m.* from mfr m join mfl l using (raw_record_id, f) where m.i = len(l.ls)""")
C.fragment("n1", ("cells", "mf"), f"""
select c.*, {title('name_cell')} as project_name, coalesce({sector('sector_cell')},'') as sector, {clean('ministry_cell')} as ministry,
 {clean('state_cell')} as state, coalesce({month('month_cell')},'UNKNOWN') as reporting_month, {money('exp_cell')} as expenditure,
 {progress('prog_cell')} as physical_progress, {money('k.o')} as approved_cost, coalesce({money('k.r')},{money('k.a')}) as revised_cost,
 {month('d.o')} as original_completion_date, coalesce({month('d.r')},{month('d.a')}) as revised_completion_date,
 {clean('milestone_cell')} as milestone_information, dev_cell as schedule_deviation
from cells c join mf k on k.raw_record_id=c.raw_record_id and k.f='cost' join mf d on d.raw_record_id=c.raw_record_id and d.f='doc'""")
C.fragment("nrm", ("n1",), f"""
select *, {project_id('code_cell', 'project_name', 'sector', 'ministry', 'state')} as project_id,
 case when expenditure<>0 and approved_cost>0 then {rounded2('expenditure/approved_cost*100.0::double')} end as financial_progress from n1""")
RAW_COLS = ["raw_record_id", "project_id", "project_name", "sector", "ministry", "state", "reporting_month", "physical_progress",
            "financial_progress", "expenditure", "approved_cost", "revised_cost", "original_completion_date", "revised_completion_date",
            "milestone_information", "schedule_deviation", "source_pdf", "source_page"]


@query("normalized_raw_records", C.check(f"select {','.join(RAW_COLS)} from nrm", "nrm"))
def _(spark, sf):
    return raw(spark, sf).select(*RAW_COLS)


@query("clean_text_documents", f"select doc_id, length({clean('text')}) as n, sha256({clean('text')}) as digest from documents")
def _(spark, sf):
    c = T.clean_text(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.length(c).alias("n"), F.sha2(c, 256).alias("digest"))


@query("clean_text_pages", f"select page_id, length({clean('html')}) as n, sha256({title('url')}) as url_title from pages")
def _(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", F.length(T.clean_text(F.col("html"))).alias("n"), F.sha2(T.clean_project_title(F.col("url")), 256).alias("url_title"))


@query("project_codes", C.check(
    f"select raw_record_id, {code('code_cell')} as code, {code('name_cell')} as name_code from cells", "cells"))
def _(spark, sf):
    return cells(spark, sf).select(
        "raw_record_id", T.extract_project_code(F.col("code_cell")).alias("code"), T.extract_project_code(F.col("name_cell")).alias("name_code"))


@query("derived_project_ids", C.check(
    f"select raw_record_id, {derived('name_cell', 'sector_cell', 'ministry_cell', 'state_cell')} as pid, "
    f"{project_id('code_cell', 'name_cell', 'sector_cell', 'ministry_cell', 'state_cell')} as best from cells", "cells"))
def _(spark, sf):
    f = [F.col(c) for c in ("name_cell", "sector_cell", "ministry_cell", "state_cell")]
    return cells(spark, sf).select("raw_record_id", T.derived_project_id(*f).alias("pid"), T.normalize_project_id(F.col("code_cell"), *f).alias("best"))


@query("normalized_months", C.check(f"select raw_record_id, month_cell, {month('month_cell')} as month from cells", "cells"))
def _(spark, sf):
    return cells(spark, sf).select("raw_record_id", "month_cell", Dt.normalize_month(F.col("month_cell")).alias("month"))


@query("normalized_progress_and_money", C.check(
    f"select raw_record_id, {progress('prog_cell')} as progress, {money('cost_cell')} as cost, {money('exp_cell')} as spent, {progress('cost_cell')} as odd from cells", "cells"))
def _(spark, sf):
    return cells(spark, sf).select(
        "raw_record_id", normalize_progress(F.col("prog_cell")).alias("progress"), normalize_money(F.col("cost_cell")).alias("cost"),
        normalize_money(F.col("exp_cell")).alias("spent"), normalize_progress(F.col("cost_cell")).alias("odd"))


@query("multi_field_cells", C.check("select raw_record_id, o as original, r as revised, a as anticipated from mf where f='doc'", "mf"))
def _(spark, sf):
    return cells(spark, sf).select("raw_record_id", T.multi_field(F.col("doc_cell")).alias("m")).select("raw_record_id", "m.*")


@query("sector_and_title_cleaning", C.check(
    f"select raw_record_id, {sector('sector_cell')} as sector, {sector('name_cell')} as from_name, {title('name_cell')} as title from cells", "cells"))
def _(spark, sf):
    return cells(spark, sf).select(
        "raw_record_id", T.clean_sector_name(F.col("sector_cell")).alias("sector"), T.clean_sector_name(F.col("name_cell")).alias("from_name"),
        T.clean_project_title(F.col("name_cell")).alias("title"))


@query("numeric_coercion", C.check(
    "select raw_record_id, case when not isnan(v) then v end as progress_number, try_cast(trim(dev_cell) as double) as deviation from (select *, try_cast(trim(prog_cell) as double) as v from cells)", "cells"))
def _(spark, sf):
    return cells(spark, sf).select(
        "raw_record_id", to_number(F.col("prog_cell")).alias("progress_number"), to_number(F.col("dev_cell")).alias("deviation"))


# ---- canonicalisation ----------------------------------------------------

C.fragment("keyed", ("nrm",), "select * from nrm where project_id not in ('','UNKNOWN') and reporting_month not in ('','UNKNOWN')")


def _ff(c):
    return f"coalesce(arg_min({c}, raw_record_id) filter ({c} is not null and {c}<>''),'') as {c}"


def _var(c, tag):
    return (f"case when count({c})>1 and max({c})-min({c})>5 then '{tag}('||printf('%.1f',min({c}))||'%-'||printf('%.1f',max({c}))||'%)' end")


C.fragment("mrg", ("keyed",), f"""
select project_id, reporting_month,
 coalesce(arg_max(trim(project_name), length(trim(project_name))*1e18::decimal(38,0) - raw_record_id) filter (length(trim(project_name))>=3), arg_min(project_name, raw_record_id)) as project_name,
 {_ff('sector')}, {_ff('ministry')}, {_ff('state')}, {_ff('schedule_deviation')},
 max(physical_progress) as physical_progress, max(financial_progress) as financial_progress, max(expenditure) as expenditure,
 max(approved_cost) as approved_cost, max(revised_cost) as revised_cost,
 arg_min(original_completion_date, raw_record_id) filter (original_completion_date is not null) as original_completion_date,
 arg_min(revised_completion_date, raw_record_id) filter (revised_completion_date is not null) as revised_completion_date,
 coalesce(arg_max(milestone_information, length(milestone_information)*1e18::decimal(38,0) - raw_record_id) filter (milestone_information<>''),'') as milestone_information,
 cast(count(*) as int) as duplicate_raw_record_count, cast(count(distinct source_pdf) as int) as source_pdf_count,
 array_to_string(list_transform(list_sort(list_distinct(list(source_page))), lambda p: 'p.'||p), '; ') as source_pages,
 concat_ws('; ', case when count(*)>1 then 'MERGED_'||count(*)||'_RAW_ROWS' end, {_var('physical_progress', 'PHYS_PROG_VARIANCE')}, {_var('financial_progress', 'FIN_PROG_VARIANCE')}) as extraction_warning,
 array_to_string(list_sort(list_distinct(list(source_pdf))), '; ') as source_pdf, min(source_page) as source_page
from keyed group by 1,2""")
_EXC = " or ".join(f"regexp_matches(trim(project_name),{lit(p)})" for p in I.EXCLUSION_PATTERNS)
C.fragment("can", ("mrg",), f"select * from mrg where not (starts_with(project_id,'PRJ_') and ({_EXC}))")
CANON = ["project_id", "reporting_month", "project_name", "sector", "ministry", "state", "schedule_deviation", "physical_progress",
         "financial_progress", "expenditure", "approved_cost", "revised_cost", "original_completion_date", "revised_completion_date",
         "milestone_information", "duplicate_raw_record_count", "source_pdf_count", "source_pages", "extraction_warning", "source_pdf", "source_page"]


@query("canonical_panel", C.check(f"select {','.join(CANON)} from can", "can"))
def _(spark, sf):
    return canon(spark, sf).select(*CANON)


@query("merge_warnings", C.check("select extraction_warning, count(*) as panel_rows from mrg where extraction_warning<>'' group by 1", "mrg"))
def _(spark, sf):
    return Cn.merge_to_grain(raw(spark, sf)).where("extraction_warning <> ''").groupBy("extraction_warning").agg(F.count("*").alias("panel_rows"))


@query("invalid_key_filter", C.check("select count(*) as kept, count(distinct project_id) as projects from keyed", "keyed"))
def _(spark, sf):
    # one row per id first, so a dominant id does not load the distinct count
    per = Cn.valid_keys(raw(spark, sf)).groupBy("project_id").agg(F.count("*").alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("kept"), F.count("*").alias("projects"))


def _pf(c):
    return f"coalesce(arg_min({c}, reporting_month) filter ({c} is not null and {c}<>''),'') as {c}"


@query("project_master", C.check(f"""
select project_id, {_pf('project_name')}, {_pf('sector')}, {_pf('ministry')}, {_pf('state')}, '' as district, '' as project_size,
 arg_min(original_completion_date, reporting_month) filter (original_completion_date is not null) as original_completion_date,
 arg_min(revised_completion_date, reporting_month) filter (revised_completion_date is not null) as revised_completion_date,
 min(reporting_month) as first_seen_month, max(reporting_month) as last_seen_month from can group by 1""", "can"))
def _(spark, sf):
    return Cn.project_master(canon(spark, sf))


C.fragment("cov", ("can",), f"""
select *, {rounded2('total_raw_records/observation_count')} as raw_to_canonical_ratio from (
select project_id, coalesce(arg_max(project_name, length(project_name)*100000-mi) filter (project_name<>''),'') as project_name,
 {_pf('sector')}, {_pf('ministry')}, {_pf('state')}, min(reporting_month) as first_observation, max(reporting_month) as last_observation,
 count(*) as observation_count, cast(sum(duplicate_raw_record_count) as bigint) as total_raw_records,
 max(mi)-min(mi)+1-count(*) as missing_months
from (select *, cast(substr(reporting_month,1,4) as int)*12+cast(substr(reporting_month,6,2) as int) as mi from can) group by 1)""")
COV = ["project_id", "project_name", "sector", "ministry", "state", "first_observation", "last_observation", "observation_count",
       "total_raw_records", "missing_months", "raw_to_canonical_ratio"]


@query("project_coverage", C.check(f"select {','.join(COV)} from cov", "cov"))
def _(spark, sf):
    return Cn.ordered_coverage(Cn.coverage(canon(spark, sf))).select(*COV)


_DB = [("1", "observation_count=1"), ("2", "observation_count=2"), ("3-5", "observation_count between 3 and 5"),
       ("6-12", "observation_count between 6 and 12"), (">12", "observation_count>12")]


@query("density_buckets", C.check(" union all ".join(
    f"select '{k}' as bucket, count(*) filter ({t}) as projects, {C.half_even(f'100.0::double*count(*) filter ({t})/count(*)', 4)} as pct from cov" for k, t in _DB), "cov"))
def _(spark, sf):
    return Cn.density_buckets(Cn.coverage(canon(spark, sf)))


@query("most_duplicated", C.check("select project_id, total_raw_records, raw_to_canonical_ratio from cov order by raw_to_canonical_ratio desc, project_id limit 20", "cov"))
def _(spark, sf):
    return Cn.most_duplicated(Cn.coverage(canon(spark, sf))).select("project_id", "total_raw_records", "raw_to_canonical_ratio")


@query("longest_histories", C.check("select project_id, observation_count, raw_to_canonical_ratio from cov order by observation_count desc, raw_to_canonical_ratio desc, project_id limit 20", "cov"))
def _(spark, sf):
    return Cn.longest_histories(Cn.coverage(canon(spark, sf))).select("project_id", "observation_count", "raw_to_canonical_ratio")


@query("extraction_confidence", C.check(f"""
select source_pdf, count(*) as projects_detected, {rounded2("count(*) filter (project_id<>'' and not starts_with(project_id,'UNKNOWN'))/count(*)*0.5::double + count(*) filter (reporting_month<>'UNKNOWN')/count(*)*0.5::double")} as confidence,
 'SUCCESS' as extraction_status from nrm group by 1""", "nrm"))
def _(spark, sf):
    return Cn.extraction_confidence(raw(spark, sf))


@query("integrity_rules", C.check(f"""
select count(*) as row_count, count(*) filter (reporting_month='UNKNOWN' or not regexp_matches(reporting_month,'^\\d{{4}}-\\d{{2}}$')) as bad_month,
 count(*) filter (project_id in ('','UNKNOWN')) as missing_id, count(*) filter (trim(project_name)='') as missing_name,
 count(*) filter (physical_progress<0 or physical_progress>100) as bad_progress,
 cast(sum((coalesce(expenditure,0)<0)::int + (coalesce(approved_cost,0)<0)::int + (coalesce(revised_cost,0)<0)::int) as bigint) as negative_cost,
 cast(0 as bigint) as bad_completion_date, count(physical_progress) as physical_present, count(financial_progress) as financial_present,
 min(reporting_month) filter (regexp_matches(reporting_month,'^\\d{{4}}-\\d{{2}}$')) as first_month,
 max(reporting_month) filter (regexp_matches(reporting_month,'^\\d{{4}}-\\d{{2}}$')) as last_month from nrm""", "nrm"))
def _(spark, sf):
    return Q.integrity_counts(raw(spark, sf))


@query("negative_values", """
with t as (select case when c_custkey%3=0 then 'PRJ_x' else 'N1' end as pid, c_acctbal as v from customer union all
  select case when s_suppkey%3=0 then 'PRJ_x' else 'N1' end, null from supplier where false)
select 'expenditure' as field, case when starts_with(pid,'PRJ_') then 'DERIVED_ID' else 'OFFICIAL_ID' end as id_kind, count(*) as negatives, min(v) as lowest
from t where v<0 group by 2""")
def _(spark, sf):
    df = table(spark, sf, "customer").select(
        F.when(F.col("c_custkey") % 3 == 0, "PRJ_x").otherwise("N1").alias("project_id"), F.col("c_acctbal").alias("expenditure"))
    return Q.negative_values(df, ["expenditure"])


@query("diverging_names", C.check("""
select project_id, arg_min(project_name, reporting_month) as first_name, arg_max(project_name, reporting_month) as last_name from can group by 1
having len(list_intersect(string_split(upper(arg_min(project_name, reporting_month)),' '), string_split(upper(arg_max(project_name, reporting_month)),' ')))=0""", "can"))
def _(spark, sf):
    return Q.diverging_names(canon(spark, sf).withColumn("month_idx", Dt.month_index(F.col("reporting_month"))))


_RULE = "coalesce(" + ",".join(
    f"case when regexp_matches(name,{lit(p)}) then '{r}: matched '''||regexp_extract(name,{lit(p)},0)||'''' end" for r, p in I.AUDIT_RULES) + ")"


@query("identity_audit", C.check(f"""
with nm as (select project_id, trim(project_name) as name, min(reporting_month) as seen, count(*) as n from mrg group by 1,2),
rs as (select *, {_RULE} as reason from nm),
pr as (select project_id, coalesce(first(name order by length(name) desc, seen, name desc) filter (name<>''),'') as project_name, cast(sum(n) as bigint) as observation_count,
  first(reason order by seen, name) filter (reason is not null) as reason_flagged from rs group by 1)
select *, case when not starts_with(project_id,'PRJ_') then case when regexp_matches(project_name,{lit(I.WORKS_START)}) then 'KEEP' else 'REVIEW' end
  when regexp_matches(project_name,{lit(I.HEADING_START)}) or regexp_matches(project_name,{lit(I.HEADING_COLUMNS)}) or not starts_with(reason_flagged,'COLUMN_HEADER') then 'EXCLUDE'
  else 'REVIEW' end as recommended_action from pr where reason_flagged is not null""", "mrg"))
def _(spark, sf):
    return Cn.identity_audit(Cn.merge_to_grain(raw(spark, sf)))


@query("reviewed_exclusions", C.check(f"""
with bad as (select distinct project_id from mrg where starts_with(project_id,'PRJ_') and regexp_matches(trim(project_name),'(?i)phase'))
select project_id, reporting_month from can where project_id not in (select project_id from bad)""", "can", "mrg"))
def _(spark, sf):
    merged = Cn.merge_to_grain(raw(spark, sf))
    reviewed = merged.where("project_id like 'PRJ\\\\_%' and project_name rlike '(?i)phase'").select(
        "project_id", F.lit("EXCLUDE").alias("recommended_action"))
    return Cn.drop_non_projects(merged, reviewed).select("project_id", "reporting_month")


# ---- documents -----------------------------------------------------------

DOC_SQL = """
select o_orderkey, case o_orderkey%13 when 0 then concat('Apr-June-',y,'.pdf') when 1 then concat('July_Sept-',y,' (Synopsis).pdf') when 2 then concat('October-December ',y,'.pdf')
  when 3 then concat('Jan-March-',y,'.pdf') when 4 then concat('QPSR_4th_QTR_',y,'-',y2,'.pdf') when 5 then concat('QPISR_3rd_QTR_',y2,'-',y2,' Part-II.pdf')
  when 6 then concat('FR_',upper(substr(mn,1,3)),'_',y,'.pdf') when 7 then 'report.pdf' when 8 then concat(mn,'.pdf') when 9 then concat('part-2 april ',y2,'.pdf')
  when 10 then 'x.pdf' when 11 then 'QPSIR_1st_QTR_2022-23 part2.pdf' else 'nothing.pdf' end as filename,
 case o_orderkey%13 when 7 then concat('Flash Report on Central Sector Projects for the month of ',mn,', ',y) when 8 then concat('status ',y,' end')
  when 10 then concat('2nd Quarter (July-Sept), ',y,'-',y2) when 9 then concat('January-March ',y,' and ',mn,' 2023') else concat('order ',o_orderpriority) end as text,
 cast(o_orderkey%60 as int) as page_count
from (select o_orderkey, o_orderpriority, cast(year(o_orderdate) as string) as y, lpad(cast((year(o_orderdate)+1)%100 as string),2,'0') as y2,
  trim(substr('January  February March    April    May      June     July     August   SeptemberOctober  November December ', cast((month(o_orderdate)-1)*9+1 as int), 9)) as mn from {orders})
"""
C.fragment("docs", (), DOC_SQL.format(orders="orders"))


def _got(c, p, g):
    return f"case when regexp_matches({c},{lit(p)}) then regexp_extract({c},{lit(p)},{g}) end"


def _fiscal(y, q):
    yr = f"case when length({y})=4 then cast({y} as int) else cast({y} as int)+2000 end"
    return (f"case substr(lower({q}),1,1) when '1' then ({yr})||'-06' when '2' then ({yr})||'-09' when '3' then ({yr})||'-12' when '4' then (({yr})+1)||'-03' end")


def _my(c, p):
    return month(f"({_got(c, p, 1)}||' '||{_got(c, p, 2)})")


_SPANS = ", ".join(f"({_got('filename', p, 1)})||'-{m}'" for p, m in Doc.QUARTER_SPANS)
_Q4 = _fiscal(f"({_got('filename', Doc.FOURTH_QUARTER_NAME, 1)})", "'4'")
_QN = _fiscal(f"({_got('filename', Doc.QUARTER_NAME, 2)})", f"({_got('filename', Doc.QUARTER_NAME, 1)})")
_QT = _fiscal(f"({_got('text', Doc.QUARTER_TEXT, 3)})", f"({_got('text', Doc.QUARTER_TEXT, 1)})")
_NM = month(f"(({_got('filename', Doc.NAME_MONTH, 1)})||' '||coalesce(({_got('text', '(?:19|20)[0-9]{2}', 0)}),'2024'))")
_DETECT = f"coalesce({_SPANS}, {_Q4}, {_QN}, {_QT}, {_my('filename', Doc.NAME_MONTH_YEAR)}, {_my('text', Doc.TEXT_MONTH_YEAR)}, {_NM})"
_INS = (f"coalesce({_my('text', Doc.RECENT_TEXT_MONTH)}, ({_got('text', Doc.RECENT_TEXT_QUARTER, 2)})||' '||({_got('text', Doc.RECENT_TEXT_QUARTER, 1)}), "
        + month(f"(({_got('filename', Doc.NAME_MONTH_MAYBE_YEAR, 1)})||' '||coalesce(nullif(({_got('filename', Doc.NAME_MONTH_MAYBE_YEAR, 2)}),''),'2024'))") + ", 'UNKNOWN')")
_CLS = """case when page_count<=25 or contains(l,'synopsis') then 'SYNOPSIS'
 when contains(l,'part-ii') or contains(l,'part-2') or contains(l,'part_ii') then case when contains(l,'april') or contains(l,'may') then 'ANNEXURE_XVIII'
   when contains(l,'qpsr') or contains(l,'qpisr') then 'CLASSIC_MASTER_TABLE' else 'MODERN_TABLE_7' end
 when contains(l,'apr-jun') or contains(l,'july-sep') or contains(l,'oct-dec') or contains(l,'jan-mar') then 'CLASSIC_MASTER_TABLE'
 when contains(l,'qpsr') or contains(l,'qpisr') or starts_with(filename,'QPSIR_1st_QTR_2022-23') then
   case when contains(l,'part2') or contains(l,'3rd_qtr') or contains(l,'4th_qtr') then 'MODERN_TABLE_7' else 'QPSR_CARDS' end
 when starts_with(filename,'FR_') or starts_with(filename,'MonthlyFR_') or starts_with(filename,'FLR_') or (starts_with(filename,'FR') and not contains(l,'march')) then 'CLASSIC_MASTER_TABLE'
 else 'MODERN_TABLE_7' end"""


@query("document_month_and_family", C.check(
    f"select o_orderkey, filename, {_DETECT} as month, {_INS} as inspection_period, {_CLS} as family from (select *, lower(filename) as l from docs)", "docs"))
def _(spark, sf):
    f, t = F.col("filename"), F.col("text")
    return run_sql(spark, sf, DOC_SQL, "orders").select(
        "o_orderkey", "filename", Doc.detect_reporting_month(f, t).alias("month"), Doc.inspection_period(f, t).alias("inspection_period"),
        Doc.classify_document(f, F.col("page_count"), 25).alias("family"))


@query("document_inspection", C.check(f"""
with pg as (select source_pdf as filename, source_page as page, code_cell||' '||name_cell as text from cells),
cd as (select distinct filename, unnest(regexp_extract_all(text,{lit(T.PROJECT_CODE)})) as code from pg)
select filename, count(distinct page) as pages, sum(length(trim(text)))>100 as is_text,
 coalesce((select count(*) from cd where cd.filename=pg.filename),0) as codes_found, (select min(code) from cd where cd.filename=pg.filename) as first_code
from pg group by 1""", "cells"))
def _(spark, sf):
    pages = cells(spark, sf).select(
        F.col("source_pdf").alias("filename"), F.col("source_page").alias("page"), F.concat("code_cell", F.lit(" "), "name_cell").alias("text"))
    return Cn.inspect_documents(pages)


@query("quality_log_rollup", C.check(
    f"select count(*) as processed, count(*) filter (s in ('SUCCESS','SYNOPSIS_NO_PROJECT_TABLES')) as successful, count(*) filter (s not in ('SUCCESS','SYNOPSIS_NO_PROJECT_TABLES')) as failed "
    f"from (select case when {_CLS}='SYNOPSIS' then 'SYNOPSIS_NO_PROJECT_TABLES' when o_orderkey%7=0 then 'NO_PROJECTS_FOUND' else 'SUCCESS' end as s from (select *, lower(filename) as l from docs))", "docs"))
def _(spark, sf):
    fam = Doc.classify_document(F.col("filename"), F.col("page_count"), 25)
    log = run_sql(spark, sf, DOC_SQL, "orders").select(
        F.when(fam == "SYNOPSIS", "SYNOPSIS_NO_PROJECT_TABLES").when(F.col("o_orderkey") % 7 == 0, "NO_PROJECTS_FOUND")
        .otherwise("SUCCESS").alias("extraction_status"))
    return Q.quality_rollup(log)
