"""Raw report cells derived from ``lineitem`` and ``part``.

Each row imitates one extracted table row: codes, titles, dates, money and
progress in the many spellings reports use. Same text on both sides.
"""

RAW_SQL = """
with b as (
  select (((l_orderkey*10+l_linenumber)*100000+l_partkey%100000)*100+l_suppkey%100)*100+(year(l_shipdate)*12+month(l_shipdate))%100 as raw_record_id,
    l_partkey as pk, l_orderkey+l_linenumber as k, l_linenumber as ln, cast(l_quantity as bigint) as q,
    cast(year(l_shipdate) as bigint) as y, cast(month(l_shipdate) as bigint) as m, p_name, p_brand, p_type, p_size,
    cast(floor(p_retailprice*p_size*4) as bigint) as app,
    cast(floor(l_extendedprice*(1-l_discount)*100) as bigint) as spend, l_suppkey as sk
  from {lineitem} join {part} on p_partkey=l_partkey),
d as (
  select *, lpad(cast(m as string),2,'0') as mm, cast(m as string) as m1, cast(y as string) as yy,
    trim(substr('January  February March    April    May      June     July     August   SeptemberOctober  November December ', cast((m-1)*9+1 as int), 9)) as mname,
    concat(cast(cast(floor(app/100) as bigint) as string),'.',lpad(cast(app%100 as string),2,'0')) as appt,
    concat(case when app>=100000 then concat(cast(cast(floor(app/100000) as bigint) as string),',',lpad(cast(cast(floor(app/100) as bigint)%1000 as string),3,'0'))
                else cast(cast(floor(app/100) as bigint) as string) end,'.',lpad(cast(app%100 as string),2,'0')) as appc,
    concat(cast(cast(floor(spend/100) as bigint) as string),'.',lpad(cast(spend%100 as string),2,'0')) as spt
  from b)
select raw_record_id,
  case when pk%10=9 then '' when k%5=0 then concat('(n',lpad(cast(pk as string),8,'0'),')') when k%5=1 then concat('code ',cast(200000000+pk as string),' x')
       else concat('[N',lpad(cast(pk as string),8,'0'),']') end as code_cell,
  case when pk%10=9 and k%12<8 then case k%12 when 0 then 'Table 7' when 1 then 'GRAND TOTAL' when 2 then 'RAILWAYS' when 3 then 'STATE : KERALA'
         when 4 then 'List of Projects' when 5 then 'AB' when 6 then '12345' else 'Flash Report' end
       else concat(upper(p_name),case k%4 when 0 then '' when 1 then concat('  PHASE ',cast(pk%7 as string)) when 2 then concat(chr(160),'PACKAGE',chr(10),'II') else concat(' - [N',lpad(cast(pk as string),8,'0'),'],NHAI,BIHAR') end) end as name_cell,
  case when k%6=0 then '' else case p_type when 'STANDARD' then 'RAILWAYS *' when 'PROMO' then 'Power (12)' when 'SMALL' then 'COAL' when 'LARGE' then 'Petroleum & Natural Gas'
       when 'ECONOMY' then 'Road Transport  & Highways' else 'Misc.' end end as sector_cell,
  case when k%3=0 then '' else concat('Ministry of ',p_brand) end as ministry_cell,
  case sk%4 when 0 then '' when 1 then 'KERALA' when 2 then 'BIHAR' else 'GOA' end as state_cell,
  case when ln=7 and k%2=0 then 'N.A.' else case k%9 when 0 then concat(yy,'-',mm) when 1 then concat(m1,'/',yy) when 2 then concat('(',mm,'/',yy,')')
       when 3 then concat(mname,', ',yy) when 4 then concat(substr(mname,1,3),'-',substr(yy,3,2)) when 5 then concat('as on ',m1,'/',yy,' (rev)')
       when 6 then concat('Report for ',mname,' ',yy) when 7 then concat(' ',mm,'-',yy,' ') else concat(yy,'/',m1) end end as month_cell,
  case k%5 when 0 then appc when 1 then concat('₹ ',appt) when 2 then concat('Rs. ',appt,' crore') when 3 then concat('[',appc,']') else concat('approx ',appc,' (rev)') end as cost_cell,
  case k%6 when 0 then '-' when 1 then concat('Rs.',spt) when 2 then 'Nil' else spt end as exp_cell,
  case k%7 when 0 then concat(cast(q as string),'%') when 1 then concat(cast(q as string),'.25 %') when 2 then concat('0.',lpad(cast(q as string),2,'0'))
       when 3 then 'N.A.' when 4 then concat('(',cast(q as string),')') when 5 then concat('1',lpad(cast(q as string),2,'0')) else 'abc' end as prog_cell,
  case k%4 when 0 then concat(mm,'/',yy,chr(10),'(',mm,'/',cast(y+1 as string),')',chr(10),'[',mm,'/',cast(y+2 as string),']')
       when 1 then concat(mname,' ',yy,chr(10),chr(10),'  ',mm,'/',cast(y+1 as string)) when 2 then concat('[',mm,'/',yy,']',chr(10),'-',chr(10),'x',chr(10),'y',chr(10),'z')
       else '' end as doc_cell,
  case k%4 when 0 then '' else cast(ln+k%3 as string) end as dev_cell,
  case k%5 when 0 then '' else concat('milestone ',cast(k%100 as string)) end as milestone_cell,
  concat('FR_',upper(substr(mname,1,3)),'_',yy,'.pdf') as source_pdf, cast(ln+pk%5 as int) as source_page
from d
"""
