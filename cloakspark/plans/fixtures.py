"""Derived input tables, each one SQL text that Spark and DuckDB both read. Tables stand in braces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RUN = "run-1"

#: One row per customer: identity, contact data and notes that mention them in several ways.
BANK = """
select row_id, first_name, last_name, email, phone, address,
  case row_id % 8
    when 0 then 'Spoke with ' || upper(first_name) || ' ' || last_name || ' about the loan'
    when 1 then 'Call ' || phone || ' or mail ' || email || '.'
    when 2 then 'Lives at ' || address || ' since long'
    when 3 then first_name || ' ' || last_name || 'son is someone else'
    when 4 then 'mail other.person@site.org or 001 555 123 4567 now'
    when 5 then ''
    when 6 then 'They moved to 77 Elm Grove Road, ask ' || first_name || ' ' || last_name
    else 'See <b>' || email || '</b> and <NAME_0123456789>' end as customer_notes,
  case row_id % 3
    when 0 then 'Paid by ' || first_name || '  ' || last_name || ' to ' || email
    when 1 then 'met with Jordan, employed by Acme Works, ref EMP-77AB'
    else 'nothing' end as transaction_description
from (select row_id, first_name, last_name, lower(first_name || '.' || last_name) || '@kag.com' as email,
        cast(19458794000 + row_id as string) as phone, cast(row_id % 90 + 10 as string) || ' ' || street || ' Street' as address
      from (select c_custkey as row_id,
              case c_custkey % 5 when 0 then 'John' when 1 then 'Mary' when 2 then 'Ravi' when 3 then 'Elena' else 'Noah' end as first_name,
              case c_custkey % 7 when 0 then 'Smith' when 1 then 'Patel' when 2 then 'Garcia' when 3 then 'Young' when 4 then 'Okafor' when 5 then 'Lind' else 'Costa' end as last_name,
              case c_custkey % 4 when 0 then 'Oak' when 1 then 'Hill' when 2 then 'Mill' else 'King' end as street
            from {customer}) a) b"""

#: One text per conversation id: a heading and numbered records with sensitive sentences.
NUMBERED = """
select c_custkey as doc_id,
  case when c_custkey % 4 = 3 then '' else 'Log of branch ' || cast(c_custkey % 9 as string) || chr(10) end
  || '1. Customer ' || n || ' (DOB 1980-0' || cast(c_custkey % 9 + 1 as string) || '-15) called. Contact: a' || cast(c_custkey as string) || '@mail.org, phone 98765 43210' || chr(10)
  || case c_custkey % 3 when 0 then '2. Mr. ' || n || ' visited City Care Hospital for diabetes medication, paid USD 120.50' || chr(10)
       when 1 then '2. Employee ID EMP-' || cast(10000 + c_custkey as string) || ' on trip to Lisbon. Passport number: K' || cast(1000000 + c_custkey as string) || chr(10)
       else '2. Transaction TXN-AB' || cast(10000 + c_custkey as string) || ' of Delta Foods Ltd transferred 50 pounds for portfolio review' || chr(10) end
  || '3. ' || n || ' again, medical ref: MED-' || cast(20000 + c_custkey as string) || '; account number 123456789012 IFSC ABCD0123456 PAN ABCDE1234F' as text
from (select c_custkey, case c_custkey % 5 when 0 then 'Anna Bell' when 1 then 'Omar Said' when 2 then 'Lea Vogt' when 3 then 'Ivan Petrov' else 'Mei Chen' end as n from {customer}) a"""

#: Detections of batches of 25 customers, as a detector may answer.
DETECTIONS = """
select cast(floor(c_custkey / 25) as bigint) as batch_id, c_custkey as ord,
  case c_custkey % 6 when 0 then 'person names' when 1 then 'NAME' when 2 then 'employee-ids' when 3 then 'Hospitals' when 4 then 'LOAN_ID' else 'NAMES' end as category,
  case c_custkey % 6 when 0 then 'Jordan' when 1 then 'J' when 2 then 'EMP-77AB' when 3 then ' Acme Works ' when 4 then '12' else case when c_custkey % 12 = 5 then '<NAME_x>' else '123' end end as value
from {customer}"""

#: Credit data per customer as text, some limits not positive, some not numbers.
CREDIT = """
select c_custkey as customer_id, c_name as name, c_mktsegment as segment,
  case when c_custkey % 11 = 0 then '0' when c_custkey % 13 = 0 then 'n/a' else cast(c_custkey % 50 * 100 as string) end as credit_limit,
  cast(coalesce(n, 0) * 90 as string) as balance
from {customer} c left join (select o_custkey, count(*) as n from {orders} group by o_custkey) o on c.c_custkey = o.o_custkey"""

#: Mappings with nested values: chains of five, and cycles.
EDGES = """
select '<T_' || cast(c_custkey as string) || '>' as placeholder,
  case when c_custkey % 50 = 7 then 'loop <T_' || cast(c_custkey + 1 as string) || '>' when c_custkey % 50 = 8 then 'back <T_' || cast(c_custkey - 1 as string) || '>'
       when c_custkey % 5 = 0 then 'value ' || cast(c_custkey as string) else 'in <T_' || cast(c_custkey - 1 as string) || '>' end as original_value
from {customer}"""

TABLES = ("customer", "orders", "documents", "events", "lineitem", "conversations")


#: Customers, or turns of conversations, that a task derives rows from.
ROWS_A_TASK = 4000


def spread(df: DataFrame, rows: int = ROWS_A_TASK) -> DataFrame:
    """The frame dealt out over tasks by its number of rows: files are split by bytes, and a million short rows may be one split."""
    tasks = -(-df.count() // rows)
    return df.repartition(tasks) if tasks > 1 else df


def fixture(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The derived table, in Spark. Work grows with customers, of which it needs little more than the key."""
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **{t: spread(df) if t in ("customer", "conversations") else df for t, df in used.items()})


def duck(sql: str) -> str:
    """The same text for DuckDB."""
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql
