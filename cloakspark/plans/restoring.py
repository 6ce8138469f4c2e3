"""Queries of nested restoration and of cycles, over documents, events and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloakspark.functions import patterns as P
from cloakspark.operators import mapping as M
from cloakspark.operators.cycles import cycles
from cloakspark.operators.restoration import restored, restored_json
from cloakspark.plans.fixtures import RUN, duck, fixture
from cloakspark.plans.queries import _BACK, _FIRST, _FOUND, _MASKED
from cloakspark.sources.session import checkpointed

#: Users by token, with a value that mentions another token.
PEOPLE = """
select '<USER_' || cast(c_custkey as string) || '>' as placeholder, c_name || ' of <CITY_' || cast(c_nationkey as string) || '>' as original_value from {customer}
union all select distinct '<CITY_' || cast(c_nationkey as string) || '>', case when c_nationkey % 5 = 0 then 'city "' || cast(c_nationkey as string) || '" by <SEA_1>' else 'town' || chr(10) || cast(c_nationkey as string) end from {customer}"""

#: Events as payloads: their own properties, and notes about users; braces by number, as the names of tables stand in braces.
PAYLOADS = """
select event_id, chr(123) || '"event":' || cast(event_id as string) || ',"props":' || props || ',"notes":["<USER_' || cast(user_id as string) || '>",' || chr(123) || '"<USER_1>":"' || event_type || ' <USER_' || cast(user_id + 1 as string) || '><CITY_3>"' || chr(125) || ']' || chr(125) as payload from {events}"""

#: Values that mention up to two others: in groups of 30, with ways ahead and back.
BRANCHES = """
select '<T_' || cast(c_custkey as string) || '>' as placeholder,
  case when p % 3 = 0 then 'a <T_' || cast(c_custkey + 1 as string) || '> b <T_' || cast(first + (p * 7) % 30 as string) || '>'
       when p = 29 and first % 60 = 1 then 'back to <T_' || cast(first as string) || '>' when p = 29 then 'end' when p = 17 then 'self <T_' || cast(c_custkey as string) || '>'
       else 'on <T_' || cast(c_custkey + 1 as string) || '>' end as original_value
from (select c_custkey, (c_custkey - 1) % 30 as p, c_custkey - (c_custkey - 1) % 30 as first from {customer}) a"""


def rehydrate_documents(spark, d):
    """Every document stands behind a token, whose value is its masked text: two passes or more for a text with values."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    trace = checkpointed(M.traced(docs, "doc_id", "text", RUN, P.ASCII_TEXT_PATTERNS))
    name = F.concat(F.lit("<DOC_"), F.col("id").cast("string"), F.lit(">"))
    mapping = M.first_seen(M.found_of(trace, RUN)).unionByName(trace.select(name.alias("placeholder"), F.col("text").alias("original_value")))
    texts = trace.select(F.col("id").alias("doc_id"), F.concat(F.lit("see "), name, F.lit(" and <X_1>")).alias("text"))
    return restored(texts, "doc_id", "text", mapping)


def restore_events(spark, d):
    return restored_json(fixture(spark, d, PAYLOADS), "event_id", "payload", fixture(spark, d, PEOPLE))


def cycles_branching(spark, d):
    mapping = fixture(spark, d, BRANCHES)
    number = F.regexp_extract("placeholder", r"(\d+)", 1).cast("int")
    return cycles(mapping, mapping.where((number % 30 == 5) & (number % 4 < 3)).select("placeholder"))


QUERIES = {f.__name__: f for f in (rehydrate_documents, restore_events, cycles_branching)}


def _passes(key: str) -> str:
    return ", ".join(f"p{k + 1} as (select {key}, n as t, passes + case when n <> t then 1 else 0 end as passes from (select {key}, t, passes, {_BACK} as n from p{k}, m))" for k in range(5))


_PH = "'" + P.PLACEHOLDER + "'"
ORACLES = {
    "rehydrate_documents": f"""with {_MASKED}, {_FOUND}, {_FIRST}, both_ as (select * from mapping union all select '<DOC_' || doc_id || '>', text from masked),
        m as (select map_from_entries(list((placeholder, original_value))) as m from both_), p0 as (select doc_id, 'see <DOC_' || doc_id || '> and <X_1>' as t, 0 as passes from masked), {_passes("doc_id")}
        select doc_id, t as text, passes from p5""",
    # the parts that are restored, apart from each other, as no pass crosses a string of the payload
    "restore_events": f"""with m as (select map_from_entries(list((placeholder, original_value))) as m from ({duck(PEOPLE)})),
        p0 as (select event_id * 2 as k, '<USER_' || user_id || '>' as t, 0 as passes from events union all select event_id * 2 + 1, event_type || ' <USER_' || (user_id + 1) || '><CITY_3>', 0 from events), {_passes("k")},
        w as (select k // 2 as event_id, list(to_json(t) order by k) as v, max(passes) as passes from p5 group by k // 2)
        select event_id, '{{"event":' || event_id || ',"props":' || props || ',"notes":[' || v[1] || ',{{"<USER_1>":' || v[2] || '}}]}}' as payload, passes from w join events using (event_id)""",
    "cycles_branching": f"""with recursive e as ({duck(BRANCHES)}), d as (select distinct placeholder as s, unnest(regexp_extract_all(original_value, {_PH})) as x from e), dep as (select * from d where x in (select placeholder from e)),
        path as (select s, x from dep union select p.s, dep.x from path p join dep on p.x = dep.s),
        roots as (select placeholder as r from (select *, regexp_extract(placeholder, '(\\d+)', 1) :: int as n from e) where n % 30 = 5 and n % 4 < 3),
        reach as (select r from roots union select x from path join roots on s = r)
        select distinct s as placeholder from path where s = x and s in (select r from reach)""",
}
