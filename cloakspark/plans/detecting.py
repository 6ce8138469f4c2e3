"""Queries of numbering, packing, and detection in two phases, over documents, conversations, orders and customers."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from cloakspark.functions import patterns as P
from cloakspark.operators import detection as D
from cloakspark.operators import records as R
from cloakspark.operators.numbering import greedy_batches, numbered
from cloakspark.plans import fixtures as X
from cloakspark.plans.fixtures import RUN, fixture
from cloakspark.plans.queries import _SHAPED, _stitch
from cloakspark.plans.queries import ORACLES as ORACLES_OF_QUERIES
from cloakspark.sources.policy import RunConfig

#: What the detector of the queries knows: names at first, and more on the second look.
KNOWN = {"person names": ["Anna Bell", "Omar Said", "Lea Vogt", "anna", "50"], "employee ids": ["EMP-77AB"]}
MORE = {"organisations": ["Delta Foods Ltd", "City Care Hospital"], "places": ["Lisbon"]}
PLACES = "Lisbon|Delta Foods|City Care"

#: Values to be found in the turns of a conversation: the nth word of other turns, with categories that decide the order.
WORDS = """
select distinct conv_id, case when turn % 2 = 0 then 'NAME' else 'ORGANIZATION' end as category, regexp_replace(split_part(text, ' ', cast(k as int)), '[^A-Za-z]', '') as value
from {conversations}, (select c_custkey as k from {customer} where c_custkey between 1 and 40) n"""


def detector(known=KNOWN, more=MORE):
    """Finds what it knows in a prompt; on the second look what else there is."""
    return lambda said: json.dumps({c: [v for v in vs if v in said] for c, vs in (more if "searched before" in said else known).items()})


def number_documents(spark, d):
    """Rows of a file in its order, numbered densely, in batches of 25."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("source", "text")
    rows = R.fixed_batches(numbered(docs, "row"), "row", 25)
    return rows.select("row", "batch_id", "position", F.sha2("text", 256).alias("text_sha256"), "source")


def batch_lines(spark, d):
    """All lines of orders in one group, packed by their number and price."""
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(F.lit("all").alias("g"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"), F.floor("l_quantity").cast("long").alias("size"))
    return greedy_batches(rows, "g", "line", "size", 25, 400)


def apply_many(spark, d):
    """All words of a conversation's turns replaced in its turns, some hundred values a batch."""
    turns = spark.read.parquet(f"{d}/conversations.parquet")
    found = fixture(spark, d, WORDS).where("value <> ''")
    return R.applied_detections(turns, found, "conv_id", "text", RUN, notes=False, applied="applied").select("conv_id", "turn", "text", F.size("applied").alias("n_applied"))


def _phases(spark, d):
    rows = R.split_records(fixture(spark, d, X.NUMBERED), "doc_id", "text").where("number is not null").select("doc_id", "number", "text")
    config = RunConfig(batch_size=2, max_characters=300, delay_seconds=0.0)
    return D.two_phases(rows, "number", "text", RUN, detector(), lambda left: left.where(F.col("text").rlike(PLACES)), config, group="doc_id", applied="applied")


def detect_two_phases(spark, d):
    return _phases(spark, d).select("doc_id", "number", "text", F.size("applied").alias("n_applied"))


def detect_count(spark, d):
    """Values that replaced something, each once per record."""
    return R.applied_count(_phases(spark, d), ["doc_id", "number"])


QUERIES = {f.__name__: f for f in (number_documents, batch_lines, apply_many, detect_two_phases, detect_count)}


def _named() -> str:
    """category, value of all that the detector can say, under common names and with the category that the value's shape gives."""
    said = [(k.upper().replace(" ", "_"), v) for known in (KNOWN, MORE) for k, vs in known.items() for v in vs]
    rows = ", ".join(f"('{P.TEXT_ALIASES.get(c, c)}', '{v}', {i})" for i, (c, v) in enumerate(said))
    return f"(select {_SHAPED} as label, value, i from (values {rows}) x(category, value, i))"


def _chained() -> str:
    """The records with every value replaced in turn, and how many of them were there. Digits come first, as hashes of tokens hold digits too."""
    n = sum(len(vs) for known in (KNOWN, MORE) for vs in known.values())
    digits = [v for known in (KNOWN, MORE) for vs in known.values() for v in vs].index("50")
    steps = [f"c0 as (select doc_id, number, text as t, 0 as n from ({ORACLE_RECORDS}) where number is not null)"]
    for k, i in enumerate([digits, *[i for i in range(n) if i != digits]]):
        pattern = "'(?i)\\b' || x.value || '\\b'"
        token = f"'<' || x.label || '_' || substr(sha256('{RUN}|' || x.label || '|' || z[2]), 1, 10) || '>'"
        # what the detector doesn't see in this case of letters isn't there at all
        steps.append(f"c{k + 1} as (select doc_id, number, {_stitch('t', pattern, token)} as t, n + regexp_matches(t, {pattern}) :: int as n from c{k}, (select * from named where i = {i}) x)")
    return f"named as materialized {_named()}, " + ", ".join(steps) + f", done as (select doc_id, number, t as text, n as n_applied from c{n})"


ORACLE_RECORDS = ORACLES_OF_QUERIES["split_records"]
ORACLES = {
    "number_documents": "select row, row // 25 as batch_id, (row % 25 + 1) :: int as position, text_sha256, source from (select row_number() over (order by doc_id) - 1 as row, sha256(text) as text_sha256, source from documents)",
    "batch_lines": """with recursive r as (select 'all' as g, l_orderkey * 10 + l_linenumber as line, floor(l_quantity) :: bigint as size, row_number() over w as k, sum(floor(l_quantity) :: bigint) over (w rows unbounded preceding) as upto from lineitem window w as (order by l_orderkey * 10 + l_linenumber, floor(l_quantity))),
        nxt as materialized (select a.k, coalesce(min(b.k) filter (b.upto - (a.upto - a.size) > 400), a.k + 25) as n from r a left join r b on b.k between a.k + 1 and a.k + 25 group by a.k),
        starts as (select 1 :: bigint as k, 0 as batch union all select n, batch + 1 from starts join nxt using (k))
        select g, line, batch from r asof join starts on r.k >= starts.k""",
    "detect_two_phases": f"with {_chained()} select doc_id, number, text, n_applied from done",
    "detect_count": f"with {_chained()} select sum(n_applied) :: bigint as n from done",
}
