"""Registered queries on the review as log and as stream, keyed tables and sources that are read once, each with the SQL that checks it."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import functions as F

from docket.operators import reviewing
from docket.operators.evaluation import ORDER
from docket.plans.catalogue import query, t
from docket.sources import files
from docket.streaming import inbox, limits, reviews
from docket.streaming.upserts import KeyedTable, adding, replacing
from docket.streaming.windows import shared_dir

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks_state(spark):
    """Streams that start inside keep their state in RocksDB."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def scratch(spark, name: str) -> str:
    return f"{shared_dir(spark)}/streams/{name}-{uuid.uuid4().hex}"


def review_log(spark, sf):
    """Events as decisions on items, each item submitted before its first; some orders are incomplete, too large, or routed away."""
    k = F.col("event_id")
    e = t(spark, sf, "events").select((F.col("user_id") * 16 + k % 16).alias("item"), F.col("ts").cast("timestamp").alias("at"), k.alias("seq"), "event_type")
    action = F.when(F.col("event_type") == "error", "rejected").when(F.col("event_type").isin("purchase", "view"), "approved").otherwise("edited")
    m = lambda *pairs: F.create_map(*map(F.lit, pairs))
    kind, k = F.col("seq") % 5, F.col("item")
    edits = (
        F.when(action == "rejected", F.lit(None).cast(reviewing.EDITS)).when(kind == 1, m("buyer_name_text", "B")).when(kind == 2, m("line_items.0.quantity", "5000", "buyer_name_text", "B"))
        .when(kind == 3, m("line_items.0.product_text", "nothing")).when((kind == 4) & (action == "edited"), m("customer_po_text", "PO"))
    )
    line = F.struct(F.concat(F.lit("SKU-"), (k % 20 + 1).cast("string")), F.when(k % 5 == 0, 5000).otherwise(5), *(F.lit(None),) * 3)
    text = lambda v: F.lit(v).cast("string")
    order = F.struct(text("P"), text("soon"), text("here"), F.when(k % 3 > 0, "A"), text(None), F.array(line)).cast(ORDER)
    made = e.select("item", "at", "seq", action.alias("action"), F.lit(None).cast(ORDER).alias("extraction"), edits.alias("edits"))
    first = e.groupBy("item").agg(F.min("at").alias("at"))
    return made.union(first.select("item", "at", F.lit(-1).cast("bigint"), F.lit("submitted"), F.when(k % 11 > 0, order), F.lit(None).cast(reviewing.EDITS)))


def priced(spark, sf):
    """(terms, products) of the part table."""
    k = F.col("p_partkey")
    p = t(spark, sf, "part").select(F.concat(F.lit("sku-"), k.cast("string")).alias("term"), k.cast("string").alias("sku"), (1 + k % 3).alias("moq"), F.lit(100).cast("bigint").alias("most"), F.round("p_retailprice").cast("bigint").alias("price_cents"))
    return p.select("term", "sku"), p.drop("term")


_VERSIONS = """case {0} when 0 then '[]' when 1 then '[{{"key":"buyer_name_text","value":"B"}}]' when 2 then '[{{"key":"buyer_name_text","value":"B"}},{{"key":"line_items.0.quantity","value":"5000"}}]'
 when 3 then '[{{"key":"line_items.0.product_text","value":"nothing"}}]' when 4 then '[{{"key":"customer_po_text","value":"PO"}}]' end"""
_REVIEW = f"""with recursive e as (select user_id * 16 + event_id % 16 item, case when event_type = 'error' then 'rejected' when event_type in ('purchase', 'view') then 'approved' else 'edited' end action,
  case when event_type = 'error' or event_id % 5 = 0 or (event_id % 5 = 4 and event_type in ('purchase', 'view')) then 0 else event_id % 5 end kind, row_number() over (partition by user_id * 16 + event_id % 16 order by ts, event_id) i from events),
 f as (select distinct item, 0::BIGINT i, 'pending' status, 0::BIGINT kind, 0::BIGINT refused, 0::BIGINT sent, 0::BIGINT held, false submitted, null::BIGINT last, null::BIGINT before, null::BIGINT covered from e
  union all select item, i, case when no then status when action = 'edited' and given = 0 then 'approved' else action end, now, refused + no::INT, sent + (go and fits)::INT, held + (go and not fits)::INT, submitted or (go and fits),
   case when go and fits then now else last end, case when go and fits then last else before end, case when go and (fits or not submitted) then now else covered end
  from (select *, action = 'approved' and not no and not (submitted and covered = now) go, item % 11 > 0 and item % 5 > 0 and now not in (2, 3) fits
   from (select f.*  exclude (i), e.i, e.action, e.kind given, e.action = 'approved' and (f.item % 11 = 0 or (f.item % 3 = 0 and f.kind not in (1, 2))) no,
     case when e.action = 'approved' and (e.kind = 0 or f.item % 11 = 0 or (f.item % 3 = 0 and f.kind not in (1, 2))) then f.kind else e.kind end as now from f join e on e.item = f.item and e.i = f.i + 1)))
 select item, status, {_VERSIONS.format('kind')} as version, i as decisions, refused, sent, held, submitted, case when submitted then 'ORD-' || upper(substr(sha256(item || '|' || {_VERSIONS.format('last')}), 1, 8)) end order_id,
  case when before is not null then 'ORD-' || upper(substr(sha256(item || '|' || {_VERSIONS.format('before')}), 1, 8)) end amends, {_VERSIONS.format('covered')} for_edits from f qualify row_number() over (partition by item order by i desc) = 1"""


@query(_REVIEW)
def review_states(spark, sf):
    return reviewing.review(review_log(spark, sf), *priced(spark, sf))


@query(_REVIEW)
def review_states_stream(spark, sf):
    """The same log arriving in three parts; the stream stops after each and goes on from its checkpoint."""
    log, (terms, products), at = review_log(spark, sf), priced(spark, sf), scratch(spark, "reviews")
    cuts = log.agg(F.percentile(F.unix_micros("at"), F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("c")).first().c
    table = KeyedTable(spark, f"{at}/table", reviewing.STATE, ["item"])
    part = F.when(F.unix_micros("at") <= cuts[0], 0).when(F.unix_micros("at") <= cuts[1], 1).otherwise(2)
    for k in range(3):
        log.where(part == k).write.mode("append").parquet(f"{at}/log")
        reviews.review_stream(spark.readStream.schema(log.schema).parquet(f"{at}/log"), table, terms, products, f"{at}/checkpoint")
    return table.read()


@query("select user_id as org_id, strftime(ts, '%Y-%m') as period, count(*) as events, sum(length(props))::BIGINT as tokens from events group by all")
def usage_upserts(spark, sf):
    """Usage added to a keyed table in three runs, the second of them merged twice."""
    rows = t(spark, sf, "events").select(F.col("user_id").alias("org_id"), F.date_format("ts", "yyyy-MM").alias("period"), F.lit(1).cast("bigint").alias("events"), F.length("props").cast("bigint").alias("tokens"), (F.col("event_id") % 3).alias("run"))
    keys, sums = ["org_id", "period"], ["events", "tokens"]
    table = KeyedTable(spark, f"{scratch(spark, 'usage')}", "org_id bigint, period string, events bigint, tokens bigint", keys, 16)
    for run in (0, 1, 1, 2):
        table.merge(rows.where(F.col("run") == run), run, adding(keys, sums))
    return table.read()


@query("select user_id as org_id, arg_max(event_type, (ts, event_id)) as plan, arg_max(event_id, (ts, event_id)) as event_id from events group by 1")
def org_upserts(spark, sf):
    """The latest row of each org, whatever the order in which batches come."""
    rows = t(spark, sf, "events").select(F.col("user_id").alias("org_id"), F.col("event_type").alias("plan"), F.col("ts").cast("timestamp").alias("at"), "event_id")
    table = KeyedTable(spark, f"{scratch(spark, 'orgs')}", rows.schema, ["org_id"], 16)
    for batch, run in enumerate((2, 0, 1)):
        table.merge(rows.where(F.col("event_id") % 3 == run), batch, replacing(["org_id"], ["at", "event_id"]))
    return table.read().select("org_id", "plan", "event_id")


@query("""select case when doc_id % 7 = 0 then 'unparsed' when doc_id % 5 = 0 then 'no id' end as error, count(*) n, sum(length(coalesce(text, '')))::BIGINT chars, min(doc_id) first from documents group by 1""")
def inbox_once(spark, sf):
    """Documents as messages of a file stream, which is started three times: half of them, the rest, nothing new."""
    k, at = F.col("doc_id"), scratch(spark, "inbox")
    good = F.to_json(F.struct(F.when(k % 5 > 0, k).alias("id"), F.length(F.coalesce("text", F.lit(""))).alias("chars")), {"ignoreNullFields": "false"})
    messages = t(spark, sf, "documents").select(k, F.when(k % 7 == 0, F.concat(F.lit("{"), good)).otherwise(good).alias("payload"), F.length(F.coalesce("text", F.lit(""))).alias("size"))
    parsed = files.strict(F.col("payload"), "id bigint, chars bigint")
    error = F.when(parsed.isNull(), "unparsed").when(parsed["id"].isNull(), "no id")
    for half in (0, 1, None):
        if half is not None:
            messages.where(k % 2 == half).write.mode("append").parquet(f"{at}/in")
        inbox.consume(spark.readStream.schema(messages.schema).parquet(f"{at}/in"), error, f"{at}/out", f"{at}/log")
    every = inbox.consumed(spark, f"{at}/out", messages.schema, False).withColumn("error", F.lit(None).cast("string")).unionByName(inbox.consumed(spark, f"{at}/out", messages.schema, True))
    return every.groupBy("error").agg(F.count("*").alias("n"), F.sum("size").alias("chars"), F.min("doc_id").alias("first"))


@query("""with w as (select event_id, user_id, cast(floor(epoch(ts)) as bigint) sec, count(*) over (partition by user_id, cast(floor(epoch(ts)) as bigint) // 86400 order by ts, event_id rows unbounded preceding) used from events)
 select event_id, used, used <= 3 allowed, case when used > 3 then (86400 - sec % 86400) end retry_after from w""")
def stream_rate_limit_decisions(spark, sf):
    """Each event's decision, the events arriving in two parts; the second run goes on from the first one's state."""
    e, at = t(spark, sf, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts")), scratch(spark, "limits")
    half = e.agg(F.percentile(F.unix_micros("ts"), 0.5).alias("c")).first().c
    table = KeyedTable(spark, f"{at}/table", limits.OPEN, ["identity"])
    for part in (F.unix_micros("ts") <= half, F.unix_micros("ts") > half):
        e.where(part).write.mode("append").parquet(f"{at}/events")
        out = limits.limit_stream(spark.readStream.schema(e.schema).parquet(f"{at}/events"), "user_id", "ts", "event_id", 86400, 3, table, f"{at}/out", f"{at}/checkpoint")
    return out.select(F.col("seq").alias("event_id"), "used", "allowed", "retry_after")
