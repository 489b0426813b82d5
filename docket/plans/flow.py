"""Registered queries on edits, approval, fulfilment and the review queue, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import functions as F

from docket.functions import columns as C
from docket.operators import flow, orders
from docket.plans.catalogue import _RULE, b, query, rule_lines, t
from docket.plans.records import _RECORDS, records

_none = lambda: F.lit(None).cast("string")


@query("""with recursive e as (select user_id, event_id, case event_type when 'error' then 'rejected' when 'purchase' then 'approved' else 'edited' end action,
  case when event_type = 'error' or event_id % 4 = 0 then '' when event_type = 'purchase' and event_id % 6 > 0 then '' else 'e' || event_id % 3 end edits, event_id % 5 = 0 missing, event_id % 7 > 1 fits, row_number() over (partition by user_id order by ts, event_id) i from events),
 f as (select distinct user_id, 0::BIGINT i, 'pending' status, '' edits, false submitted, null::VARCHAR order_id, null::VARCHAR amends, null::VARCHAR for_edits, 0::BIGINT refused, 0::BIGINT sent from e
  union all select user_id, i, case when no then os else case when action = 'edited' and edits = '' then 'approved' else action end end, ne, submitted or go and fits, case when go and fits then 'R' || event_id when go and not submitted then null else order_id end,
   case when go and fits then case when submitted then order_id end when go and not submitted then null else amends end, case when go and (fits or not submitted) then ne else for_edits end, refused + no::INT, sent + (go and fits)::INT
  from (select *, action = 'approved' and not no and not (submitted and for_edits is not distinct from ne) go from (select f.user_id, e.i, e.event_id, e.action, e.edits, e.fits, f.status os, f.submitted, f.order_id, f.amends, f.for_edits, f.refused, f.sent, e.action = 'approved' and e.missing no,
   case when e.action = 'approved' and (e.missing or e.edits = '') then f.edits else e.edits end ne from f join e on e.user_id = f.user_id and e.i = f.i + 1)))
 select user_id, status, nullif(edits, '') edits, submitted, order_id, amends, nullif(for_edits, '') for_edits, refused, sent from f qualify row_number() over (partition by user_id order by i desc) = 1""")
def approve_flow(spark, sf):
    e, k, kind = t(spark, sf, "events"), F.col("event_id"), F.col("event_type")
    edits = F.when((kind == "error") | (k % 4 == 0), "").when((kind == "purchase") & (k % 6 > 0), "").otherwise(F.concat(F.lit("e"), (k % 3).cast("string")))
    action = F.when(kind == "error", "rejected").when(kind == "purchase", "approved").otherwise("edited")
    log = e.select("user_id", "ts", "event_id", action.alias("action"), edits.alias("edits"), (k % 5 == 0).alias("missing"), (k % 7 > 1).alias("fits"), F.concat(F.lit("R"), k.cast("string")).alias("receipt"))
    return flow.approve_flow(log, "user_id", "ts", "event_id")


@query(f"""with {_RECORDS}, n as (select ok, has_gold, site, count(k) n, arg_min(product, pos) first, bool_or(quantity is null) filter (pos > 2) hole from pr left join gl on k = ok and has_gold group by all)
 select ok id, 'NEW' po, (case when n = 0 then 1 else n end)::INT lines, 12::BIGINT first_quantity, case when n = 1 then first else 'added' end last_product,
  ((not has_gold or site is null)::INT + (n = 0 and false)::INT + coalesce((select count(*) from gl where k = ok and has_gold and quantity is null and pos > 2), 0) + (n > 1)::INT)::INT missing from n""")
def order_edits(spark, sf):
    r = records(spark, sf)
    n = F.coalesce(F.size("gold.line_items"), F.lit(0)).cast("string")
    edits = F.map_concat(
        F.create_map(F.lit("customer_po_text"), F.lit("NEW"), F.lit("line_items.0.quantity"), F.lit(" 12"), F.lit("line_items.0.unit_text"), F.lit("")),
        F.create_map(F.concat(F.lit("line_items."), n, F.lit(".product_text")), F.lit("added"), F.lit("line_items.1"), F.lit(flow.DELETED), F.lit("line_items.99"), F.lit(flow.DELETED)),
    )
    x = r.select("id", flow.apply_edits(F.col("gold"), edits).alias("o"))
    lines = F.col("o.line_items")
    return x.select("id", F.col("o.customer_po_text").alias("po"), F.size(lines).alias("lines"), F.get(lines, F.lit(0))["quantity"].alias("first_quantity"), F.element_at(lines, -1)["product_text"].alias("last_product"), F.size(flow.missing_after(F.col("o"))).alias("missing"))


@query("select o_orderkey, (case when o_orderkey % 2 = 0 then 0 else 1 end + 1)::INT changed, o_orderkey % 5 = 0 as same from orders")
def edit_drafts(spark, sf):
    k = F.col("o_orderkey")
    original = F.create_map(F.lit("po"), k.cast("string"), F.lit("site"), F.col("o_orderpriority"))
    edits = F.create_map(F.lit("po"), F.when(k % 2 == 0, k.cast("string")).otherwise("x"), F.lit("new"), F.lit("y"), F.lit("site"), F.col("o_orderpriority"))
    other = F.create_map(F.lit("site"), F.col("o_orderpriority"), F.lit("po"), F.when(k % 5 == 0, k.cast("string")).otherwise("?"))
    return t(spark, sf, "orders").select(k, F.size(flow.edit_draft(original, edits)).alias("changed"), flow.same_edits(original, other).alias("same"))


_BUILT = f"with {_RULE}, i as (select *, sku is null or quantity is null or quantity < moq or quantity > most bad from rl), o as (select l_orderkey, count(*) n_lines, bool_or(bad) blocked, coalesce(sum(quantity * cents) filter (sku is not null), 0)::BIGINT total_cents from i group by 1)"


@query(f"{_BUILT} select l_orderkey, not blocked submitted, case when not blocked then 'ORD-' || upper(substr(sha256(l_orderkey || '|' || n_lines || '|' || total_cents), 1, 8)) end order_id, case when blocked then 'held_for_mapping' else 'submitted' end reason from o")
def fulfilments(spark, sf):
    return flow.fulfilments(orders.build_orders(rule_lines(spark, sf), "l_orderkey"), "l_orderkey")


@query(f"with {_RULE} select l_orderkey, count(*) erp_lines, sum(quantity * cents)::BIGINT total_cents from rl where sku is not null and quantity is not null group by 1")
def erp_line_totals(spark, sf):
    return flow.erp_lines(rule_lines(spark, sf)).groupBy("l_orderkey").agg(F.count("*").alias("erp_lines"), F.sum("line_cents").alias("total_cents"))


@query(f"""with {_RECORDS}, x as (select case guess when 'new_order' then 'extract' when 'amendment' then 'extract' when 'cancellation' then 'cancel' when 'inquiry' then 'inquiry' when 'other' then 'discard' end route from pr)
 select route, case route when 'extract' then 'classify,extract,finalize' when 'cancel' then 'classify,cancel,finalize' when 'inquiry' then 'classify,finalize' when 'discard' then 'classify,finalize' else 'classify' end steps, count(*) n from x group by 1, 2""")
def pipeline_branches(spark, sf):
    return flow.branches(records(spark, sf), "guess").groupBy("route", F.array_join("steps", ",").alias("steps")).agg(F.count("*").alias("n"))


_STATE = """st as (select o_orderkey id, (o_orderkey % 100) / 100.0::DOUBLE a, (o_orderkey * 7 % 100) / 100.0::DOUBLE z, o_orderkey % 4 nv, o_orderkey % 3 na from orders),
 it as (select *, (a between 0.8 and 0.95)::INT + (z between 0.8 and 0.95)::INT nb from st)"""


def items(spark, sf):
    k = F.col("o_orderkey")
    some = lambda n, v: F.array_repeat(F.lit(v), n.cast("int"))
    conf = F.create_map(F.lit("po"), (k % 100) / 100.0, F.lit("date"), (k * 7 % 100) / 100.0)
    return flow.review_items(t(spark, sf, "orders").select(k.alias("id"), conf.alias("confidence"), some(k % 3, "ask").alias("asks"), some(k % 4, "kind").alias("violations")))


@query(f"with {_STATE} select id, (10 * nv + 4 * na + nb)::INT priority, 'pending' status, nb band from it")
def review_item_rows(spark, sf):
    return items(spark, sf).select("id", "priority", "status", F.size("band_fields").alias("band"))


@query(f"with {_STATE} select count(*) items, count(*) filter (na > 0) with_asks, count(*) filter (nb > 0) with_band_fields, count(*) filter (nv > 0) with_violations from it")
def queue_summary(spark, sf):
    return flow.queue_summary(items(spark, sf))


@query("""with e as (select user_id, ts, event_id, case event_type when 'error' then 'deleted' when 'purchase' then 'fulfilled' else 'added' end kind from events),
 x as (select user_id, max(ts) filter (kind = 'added') added, max(ts) filter (kind = 'deleted') deleted, arg_max('v' || event_id, ts) filter (kind = 'fulfilled') outcome from e group by 1)
 select user_id, added, outcome from x where added is not null and (deleted is null or deleted < added)""")
def current_queue(spark, sf):
    kind = F.when(F.col("event_type") == "error", "deleted").when(F.col("event_type") == "purchase", "fulfilled").otherwise("added")
    e = t(spark, sf, "events").select("user_id", F.col("ts").alias("at"), kind.alias("kind"), F.concat(F.lit("v"), F.col("event_id").cast("string")).alias("value"))
    return flow.current_items(e, "user_id", "at")


@query("select case when c_custkey % 3 = 0 then 'EXC-' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') else 'USR-' || c_custkey end id from customer where c_custkey % 3 = 0 or c_custkey % 2 = 1")
def protected_deletes(spark, sf):
    k = F.col("c_custkey")
    c = t(spark, sf, "customer").select(k, F.when(k % 3 == 0, F.concat(F.lit("EXC-"), F.lpad((k % 10000).cast("string"), 4, "0"))).otherwise(F.concat(F.lit("USR-"), k.cast("string"))).alias("id"))
    return flow.deletable(c, c.where(k % 2 == 0), "id").select("id")


@query("select o_orderkey, o_custkey from orders where o_orderkey = 7 and o_custkey % 5 = (select o_custkey % 5 from orders where o_orderkey = 7) union all select o_orderkey, o_custkey from orders where o_orderkey = 8 and o_custkey % 5 = -1")
def point_lookup(spark, sf):
    o = t(spark, sf, "orders").withColumn("org_id", F.col("o_custkey") % 5)
    own = o.where("o_orderkey = 7").first()
    return flow.point(o, "o_orderkey", 7, own.org_id).union(flow.point(o, "o_orderkey", 8, -1)).select("o_orderkey", "o_custkey")


@query("""select o_orderkey, case when o_orderkey % 3 = 0 then 'org-demo' else 'org' || o_custkey % 4 end org_id, case when o_orderkey % 2 = 0 then case when o_orderkey % 4 = 0 then 'old' when o_orderkey % 5 = 0 then null else 'now' end end covered, o_orderkey % 2 = 0 as sent from orders""")
def migrated_items(spark, sf):
    k = F.col("o_orderkey")
    m = lambda v: F.create_map(F.lit("po"), F.lit(v))
    outcome = F.when(k % 2 == 0, F.struct(k.cast("string").alias("order_id"), F.when(k % 4 == 0, m("old")).alias("for_edits")))
    x = t(spark, sf, "orders").select(k, F.when(k % 3 > 0, F.concat(F.lit("org"), (F.col("o_custkey") % 4).cast("string"))).alias("org_id"), F.when(k % 5 > 0, m("now")).alias("edits"), outcome.alias("fulfillment"))
    x = flow.migrated(x)
    return x.select("o_orderkey", "org_id", F.try_element_at("fulfillment.for_edits", F.lit("po")).alias("covered"), F.col("fulfillment").isNotNull().alias("sent"))


@query("select o_orderkey, o_orderpriority subject, case when o_orderkey % 3 > 0 then 'ORD-' || o_orderkey end order_id, case when o_orderkey % 3 = 1 then 'submitted' when o_orderkey % 3 = 2 then 'held' end reason from orders")
def shown_items(spark, sf):
    k = F.col("o_orderkey")
    x = t(spark, sf, "orders").select(k, F.col("o_orderpriority").alias("subject"), F.lit("secret").alias("org_id"), F.when(k % 3 > 0, F.concat(F.lit("ORD-"), k.cast("string"))).alias("order_id"), F.when(k % 3 == 1, "submitted").when(k % 3 == 2, "held").alias("reason"), _none().alias("amends"))
    return flow.shown(x).select("o_orderkey", "subject", "fulfillment.order_id", "fulfillment.reason")


@query("""select o_orderkey, case when o_orderkey % 4 = 1 then 'add' when o_orderkey % 4 = 2 then 'price' else '' end subtype, case when o_orderkey % 5 > 0 then o_custkey / 1e6 * 0.15 + o_orderkey / 1e6 * 0.6 end cost,
 case when o_orderkey % 3 = 0 then 'user' || o_custkey when o_orderkey % 3 = 1 then '10.0.0.' || o_custkey % 9 else 'anonymous' end identity,
 case when o_orderkey % 2 = 0 then '—' else '5' end || ' box × tape (style=plain' || case when o_orderkey % 3 = 0 then ', typo' else '' end || case when o_orderkey % 4 = 0 then ', trap(packs=2)' else '' end || case when o_orderkey % 5 = 0 then ', price=$2' else '' end || ')' line,
 array_to_string(list_filter([case when o_orderkey % 3 = 0 then 'late' end, case when o_orderkey % 2 = 0 then 'rush' end], lambda x: x is not null), ',') flags from orders""")
def row_projections(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    sub = flow.subtype(F.when(k % 4 == 1, "add"), F.when(k % 4 == 2, "price"), _none())
    who = flow.identity(F.when(k % 3 == 0, F.concat(F.lit("user"), c.cast("string"))), F.when(k % 3 == 1, F.concat(F.lit("10.0.0."), (c % 9).cast("string"))))
    line = flow.item_line(F.when(k % 2 == 0, "").otherwise("5"), F.lit("box"), F.lit("tape"), F.lit("plain"), k % 3 == 0, F.when(k % 4 == 0, 2), F.when(k % 5 == 0, "$2").otherwise(""))
    flags = F.create_map(F.lit("rush"), k % 2 == 0, F.lit("late"), k % 3 == 0)
    return t(spark, sf, "orders").select(k, sub.alias("subtype"), flow.token_cost(c, k, F.lit(0.15), F.when(k % 5 > 0, 0.6)).alias("cost"), who.alias("identity"), line.alias("line"), F.array_join(flow.active_flags(flags), ",").alias("flags"))


@query("select doc_id, array_to_string(list_concat(case when doc_id % 2 = 0 then ['quantity'] else [] end, case when doc_id % 3 = 0 then ['short_reply', 'quantity'] else [] end), ',') asks from documents")
def merged_asks(spark, sf):
    k = F.col("doc_id")
    strings = lambda *x: F.array(*map(F.lit, x))
    return t(spark, sf, "documents").select(k, F.array_join(orders.merged_asks(F.when(k % 2 == 0, strings("quantity")), F.when(k % 3 == 0, strings("short_reply", "quantity"))), ",").alias("asks"))


@query(f"with d as (select doc_id, case {b(5, "concat_ws('|', 'lab', doc_id)")} when 0 then 'new_order' when 1 then 'amendment' else 'other' end label, text from documents) select label, count(*) n from d where label in ('new_order', 'amendment') and regexp_matches(text, '(?i)' || array_to_string(['\\bdo you (?:stock|have|carry|supply|sell)\\b', '\\bdo you offer\\b', '\\bis there a\\b', '\\bare there any\\b', '\\bwhat(?:''s| is) the (?:price|cost|lead time|moq)\\b', '\\bcan you (?:source|get|supply)\\b', 'e'], '|')) group by 1")
def inquiries_in_orders(spark, sf):
    label = F.when(C.bucket(5, F.lit("lab"), F.col("doc_id")) == 0, "new_order").when(C.bucket(5, F.lit("lab"), F.col("doc_id")) == 1, "amendment").otherwise("other")
    d = t(spark, sf, "documents").withColumn("label", label).where(F.col("label").isin("new_order", "amendment"))
    return d.where(C.is_inquiry(F.col("text")) | F.col("text").rlike("(?i)e")).groupBy("label").agg(F.count("*").alias("n"))
