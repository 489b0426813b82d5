"""More registered queries: review, audit, contracts, caches and text rules on the star-schema tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docket.functions import columns as C
from docket.operators import align, orders, review, scoring
from docket.plans.catalogue import _LOG, _PRED, _RULE, _SPLIT, CLASSES, LINES, b, classification_confusion, predictions, query, ratio, rule_kinds, rule_lines, split_documents, t
from docket.sources import files, mail
from docket.streaming import windows as streams

EVENT_CLASS = {"click": "new_order", "view": "amendment", "purchase": "cancellation", "error": "inquiry"}
_HASH = lambda tag, key, n: b(n, f"concat_ws('|', '{tag}', {key})")


def hashed(tag: str, key: str, n: int):
    return C.bucket(n, F.lit(tag), F.col(key))


# --- orders ------------------------------------------------------------------------------------------------------------
@query(f"""with {_RULE}, a as (select l_orderkey, bool_or(quantity is null) q, l_orderkey % 3 = 0 no_address, 1 + l_orderkey % 2 sites from v group by 1)
 select l_orderkey, array_to_string(list_filter([case when q then 'quantity' end, case when no_address and sites > 1 then 'delivery_site' end], lambda x: x is not null), ',') asks from a""")
def order_asks(spark, sf):
    x = rule_lines(spark, sf).groupBy("l_orderkey").agg(F.collect_set(F.struct("quantity")).alias("q"))
    address = F.when(F.col("l_orderkey") % 3 != 0, "known")
    asks = orders.asks(F.transform("q", lambda s: s["quantity"]), address, 1 + F.col("l_orderkey") % 2)
    return x.select("l_orderkey", F.array_join(asks, ",").alias("asks"))


_ISSUE = "case when sku is null then 'unresolved' when quantity is null then 'missing' when quantity < moq then 'below_moq' when quantity > most then 'above_max' end"


@query(f"with {_RULE} select {_ISSUE} kind, count(*) n, sum(coalesce(quantity, 0))::BIGINT quantity from rl where {_ISSUE} is not null group by 1")
def erp_quantity_issues(spark, sf):
    x = rule_lines(spark, sf)
    q = F.col("quantity")
    kind = F.when(F.col("sku").isNull(), "unresolved").when(q.isNull(), "missing").when(q < F.col("moq"), "below_moq").when(q > F.col("most"), "above_max")
    return x.withColumn("kind", kind).where("kind is not null").groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.coalesce(q, F.lit(0))).alias("quantity"))


@query(f"with {_RULE}, o as (select l_orderkey, bool_or({_ISSUE} is not null) blocked from rl group by 1) select blocked, count(*) orders from o group by 1")
def erp_blocked(spark, sf):
    return orders.build_orders(rule_lines(spark, sf), "l_orderkey").groupBy("blocked").agg(F.count("*").alias("orders"))


@query("""select o_orderkey, 'Order ' || case when o_orderkey % 4 = 0 then '(no PO)' else 'PO-' || o_orderkey end || case when o_orderkey % 3 = 0 then ' held for manual mapping — 1 product(s) not matched to a SKU: bolt; 2 quantity issue(s): a, b.'
 else ' accepted into the ERP as ORD-' || o_orderkey || ' — ' || (o_orderkey % 2 + 1) || case when o_orderkey % 2 = 0 then ' line, $' else ' lines, $' end || format('{:,.2f}', (o_orderkey * 1234)::DOUBLE / 100) || '.' end message from orders""")
def notification_text(spark, sf):
    k = F.col("o_orderkey")
    po = F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("PO-"), k.cast("string")))
    sent = review.submitted_message(po, F.concat(F.lit("ORD-"), k.cast("string")), k % 2 + 1, k * 1234)
    held = review.held_message(po, F.array(F.lit("bolt")), F.array(F.lit("a"), F.lit("b")))
    return t(spark, sf, "orders").select(k, F.when(k % 3 == 0, held).otherwise(sent).alias("message"))


@query("select o_orderkey, 'ORD-' || upper(substr(sha256(o_custkey || chr(31) || coalesce(o_orderpriority, '')), 1, 8)) order_id from orders")
def order_receipts(spark, sf):
    return review.receipts(t(spark, sf, "orders"), ["o_custkey", "o_orderpriority"]).select("o_orderkey", "order_id")


# --- review ------------------------------------------------------------------------------------------------------------
@query(f"""with q as (select o.o_orderkey id, c.c_nationkey org_id, (10 * {_HASH('v', 'o_orderkey', 4)} + 4 * {_HASH('a', 'o_orderkey', 3)})::BIGINT priority from orders o join customer c on o.o_custkey = c.c_custkey)
 select id, priority from q where org_id = 7 order by priority desc, id""")
def tenant_queue(spark, sf):
    c = t(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("org_id"))
    o = t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", orders.priority(hashed("v", "o_orderkey", 4), hashed("a", "o_orderkey", 3), F.lit(0)).alias("priority"))
    return orders.queue(o.join(c, "o_custkey"), tenant=7).select("id", "priority")


@query(f"""with h as (select o_orderkey, {_HASH('r', 'o_orderkey', 4)} v from orders)
 select o_orderkey, case v when 0 then 'violation' when 1 then 'reply' when 2 then 'violation' else 'band' end kind,
 case v when 0 then 'below_moq' when 1 then 'email is a Reply' when 2 then 'quantity' else (o_orderkey % 3) || case when o_orderkey % 3 = 1 then ' field' else ' fields' end || ' — model moderately confident' end label from h""")
def review_reason(spark, sf):
    v, none = hashed("r", "o_orderkey", 4), F.array().cast("array<string>")
    kinds = F.when(v == 0, F.array(F.lit("below_moq"), F.lit("discontinued"))).otherwise(none)
    asks = F.when(v == 1, F.array(F.lit("email is a Reply"))).when(v == 2, F.array(F.lit("quantity"))).otherwise(none)
    return t(spark, sf, "orders").select("o_orderkey", review.reason(kinds, asks, F.col("o_orderkey") % 3).alias("r")).select("o_orderkey", "r.kind", "r.label")


@query("""with f as (select l_orderkey, unnest([{'path': 'quantity', 'raw': round(1 - l_discount, 2)}, {'path': 'price', 'raw': round(1 - l_tax, 2)}]) e from lineitem)
 select e.path "path", count(*) n, count(*) filter (e.raw between 0.8 and 0.95) in_band, round(sum(least(greatest(e.raw, 0.5), 0.9)), 4) calibrated from f group by 1""")
def field_flags(spark, sf):
    x = t(spark, sf, "lineitem").select(F.create_map(F.lit("quantity"), F.round(1 - F.col("l_discount"), 2), F.lit("price"), F.round(1 - F.col("l_tax"), 2)).alias("m"))
    f = x.select(F.explode(review.field_flags(F.col("m"), [(0.5, 0.5), (0.9, 0.9)])).alias("f")).select("f.*")
    return f.groupBy("path").agg(F.count("*").alias("n"), F.count_if("in_band").alias("in_band"), F.round(F.sum("calibrated_confidence"), 4).alias("calibrated"))


def routed(spark, sf):
    e = t(spark, sf, "events")
    label = F.lit("other")
    for k, v in EVENT_CLASS.items():
        label = F.when(F.col("event_type") == k, v).otherwise(label)
    return e.withColumn("label", F.when(F.col("event_id") % 11 != 0, label))


_ROUTED = """e as (select *, case when event_id % 11 <> 0 then case event_type when 'click' then 'extract' when 'view' then 'extract' when 'purchase' then 'cancel' when 'error' then 'inquiry' else 'discard' end end route from events)"""


@query(f"""with {_ROUTED}, p as (select unnest(list_filter([case when route is null then 'no route assigned' end, case when route = 'extract' and event_id % 5 = 0 then 'EXTRACT route without an extraction' end,
 case when route <> 'extract' and event_id % 5 <> 0 then route || ' route carries an unexpected extraction' end], lambda x: x is not null)) problem from e) select problem, count(*) n from p group by 1""")
def policy_violations(spark, sf):
    p = review.policy_violations(orders.route_of(F.col("label")), F.col("event_id") % 5 != 0)
    return routed(spark, sf).select(F.explode(p).alias("problem")).groupBy("problem").agg(F.count("*").alias("n"))


_ITEMS = f"it as (select *, case when event_id % 7 = 0 then null else 'x' end extraction from (select *, case when action = 'edited' and edits = '' then 'approved' else action end status from lg)), {{0}}"
_CORRECTION = "case when extraction is null then null when status in ('edited', 'approved') and coalesce(edits, '') <> '' then 'edited' when status = 'rejected' then 'rejected' end"


def reviewed(spark, sf):
    e = t(spark, sf, "events")
    status = F.when(F.col("event_type") == "error", "rejected").when((F.col("event_type") == "purchase") | (F.col("event_id") % 3 == 0), "approved").otherwise("edited")
    made = ~F.col("event_type").isin("error", "purchase") & (F.col("event_id") % 3 != 0)
    edits = F.when(made, F.create_map(F.lit("po"), F.concat(F.lit("e"), F.col("event_id").cast("string"))))
    return e.select("event_id", "event_type", status.alias("status"), edits.alias("edits"), F.when(F.col("event_id") % 7 != 0, "x").alias("extraction"))


@query(f"with {_LOG}, {_ITEMS.format(f'c as (select event_id, {_CORRECTION} correction_type from it)')} select * from c where correction_type is not null")
def corrections(spark, sf):
    return review.corrections(reviewed(spark, sf)).select("event_id", "correction_type")


@query(f"with {_LOG}, {_ITEMS.format(f'c as (select event_id, {_CORRECTION} correction_type from it)')} select event_id from c where correction_type = 'edited'")
def training_corrections(spark, sf):
    return review.training_corrections(reviewed(spark, sf)).select("event_id")


@query("select user_id, event_type edits, arg_min(event_id, (ts, event_id)) event_id, count(*) attempts from events group by 1, 2")
def submit_once(spark, sf):
    return review.submit_once(t(spark, sf, "events").withColumnRenamed("event_type", "edits"), "user_id", "edits", "ts", "event_id")


@query(f"""with {_LOG}, s as (select *, case when action = 'edited' and coalesce(edits, '') = '' then 'approved' else action end status from lg),
 l as (select user_id, arg_max(status, (ts, event_id)) status, arg_max(coalesce(edits, ''), (ts, event_id)) filter (not (action = 'approved' and coalesce(edits, '') = '')) e, count(*) decisions from s group by 1)
 select user_id, status, nullif(e, '') edits, decisions from l""")
def stream_review_state(spark, sf):
    e = streams.event_stream(spark, sf)
    action = F.when(F.col("event_type") == "error", "rejected").when(F.col("event_type") == "purchase", "approved").otherwise("edited")
    edits = F.when(F.col("event_type").isin("error", "purchase"), None).when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit("e"), F.col("event_id").cast("string")))
    return streams.drain(orders.latest_decision(e.withColumn("action", action).withColumn("edits", edits), "user_id", "at", "event_id"), "update", ["user_id"])


@query("select user_id, cast(floor(epoch(ts)) as bigint) // 60 * 60 window_start, count(*) used, count(*) > 1 over_limit from events group by 1, 2")
def rate_limit_window_counts(spark, sf):
    start = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 60) * 60
    return t(spark, sf, "events").groupBy("user_id", start.alias("window_start")).agg(F.count("*").alias("used")).withColumn("over_limit", F.col("used") > 1)


# --- confidence --------------------------------------------------------------------------------------------------------
@query("select p_partkey, length(p_name) + 9 text_end, round(exp(-0.5), 9) name_confidence, round(exp(-0.1), 9) size_confidence, false as has_gone from part")
def field_confidence(spark, sf):
    """Tokens: key, value, key, value; the third field's value is not in the text."""
    name, size = F.concat(F.lit('"'), F.col("p_name"), F.lit('"')), F.concat(F.lit(" #"), F.col("p_partkey").cast("string"))
    tokens = F.array(F.lit('"name"'), name, F.lit('"size"'), size)
    logs = F.array(*map(F.lit, (-2.0, -0.5, -2.0, -0.1)))
    field = lambda k, v: F.struct(F.lit(k).alias("path"), F.lit(k).alias("key"), v.alias("value"))
    wanted = F.array(field("name", name), field("size", size), field("gone", F.lit("@@")))
    x = t(spark, sf, "part").select("p_partkey", review.token_spans(tokens).alias("s"), review.field_confidences(tokens, logs, wanted).alias("m"), F.length("p_name").alias("n"))
    return x.select("p_partkey", (F.get("s", 1)["end"] + 1).cast("long").alias("text_end"), F.round(F.col("m")["name"], 9).alias("name_confidence"), F.round(F.col("m")["size"], 9).alias("size_confidence"), F.map_contains_key("m", "gone").alias("has_gone"))


# --- audit -------------------------------------------------------------------------------------------------------------
_VERDICTS = f"vd as (select d.doc_id, d.lang, case when {_HASH('re', 'd.doc_id', 5)} = 0 then null else {_HASH('re', 'd.doc_id', 5)} > 1 end realistic, l.quality = 1 labels_correct from documents d left join labels l using (doc_id))"


def verdicts(spark, sf):
    lab = t(spark, sf, "labels").select("doc_id", (F.col("quality") == 1).alias("labels_correct"))
    h = hashed("re", "doc_id", 5)
    return t(spark, sf, "documents").select("doc_id", "lang", "n_chars", F.when(h != 0, h > 1).alias("realistic")).join(lab, "doc_id", "left")


@query(f"""with {_VERDICTS} select lang, count(*) total, count(*) filter (realistic is not null and labels_correct is not null) filled, count(*) filter ((realistic is null) <> (labels_correct is null)) "partial",
 count(*) filter (realistic is null and labels_correct is null) pending, count(*) filter (realistic) realistic_true, count(*) filter (not realistic) realistic_false, count(*) filter (labels_correct) labels_true, count(*) filter (not labels_correct) labels_false from vd group by 1""")
def verdict_progress(spark, sf):
    return review.verdict_progress(verdicts(spark, sf), "lang")


@query(f"""with {_VERDICTS}, s as (select realistic, unnest(list_filter([case when lang = 'de' then 'german' end, case when n_chars > 5000 then 'long' end, 'all'], lambda x: x is not null)) stratum from vd join documents using (doc_id, lang))
 select stratum, count(*) sampled, count(*) filter (not realistic) unrealistic from s group by 1""")
def audit_strata(spark, sf):
    names = review.strata_of({"german": F.col("lang") == "de", "long": F.col("n_chars") > 5000, "all": F.lit(True)})
    x = verdicts(spark, sf).select("realistic", F.explode(names).alias("stratum"))
    return x.groupBy("stratum").agg(F.count("*").alias("sampled"), F.count_if(~F.col("realistic")).alias("unrealistic"))


@query("select case when event_id % 2 = 0 then 'quirk:' else 'protocol:' end tag, event_type qualifier, count(*) n from events group by 1, 2")
def note_tags(spark, sf):
    tag = F.when(F.col("event_id") % 2 == 0, "(quirk:").otherwise("seen; protocol:,")
    note = F.concat(F.lit("  checked "), tag, F.lit(" "), F.col("event_type"), F.lit(". again"))
    x = t(spark, sf, "events").select(F.explode(C.note_tags(note)).alias("t")).select("t.tag", "t.qualifier")
    return x.groupBy("tag", "qualifier").agg(F.count("*").alias("n"))


@query()
def sample_coverage(spark, sf):
    d = t(spark, sf, "documents")
    strata = {"german": F.col("lang") == "de", "long": F.col("n_chars") > 5000, "source0": F.col("source") == "src0"}
    rows = review.coverage_sample(d, strata, 5, 40, "doc_id", 9)
    return rows.join(d.select("doc_id", F.array_join(review.strata_of(strata), ",").alias("strata")), "doc_id")


@query(f"""with {_RULE}, fl as (select distinct l_orderkey, case when quantity < 3 then 'below_moq' else 'discontinued' end kind from v where quantity < 3 or not active),
 dv as (select distinct l_orderkey, kind from (select l_orderkey, unnest(kinds) kind from v) where kind in ('below_moq', 'discontinued')),
 j as (select coalesce(fl.kind, dv.kind) kind, fl.kind is not null f, dv.kind is not null d from fl full join dv on fl.l_orderkey = dv.l_orderkey and fl.kind = dv.kind),
 r as (select kind, count(*) filter (f) flagged, count(*) filter (d) derived, count(*) filter (f and d) matched, count(*) filter (f and not d) flag_only, count(*) filter (d and not f) derived_only from j group by 1)
 select *, flag_only = 0 and derived_only = 0 reconciled from r""")
def injection_ledger(spark, sf):
    x = rule_kinds(spark, sf)
    flagged = x.where("quantity < 3 or not active").select("l_orderkey", F.when(F.col("quantity") < 3, "below_moq").otherwise("discontinued").alias("kind"))
    derived = x.select("l_orderkey", F.explode("kinds").alias("kind")).where(F.col("kind").isin("below_moq", "discontinued"))
    return review.ledger(flagged, derived, "l_orderkey", "kind")


@query(f"""with {LINES}, s as (select l_linestatus = 'F' is_counter, count(*) filter (gold_product = pred_product) matched, count(pred_product) pred_items, count(gold_product) gold_items from lines group by 1)
 select *, {ratio('matched', 'pred_items')} "precision", {ratio('matched', 'gold_items')} recall from s""")
def targeted_gate(spark, sf):
    from docket.plans.catalogue import lines

    g, p = F.col("gold_product"), F.col("pred_product")
    x = lines(spark, sf).select((F.col("l_linestatus") == "F").alias("is_counter"), F.coalesce((g == p).cast("long"), F.lit(0)).alias("matched"), p.isNotNull().cast("long").alias("pred_items"), g.isNotNull().cast("long").alias("gold_items"))
    return review.targeted_gate(x, "is_counter")


@query("""with k as (select event_id, event_id % 4 c, event_id % 3 = 0 other from events)
 select event_id, case when c = 0 then 'miss' when other then 'stale' else 'hit' end outcome, case when c <> 0 and not other then 'p' || event_id end payload from k""")
def sidecar_cache_hits(spark, sf):
    e = t(spark, sf, "events").select("event_id")
    cache = e.where("event_id % 4 <> 0").select("event_id", F.when(F.col("event_id") % 3 == 0, "old").otherwise("new").alias("prompt_hash"), F.lit("m").alias("model"), F.concat(F.lit("p"), F.col("event_id").cast("string")).alias("payload"))
    return review.cache_lookup(e.withColumn("prompt_hash", F.lit("new")).withColumn("model", F.lit("m")), cache, ["event_id"], ["prompt_hash", "model"]).select("event_id", "outcome", "payload")


@query("select user_id, arg_max(event_id, (ts, event_id)) event_id, arg_max(event_type, (ts, event_id)) event_type from events group by 1")
def last_prediction(spark, sf):
    return review.last_per(t(spark, sf, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("select event_type, min(event_id) event_id from events group by 1")
def first_per_shape(spark, sf):
    return review.first_per(t(spark, sf, "events"), "event_type", ["event_id"]).select("event_type", "event_id")


@query("select p_name, count(*) n, min(p_partkey) first_seen from part group by 1 order by n desc, first_seen limit 10")
def most_common_names(spark, sf):
    return review.most_common(t(spark, sf, "part"), "p_name", "p_partkey", 10)


# --- contracts ---------------------------------------------------------------------------------------------------------
@query("select lower(p_name) term, count(distinct p_partkey) owners from part group by 1 having count(distinct p_partkey) > 1")
def term_conflicts(spark, sf):
    return review.term_conflicts(t(spark, sf, "part").withColumn("term", C.norm_text(F.col("p_name"))), "term", "p_partkey")


@query("""select c_custkey, unnest(list_filter([case when not coalesce(regexp_matches(c_name, '^Customer#[0-9]+$'), false) then 'name' end, case when not coalesce(c_acctbal >= 0, false) then 'balance' end,
 case when not coalesce(c_mktsegment in ('BUILDING', 'MACHINERY'), false) then 'segment' end], lambda x: x is not null)) problem from customer""")
def customer_checks(spark, sf):
    checks = {"name": F.col("c_name").rlike(r"^Customer#\d+$"), "balance": F.col("c_acctbal") >= 0, "segment": F.col("c_mktsegment").isin("BUILDING", "MACHINERY")}
    return review.failed_checks(t(spark, sf, "customer"), "c_custkey", checks)


@query(f"with d as (select text, {_SPLIT} split from documents) select count(distinct d.text) overlap from d join d x on d.text = x.text where d.split = 'test' and x.split = 'val'")
def eval_purity(spark, sf):
    d = split_documents(spark, sf)
    return d.where("split = 'test'").select("text").intersect(d.where("split = 'val'").select("text")).agg(F.count("*").alias("overlap"))


@query("""select event_id, case when event_id % 3 = 2 then null else cast(json_extract(props, '$.k') as bigint) end k from events""")
def strict_json(spark, sf):
    payload = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("  "), F.col("props"))).otherwise(F.replace("props", F.lit("}"), F.lit(', "extra": 1}')))
    return t(spark, sf, "events").select("event_id", files.strict(payload, "k bigint")["k"].alias("k"))


@query("""select event_id, case event_id % 6 when 1 then 'blank line' when 2 then 'invalid JSON' when 3 then 'keys' when 4 then 'verdict is not true, false or null' else 'id out of order' end problem from events where event_id % 6 <> 0""")
def verdict_lines(spark, sf):
    e = F.col("event_id")
    good = F.concat(F.lit('{"id": "R'), e.cast("string"), F.lit('", "realistic": true, "labels_correct": null, "notes": ""}'))
    shown = F.when(e % 6 == 1, " ").when(e % 6 == 2, "{oops").when(e % 6 == 3, '{"id": "x"}').when(e % 6 == 4, F.replace(good, F.lit("true"), F.lit('"yes"'))).when(e % 6 == 5, F.replace(good, F.lit('"R'), F.lit('"Q'))).otherwise(good)
    x = t(spark, sf, "events")
    lines = x.select(e.alias("line"), shown.alias("value"))
    return review.verdict_problems(lines, x.select(e.alias("line"), F.concat(F.lit("R"), e.cast("string")).alias("id"))).withColumnRenamed("line", "event_id")


@query("""select 'HUM-' || lpad(user_id::VARCHAR, 6, '0') id, 'user' || user_id || '@example.org' sender, case when user_id % 4 <> 1 then strptime('2026-03-05 03:15', '%Y-%m-%d %H:%M') end sent_at, case when user_id % 4 = 3 then null else '{"line_items": []}' end gold,
 case user_id % 4 when 1 then 'sent' when 2 then 'gold not allowed' when 3 then 'gold missing' end error from (select distinct user_id from events)""")
def authored_blocks(spark, sf):
    u = F.col("user_id")
    text = lambda s: F.lit(s)
    block = F.concat(
        text("### HUM-"), F.lpad(u.cast("string"), 6, "0"), text("\nFrom: User"), u.cast("string"), text("@Example.org\nSent: "), F.when(u % 4 == 1, "2025-03-05 14:15").otherwise("2026-03-05 14:15"),
        text("\nClass: "), F.when(u % 4 == 2, "inquiry").otherwise("new_order"), text("\nSubject: Order\n\nPlease send ten.\n"), F.when(u % 4 == 3, "").otherwise('```gold\n{"line_items": []}\n```\n'),
    )
    x = files.authored_blocks(t(spark, sf, "events").select(u).distinct().select(F.concat(block).alias("file")), "file", r"HUM-\d+", "Australia/Sydney", 2026, ["new_order", "inquiry"], ["new_order"])
    return x.select("id", "sender", F.col("sent_at").cast("timestamp_ntz").alias("sent_at"), "gold", "error")


# --- text --------------------------------------------------------------------------------------------------------------
@query(f"select conv_id, turn, regexp_matches(text, '(?i){'|'.join(C.INQUIRY).replace(chr(39), chr(39) * 2)}') inquiry from conversations")
def inquiry_flag(spark, sf):
    return t(spark, sf, "conversations").select("conv_id", "turn", C.is_inquiry(F.col("text")).alias("inquiry"))


@query("""select conv_id, turn, turn % 2 = 0 is_reply, turn % 2 = 0 and len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) < 25 short_reply from conversations""")
def reply_flags(spark, sf):
    subject = F.when(F.col("turn") % 2 == 0, " RE: order").otherwise("order re: it")
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    return t(spark, sf, "conversations").select("conv_id", "turn", C.is_reply(subject).alias("is_reply"), (C.is_reply(subject) & (words < 25)).alias("short_reply"))


@query("select conv_id, turn, rtrim(text, ' \t\n') body from conversations where not regexp_matches(text, '(^|\n)>')")
def quoted_strip(spark, sf):
    quoted = F.concat("text", F.lit("\n\n> "), F.replace("text", F.lit("\n"), F.lit("\n> ")), F.lit("\n  \n>\n"))
    x = t(spark, sf, "conversations").where(~F.col("text").rlike("(^|\n)>"))
    return x.select("conv_id", "turn", F.rtrim(C.strip_quoted(quoted)).alias("body"))


@query()
def html_text(spark, sf):
    from pyspark.sql.functions import pandas_udf

    text = pandas_udf(lambda pages: pages.map(lambda p: mail.html_text(p or "")), "string")
    return t(spark, sf, "pages").select("page_id", text("html").alias("text"))


@query("""with w as (select doc_id, coalesce(text, '') x, string_split(coalesce(text, ''), ' ') w from documents), s as (select doc_id, x, w[1] one, w[1] || ' ' || w[2] two from w where len(w) > 1 and w[1] <> '' and w[2] <> '')
 select doc_id, contains(replace(x, two, chr(65533)), one) apart from s""")
def shadow_containment(spark, sf):
    w = F.split(F.coalesce("text", F.lit("")), " ")
    x = t(spark, sf, "documents").select("doc_id", "text", F.get(w, 0).alias("one"), F.get(w, 1).alias("next")).where("one <> '' and next <> ''")
    return x.select("doc_id", C.contained(F.col("text"), F.array(F.col("one"), F.concat_ws(" ", "one", "next"))).alias("apart"))


@query(f"select p_partkey, case {_HASH('w', 'p_partkey', 10)} when 0 then 'rare' when 1 then 'some' when 2 then 'some' when 3 then 'some' else 'most' end choice, substr(p_name, 2, 1) || substr(p_name, 1, 1) || substr(p_name, 3) typo, printf('$%d.%02d', p_partkey // 100, p_partkey % 100) price from part")
def noise_draws(spark, sf):
    k = F.col("p_partkey")
    return t(spark, sf, "part").select(k, review.weighted_choice(hashed("w", "p_partkey", 10), {"rare": 1, "some": 3, "most": 6}).alias("choice"), C.transposed(F.col("p_name"), F.lit(1)).alias("typo"), C.price_text(k).alias("price"))


# --- training sets -----------------------------------------------------------------------------------------------------
@query("""select conv_id, turn, 'sys' system, 'Subject: S' || turn || chr(10) || chr(10) || text "user", '{"turn":' || turn || '}' assistant from conversations""")
def sft_messages(spark, sf):
    answer = F.to_json(F.struct("turn"))
    m = orders.sft_messages("sys", F.concat(F.lit("S"), F.col("turn").cast("string")), F.col("text"), answer)
    x = t(spark, sf, "conversations").select("conv_id", "turn", m.alias("m"))
    return x.select("conv_id", "turn", *(F.get("m", k)["content"].alias(r) for k, r in enumerate(("system", "user", "assistant"))))


@query("with c as (select conv_id, count(*) n, min(case when conv_id % 2 = 0 then 'new_order' else 'amendment' end) label from conversations group by 1) select count(*) n, count(*) filter (label = 'new_order') new_order, count(*) filter (label = 'amendment') amendment, round(avg(n), 3) avg_line_items from c")
def sft_composition(spark, sf):
    c = t(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_lines"))
    return review.composition(c.withColumn("label", F.when(F.col("conv_id") % 2 == 0, "new_order").otherwise("amendment")), "label", "n_lines", ["new_order", "amendment"])


@query("select lang, '| ' || lang || ' | ' || count(*) || ' |' line from documents group by 1")
def report_markdown(spark, sf):
    return t(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n")).select("lang", review.markdown_rows(F.col("lang"), F.col("n")).alias("line"))


# --- resolution and resampling -----------------------------------------------------------------------------------------
@query("""with m as (select p_partkey, case p_partkey % 3 when 0 then ' sku-' || p_partkey || ' ' when 1 then '  ' || upper(p_name) else 'no such part' end mention from part),
 k as (select 'SKU-' || p_partkey term, p_partkey target, 'code' kind from part union all select lower(p_name), p_partkey, 'term' from part)
 select p_partkey, (select min(target) from k where (kind = 'code' and term = upper(trim(mention))) or (kind = 'term' and term = lower(trim(mention)))) target from m""")
def code_resolve(spark, sf):
    p, k = t(spark, sf, "part"), F.col("p_partkey")
    mention = F.when(k % 3 == 0, F.concat(F.lit(" sku-"), k.cast("string"), F.lit(" "))).when(k % 3 == 1, F.concat(F.lit("  "), F.upper("p_name"))).otherwise("no such part")
    pairs = F.array(F.struct(F.lit("code").alias("kind"), F.concat(F.lit("SKU-"), k.cast("string")).alias("term")), F.struct(F.lit("term").alias("kind"), C.norm_text(F.col("p_name")).alias("term")))
    keys = p.select(k.alias("target"), k.alias("place"), F.explode(pairs).alias("e")).select("e.kind", "e.term", "target", "place")
    return align.resolve_keyed(p.select(k, mention.alias("text")), "text", keys).select("p_partkey", "target")


@query("select case l_returnflag when 'A' then 'each' when 'R' then 'roll' end unit, count(*) n from lineitem group by 1")
def unit_resolve(spark, sf):
    units = spark.createDataFrame([("each", ["ea", "each"]), ("roll", ["rolls"])], "unit string, aliases array<string>")
    terms = units.select("unit", F.explode(F.array_distinct(F.concat(F.array("unit"), "aliases"))).alias("term"))
    said = F.when(F.col("l_returnflag") == "A", " EA").when(F.col("l_returnflag") == "R", "Rolls").otherwise("bag")
    x = t(spark, sf, "lineitem").select(C.norm_text(said).alias("term"))
    return x.join(terms, "term", "left").groupBy("unit").agg(F.count("*").alias("n"))


@query("select e.event_id, case when e.user_id % 2 = 0 then c.c_custkey end customer from events e left join customer c on c.c_custkey = e.user_id")
def sender_resolve(spark, sf):
    domain = lambda a, c: F.concat(F.lit(a), c.cast("string"), F.lit(".example"))
    k, u = F.col("c_custkey"), F.col("user_id")
    customers = t(spark, sf, "customer").select(k.alias("customer"), F.array(domain("shop", k), domain("cust", k)).alias("domains"))
    sender = F.concat(F.lit(" Buyer@"), F.when(u % 2 == 0, domain("CUST", u)).otherwise("elsewhere.example"))
    return align.resolve_sender(t(spark, sf, "events").select("event_id", sender.alias("sender")), "sender", customers, "domains", "customer").select("event_id", "customer")


_WEIGHT = " + ".join(f"(u >= {c})::BIGINT" for c in ("0.36787944117144233", "0.7357588823428847", "0.9196986029286058", "0.9810118431238462", "0.9963401531726563", "0.9994058151824183"))


@query(f"""with {_PRED}, v as (select o_orderkey, gold, case when guess in ({', '.join(repr(c) for c in CLASSES)}) then guess else 'invalid' end pred from pred),
 d as (select rep, gold, pred, {b(1000000, "concat_ws('|', 3, rep, o_orderkey)")} / 1e6 u from v, (select unnest(range(20)) rep)), w as (select rep, gold, pred, sum({_WEIGHT}) n from d group by all),
 g as (select rep, gold label, sum(n) support, sum(n) filter (gold = pred) tp from w group by all), pr as (select rep, pred label, sum(n) predicted from w group by all),
 f as (select rep, avg(2 * coalesce(tp, 0)::DOUBLE / (support + coalesce(predicted, 0))) macro_f1, sum(tp)::DOUBLE / sum(support) accuracy from g left join pr using (rep, label) where support > 0 group by 1)
 select round(quantile_cont(accuracy, 0.025), 9) accuracy_low, round(quantile_cont(accuracy, 0.975), 9) accuracy_high, round(quantile_cont(macro_f1, 0.025), 9) macro_f1_low, round(quantile_cont(macro_f1, 0.975), 9) macro_f1_high, count(*) replicates from f""")
def bootstrap_classes(spark, sf):
    return scoring.bootstrap_classes(valid_predictions(spark, sf), "o_orderkey", "gold", "pred", 20, 3)


def valid_predictions(spark, sf):
    return predictions(spark, sf).withColumn("pred", F.when(F.col("guess").isin(*CLASSES), F.col("guess")).otherwise("invalid"))


@query()
def bootstrap_classes_1000(spark, sf):
    return scoring.bootstrap_confusion(valid_predictions(spark, sf), "gold", "pred")


@query(f"with {_PRED}, s as (select sum(n)::BIGINT order_rows, coalesce(sum(n) filter (pred not in ('1-URGENT', '2-HIGH')), 0)::BIGINT missed from conf where gold = '1-URGENT') select *, {ratio('missed', 'order_rows')} missed_rate from s")
def order_missed(spark, sf):
    return scoring.order_missed(classification_confusion(spark, sf), ["1-URGENT"], ["1-URGENT", "2-HIGH"])


@query("with m as (select p_partkey, case when p_partkey % 2 = 0 then 'name_exact' else 'alias_exact' end \"method\" from part) select \"method\", count(*) n from m group by 1")
def resolve_method_counts(spark, sf):
    p, k = t(spark, sf, "part"), F.col("p_partkey")
    entry = lambda name, is_alias: F.struct(F.concat(F.lit(name), k.cast("string")).alias("term"), F.lit(is_alias).alias("alias"))
    terms = p.select(k.alias("target"), F.explode(F.array(entry("part ", False), entry("item ", True))).alias("e")).select("e.term", "e.alias", "target")
    said = p.select(F.concat(F.when(k % 2 == 0, "PART  ").otherwise(" Item "), k.cast("string")).alias("m"))
    return align.resolve(said, "m", terms, "term", "target", alias="alias").groupBy("method").agg(F.count("*").alias("n"))


@query()
def resolve_text_targets(spark, sf):
    p = t(spark, sf, "part").select("p_name", F.concat(F.lit("SKU-"), F.col("p_partkey").cast("string")).alias("sku"), F.col("p_partkey").alias("place"))
    typed = F.when(F.col("place") % 3 == 0, F.col("p_name")).when(F.col("place") % 3 == 1, F.concat(F.col("p_name"), F.lit("s"))).otherwise(F.concat_ws(" ", F.reverse(F.split("p_name", " "))))
    return align.resolve(p.select(typed.alias("m")), "m", p, "p_name", "sku", place="place")


@query("select doc_id, md5(replace(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 'ß', 'ss')) folded from documents where not regexp_matches(text, '[^\\x00-\\x7fßäöüéèñçáíóúàêâîôûÄÖÜÉ]')")
def folded_texts(spark, sf):
    d = t(spark, sf, "documents").where(~F.col("text").rlike(r"[^\x00-\x7fßäöüéèñçáíóúàêâîôûÄÖÜÉ]"))
    return d.select("doc_id", F.md5(C.norm_folded(F.col("text"))).alias("folded"))
