"""Registered queries on records and predictions built from the star schema, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docket.functions import columns as C
from docket.operators import evaluation as E
from docket.plans.catalogue import b, query, ratio, t
from docket.sources.store import written

# Records are orders; every line of an order has values of its own, so that a predicted line is like no other gold line than its own
# and the best assignment can be told in SQL. Predictions differ from the gold by hashes.
_H = lambda tag: b(100, f"concat_ws('|', '{tag}', k, pos)")
_CLASS = "case when ok % 10 < 6 then 'new_order' when ok % 10 = 6 then 'amendment' when ok % 10 = 7 then 'cancellation' when ok % 10 = 8 then 'inquiry' else 'other' end"
_RECORDS = f"""li as (select l_orderkey k, row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice) pos, l_quantity::BIGINT q, l_partkey part from lineitem),
gl as (select k, pos, 'Part ' || part || '-' || pos product, case when {_H('gq')} >= 8 then pos * 1000 + q end quantity, case when {_H('gu')} >= 20 then 'u' || pos end unit, case when {_H('gp')} < 30 then '$' || pos || '.50' end price from li),
pl as (select k, pos, case when {_H('pp')} < 6 then null when {_H('pp')} < 14 then product || ' x' when {_H('pp')} < 30 then upper(product) else product end product,
  case when {_H('pq')} < 5 then null when {_H('pq')} < 10 then coalesce(quantity, pos * 1000) + 500 else quantity end quantity,
  case when {_H('pu')} < 8 then null when {_H('pu')} < 12 then 'w' || pos else unit end unit, price from gl where {_H('drop')} >= 5
  union all select k, pos + 1000, 'extra ' || pos, null, null, null from gl where {_H('more')} < 4),
rec as (select o_orderkey ok, {_CLASS.replace('ok', 'o_orderkey')} email_class, o_orderkey % 10 < 7 has_gold, {b(100, "concat_ws('|', 'state', o_orderkey)")} state,
  case when o_orderkey % 4 > 0 then 'PO-' || o_orderkey end po, strftime(o_orderdate, '%Y-%m-%d') due, case when o_orderkey % 3 > 0 then 'Site ' || o_custkey end site, o_orderpriority buyer, o_orderkey % 5 layout, o_orderkey % 7 placement from orders),
pr as (select *, case when {b(100, "concat_ws('|', 'class', o_orderkey)").replace('o_orderkey', 'ok')} < 85 then email_class when ok % 3 = 0 then 'other' when ok % 3 = 1 then 'nonsense' else 'amendment' end guess, has_gold and state >= 3 tried, has_gold and state >= 6 parsed,
  case when ok % 11 > 0 then lower(po) end ppo, case when ok % 13 = 0 then 'soon' else due end pdue, case when ok % 3 = 0 and ok % 17 = 0 then 'Dock' when ok % 19 > 0 then site end psite, buyer pbuyer from rec)"""


def records(spark, sf: str) -> DataFrame:
    """Records with their predictions in columns ``guess`` and ``predicted`` (E.PREDICTION)."""
    w = Window.partitionBy("k").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")
    x = t(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "k")  # before the window, so that grouping by k finds its rows together
    x = x.select("k", F.row_number().over(w).cast("long").alias("at"), F.col("l_quantity").cast("long").alias("q"), F.col("l_partkey").alias("part"))
    h = lambda tag: C.bucket(100, F.lit(tag), F.col("k"), F.col("at"))
    at, text, none = F.col("at"), lambda *c: F.concat(*(x.cast("string") if not isinstance(x, str) else F.lit(x) for x in c)), F.lit(None)
    line = lambda *v: F.struct(*(c.cast(ty).alias(n) for c, (n, ty) in zip(v, (("product_text", "string"), ("quantity", "long"), ("unit_text", "string"), ("unit_price_text", "string"), ("item_notes", "string")))))
    once = [h(tag).alias(f"h_{tag}") for tag in ("pp", "pq", "pu")]  # a chain of cases would make its hash again for each
    x = x.select("k", "at", text("Part ", F.col("part"), "-", at).alias("p"), F.when(h("gq") >= 8, at * 1000 + F.col("q")).alias("q"), F.when(h("gu") >= 20, text("u", at)).alias("u"), F.when(h("gp") < 30, text("$", at, ".50")).alias("c"), *once)
    p, q, u, pp, pq, pu = (F.col(c) for c in ("p", "q", "u", "h_pp", "h_pq", "h_pu"))
    product = F.when(pp < 6, none).when(pp < 14, text(p, " x")).when(pp < 30, F.upper(p)).otherwise(p)
    quantity = F.when(pq < 5, none).when(pq < 10, F.coalesce(q, at * 1000) + 500).otherwise(q)
    unit = F.when(pu < 8, none).when(pu < 12, text("w", at)).otherwise(u)
    x = x.select("k", "at", line(p, q, u, F.col("c"), none).alias("g"), F.when(h("drop") >= 5, line(product, quantity, unit, F.col("c"), none)).alias("r"), F.when(h("more") < 4, line(text("extra ", at), none, none, none, none)).alias("e"))
    x = x.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("at", "g", "r", "e"))).alias("all"))  # sort_array compares in the JVM, array_sort by a lambda
    of = lambda c: F.array_compact(F.transform("all", lambda s: s[c]))
    x = x.select("k", of("g").alias("g"), F.concat(of("r"), of("e")).alias("r"))
    o, k = t(spark, sf, "orders").join(x, F.col("o_orderkey") == F.col("k"), "left"), F.col("o_orderkey")
    m, empty = k % 10, F.array().cast(f"array<{E.LINE}>")
    label = F.when(m < 6, "new_order").when(m == 6, "amendment").when(m == 7, "cancellation").when(m == 8, "inquiry").otherwise("other")
    state = C.bucket(100, F.lit("state"), k)
    po, day, site = F.when(k % 4 > 0, text("PO-", k)), F.date_format("o_orderdate", "yyyy-MM-dd"), F.when(k % 3 > 0, text("Site ", F.col("o_custkey")))
    order = lambda po, day, site, lines: F.struct(po.alias("customer_po_text"), day.alias("requested_date_text"), site.alias("delivery_address_text"), F.col("o_orderpriority").alias("buyer_name_text"), none.cast("string").alias("notes"), F.coalesce(lines, empty).alias("line_items"))
    guessed = order(F.when(k % 11 > 0, F.lower(po)), F.when(k % 13 == 0, "soon").otherwise(day), F.when((k % 3 == 0) & (k % 17 == 0), "Dock").when(k % 19 > 0, site), F.col("r"))
    return o.select(
        k.alias("id"), label.alias("email_class"), F.when(m < 7, order(po, day, site, F.col("g"))).cast(E.ORDER).alias("gold"),
        F.when(C.bucket(100, F.lit("class"), k) < 85, label).when(k % 3 == 0, "other").when(k % 3 == 1, "nonsense").otherwise("amendment").alias("guess"),
        F.when((m < 7) & (state >= 3), F.struct(F.when(state >= 6, guessed).alias("parsed"), (state % 7 == 0).alias("repair_used"))).cast(E.PREDICTION).alias("predicted"),
        F.map_from_arrays(F.array(*map(F.lit, E.FLAGS)), F.array(*((k % (n + 2) == 0) for n in range(len(E.FLAGS))))).alias("flags"),
        F.element_at(F.array(*map(F.lit, (*E.LAYOUTS, "none"))), (k % 5 + 1).cast("int")).alias("layout"), F.element_at(F.array(*map(F.lit, (*E.PLACEMENTS, *["none"] * 4))), (k % 7 + 1).cast("int")).alias("po_placement"),
        F.when(m < 6, F.element_at(F.array(*map(F.lit, ("touchless", "clarification", "exception"))), (k % 3 + 1).cast("int"))).alias("route"),
    )


def predictions_of(records: DataFrame, every: int | None = None) -> DataFrame:
    p = records.select("id", F.col("guess").alias("classification"), F.col("predicted").alias("extraction"))
    return p if every is None else p.where(F.col("id") % every > 0)


def joined(spark, sf, missing: str = "error", every: int | None = None) -> DataFrame:
    r = written(records(spark, sf), "records")  # both sides of the join read it: it is built once
    return E.with_predictions(r.drop("guess", "predicted"), predictions_of(r, every), missing)


_EQ = "({0} is not null and {1} is not null and lower({0}::VARCHAR) = lower({1}::VARCHAR))"


def _slot_sql(f: str, g: str, p: str, rows: str) -> str:
    two = f"({g} is not null and {p} is not null)"
    return f"""select ok, '{f}' field, {_EQ.format(g, p)}::INT correct, coalesce({g} = {p}, false)::INT strict_correct, ({two} and not {_EQ.format(g, p)})::INT wrong,
 ({g} is null and {p} is not null)::INT hallucination, ({g} is not null and {p} is null)::INT miss, ({rows} and {g} is null and {p} is null)::INT null_agree"""


# A line's slots stand in one row if the lines pair, and in a row for each side if they do not.
_TALLY = _RECORDS + f""",
al as (select pr.ok, g.pos is not null hg, p.pos is not null hp, g.product gp, p.product pp, g.quantity gq, p.quantity pq, g.unit gu, p.unit pu, g.price gc, p.price pc,
  coalesce({_EQ.format('g.product', 'p.product')} or g.quantity = p.quantity or {_EQ.format('g.unit', 'p.unit')} or {_EQ.format('g.price', 'p.price')}, false) paired
  from pr join (select coalesce(x.k, y.k) k, coalesce(x.pos, y.pos) pos from gl x full join pl y on x.k = y.k and x.pos = y.pos) n on n.k = pr.ok
  left join gl g on g.k = n.k and g.pos = n.pos left join pl p on p.k = n.k and p.pos = n.pos and pr.parsed where pr.has_gold),
sl as (select ok, hg, paired hp, paired, gp, case when paired then pp end pp, gq, case when paired then pq end pq, gu, case when paired then pu end pu, gc, case when paired then pc end pc from al where hg
  union all select ok, false, true, false, null, pp, null, pq, null, pu, null, pc from al where hp and not paired),
slots as ({' union all '.join([*(_slot_sql(f, g, f'(case when parsed then {p} end)', 'true') + ' from pr where has_gold' for f, g, p in zip(E.ORDER_FIELDS, ('po', 'due', 'site', 'buyer'), ('ppo', 'pdue', 'psite', 'pbuyer'))), *(_slot_sql(f, g, p, 'paired') + ' from sl' for f, g, p in zip(E.ITEM_FIELDS, ('gp', 'gq', 'gu', 'gc'), ('pp', 'pq', 'pu', 'pc')))])}),
sums as (select pr.ok, (pr.parsed)::INT parsed, (pr.tried and pr.state % 7 = 0)::INT repair_used, count(*) filter (hg) gold_items, count(*) filter (hp) pred_items, count(*) filter (paired) matched,
  count(*) filter (paired and {_EQ.format('gp', 'pp')}) product_correct from pr left join al using (ok) where has_gold group by all)"""
_SUMS = ", ".join(f"sum({c})::BIGINT {c}" for c in E.COUNTS)
_RATES = f"""{ratio('correct', 'correct + wrong + hallucination')} "precision", {ratio('correct', 'correct + wrong + miss')} recall, {ratio('2 * correct', '2 * correct + 2 * wrong + hallucination + miss')} f1,
 {ratio('correct + null_agree', 'correct + wrong + hallucination + miss + null_agree')} accuracy, {ratio('strict_correct', 'correct')} strict_rate, {ratio('hallucination', 'hallucination + null_agree')} hallucination_rate"""


@query(f"with {_TALLY}, s as (select field, {_SUMS} from slots group by 1) select *, {_RATES} from s")
def extraction_fields(spark, sf):
    return E.field_report(E.tallies(joined(spark, sf)))


@query(f"with {_TALLY}, s as (select {_SUMS} from slots) select *, {_RATES} from s")
def extraction_headline(spark, sf):
    return E.field_report(E.tallies(joined(spark, sf)), [])


@query(f"""with {_TALLY}, s as (select count(*) records, sum(parsed)::BIGINT parsed, sum(repair_used)::BIGINT repair_used, sum(gold_items)::BIGINT gold_items, sum(pred_items)::BIGINT pred_items, sum(matched)::BIGINT matched,
 sum((pred_items > 0 and gold_items > 0 and (gold_items > 8 or pred_items > 8))::INT)::BIGINT greedy_runs, sum(product_correct)::BIGINT product_correct from sums)
 select *, {ratio('parsed', 'records')} parse_rate, {ratio('repair_used', 'records')} repair_rate, {ratio('product_correct', 'pred_items')} alignment_precision, {ratio('product_correct', 'gold_items')} alignment_recall, {ratio('2 * product_correct', 'pred_items + gold_items')} alignment_f1 from s""")
def extraction_alignment(spark, sf):
    return E.record_report(E.tallies(joined(spark, sf))).drop("notes_overlap", "notes_gold", "notes_pred", "item_notes_overlap", "item_notes_gold", "item_notes_pred", "notes_f1", "item_notes_f1")


_SLICES = [(f"class:{c}", f"email_class = '{c}'") for c in E.CLASSES] + [(f"flag:{f}", f"email_class = 'new_order' and ok % {n + 2} = 0") for n, f in enumerate(E.FLAGS)]
_SLICES += [(f"route:{r}", f"ok % 10 < 6 and ok % 3 = {n}") for n, r in enumerate(("touchless", "clarification", "exception"))] + [(f"layout:{x}", f"layout = {n}") for n, x in enumerate(E.LAYOUTS)] + [(f"po_placement:{x}", f"placement = {n}") for n, x in enumerate(E.PLACEMENTS)]


@query(f"""with {_TALLY}, m as (select pr.*, unnest(list_filter([{', '.join(f"case when {p} then '{n}' end" for n, p in _SLICES)}], lambda x: x is not null)) slice from pr),
 a as (select slice, count(*) n, count(*) filter (email_class = guess) hits, count(*) filter (has_gold) ne from m group by 1),
 f as (select slice, {ratio('2 * sum(correct)', '2 * sum(correct) + 2 * sum(wrong) + sum(hallucination) + sum(miss)')} headline_f1 from m join slots using (ok) group by 1),
 g as (select slice, {ratio('2 * sum(product_correct)', 'sum(pred_items) + sum(gold_items)')} alignment_f1 from m join sums using (ok) group by 1)
 select d.slice, coalesce(n, 0)::BIGINT n, {ratio('hits', 'n')} accuracy, coalesce(ne, 0)::BIGINT n_extraction, headline_f1, alignment_f1 from (select unnest([{', '.join(f"'{n}'" for n, _ in _SLICES)}]) slice) d left join a using (slice) left join f using (slice) left join g using (slice)""")
def extraction_slices(spark, sf):
    return E.slice_report(joined(spark, sf))


@query(f"""with {_TALLY}, tr as (select sl.* from sl join pr using (ok) join li on li.k = ok and gp = 'Part ' || li.part || '-' || li.pos where hg and email_class = 'new_order' and li.pos % 3 = 1)
 select count(distinct ok) records, count(*) items, {ratio('count(*) filter (paired)', 'count(*)')} match_rate, {ratio("count(*) filter (lower(gp) = lower(pp))", 'count(gp)')} product_text_recall, {ratio('count(*) filter (gq = pq)', 'count(gq)')} quantity_recall, {ratio('count(*) filter (gu = pu)', 'count(gu)')} unit_text_recall from tr""")
def extraction_traps(spark, sf):
    x = joined(spark, sf)
    places = F.filter(F.transform("gold.line_items", lambda i, at: at), lambda at: at % 3 == 0)
    return E.trap_report(x.withColumn("traps", places), "traps")


@query(f"""with {_RECORDS}, g as (select k, quantity q, unit u, row_number() over (partition by k, quantity, unit order by pos) nth, lower(product) a from gl join pr on ok = k and has_gold where quantity is not null),
 p as (select k, quantity q, unit u, row_number() over (partition by k, quantity, unit order by pos) nth, lower(product) b from pl join pr on ok = k and parsed where quantity is not null),
 s as (select (select count(*) from g) anchorable_gold, (select count(*) from p) anchorable_pred, count(*) matched, count(*) filter (a = b) product_exact, count(*) filter (contains(b, a)) product_contains from g join p on g.k = p.k and g.q = p.q and g.u is not distinct from p.u and g.nth = p.nth)
 select *, {ratio('matched', 'anchorable_gold')} match_rate, {ratio('product_exact', 'matched')} product_exact_rate, {ratio('product_contains', 'matched')} product_contains_rate, {ratio('product_contains - product_exact', 'matched')} span_gap from s""")
def extraction_semantics(spark, sf):
    return E.semantics_report(joined(spark, sf))


_ROUTED = "case {0} when 'new_order' then 'extract' when 'amendment' then 'extract' when 'cancellation' then 'cancel' when 'inquiry' then 'inquiry' when 'other' then 'discard' end"


@query(f"""with {_RECORDS}, x as (select *, {_ROUTED.format('email_class')} g, {_ROUTED.format('guess')} p from pr where ok % 9 > 0), s as (select count(*) n, count(*) filter (g = p) r, count(*) filter (email_class = guess) c, count(*) filter (p is null) invalid_route from x)
 select n, {ratio('r', 'n')} routing_accuracy, {ratio('c', 'n')} classification_accuracy, invalid_route, {ratio('r', 'n')} - {ratio('c', 'n')} gap from s""")
def route_report(spark, sf):
    return E.route_report(joined(spark, sf, "skip", 9))


@query(f"with {_RECORDS}, x as (select coalesce({_ROUTED.format('email_class')}, 'none') gold_route, coalesce({_ROUTED.format('guess')}, 'invalid') pred_route from pr where ok % 9 > 0) select gold_route, pred_route, count(*) n from x where gold_route <> pred_route group by all")
def route_off_diagonal(spark, sf):
    return E.route_confusion(joined(spark, sf, "skip", 9))


@query(f"with {_TALLY.replace('state >= 3 tried', 'ok % 9 > 0 and state >= 3 tried').replace('state >= 6 parsed', 'ok % 9 > 0 and state >= 6 parsed')}, s as (select {_SUMS} from slots) select *, {_RATES} from s")
def missing_predictions_as_empty(spark, sf):
    return E.field_report(E.tallies(joined(spark, sf, "empty", 9)), [])


@query(f"with {_RECORDS} select 'oracle' kind, count(*) filter (has_gold) records, 1.0::DOUBLE f1 from pr union all select 'empty', count(*) filter (has_gold), 0.0 from pr")
def reference_predictors(spark, sf):
    r = written(records(spark, sf).select("id", "email_class", "gold"), "records")
    one = lambda kind: E.tallies(E.with_predictions(r, E.reference_predictions(r, kind))).select(F.lit(kind).alias("kind"), "id", "fields")
    both = one("oracle").union(one("empty"))
    return both.groupBy("kind").agg(F.count("*").alias("records")).join(E.field_report(both, ["kind"]).select("kind", "f1"), "kind")


@query(f"""with {_RECORDS}, x as (select ok, po, ppo, {b(1000, "concat_ws('|', 'conf', ok)")} / 1000.0::DOUBLE c from pr where has_gold and parsed)
 select 'customer_po_text' field, count(*) pairs, round(sum(c), 6) confidence, sum((po is null and ppo is null or coalesce(lower(po) = lower(ppo), false))::INT)::BIGINT correct from x where ok % 4 <> 2
 union all select 'line_items.quantity', count(*), round(sum(0.5::DOUBLE), 6), sum((g.quantity is null and p.quantity is null or coalesce(g.quantity = p.quantity, false))::INT)::BIGINT
 from x join (select *, row_number() over (partition by k order by pos) nth from gl) g on g.k = ok join (select *, row_number() over (partition by k order by pos) nth from pl) p on p.k = ok and p.nth = 1 and g.nth = 1""")
def calibration_pairs(spark, sf):
    confidence = (C.bucket(1000, F.lit("conf"), F.col("id")) / 1000.0)
    both = F.map_from_arrays(F.array(F.lit("customer_po_text"), F.lit("line_items.0.quantity")), F.array(confidence, F.lit(0.5)))
    line = F.map_filter(both, lambda k, v: k != "customer_po_text")
    x = joined(spark, sf).withColumn("conf", F.when(F.col("id") % 4 != 2, both).otherwise(line))
    return E.calibration_pairs(x, "conf").groupBy("field").agg(F.count("*").alias("pairs"), F.round(F.sum("confidence"), 6).alias("confidence"), F.sum(F.col("correct").cast("long")).alias("correct"))


@query("select 'run' || n_nationkey run, case when n_nationkey % 3 = 0 then 'missing' else 'ok' end status, case when n_nationkey % 3 > 0 then n_nationkey / 100.0::DOUBLE end f1 from nation")
def run_table(spark, sf):
    n = t(spark, sf, "nation").select(F.concat(F.lit("run"), F.col("n_nationkey").cast("string")).alias("run"), F.col("n_nationkey").alias("k"))
    return E.run_table(n.select("run"), n.where("k % 3 > 0").select("run", (F.col("k") / 100.0).alias("f1"))).select("run", "status", "f1")
