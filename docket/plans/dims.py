"""Registered queries on the catalogue, the customer book, corpus statistics and scenario texts, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import functions as F

from docket.functions import columns as C
from docket.operators import corpus, dims
from docket.operators import evaluation as E
from docket.plans.catalogue import b, query, ratio, t
from docket.plans.records import _RECORDS, records

_KEY = lambda k, n: F.lpad((k % n).cast("string"), 3, "0")
_PART = """pt as (select *, case when p_partkey % 17 = 0 then 'abc-1' when p_partkey % 19 = 0 then 'ABC-X1-000' else 'ABC-X' || p_partkey // 1000 || '-' || lpad((p_partkey % 1000)::VARCHAR, 3, '0') end sku,
  case when p_partkey % 5 = 0 then ['Upper ' || p_partkey] when p_partkey % 7 = 0 then ['x' || p_partkey, 'x' || p_partkey] else ['alias ' || p_partkey] end aliases, case when p_partkey % 13 = 0 then 'crate' when p_partkey % 2 = 0 then 'box' else 'roll' end unit, p_size moq, p_size + 5 - 10 * (p_partkey % 11 = 0)::INT most from part)"""


def products(spark, sf):
    k = F.col("p_partkey")
    strings = lambda *x: F.array(*x)
    sku = F.when(k % 17 == 0, "abc-1").when(k % 19 == 0, "ABC-X1-000").otherwise(F.concat(F.lit("ABC-X"), F.floor(k / 1000).cast("string"), F.lit("-"), _KEY(k, 1000)))
    text = lambda p: F.concat(F.lit(p), k.cast("string"))
    aliases = F.when(k % 5 == 0, strings(text("Upper "))).when(k % 7 == 0, strings(text("x"), text("x"))).otherwise(strings(text("alias ")))
    unit = F.when(k % 13 == 0, "crate").when(k % 2 == 0, "box").otherwise("roll")
    p = t(spark, sf, "part").select(k.alias("place"), sku.alias("sku"), F.col("p_name").alias("name"), F.col("p_type").alias("category"), aliases.alias("aliases"), unit.alias("unit"), F.col("p_size").alias("moq"), (F.col("p_size") + 5 - 10 * (k % 11 == 0).cast("int")).alias("max_qty"), (k % 4 > 0).alias("active"))
    u = spark.createDataFrame([("box", ["boxes", "bx"]), ("roll", ["rolls", "bx", "Rl"])], "unit string, aliases array<string>")
    return p, u


@query(f"""with {_PART}, own as (select sku k, unnest(list_filter([case when not regexp_matches(sku, '^[A-Z]{{3}}-[A-Z0-9]{{2,3}}-[0-9]{{3}}$') then 'sku' end, case when p_partkey % 5 = 0 then 'aliases' end, case when p_partkey % 5 > 0 and p_partkey % 7 = 0 then 'alias repeated' end, case when most < moq then 'range' end, case when unit = 'crate' then 'unit' end], lambda x: x is not null)) problem from pt),
 tm as (select unnest(list_concat([lower(p_name)], list_distinct(aliases))) term from pt)
 select k as key, problem, count(*) n from (select * from own union all select 'roll', 'unit aliases' union all select sku, 'sku repeated' from pt group by sku having count(*) > 1 union all select term, 'term repeated' from tm group by term having count(*) > 1 union all select 'bx', 'unit term repeated') group by 1, 2""")
def product_problems(spark, sf):
    return dims.product_problems(*products(spark, sf)).groupBy("key", "problem").agg(F.count("*").alias("n"))


@query(f"with {_PART} select p_type category, count(*) n from pt where p_partkey % 4 > 0 and p_type <> 'SMALL' group by 1")
def active_products(spark, sf):
    return dims.active_products(products(spark, sf)[0], ["SMALL"]).groupBy("category").agg(F.count("*").alias("n"))


_CUST = """cu as (select *, 'CUST-' || c_custkey customer_id, case when c_custkey % 11 = 0 then 'shared.example' when c_custkey % 13 = 0 then 'Bad_' || c_custkey else 'c' || c_custkey || '.example' end dom from customer)"""


def customers(spark, sf):
    k = F.col("c_custkey")
    text = lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) else v.cast("string") for v in x))
    dom = F.when(k % 11 == 0, "shared.example").when(k % 13 == 0, text("Bad_", k)).otherwise(text("c", k, ".example"))
    email = F.when(k % 6 == 0, text("buyer", k, "@elsewhere.example")).otherwise(text("buyer", k, "@", dom))
    contact = F.struct(F.col("c_name").alias("name"), email.alias("email"), F.when(k % 2 == 0, "buyer").otherwise("manager").alias("role"), F.when(k % 9 == 0, "0412").otherwise("+61412345678").alias("phone"))
    address = lambda label: F.struct(F.lit(label).alias("label"), F.lit("1 Road").alias("line1"), F.lit(None).cast("string").alias("line2"), F.lit("Town").alias("suburb"), F.when(k % 8 == 0, "XX").otherwise("NSW").alias("state"), F.lit("2000").alias("postcode"))
    addresses = F.when(k % 10 == 0, F.array(address("a"), address("a"))).otherwise(F.array(address("a")))
    return t(spark, sf, "customer").select(k, text("CUST-", k).alias("customer_id"), F.array(dom).alias("domains"), F.array(contact).alias("contacts"), addresses.alias("delivery_addresses"), F.when(k % 7 == 0, "PO").when(k % 3 > 0, "PO-####").alias("po_template"))


@query(f"""with {_CUST}, own as (select customer_id k, unnest(list_filter([case when dom like 'Bad%' then 'domain' end, case when dom like 'Bad%' and c_custkey % 6 > 0 then 'email' end, case when c_custkey % 9 = 0 then 'phone' end, case when c_custkey % 8 = 0 then 'state' end, case when c_custkey % 7 = 0 then 'template' end, case when c_custkey % 6 = 0 then 'contact' end, case when c_custkey % 10 = 0 then 'label repeated' end], lambda x: x is not null)) problem from cu)
 select k as key, problem from own union all select dom, 'shared domain' from cu group by dom having count(*) > 1""")
def customer_problems(spark, sf):
    return dims.customer_problems(customers(spark, sf))


@query(f"""with {_CUST} select o_orderkey, case when dom not in (select dom from cu group by dom having count(*) > 1) and dom not like 'Bad%' then customer_id end sender_customer,
 case when dom not in (select dom from cu group by dom having count(*) > 1) and dom not like 'Bad%' and o_orderkey % 2 = 0 and c_custkey % 6 > 0 then case when c_custkey % 2 = 0 then 'buyer' else 'manager' end end "role" from orders join cu on c_custkey = o_custkey where c_custkey % 11 > 0""")
def sender_roles(spark, sf):
    c, k = customers(spark, sf), F.col("o_custkey")
    who = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("buyer"), k.cast("string"))).otherwise("someone")
    o = t(spark, sf, "orders").where("o_custkey % 11 > 0").select("o_orderkey", F.concat(who, F.lit("@c"), k.cast("string"), F.lit(".example")).alias("sender"))
    return dims.sender_role(o, "sender", c).select("o_orderkey", "sender_customer", "role")


@query(f"""with {_RECORDS}, n as (select ok, count(k) n from rec left join li on k = ok where has_gold group by 1), c as (select count(*) total from rec),
 u as (select unnest(list_concat(list_filter([{', '.join(f"case when ok % {n + 2} = 0 then 'flag|{f}' end" for n, f in enumerate(E.FLAGS))}], lambda x: x is not null), list_filter(['layout|' || ['dash_list', 'x_list', 'reverse_list', 'prose', 'none'][layout + 1], case when ok % 10 < 6 then 'route|' || ['touchless', 'clarification', 'exception'][ok % 3 + 1] end, (select 'items|' || n from n where n.ok = rec.ok)], lambda x: x is not null))) s from rec)
 select split_part(s, '|', 1) kind, split_part(s, '|', 2) "name", count(*) n, {ratio('count(*)', 'any_value(total)')} rate from u, c group by 1, 2""")
def corpus_stats(spark, sf):
    r = records(spark, sf).withColumn("items", F.size("gold.line_items"))
    r = r.withColumn("items", F.when(F.col("gold").isNotNull(), F.col("items")))
    return corpus.corpus_stats(r, "flags", {"layout": "layout", "route": "route", "items": "items"})


@query(f"""with {_RECORDS}, o as (select ok, count(k) filter (quantity is null) nq, count(k) filter (price is not null) np from pr left join gl on k = ok where email_class = 'new_order' group by 1), z as (select (select count(*) from pr where email_class = 'new_order' and po is null) a, (select count(*) from o where nq > 0) b, (select count(*) from o where np > 0) c, (select count(distinct o_custkey % 50) from orders) d)
 select what, wanted::BIGINT wanted, found, found >= wanted met from (select 'no order number' what, 8 wanted, a found from z union all select 'quantity missing', 6, b from z union all select 'prices stated', 1000000, c from z union all select 'customers', 6, d from z)""")
def coverage(spark, sf):
    new, lines = F.col("email_class") == "new_order", F.col("gold.line_items")
    counts = {"no order number": (8, new & F.col("gold.customer_po_text").isNull()), "quantity missing": (6, new & F.exists(lines, lambda i: i["quantity"].isNull())), "prices stated": (1_000_000, new & F.exists(lines, lambda i: i["unit_price_text"].isNotNull()))}
    who = t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 50).alias("who"))
    return corpus.coverage(records(spark, sf).join(who, "id"), counts, {"customers": (6, F.col("who"))})


@query("select c as class, p problem from (values ('other', 'missing'), ('spam', 'unknown'), ('inquiry', 'weight')) v(c, p)")
def class_mix(spark, sf):
    mix = spark.createDataFrame([("new_order", 6.0), ("amendment", 1.0), ("cancellation", 1.0), ("inquiry", 0.0), ("spam", 1.0)], "class string, weight double")
    return corpus.class_mix_problems(mix, list(E.CLASSES))


@query("""with x as (select o_orderkey k, case when o_orderkey % 2 = 0 then 'PO' end po, case when o_orderkey % 3 > 0 then 'last week' end temporal, ['date_change', 'add_item', 'remove_item'][o_orderkey % 3 + 1] ch, case when o_orderkey % 5 > 0 then 'l' end line, case when o_orderkey % 7 > 0 then 5 end q, case when o_orderkey % 4 = 0 then 'p' end phrase from orders)
 select k o_orderkey, case when (po is null) = (temporal is null) then 'reference' end reference, case when ch = 'date_change' and not (line is null and phrase is not null) then 'date' when ch <> 'date_change' and not (line is not null and phrase is null) then 'item' when ch = 'remove_item' and q is not null then 'removal' end change from x""")
def scenario_contracts(spark, sf):
    k = F.col("o_orderkey")
    change = F.element_at(F.array(F.lit("date_change"), F.lit("add_item"), F.lit("remove_item")), (k % 3 + 1).cast("int"))
    phrase = F.when(k % 4 == 0, "p")
    bad = corpus.change_problem(change, F.when(k % 5 > 0, "l"), F.when(k % 7 > 0, 5), F.lit(None).cast("string"), phrase, phrase)
    return t(spark, sf, "orders").select(k, corpus.reference_problem(F.when(k % 2 == 0, "PO"), F.when(k % 3 > 0, "last week")).alias("reference"), bad.alias("change"))


@query("select doc_id from documents where doc_id % 9 = 0")
def namespace_impurities(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", F.concat(F.when(F.col("doc_id") % 9 > 0, "TRN-").otherwise("VAL-"), F.col("doc_id").cast("string")).alias("id"))
    return corpus.impure(d, "id", "TRN-").select("doc_id")


@query("select n_regionkey, count(*) metrics, not bool_or(n_nationkey % 6 = 5) passed, (sum(n_nationkey) - 40 > 0 and n_regionkey / 50.0 < 0.05) gain from nation group by 1")
def gate_verdicts(spark, sf):
    n = t(spark, sf, "nation").withColumn("regressed", F.col("n_nationkey") % 6 == 5)
    out = None
    for r in range(5):
        one = corpus.gate_verdict(n.where(F.col("n_regionkey") == r), "regressed").withColumn("n_regionkey", F.lit(r))
        out = one if out is None else out.union(one)
    gain = n.groupBy("n_regionkey").agg(corpus.gain_gate(F.sum("n_nationkey") - 40, F.first("n_regionkey") / 50.0).alias("gain"))
    return out.join(gain, "n_regionkey").select("n_regionkey", "metrics", "passed", "gain")


@query(f"""with x as (select o_orderkey k, [6, 12, 24, 5][o_orderkey % 4 + 1] q, [3, 5, 7, 10, 14, 4][o_orderkey % 6 + 1] d, round(o_totalprice * 100)::BIGINT c, o_orderdate from orders)
 select k o_orderkey, 'PO-' || {b(10, "k || '|3'")} || {b(10, "k || '|4'")} || '/A' po, case q when 6 then 'half a dozen' when 12 then 'a dozen' when 24 then 'two dozen' end words, case d when 3 then 'in 3 days' when 5 then 'in 5 days' when 7 then 'in a week' when 10 then 'in 10 days' when 14 then 'in a fortnight' end phrase,
  case when d <> 4 then ltrim(strftime(o_orderdate::DATE + d, '%d %B'), '0') end due, concat_ws(' ', q, 'cartons of', 'tape', '@ $' || c // 100 || '.' || lpad((c % 100)::VARCHAR, 2, '0')) line, case when q = 5 then null else q end back from x""")
def scenario_texts(spark, sf):
    k = F.col("o_orderkey")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    q, d, cents = pick([6, 12, 24, 5]), pick([3, 5, 7, 10, 14, 4]), F.round(F.col("o_totalprice") * 100).cast("long")
    words, phrase = corpus.number_words(q), corpus.relative_phrase(d)
    return t(spark, sf, "orders").select(
        k, corpus.expanded_po(F.lit("PO-##/A"), k).alias("po"), words.alias("words"), phrase.alias("phrase"), corpus.due_date(F.col("o_orderdate"), phrase).alias("due"),
        corpus.rendered_line(q, F.lit("cartons"), F.lit("tape"), cents).alias("line"), corpus.quantity_of(words).alias("back"),
    )


@query("select o_orderkey, case when round_even(c * [0.85, 0.9, 0.95, 1.1][o_orderkey % 4 + 1], 0)::BIGINT = c then c - 1 else round_even(c * [0.85, 0.9, 0.95, 1.1][o_orderkey % 4 + 1], 0)::BIGINT end price from (select o_orderkey, o_orderkey % 7 + 1 c from orders)")
def corrupted_prices(spark, sf):
    k = F.col("o_orderkey")
    return t(spark, sf, "orders").select(k, corpus.corrupted_price(k % 7 + 1, k).alias("price"))


@query("select o_orderkey, case when o_orderkey % 3 = 0 then 'digit' when o_orderkey % 3 = 1 then 'tape' end \"left\" from orders")
def closures(spark, sf):
    k = F.col("o_orderkey")
    text = F.concat(F.lit("Send 12 rolls of blue tape to Site "), k.cast("string"), F.when(k % 3 == 0, " 7").when(k % 3 == 1, " and Tape").otherwise(""))
    surfaces = F.array(F.lit("12"), F.lit("blue tape"), F.concat(F.lit("Site "), k.cast("string")))
    return t(spark, sf, "orders").select(k, corpus.unclosed(text, surfaces, F.array(F.lit("tape"), F.lit("glue"))).alias("left"))


@query(f"""with {_RECORDS} select ok id, ((po is not null)::INT + (due is not null)::INT + (site is not null)::INT + 1 + coalesce((select count(product) + count(quantity) + count(unit) + count(price) from gl where k = ok), 0))::INT surfaces from pr where has_gold""")
def gold_surfaces(spark, sf):
    return records(spark, sf).where("gold is not null").select("id", F.size(corpus.gold_surfaces(F.col("gold"))).alias("surfaces"))


@query("select doc_id, len(list_filter(string_split(text, ' '), lambda w: not (starts_with(w, '<|') and ends_with(w, '|>'))))::INT tokens from documents")
def ordinary_tokens(spark, sf):
    x = F.concat(F.array(F.lit("<|start|>")), F.split("text", " "), F.array(F.lit("<|end|>")))
    return t(spark, sf, "documents").select("doc_id", F.size(corpus.ordinary_tokens(x)).alias("tokens"))


@query("select event_id, ts from (select * from events order by ts desc, event_id desc limit 25)")
def latest_messages(spark, sf):
    return corpus.latest(t(spark, sf, "events"), 25, "ts", "event_id").select("event_id", "ts")


@query(f"with d as (select doc_id, {b(4, "concat_ws('|', 'fly', doc_id)")} f from documents) select part, count(*) n from (select 'pool' part from d union all select 'corrections' from d where f = 0) group by 1")
def flywheel_pool(spark, sf):
    d = t(spark, sf, "documents").select("doc_id")
    pool, fixed = d.withColumn("part", F.lit("pool")), d.where(C.bucket(4, F.lit("fly"), F.col("doc_id")) == 0).withColumn("part", F.lit("corrections"))
    return pool.unionByName(fixed).groupBy("part").agg(F.count("*").alias("n"))
