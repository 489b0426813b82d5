"""Registered queries on scoring of folded texts and notes, the audit report and class checks, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import functions as F

from docket.functions import columns as C
from docket.operators import auditing, corpus, dims, scoring
from docket.operators import evaluation as E
from docket.plans.catalogue import query, ratio, t
from docket.plans.records import _RECORDS, joined

# Gold and predicted names that differ by case alone, in ways that lower() does not see, and two pairs that do differ.
_NAMES = [("Hauptstraße {}", "HAUPTSTRASSE {}"), ("Ünal & Söhne {}", "ÜNAL & SÖHNE {}"), ("Σοφός {}", "ΣΟΦΌΣ {}"), ("ﬁne {}", "FINE {}"), ("ırmak {}", "IRMAK {}"), ("Straße {}", "Strase {}"), ("plain {}", "Plain {}")]


@query("select c_custkey % 7 as kind, count(*) as n, count(*) filter (c_custkey % 7 not in (4, 5) and c_custkey % 3 > 0) as correct, 0::BIGINT as strict_correct, count(*) filter (c_custkey % 7 in (4, 5) and c_custkey % 3 > 0) as wrong, count(*) filter (c_custkey % 3 = 0) as miss from customer group by 1")
def folded_slots(spark, sf):
    """Slots whose gold and prediction differ by case in four scripts."""
    k = F.col("c_custkey")
    pick = lambda side: F.get(F.array(*(F.concat(F.lit(p[side].format("")), k.cast("string")) for p in _NAMES)), (k % 7).cast("int"))
    x = t(spark, sf, "customer").select((k % 7).alias("kind"), pick(0).alias("gold_name"), F.when(k % 3 > 0, pick(1)).alias("pred_name"))
    s = scoring.slot_outcomes(x, ["name"], ["kind"]).groupBy("kind")
    return s.agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in ("correct", "strict_correct", "wrong", "miss")))


@query(f"""with k as (select o_orderkey k from orders), r as (select case when k % 4 > 0 then 6 else 0 end ng, case when k % 5 > 0 then 5 else 0 end np, case when k % 4 > 0 and k % 5 > 0 then 4 + (k % 3 = k % 2)::INT else 0 end no,
  3 ig, case when k % 7 > 0 then 3 else 0 end ip, case when k % 7 > 0 then 2 else 0 end io from k), s as (select count(*) records, sum(no)::BIGINT notes_overlap, sum(ng)::BIGINT notes_gold, sum(np)::BIGINT notes_pred, sum(io)::BIGINT item_notes_overlap, sum(ig)::BIGINT item_notes_gold, sum(ip)::BIGINT item_notes_pred from r)
 select *, {ratio('2 * notes_overlap', 'notes_gold + notes_pred')} notes_f1, {ratio('2 * item_notes_overlap', 'item_notes_gold + item_notes_pred')} item_notes_f1 from s""")
def notes_report(spark, sf):
    """Word overlap of the notes of orders and of their lines, with words that only fold alike and words that recur."""
    k = F.col("id")
    order = lambda notes, lines: F.struct(*(F.lit(None).cast("string").alias(f) for f in E.ORDER_FIELDS), notes.alias("notes"), lines.alias("line_items")).cast(E.ORDER)
    line = lambda note: F.array(F.struct(F.lit("tape"), F.lit(1), F.lit(None), F.lit(None), F.lit(note)))
    none = F.array().cast(f"array<{E.LINE}>")
    x = t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    gold = order(F.when(k % 4 > 0, F.concat(F.lit("Ring the  Bell at Straße "), (k % 3).cast("string"))), line("Fragile fragile GLASS").cast(f"array<{E.LINE}>"))
    pred = order(F.when(k % 5 > 0, F.concat(F.lit("ring bell AT STRASSE "), (k % 2).cast("string"))), F.when(k % 7 > 0, line("glass fragile glass").cast(f"array<{E.LINE}>")).otherwise(none))
    tally = E.tallies(x.select("id", gold.alias("gold"), F.struct(pred.alias("parsed"), F.lit(False).alias("repair_used")).alias("extraction")))
    return E.record_report(tally).select("records", "notes_overlap", "notes_gold", "notes_pred", "item_notes_overlap", "item_notes_gold", "item_notes_pred", "notes_f1", "item_notes_f1")


@query(f"""with {_RECORDS}, g as (select k, quantity q, unit u, row_number() over (partition by k, quantity, unit order by pos) nth from gl join pr on ok = k and has_gold where quantity is not null),
 p as (select k, quantity q, unit u, row_number() over (partition by k, quantity, unit order by pos) nth from pl join pr on ok = k and parsed where quantity is not null),
 s as (select count(*) matched, count(*) filter (g.q = p.q) quantity_hit, count(*) filter (g.u is not distinct from p.u) unit_hit from g join p on g.k = p.k and g.q = p.q and g.u is not distinct from p.u and g.nth = p.nth)
 select *, {ratio('unit_hit', 'matched')} unit_hit_rate from s""")
def semantics_hits(spark, sf):
    return E.semantics_totals(joined(spark, sf)).select("matched", "quantity_hit", "unit_hit", "unit_hit_rate")


_AUDIT = """v as (select doc_id id, case ('0x' || substr(md5(concat_ws('|', 'audit', doc_id)), 1, 8))::BIGINT % 4 when 0 then false else true end realistic, doc_id % 9 > 0 labels_correct,
 case when doc_id % 3 = 0 then 'quirk: tone' when doc_id % 3 = 1 then 'seen; (quirk: protocol: dup.' else '' end notes, lang, coalesce(n_chars, 0) n_chars from documents)"""


def audit_inputs(spark, sf):
    k = F.col("doc_id")
    d = t(spark, sf, "documents")
    records = d.select(k.alias("id"), F.col("lang").alias("email_class"), F.coalesce("n_chars", F.lit(0)).alias("n_chars"))
    notes = F.when(k % 3 == 0, "quirk: tone").when(k % 3 == 1, "seen; (quirk: protocol: dup.").otherwise("")
    found = d.select(k.alias("id"), (C.bucket(4, F.lit("audit"), k) > 0).alias("realistic"), (k % 9 > 0).alias("labels_correct"), notes.alias("notes"))
    return records, found


@query(f"""with {_AUDIT}, st as (select * from (values ('en/short', 'en', 0, 1000), ('en/long', 'en', 1000, 999999999), ('de/all', 'de', 0, 999999999), ('fr/huge', 'fr', 99999999, 999999999)) s(stratum, lang, lo, hi))
 select 'class' as section, lang as name, count(*) filter (realistic) as a, count(*) as b from v group by lang
 union all select 'stratum', stratum, count(id), count(id) filter (not realistic) from st left join v on v.lang = st.lang and v.n_chars >= lo and v.n_chars < hi group by stratum
 union all select 'tag', case when id % 3 = 0 then 'quirk: tone' else 'quirk: —' end, count(*), 0 from v where id % 3 < 2 group by 2
 union all select 'protocol', null, count(*), 0 from v where id % 3 = 1 union all select 'labels', null, count(*), 0 from v where not labels_correct union all select 'evidence', null, count(*), sum(n_chars)::BIGINT from v where not realistic""")
def audit_report(spark, sf):
    records, found = audit_inputs(spark, sf)
    n = F.col("n_chars")
    r = auditing.audit_report(records, found, {"en": {"short": n < 1000, "long": n >= 1000}, "de": {"all": F.lit(True)}, "fr": {"huge": n >= 99999999}})
    row = lambda df, section, name, a, b: df.select(F.lit(section).alias("section"), name.cast("string").alias("name"), a.cast("long").alias("a"), b.cast("long").alias("b"))
    count = lambda df, section, b=F.lit(0): row(df.agg(F.count("*").alias("n"), F.sum(b).alias("b")), section, F.lit(None), F.col("n"), F.coalesce("b", F.lit(0)))
    tables = [
        row(r["classes"], "class", F.col("email_class"), F.col("realistic"), F.col("total")), row(r["strata"], "stratum", F.col("stratum"), F.col("sampled"), F.col("unrealistic")),
        row(r["tags"], "tag", F.concat_ws(" ", "tag", "qualifier"), F.col("n"), F.lit(0)), count(r["protocol"], "protocol"), count(r["label_findings"], "labels"), count(r["evidence"], "evidence", n),
    ]
    out = tables[0]
    for x in tables[1:]:
        out = out.unionByName(x)
    return out


@query("""with m as (select case o_orderpriority when '1-URGENT' then 'new_order' when '2-HIGH' then 'amendment' when '3-MEDIUM' then 'inquiry' when '5-LOW' then 'spam' end as class, count(*) filter (o_orderpriority <> '3-MEDIUM') weight from orders group by 1)
 select class, 'weight' problem from m where class is not null and weight <= 0 union all select class, 'unknown' from m where class = 'spam' union all select c, 'missing' from (values ('new_order'), ('amendment'), ('cancellation'), ('inquiry'), ('other')) v(c) where c not in (select class from m where class is not null)""")
def class_mix_of_orders(spark, sf):
    """The checks of a class mix over weights that the orders give."""
    p = F.col("o_orderpriority")
    cls = F.when(p == "1-URGENT", "new_order").when(p == "2-HIGH", "amendment").when(p == "3-MEDIUM", "inquiry").when(p == "5-LOW", "spam")
    mix = t(spark, sf, "orders").select(cls.alias("class"), (p != "3-MEDIUM").alias("counts")).where("class is not null").groupBy("class").agg(F.count_if("counts").alias("weight"))
    return corpus.class_mix_problems(mix, list(E.CLASSES))


@query("""with d as (select doc_id, case doc_id % 3 when 0 then 'new_order' when 1 then 'amendment' else 'other' end label from documents) select label, count(*) n from d where label <> 'other' and doc_id % 5 < 2 group by 1""")
def inquiry_orders(spark, sf):
    """Order-class texts that the inquiry pattern finds: every document, two in five with a question put after its text and one with none that counts."""
    k = F.col("doc_id")
    said = F.when(k % 5 == 0, " Do you stock tape?").when(k % 5 == 1, "\nWHAT IS THE PRICE of it").when(k % 5 == 2, " redo your stocks").otherwise("")
    label = F.when(k % 3 == 0, "new_order").when(k % 3 == 1, "amendment").otherwise("other")
    d = t(spark, sf, "documents").select(label.alias("label"), F.concat(F.coalesce("text", F.lit("")), said).alias("text")).where("label <> 'other'")
    return d.where(C.is_inquiry(F.col("text"))).groupBy("label").agg(F.count("*").alias("n"))


@query("""select p_partkey, '{"type":"object","title":"' || p_name || '","properties":{"minimum":{"type":"integer"},"list":{"type":"array","items":[{"type":"string","enum":["minLength",' || p_size || ']}]}}}' as "schema" from part""")
def schema_keywords(spark, sf):
    """A schema for each part, with keywords at three depths and a property that is called like one."""
    text = F.concat(
        F.lit('{"type":"object","title":"'), F.col("p_name"), F.lit('","minLength":1,"properties":{"minimum":{"type":"integer","minimum":'), F.col("p_size").cast("string"),
        F.lit('},"list":{"type":"array","items":[{"type":"string","minLength":2,"enum":["minLength",'), F.col("p_size").cast("string"), F.lit("]}]}}}"),
    )
    return t(spark, sf, "part").select("p_partkey", C.stripped_schema(text).alias("schema"))


@query("""select 'CUST-' || case when c_custkey % 2 = 0 then lpad((c_custkey % 10000)::VARCHAR, 4, '0') else c_custkey || 'x' end as key, 'id' as problem from customer where c_custkey % 2 = 1""")
def customer_ids(spark, sf):
    """Customers whose id is not of the usual form."""
    k = F.col("c_custkey")
    number = F.when(k % 2 == 0, F.lpad((k % 10000).cast("string"), 4, "0")).otherwise(F.concat(k.cast("string"), F.lit("x")))
    book = t(spark, sf, "customer").select(F.concat(F.lit("CUST-"), number).alias("customer_id"), F.from_json(F.lit("{}"), f"struct<{dims.CUSTOMER}>").alias("c")).select("customer_id", *(f"c.{f}" for f in ("company", "domains", "contacts", "delivery_addresses", "po_template", "style")))
    return dims.customer_problems(book, dims.CUSTOMER_ID).where("problem = 'id'")
