"""Cases of the third round's findings; each failed before its finding was settled."""

import re
from datetime import datetime
from email import message_from_string, policy

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from docket.functions import columns as C
from docket.operators import align, evaluation, flow, resampling, reviewing, surfaces
from docket.operators.evaluation import ORDER
from docket.plans import records
from docket.sources import mail
from docket.streaming import limits, reviews, upserts


def same_as_sql(spark, tmp_path, query, **tables):
    """The query's rows and those of its SQL over ``tables``, both sorted."""
    duck = duckdb.connect()
    for name, rows in tables.items():
        path = f"{tmp_path}/{name}.parquet"
        rows.coalesce(1).write.parquet(path)
        duck.execute(f"create view {name} as select * from '{path}/*.parquet'")
    df, sql = entry.queries()[query](spark, str(tmp_path)), duck.execute(entry.oracle_sql()[query])
    names = sorted(df.columns)
    wanted = [dict(zip((c[0] for c in sql.description), row)) for row in sql.fetchall()]
    return sorted(tuple(r[n] for n in names) for r in df.collect()), sorted(tuple(r[n] for n in names) for r in wanted)


def test_token_f1_tells_sharp_s_from_ss(spark, tmp_path):
    turns = spark.createDataFrame([(1, 0, "Straße ss Maß"), (1, 1, "strasse SS maß"), (1, 2, "ß")], "conv_id long, turn int, text string")
    got, wanted = same_as_sql(spark, tmp_path, "token_f1", conversations=turns)
    assert got == wanted == [(1, 0, 0, "1/2"), (3, 0, 1, "1/1"), (3, 2, 3, "1/0")]  # gold words, overlap, predicted words


def test_draws_are_no_broadcast(spark):
    """A replicate is one row to the planner, but it has a draw for every record: whoever broadcasts draws sends them all through the driver."""
    df = spark.range(50).select(F.col("id").alias("k"), (F.col("id") % 3).alias("v"))
    drawn, sums = resampling.drawn(df, "k", 30, 9), resampling.drawn_sums(df, "k", ["v"], 30, 9)
    for x in (drawn, sums):
        assert "BroadcastHashJoin [place" not in x._jdf.queryExecution().executedPlan().toString()
    by_rep = drawn.groupBy("rep").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("v")).alias("v"))
    assert sorted(by_rep.collect()) == sorted(sums.collect()) and sums.count() == 30


def test_resolution_broadcasts_neither_mentions_nor_terms(spark):
    text = lambda v: F.concat(F.lit(v), F.col("id").cast("string"))
    said = spark.range(40).select(F.when(F.col("id") % 2 == 0, text("Long Part ")).otherwise(text("part long  x")).alias("m"))
    got = align.resolve(said, "m", spark.range(40).select(text("long part ").alias("term"), F.col("id").alias("target")), "term", "target")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Broadcast\w*Join \[(norm|term|mention|a|b|g)#", plan), plan
    assert got.where("method = 'name_exact'").count() == 20 and got.count() == 40


def test_records_are_built_once(spark):
    """What joins gold and predictions reads a table of records, not the star schema once for each side."""
    plan = records.joined(spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
    assert "l_orderkey" not in plan


def test_terms_without_a_text_stay_out(spark):
    texts = spark.createDataFrame([(0, "The o\u212a Straße of_the A-1, sku 12x"), (1, None), (2, "\u0130 ok")], "id long, text string")
    said = ["OK", "straße", "of the", "a-1", "a-2", "sku 12", "sku 12x", "...", "é", ", SKU", "Part x #7", "12x"]
    terms = spark.createDataFrame([(t,) for t in said], "term string")
    left = {r.term for r in surfaces.possible_terms(terms, texts, "term", "text").collect()}
    assert left == {"OK", "straße", "a-1", "sku 12x", "...", "é", ", SKU", "12x"}  # "of_the" is one word
    for ascii_words in (False, True):
        found = surfaces.automaton(said)
        for r in surfaces.term_spans(texts, terms, ascii_words=ascii_words).collect():
            assert [tuple(s) for s in r.spans or []] == surfaces.chosen(surfaces.occurrences(found, r.text or "", ascii_words))


def test_latin_texts_fold_without_python(spark):
    chars = [chr(k) for k in [*range(1, 0x250), *range(0x2000, 0x20D0)]]
    texts = [f"x{c}Y{c.upper()} {c.lower()}z" for c in chars] + ["ΣΟΦΟΣ", "plain TEXT", "Ⅷ ﬁ ẞ"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", C.norm_folded(F.col("t")).alias("f"), C.norm_text(F.col("t")).alias("n")).collect()
    assert [r.t for r in rows if r.f != r.n.casefold()] == []
    plan = spark.range(1).select(C.norm_folded(F.col("id").cast("string")))._jdf.queryExecution().optimizedPlan().toString()
    assert "casefolded(CASE WHEN" in plan, plan  # as it stands, a function is called for every row


def test_mail_headers_that_come_again_are_parsed_once():
    before = mail.POLICY.header_factory.cache_info().misses
    for k in range(50):
        m = mail.parse_message(f"From: user{k}@example.org\nSubject: Event {k}\nContent-Type: text/html\n\n<p>value {k}</p>")
        assert (m["sender"], m["subject"], m["body"], m["error"]) == (f"user{k}@example.org", f"Event {k}", f"value {k}", None)
    assert mail.POLICY.header_factory.cache_info().misses - before <= 1
    for raw in ("=?utf-8?q?a=C3=A9?=", " two  spaces ", "a\n b", "A B <a@b.c>", "a@b.c, d@e.f", "a.@b", "a_b@c", "a" * 500, "ab " * 60, "", "5"):
        for name in ("Subject", "From"):
            m = message_from_string(f"{name}: {raw}\n\nx", policy=policy.default)
            assert mail.header(m, name.lower()) == str(m[name])


def test_a_review_makes_each_order_once(spark):
    """What is judged, sent and tallied reads a table of orders and one of decisions, not the windows over the log once for each."""
    log = spark.createDataFrame([(1, None, 0, "submitted", None, None), (1, None, 1, "edited", None, {"notes": "n"}), (1, None, 2, "edited", None, {"notes": "n"})], reviewing.LOG)
    orders = reviewing.orders_of(log)
    assert sorted((r.item, r.version) for r in orders.collect()) == [(1, "[]"), (1, '[{"key":"notes","value":"n"}]')]
    terms = spark.createDataFrame([("a", "A")], "term string, sku string")
    plan = reviewing.review(log, terms, spark.createDataFrame([("A", 1, 9, 5)], "sku string, moq long, most long, price_cents long"))._jdf.queryExecution().analyzed().toString()
    assert "map_entries" not in plan


def test_edits_are_worked_out_once(spark):
    """Functions of transform and filter work out again whatever they name, so edits and order are bound before."""
    edits = F.map_concat(F.create_map(F.lit("notes"), F.lit("n")), F.create_map(F.lit("line_items.0.quantity"), F.lit("2")))
    plan = spark.createDataFrame([(None,)], f"o {ORDER}").select(flow.apply_edits(F.col("o"), edits).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("map_concat") == 1


def test_review_stream_folds_batches_as_tables(spark, tmp_path):
    """No decision goes through Python and no state store is needed: what stands of an item goes on from the table, an order that was submitted before as well."""
    at = lambda n: datetime(2024, 1, 1, 0, 0, n)
    order = ("P", "soon", "here", "A", None, [("a", 5, None, None, None)])
    parts = [[(1, at(5), 0, "submitted", order, None), (1, at(6), 1, "edited", None, {"buyer_name_text": ""})], [(1, at(1), 2, "approved", None, None), (2, at(2), 3, "approved", None, None)], [(1, at(7), 4, "approved", None, {"buyer_name_text": "B"}), (1, at(8), 5, "edited", None, None), (1, at(9), 6, "approved", None, None)]]
    terms, products = spark.createDataFrame([("a", "A")], "term string, sku string"), spark.createDataFrame([("A", 1, 9, 5)], "sku string, moq long, most long, price_cents long")
    table = upserts.KeyedTable(spark, f"{tmp_path}/table", reviewing.STATE, ["item"], 2)
    for rows in parts:
        part = spark.createDataFrame(rows, reviewing.LOG)
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        reviews.review_stream(spark.readStream.schema(part.schema).parquet(f"{tmp_path}/in"), table, terms, products, f"{tmp_path}/checkpoint")
    got = table.read().collect()
    assert [(r.item, r.status, r.version, r.decisions, r.refused, r.sent) for r in got] == [(1, "approved", "[]", 5, 2, 1)]  # both approvals of an order without buyer are refused


def test_limits_fold_batches_as_tables(spark, tmp_path):
    """No state store is needed; the open window goes on from the table, a late event counts on its own, and one without a time fails nothing."""
    at = lambda day, n: datetime(2024, 1, day, 0, 0, n)
    table = upserts.KeyedTable(spark, f"{tmp_path}/table", limits.OPEN, ["identity"], 2)
    for rows in ([("a", at(2, 1), 1), ("a", at(2, 2), 2), (None, at(2, 1), 3), ("b", None, 4)], [("a", at(2, 3), 5), ("a", at(1, 3), 6), ("a", at(3, 4), 7), (None, at(2, 4), 8)]):
        part = spark.createDataFrame(rows, "who string, at timestamp, k long")
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        out = limits.limit_stream(spark.readStream.schema(part.schema).parquet(f"{tmp_path}/in"), "who", "at", "k", 86400, 1, table, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    assert {r.seq: (r.used, r.allowed, r.retry_after) for r in out.collect()} == {
        1: (1, True, None), 2: (2, False, 86398), 3: (1, True, None), 4: (1, True, None), 5: (3, False, 86397), 6: (1, True, None), 7: (1, True, None), 8: (2, False, 86396),
    }


def test_tallies_make_no_text_comparable_in_lambdas(spark):
    """regular expressions within lambdas ran by line, field and use; whole batches are made comparable instead, to the same classes."""
    plan = evaluation.field_report(evaluation.tallies(records.joined(spark, "/root/testdata/sf0.001")), [])._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and "lambda" not in plan
    texts = [None, "", " ", "A", " a ", "a\tB", "A  b", "a b", "a \n b", "a\x1cb", "a b", "STRASSE", "straße", "ΣΟΦΟΣ", "σοφος", "İ", "i̇", "I", "ı", "\x85a", "a\x0b", "ẞ", "ss"]
    both = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    lines = lambda c: F.array(F.struct(F.col(c).alias("p"), F.lit(None).cast("long").alias("q"), F.lit(None).cast("string").alias("u"), F.lit(None).cast("string").alias("c")))
    of = lambda c: F.struct(F.col(c).alias("h"))
    same = C.norm_equal(F.col("a")) == C.norm_equal(F.col("b"))
    rows = both.select("a", "b", F.coalesce(same, F.lit(False)).alias("same"), align.compared(lines("a"), lines("b"), of("a"), of("b"))["fields"].alias("f")).collect()
    for r in rows:
        assert (r.f[0].correct, r.f[1].correct) == (r.same, r.same), r
        assert r.f[0].strict_correct == (r.a is not None and r.a == r.b) and r.f[0].miss == (r.a is not None and r.b is None)


def test_records_are_grouped_where_their_lines_are_numbered(spark):
    """one shuffle numbers an order's lines, gathers them and meets the order; each took one of its own."""
    plan = records.records(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning(k#") + plan.count("Exchange hashpartitioning(l_orderkey#") == 1, plan
