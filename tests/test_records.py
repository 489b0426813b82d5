"""Records, flow, dimensions and frozen files: brute force and small cases that the star schema does not hold."""

import json
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from docket.functions import columns as C
from docket.operators import align, corpus, dims, evaluation, flow, scoring
from docket.sources import frozen


def order(lines, **head):
    base = dict.fromkeys((*evaluation.ORDER_FIELDS, "notes"))
    return {**base, **head, "line_items": [{**dict.fromkeys(flow.LINE_FIELDS), **x} for x in lines]}


SCHEMA = f"id long, email_class string, gold {evaluation.ORDER}"
PREDICTED = f"id long, classification string, extraction {evaluation.PREDICTION}"


def brute_tally(gold, pred):
    """Counts of one record, pairs by trying all assignments."""
    from itertools import permutations

    norm = lambda v: None if v is None else " ".join(str(v).lower().split())
    same = lambda a, b: a is not None and b is not None and norm(a) == norm(b)
    sim = lambda g, p: 3 * (norm(g["product_text"]) == norm(p["product_text"])) + sum(same(g[f], p[f]) for f in ("quantity", "unit_text", "unit_price_text"))
    g, p = gold["line_items"], pred["line_items"]
    n = max(len(g), len(p))
    best = max(sum(sim(g[i], p[j]) for i, j in enumerate(order) if i < len(g) and j < len(p)) for order in permutations(range(n))) if n else 0
    return best


def test_tallies(spark):
    rng = random.Random(3)
    line = lambda: {"product_text": rng.choice(["tape", "Tape ", "box", "roll"]), "quantity": rng.choice([None, 1, 2]), "unit_text": rng.choice([None, "u"]), "item_notes": rng.choice([None, "keep dry"])}
    records, predictions = [], []
    for i in range(60):
        gold = order([line() for _ in range(rng.randint(0, 4))], customer_po_text=rng.choice([None, "PO-1"]), notes="leave at gate 2")
        pred = None if i % 9 == 0 else order([line() for _ in range(rng.randint(0, 4))], customer_po_text=rng.choice([None, "po-1", "PO-2"]), notes="gate 2 please")
        records.append((i, "new_order", gold))
        predictions.append((i, "new_order", {"parsed": pred, "repair_used": i % 5 == 0} if i % 10 else None))
    r, p = spark.createDataFrame(records, SCHEMA), spark.createDataFrame(predictions, PREDICTED)
    out = {t.id: t for t in evaluation.tallies(evaluation.with_predictions(r, p)).collect()}
    for (i, _, gold), (_, _, e) in zip(records, predictions):
        pred = (e or {}).get("parsed") or order([])
        t, counts = out[i], {f["field"]: f.asDict() for f in out[i].fields}
        assert (t.gold_items, t.pred_items, t.parsed) == (len(gold["line_items"]), len(pred["line_items"]), int(bool(e and e["parsed"])))
        for f in evaluation.ITEM_FIELDS:
            c = counts[f]
            assert c["correct"] + c["wrong"] + c["miss"] == sum(x[f] is not None for x in gold["line_items"])
            assert c["correct"] + c["wrong"] + c["hallucination"] == sum(x[f] is not None for x in pred["line_items"])
        total = 3 * t.product_correct + sum(counts[f]["correct"] for f in evaluation.ITEM_FIELDS[1:])
        assert total == brute_tally(gold, pred)  # products are never null here
        assert t.notes_overlap == (2 if e and e["parsed"] else 0) and t.notes_gold == 4
    with pytest.raises(Exception, match="no prediction for record"):
        evaluation.with_predictions(r, p.where("id <> 3")).count()
    assert evaluation.with_predictions(r, p.where("id <> 3"), "skip").count() == 59 and evaluation.with_predictions(r, p.where("id <> 3"), "empty").count() == 60
    with pytest.raises(ValueError):
        evaluation.reference_predictions(r, "other")
    empty = evaluation.with_predictions(r.limit(0), p.limit(0))
    assert evaluation.tallies(empty).count() == 0 and evaluation.field_report(evaluation.tallies(empty), []).first().f1 == 0.0


def test_order_edits(spark):
    base = order([{"product_text": "a", "quantity": 1}, {"product_text": "b"}], customer_po_text="P")
    cases = [
        ({}, [("a", 1), ("b", None)], "P"), ({"line_items.2.product_text": "c", "line_items.3.quantity": "7"}, [("a", 1), ("b", None), ("c", None), (None, 7)], "P"), ({"line_items.5.product_text": "x"}, [("a", 1), ("b", None)], "P"),
        ({"line_items.0": "__deleted__", "line_items.1.quantity": " 12 ", "line_items.9": "__deleted__"}, [("b", 12)], "P"), ({"customer_po_text": ""}, [("a", 1), ("b", None)], ""), (None, [("a", 1), ("b", None)], "P"),
    ]
    df = spark.createDataFrame([(k, base, e) for k, (e, *_) in enumerate(cases)] + [(99, None, {"line_items.0.product_text": "n"})], f"k int, o {evaluation.ORDER}, e map<string,string>")
    got = {r.k: r.x for r in df.select("k", flow.apply_edits(F.col("o"), F.col("e")).alias("x")).collect()}
    for k, (_, lines, po) in enumerate(cases):
        assert [(x.product_text, x.quantity) for x in got[k].line_items] == lines and got[k].customer_po_text == po
    assert [x.product_text for x in got[99].line_items] == ["n"] and got[99].customer_po_text is None
    m = spark.range(1).select(flow.missing_after(F.from_json(F.lit(json.dumps(order([]))), evaluation.ORDER)).alias("m")).first().m
    assert m == ["customer_po_text", "delivery_address_text", "line_items"]


def test_a_failed_amendment_keeps_the_receipt(spark):
    log = [("a", 1, "edited", "e1", False, True), ("a", 2, "approved", "", False, True), ("a", 3, "approved", "", False, True), ("a", 4, "edited", "e2", False, True), ("a", 5, "approved", "", False, False), ("b", 1, "approved", "", True, True), ("c", 1, "approved", "e", False, False), ("c", 2, "approved", "f", False, True)]
    df = spark.createDataFrame([(*x, f"R{x[1]}") for x in log], "item string, at int, action string, edits string, missing boolean, fits boolean, receipt string")
    got = {r["item"]: r for r in flow.approve_flow(df, "item", "at", "at").collect()}
    assert (got["a"].order_id, got["a"].for_edits, got["a"].edits, got["a"].sent, got["a"].status) == ("R2", "e1", "e2", 1, "approved")
    assert (got["b"].status, got["b"].refused) == ("pending", 1) and (got["c"].order_id, got["c"].amends, got["c"].sent) == ("R2", None, 1)


def test_close_pairs_lose_nothing(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abc ") for _ in range(rng.randint(0, 14))) for _ in range(160)]
    left, right = words[:80], words[80:] + [w[:-1] + "b" for w in words[:40] if w] + [""]
    for floor in (60.0, 75.0, 80.0, 95.0):
        got = {(r.a, r.b) for r in align.close_pairs(spark.createDataFrame([(w,) for w in left], "a string"), spark.createDataFrame([(w,) for w in right], "b string"), floor).collect()}
        assert {(a, b) for a in left for b in right if align.indel_ratio(a, b) >= floor} <= got


def test_resolve_of_text_targets(spark):
    d = spark.createDataFrame([("cold plate", "S-2", 0), ("cold  Plate", "S-1", 1), ("hot anvils", "S-9", 2), ("hot anvilx", "S-3", 3)], "name string, sku string, place int")
    m = spark.createDataFrame([("COLD plate",), ("hot anvil",), ("zz",)], "m string")
    assert {r.mention: (r.target, r.method) for r in align.resolve(m, "m", d, "name", "sku", place="place").collect()} == {"COLD plate": ("S-1", "name_exact"), "hot anvil": ("S-9", "fuzzy"), "zz": (None, "unresolved")}
    assert {r.mention: r.target for r in align.resolve(m, "m", d, "name", "sku").collect()} == {"COLD plate": "S-2", "hot anvil": "S-3", "zz": None}


def test_interpolation_searches_many_knots(spark):
    rng = random.Random(1)
    xs = sorted(rng.random() for _ in range(2004))
    knots = [(x, x * x) for x in xs]
    points = [-1.0, 2.0, xs[0], xs[-1], xs[7], *(rng.random() for _ in range(200))]
    got = [r.y for r in spark.createDataFrame([(k, p) for k, p in enumerate(points)], "k int, p double").select("k", scoring.interpolate(F.col("p"), knots).alias("y")).orderBy("k").collect()]
    import numpy as np

    assert np.allclose(got, np.interp(points, xs, [y for _, y in knots]))


def test_folding(spark):
    texts = ["Straße  GROSS", "plain TEXT", "İx", None, ""]
    got = [r.v for r in spark.createDataFrame([(k, v) for k, v in enumerate(texts)], "k int, s string").orderBy("k").select(C.norm_folded(F.col("s")).alias("v")).collect()]
    assert got[:2] == ["strasse gross", "plain text"] and got[3:] == [None, ""]


def test_dimension_files(spark, tmp_path):
    products = [{"sku": "ABC-X1-001", "name": "Tape", "category": "tape", "aliases": ["sticky"], "unit": "box", "pack_size": None, "moq": 1, "max_qty": 9, "unit_price_cents": 120, "active": True}, {"sku": "ABC-X1-001", "name": "Sticky", "category": "tape", "aliases": [], "unit": "crate", "moq": 5, "max_qty": 2, "unit_price_cents": 1, "active": False}]
    (tmp_path / "c.json").write_text(json.dumps({"version": 1, "company": "x", "units": {"box": ["boxes"]}, "products": products}, indent=1))
    p, u = dims.catalogue(spark, str(tmp_path / "c.json"))
    assert [r.place for r in p.orderBy("place").collect()] == [0, 1] and [(r.unit, r.aliases) for r in u.collect()] == [("box", ["boxes"])]
    assert sorted(map(tuple, dims.product_problems(p, u).collect())) == [("ABC-X1-001", "range"), ("ABC-X1-001", "sku repeated"), ("ABC-X1-001", "unit"), ("sticky", "term repeated")]
    assert dims.active_products(p).count() == 1 and dims.active_products(p, ["tape"]).count() == 0
    customer = {"customer_id": "C1", "company": "x", "domains": ["a.example"], "contacts": [{"name": "n", "email": "b@a.example", "role": "buyer", "phone": "+61412345678"}], "delivery_addresses": [{"label": "l", "line1": "1", "suburb": "s", "state": "NSW", "postcode": "2000"}], "po_template": "PO-##", "style": {"tone": "terse", "signoff": "x"}}
    (tmp_path / "b.json").write_text(json.dumps({"version": 1, "customers": [customer]}))
    b = dims.customer_book(spark, str(tmp_path / "b.json"))
    assert dims.customer_problems(b).count() == 0
    mail = spark.createDataFrame([("b@a.example",), ("z@a.example",), ("q@q.example",), (None,)], "s string")
    assert {r.s: (r.sender_customer, r.role) for r in dims.sender_role(mail, "s", b).collect()} == {"b@a.example": ("C1", "buyer"), "z@a.example": ("C1", None), "q@q.example": (None, None), None: (None, None)}


def test_frozen_files(spark, tmp_path):
    df = spark.createDataFrame([(1, {"b": 1, "a": [{"z": None, "y": "é"}]})], "id int, o struct<b:int,a:array<struct<z:string,y:string>>>")
    line = frozen.canonical_lines(df).first().value
    assert line == '{"id":1,"o":{"a":[{"y":"é","z":null}],"b":1}}'
    assert spark.range(1).select(frozen.idempotent(F.lit(line), df.schema).alias("x"), frozen.idempotent(F.lit('{"o":null,"id":1}'), df.schema).alias("y")).first() == (True, False)
    path = str(tmp_path / "f")
    assert [frozen.freeze(df, path), frozen.freeze(df.repartition(3), path)] == ["frozen", "intact"]
    other = df.withColumn("id", F.lit(2))
    with pytest.raises(ValueError, match="other lines"):
        frozen.freeze(other, path)
    with pytest.raises(ValueError, match="entry"):
        frozen.freeze(other, path, True, "x", "log")
    assert frozen.freeze(other, path, True, "fix 1", "# fix 1: why") == "refrozen" and spark.read.json(path).first().id == 2
    (tmp_path / "one.jsonl").write_text('{"id": 1}\n{"id": 2}\n')
    digest = frozen.file_digest(spark, str(tmp_path / "one.jsonl"))
    (tmp_path / "m.json").write_text(json.dumps({"splits": {"test": {"sha256": digest}, "val": {"sha256": "0"}}}))
    read = lambda split: frozen.frozen_jsonl(spark, str(tmp_path / "one.jsonl"), "id int", str(tmp_path / "m.json"), split)
    assert read("test").count() == 2 and frozen.load_source(spark, {"synthetic": (str(tmp_path / "one.jsonl"), digest)}, "synthetic", "id int")[1] == digest
    for bad in (lambda: read("val"), lambda: frozen.load_source(spark, {}, "human", "id int")):
        with pytest.raises(ValueError):
            bad()
    assert frozen.report_value(spark, str(tmp_path / "m.json"), "splits.val.sha256") == 0 and frozen.report_value(spark, str(tmp_path / "m.json"), "none.f1") is None
    m = frozen.content_manifest(spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 3)], "split string, kind string, v int"), "split", "kind").collect()
    assert {r.split: (r.n, r.counts) for r in m} == {"a": (2, {"x": 1, "y": 1}), "b": (1, {"x": 1})} and len({r.digest for r in m}) == 2


def test_caches_and_runs(spark, tmp_path):
    replies = spark.createDataFrame([(1, "h", "m", "p"), (1, "h", "m", "p"), (2, "h", "m", "q")], "id int, hash string, model string, payload string")
    cache = str(tmp_path / "cache")
    for _ in range(2):
        frozen.put_replies(replies, cache, "model")
    assert spark.read.parquet(cache).count() == 2
    frozen.write_run(replies.select("id", "payload"), replies.select("id", "hash"), str(tmp_path), "r1")
    assert spark.read.json(str(tmp_path / "r1/sidecar")).columns == ["hash", "id"]
    orders = spark.createDataFrame([("PO-1", 5), ("PO-2", 6), ("PO-1", 5)], "po string, cents int")
    for _ in range(2):
        receipts = frozen.append_orders(orders, str(tmp_path / "erp"))
    assert spark.read.json(str(tmp_path / "erp")).count() == 2 and receipts.select("order_id").distinct().count() == 2
    frozen.save_knots(spark.createDataFrame([(0.5, 0.7), (0.1, 0.0)], "x double, y double"), str(tmp_path / "k"))
    assert [tuple(r) for r in frozen.load_knots(spark, str(tmp_path / "k")).orderBy("x").collect()] == [(0.1, 0.0), (0.5, 0.7)]
    texts = ['{"label": "new_order"}', "new_order", '{"label": 3}', '{"other": "x"}', '["label"]', "{", None]
    got = [r.v for r in spark.createDataFrame([(k, v) for k, v in enumerate(texts)], "k int, s string").orderBy("k").select(frozen.unwrapped_label(F.col("s")).alias("v")).collect()]
    assert got == ["new_order", *texts[1:]]
    parsed = spark.createDataFrame([(1, None), (2, "bad")], "id int, error string")
    good, bad = frozen.dead_letters(parsed, "error")
    assert (good.count(), bad.count()) == (1, 1) and frozen.dead_letters(parsed.limit(0), "error")[0].count() == 0
    with pytest.raises(ValueError):
        frozen.dead_letters(parsed.where("id = 2"), "error")


def test_scenario_texts(spark):
    row = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert row(corpus.due_date(F.lit("2026-06-30"), F.lit(" In a Week"))) == "7 July" and row(corpus.due_date(F.lit("2026-06-30"), F.lit("soon"))) is None
    assert row(corpus.rendered_line(F.lit(None).cast("int"), F.lit("box"), F.lit("tape"), F.lit(None).cast("long"))) == "box of tape"
    assert len(row(corpus.expanded_po(F.lit("A#-##"), F.lit(4)))) == 5 and row(corpus.corrupted_price(F.lit(1), F.lit(0))) != 1


def test_case_folding_of_every_character(spark):
    """Two characters fold alike exactly where full case folding makes them equal; nulls stay."""
    from collections import defaultdict

    from docket.functions import columns as C

    known = [chr(c) for c in range(1, 0x20000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn"]
    found = spark.createDataFrame([(c,) for c in known], "c string").select("c", C.folded(F.col("c")).alias("f")).collect()
    ours, full = defaultdict(set), defaultdict(set)
    for r in found:
        ours[r.f].add(r.c)
        full[r.c.casefold()].add(r.c)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, full.values()))
    pairs = [("Hauptstraße 5", " HAUPTSTRASSE  5", True), ("ΣΟΦΌΣ", "σοφός", True), ("ﬁne", "FINE", True), ("ı", "I", False), ("a b", "ab", False), (None, "x", None)]
    rows = spark.createDataFrame([(a, b) for a, b, _ in pairs], "a string, b string").select((C.norm_equal(F.col("a")) == C.norm_equal(F.col("b"))).alias("same")).collect()
    assert [r.same for r in rows] == [same for *_, same in pairs]
