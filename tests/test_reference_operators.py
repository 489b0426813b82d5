"""Operators that SQL cannot check, against brute force or by hand."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docket.functions import columns as C
from docket.operators import align, auditing, orders, scoring
from docket.sources import files, frozen, mail
from docket.streaming import windows


def test_assignment_is_the_best():
    rng = random.Random(1)
    for _ in range(80):
        n, m = rng.randint(1, 5), rng.randint(1, 5)
        w = [[rng.choice([0, 0, 1, 2, 3]) for _ in range(m)] for _ in range(n)]
        pairs = align.assign(w)
        assert sum(w[i][j] for i, j in pairs) == align.brute_assign(w)
        assert len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs) and all(w[i][j] > 0 for i, j in pairs)
    assert align.assign([[3, 3], [3, 3]]) == [(0, 0), (1, 1)]
    for n, m in [(1, 1), (2, 3), (3, 3), (4, 8), (8, 8), (5, 6)]:  # all records of a shape at once, ties as one by one
        many = np.array([[[rng.choice([0, 1, 3, 4]) for _ in range(m)] for _ in range(n)] for _ in range(40)], float)
        for w, columns in zip(many, align.assign_all(many)):
            assert [(i, int(j)) for i, j in enumerate(columns) if j >= 0] == align.assign(w.tolist())
    assert align.assign([]) == [] and len(align.assign([[1.0] * 12 for _ in range(10)])) == 10


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for k, y in enumerate(b, 1):
            before, row[k] = row[k], before + 1 if x == y else max(row[k], row[k - 1])
    return row[-1]


def test_indel_ratio():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcd ") for _ in range(rng.randint(0, 12))) for _ in range(2))
        assert align.indel_ratio(a, b) == pytest.approx(100.0 if not a and not b else 200 * lcs(a, b) / (len(a) + len(b)))


def test_resolve(spark):
    d = spark.createDataFrame([("cold plate", 1), ("Cold  Plate", 4), ("hot anvil", 2), ("steel ring", 3)], "name string, id long")
    m = spark.createDataFrame([("COLD plate",), ("plate cold",), ("hot anvl",), ("zzz",), (None,), ("",)], "m string")
    got = {r.mention: (r.target, r.method) for r in align.resolve(m, "m", d, "name", "id").collect()}
    assert got == {"COLD plate": (4, "name_exact"), "plate cold": (4, "fuzzy"), "hot anvl": (2, "fuzzy"), "zzz": (None, "unresolved"), "": (None, "unresolved"), None: (None, "unresolved")}
    d = spark.createDataFrame([("cold plate", 1, False), ("chiller", 1, True), ("chiller", 0, False)], "name string, id long, alias boolean")
    m = spark.createDataFrame([("Cold plate",), ("CHILLER",)], "m string")
    assert {r.mention: (r.target, r.method) for r in align.resolve(m, "m", d, "name", "id", alias="alias").collect()} == {"Cold plate": (1, "name_exact"), "CHILLER": (1, "alias_exact")}


def test_text_columns(spark):
    row = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert row(C.norm_text(F.lit("  A  b\n\tC "))) == "a b c"
    assert row(C.normalize_label(F.lit(' "New_Order." '))) == "new_order" and row(C.normalize_label(F.lit(" '' "))) is None
    assert row(C.repair_json(F.lit('Sure: ```json\n{"a": 1}\n``` ok'))) == '{"a": 1}' and row(C.repair_json(F.lit('x {"a":{}} y'))) == '{"a":{}}' and row(C.repair_json(F.lit(" none "))) is None
    assert row(C.clean_body(F.lit("Hi\n\n\n\nthere\n> q\n\nOn Mon, A wrote:\n> old\n"))) == "Hi\n\nthere"
    assert row(C.clean_body(F.lit("Body\n-- \nme"))) == "Body" and row(C.clean_body(F.lit(""))) == ""
    assert row(C.slug(F.lit("Ab C--d!/x"))) == "Ab-C--d-x" and row(F.lit("PO-12").rlike(row(C.po_pattern(F.lit("PO-##")))))
    assert [tuple(x) for x in row(C.note_tags(F.lit("see quirk: typo, and protocol:")))] == [("quirk:", "typo"), ("protocol:", None)]
    assert row(C.normalize_label(F.lit("\t' x. ' "))) == "x"
    assert row(C.is_inquiry(F.lit("What's the lead time?"))) and not row(C.is_inquiry(F.lit("Please send ten.")))
    assert row(C.ratio(F.lit(1), F.lit(0))) == 0.0


def test_line_edits(spark):
    df = spark.createDataFrame([([("a", "1"), ("b", "2")],)], "lines array<struct<product:string,quantity:string>>")
    edits = lambda d: F.create_map(*(F.lit(x) for kv in d.items() for x in kv)) if d else F.lit(None).cast("map<string,string>")
    run = lambda d: [tuple(x) for x in df.select(orders.apply_line_edits(F.col("lines"), edits(d), ["product", "quantity"]).alias("v")).first().v]
    assert run({}) == [("a", "1"), ("b", "2")]
    assert run({"line_items.0.quantity": "9", "line_items.2.product": "c"}) == [("a", "9"), ("b", "2"), ("c", None)]
    assert run({"line_items.1": "delete", "line_items.9": "delete"}) == [("a", "1")]
    assert run({"line_items.0.product": ""}) == [(None, "1"), ("b", "2")]


def test_interpolation_and_isotonic(spark):
    pairs = spark.createDataFrame([(0.1, 0), (0.2, 0), (0.4, 1), (0.6, 0), (0.9, 1), (0.9, 1)], "c double, ok int")
    knots = scoring.isotonic_knots(pairs, "c", "ok")
    ys = [r.v for r in spark.createDataFrame([(x / 20,) for x in range(21)], "x double").orderBy("x").select(scoring.interpolate(F.col("x"), knots).alias("v")).collect()]
    assert ys == sorted(ys) and ys[0] == 0.0 and ys[-1] == 1.0


def test_review_state(spark):
    log = spark.createDataFrame([("i", 1, "edited", "e1"), ("i", 2, "approved", None), ("j", 1, "edited", "e"), ("j", 2, "rejected", None), ("k", 1, "edited", "")], "item string, at long, action string, edits string")
    got = {r["item"]: (r.status, r.edits) for r in orders.latest_decision(log.withColumn("id", F.col("at")), "item", "at", "id").collect()}
    assert got == {"i": ("approved", "e1"), "j": ("rejected", None), "k": ("approved", None)}


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "é"), (2, None)], "id long, body string")
    files.canonical_jsonl(df, str(tmp_path / "x"))
    digest, n = files.pin(spark.read.text(str(tmp_path / "x")))
    assert n == 2 and files.pinned_jsonl(spark, str(tmp_path / "x"), df.schema, digest, 2).count() == 2
    with pytest.raises(ValueError):
        files.pinned_jsonl(spark, str(tmp_path / "x"), df.schema, "0", 2)
    raw = spark.createDataFrame([(1, '{"a":1}'), (2, "nope"), (3, '{"a":1,"b":2}'), (4, ""), (1, '{"a":2}')], "id long, payload string")
    good, bad = files.checked_predictions(raw, spark.createDataFrame([(1,), (2,), (3,), (4,), (9,)], "id long"), "a int")
    assert good.count() == 2
    assert {(r.id, r.problem) for r in bad.collect()} == {(2, "unparsed"), (3, "unparsed"), (4, "blank"), (1, "duplicate"), (9, "missing")}
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.eml").write_text("From: a@b.c\nSubject: Re: x\n\nShort\n")
    (tmp_path / "m" / "b.txt").write_text("no")
    got = mail.standardized(files.whole_messages(spark, str(tmp_path / "m"))).collect()
    assert len(got) == 1 and got[0].body == "Short" and got[0].is_reply and got[0].asks == ["short_reply"]


def test_stream_equals_batch(spark):
    sf = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{sf}/events.parquet")
    batch = {(r.user_id, r.window_start): r.used for r in events.groupBy("user_id", (F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600) * 3600).alias("window_start")).agg(F.count("*").alias("used")).collect()}
    out = windows.drain(windows.window_counts(windows.event_stream(spark, sf), "user_id", "1 hour"), "complete")
    assert {(r.user_id, r.window_start): r.used for r in out.collect()} == batch
    once = windows.drain(windows.once_per_message(windows.event_stream(spark, sf), "event_id"), "append")
    assert once.count() == events.select("event_id").distinct().count()


def test_bootstrap_of_a_thousand_replicates(spark):
    import numpy as np

    rows = [(i, i % 3, int(i % 7 == 0), int(i % 5 == 0)) for i in range(600)]
    one = scoring.bootstrap_counts(spark.createDataFrame(rows, "id long, tp long, fp long, fn long"), "tp", "fp", "fn").first()
    again = scoring.bootstrap_counts(spark.createDataFrame(rows[::-1], "id long, tp long, fp long, fn long").repartition(5), "tp", "fp", "fn").first()
    x, rng = np.array(rows)[:, 1:], np.random.default_rng(1)
    f1 = [2 * tp / (2 * tp + fp + fn) for tp, fp, fn in (x[rng.integers(0, 600, 600)].sum(0) for _ in range(4000))]
    assert one == again and one.replicates == 1000
    assert np.allclose([one.low, one.high], np.quantile(f1, [0.025, 0.975]), atol=0.003)
    pairs = [(i, "ab"[i % 2], "ab"[i % 2] if i % 10 else "a") for i in range(600)] + [(k, "c", None) for k in range(5)]
    c = scoring.bootstrap_confusion(spark.createDataFrame(pairs, "id long, gold string, pred string"), "gold", "pred").first()
    right, rng = np.array([g == p for _, g, p in pairs]), np.random.default_rng(2)
    accuracy = [right[rng.integers(0, len(right), len(right))].mean() for _ in range(4000)]
    assert c.replicates == 1000 and np.allclose([c.accuracy_low, c.accuracy_high], np.quantile(accuracy, [0.025, 0.975]), atol=0.004)


def test_streams_are_drained_into_the_shared_folder(spark, tmp_path):
    for k, values in enumerate(([1, 1, 2], [2, 3])):
        spark.createDataFrame([(v, 10 * k + v) for v in values], "key long, v long").coalesce(1).write.parquet(str(tmp_path / f"in/part{k}"))
    stream = spark.readStream.schema("key long, v long").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    counts = stream.groupBy("key").agg(F.count("*").alias("n"))
    for mode in ("update", "complete"):
        out = windows.drain(counts, mode, ["key"])
        assert sorted(map(tuple, out.collect())) == [(1, 2), (2, 2), (3, 1)]
        assert out.inputFiles() and all(f.startswith("file:") for f in out.inputFiles())
    assert sorted(r.v for r in windows.drain(stream, "append").collect()) == [1, 1, 2, 12, 13]


def test_sampling_and_messages(spark):
    df = spark.range(500).withColumnRenamed("id", "doc_id")
    sets = orders.nested_prefixes(df, "doc_id", 3, [5, 50]).groupBy("size").agg(F.collect_set("doc_id").alias("s")).collect()
    s = {r["size"]: set(r.s) for r in sets}
    assert len(s[5]) == 5 and len(s[50]) == 50 and s[5] < s[50]
    parts = df.select(orders.split_of(F.col("doc_id"), 1, {"a": 70, "b": 30}).alias("p")).groupBy("p").count().collect()
    assert sum(r["count"] for r in parts) == 500 and {r.p for r in parts} == {"a", "b"}
    m = spark.range(1).select(orders.sft_messages("sys", F.lit("S"), F.lit("B"), F.lit("{}")).alias("m")).first().m
    assert [(x.role, x.content) for x in m] == [("system", "sys"), ("user", "Subject: S\n\nB"), ("assistant", "{}")]
    table = scoring.sliced(df, {"even": F.col("doc_id") % 2 == 0, "small": F.col("doc_id") < 10}).groupBy("slice").count().collect()
    assert {r["slice"]: r["count"] for r in table} == {"even": 250, "small": 10}


def test_slot_counts_equal_counted_outcomes(spark):
    rows = [(1, "Box", " box", 5, 5), (1, "box", "box", 5, 6), (2, "a  b", "A b", None, 7), (2, None, None, None, None), (2, "x", None, 1, None), (None, None, "y", 2, 2)]
    df = spark.createDataFrame(rows, "r long, gold_unit string, pred_unit string, gold_n long, pred_n long")
    sums = [F.sum(n).alias(n) for n in scoring.OUTCOMES]
    for some in (df, df.limit(0)):
        slots, same = scoring.slot_outcomes(some, ["unit", "n"], ["r"]), lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
        assert same(slots.groupBy("r", "field").agg(*sums), scoring.slot_counts(some, ["unit", "n"], ["r"]))
        assert same(slots.groupBy("field").agg(*sums), scoring.slot_counts(some, ["unit", "n"]))
        assert same(slots.groupBy("r").agg(*sums), scoring.slot_totals(some, ["unit", "n"], ["r"]))
        assert same(slots.agg(*sums), scoring.slot_totals(some, ["unit", "n"]))
    unit = scoring.slot_counts(df, ["unit"]).first()
    assert (unit.correct, unit.strict_correct, unit.wrong, unit.hallucination, unit.miss, unit.null_agree) == (3, 1, 0, 1, 1, 1)


def test_item_semantics_by_hand(spark):
    schema = "r long, q long, u string, at long, item string"
    gold = spark.createDataFrame([(1, 5, "box", 1, "a"), (1, 5, "box", 2, "b"), (1, 5, None, 3, "c"), (1, None, "box", 4, "d"), (2, 5, "box", 1, None)], schema)
    pred = spark.createDataFrame([(1, 5, "box", 1, "b"), (1, 5, None, 2, "c"), (1, None, "box", 4, "d"), (2, 5, "box", 9, None), (3, 5, "box", 1, "a")], schema)
    got = scoring.item_semantics(gold, pred, "r", "q", "u", "at", "item").collect()
    assert sorted((x.r, x.q, x.u or "", x.nth, x.product_same) for x in got) == [(1, 5, "", 1, True), (1, 5, "box", 1, False), (2, 5, "box", 1, True)]


def test_schema_keywords(spark):
    deep = '{"a":' * 200 + '{"minimum":1}' + "}" * 200
    cases = [('{"minimum":1,"x":[{"minLength":2,"y":3}]}', '{"x":[{"y":3}]}'), ('{"properties":{"minimum":{"minimum":0}}}', '{"properties":{"minimum":{}}}'), ('{"default":{"minimum":1}}', '{"default":{"minimum":1}}'), ("nope", None), (None, None), ("[1]", "[1]"), (deep, deep.replace('{"minimum":1}', "{}"))]
    got = spark.createDataFrame(cases, "s string, w string").select(C.stripped_schema(F.col("s")).alias("g"), "w").collect()
    assert [r.g for r in got] == [r.w for r in got]


def test_pairs_and_large_digest(spark, tmp_path):
    import hashlib

    (tmp_path / "p.jsonl").write_text('{"confidence": 0.5, "correct": true}\n{"confidence": 1.0, "correct": false}\n')
    assert [tuple(r) for r in files.pairs_jsonl(spark, str(tmp_path / "p.jsonl")).collect()] == [(0.5, True), (1.0, False)]
    (tmp_path / "q.jsonl").write_text('{"confidence": 0.5}\n')
    with pytest.raises(Exception, match="lacks"):
        files.pairs_jsonl(spark, str(tmp_path / "q.jsonl")).collect()
    block, n = bytes(range(256)) * 4096, 64
    with open(tmp_path / "big", "wb") as f:
        for _ in range(n):
            f.write(block)
    h = hashlib.sha256()
    for _ in range(n):
        h.update(block)
    assert frozen.file_digest(spark, str(tmp_path / "big")) == h.hexdigest()
    for missing in ("none", "*.jsonl"):
        with pytest.raises(ValueError, match="not one"):
            frozen.file_digest(spark, str(tmp_path / missing))


def test_audit_report(spark):
    records = spark.createDataFrame([(1, "en", 5), (2, "en", 50), (3, "de", 1)], "id long, email_class string, n int")
    told = lambda *rows: spark.createDataFrame(rows, "id long, realistic boolean, labels_correct boolean, notes string")
    strata = {"en": {"short": F.col("n") < 10, "none": F.lit(False)}}
    r = auditing.audit_report(records, told((1, False, True, "quirk: a|b"), (2, True, False, "protocol: x quirk:"), (3, True, True, None)), strata)
    rows = {n: sorted(tuple(x) for x in df.collect()) for n, df in r.items()}
    assert rows["classes"] == [("de", 1, 1), ("en", 1, 2)] and rows["strata"] == [("en/none", 0, 0), ("en/short", 1, 1)]
    assert rows["tags"] == [("quirk:", "a|b", 1), ("quirk:", "—", 1)] and rows["protocol"] == [(2, "protocol: x quirk:")] and rows["label_findings"] == [(2,)]
    assert [x.id for x in r["evidence"].collect()] == [1]
    text = auditing.markdown(r, most=1)
    assert "| quirk: | a\\|b | 1 |" in text and "More than 1 rows." in text and text.count("## ") == 6
    for bad in (told((1, None, True, "")), told((1, True, None, ""))):
        with pytest.raises(ValueError, match="not filled"):
            auditing.audit_report(records, bad, strata)
    with pytest.raises(Exception, match="no record 9"):
        auditing.audit_report(records, told((9, True, True, "")), strata)["classes"].collect()
