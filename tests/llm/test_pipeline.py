"""The pipeline against its stages computed one by one on the driver."""

from collections import defaultdict

import corpus_pipeline
import test_operators as brute
from docket.llm import decontaminate

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = {r.doc_id: r.text for r in now.collect()}
        now = stage(spark, now, SF)
        assert now.columns == docs.columns
        kept = {r.doc_id for r in now.collect()}
        assert kept <= set(rows)
        if name == "quality classifier":
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.doc_id in rows}
            assert sum((i in kept) == bool(q) for i, q in labels.items()) >= 0.9 * len(labels)
        if name == "exact dedup":
            last = defaultdict(int)
            for i, t in rows.items():
                last[t or ""] = max(last[t or ""], i)
            assert kept == set(last.values())
        if name == "SimHash near-dedup":
            assert kept == set(brute.brute_components({i: brute.brute_fingerprint(t) for i, t in rows.items()}).values())
        if name == "benchmark decontamination":
            index = decontaminate.Index(list(enumerate(items)), 0.8, 5)
            grams = [index.items[k][1] for k in range(len(items))]
            for i, t in rows.items():
                w = decontaminate.words(t or "")
                own = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
                assert (i in kept) == all(len(g & own) < 0.8 * len(g) for g in grams)
    final = {r.doc_id: r.text for r in now.collect()}
    pieces = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in pieces} == set(final)
    tokens = defaultdict(int)
    for r in pieces:
        tokens[r.doc_id] += r.length
    assert all(tokens[i] == len(brute.brute_ids(t)) for i, t in final.items())


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Null and repeated ids, null, empty and long texts, a column of a name used inside; and no documents at all."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, h string"
    long = " ".join(f"word{k % 9973} and" for k in range(20_000)) + "."
    prose = "The harbour was quiet in the morning and the boats came back before noon with what they had caught."
    rows = [(1, None), (2, ""), (None, prose), (3, prose), (3, prose + " Twice."), (4, long), (5, long), (6, prose.replace("quiet", "calm"))]
    for name, some in (("odd", rows), ("none", [])):
        (tmp_path / name).mkdir()
        spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x") for i, t in some], schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        for table in ("labels", "benchmark"):
            spark.read.parquet(f"{SF}/{table}.parquet").write.parquet(f"{tmp_path}/{name}/{table}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
    now = spark.read.parquet(f"{tmp_path}/odd/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, now = now, stage(spark, now, f"{tmp_path}/odd")
        assert now.columns == before.columns
    kept = sorted(((r.doc_id is None, r.doc_id or 0, r.text or "") for r in now.collect()))
    assert len([k for k in kept if k[2] == long]) <= 1
    got = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    ids = {}
    for r in got:
        ids[r.doc_id] = ids.get(r.doc_id, 0) + r.length
    want = {}
    for null, i, text in kept:
        key = None if null else i
        want[key] = want.get(key, 0) + len(brute.brute_ids(text))
    assert ids == want
