"""Language-model scores: counts against a plain version, a distribution that sums to one, better than word counts on held-out texts."""

import math
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest

from docket.llm import maxent
from test_operators import frame, odd_rows  # noqa: F401

SF = "/root/testdata/sf0.01"


def tokens_of(text):
    return [*(text or "").encode().lower().split(), b""]


def out_of(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 7 == 2


def brute_base(rows):
    counts = Counter(w for i, t in rows if not out_of(i) for w in tokens_of(t))
    n, v = sum(counts.values()), len(counts)
    return [(i, out_of(i), len(w), sum(counts[x] > 0 for x in w), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)) for i, t in rows for w in [tokens_of(t)]]


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("block_tokens", [50, 1 << 18])
def test_base_and_odd_rows(spark, odd_rows, block_tokens):  # noqa: F811
    rows = [*odd_rows, (None, "alpha beta"), (-3, "Ünïcode ÀB AB\x85c\x1cd"), (21, "a\x0bb\x0cc\r\nd")]
    got = maxent.language_scores(frame(spark, rows).repartition(3), block_tokens=block_tokens).collect()
    same([tuple(r)[:6] for r in got], brute_base(rows))
    assert all(math.isfinite(r.score) and r.score <= 1e-9 for r in got)


def test_no_rows_and_nothing_to_learn_from(spark):
    assert maxent.language_scores(frame(spark, [])).collect() == []
    rows = [(i, "a b") for i in range(60) if out_of(i)][:3]
    assert rows
    got = maxent.language_scores(frame(spark, rows)).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got] == [(3, 0, 0, 0.0)] * 3
    assert all(abs(r.score) < 1e-9 for r in got)


def test_distribution_sums_to_one():
    """Over every word of a vocabulary and the unknown one: within each class, and over classes for any weights."""
    rng = np.random.default_rng(3)
    n = np.concatenate([[900, 400, 400, 77], rng.integers(1, 30, 500)])
    topic = rng.integers(0, 5, len(n))
    masses = Counter()
    for c, t in zip(n, topic):
        masses[int(t), int(maxent.bins(np.array([c]))[0])] += np.array([1, c])
    masses[5, int(maxent.bins(np.array([50]))[0])] += np.array([1, 50])
    classes = maxent.Classes([(t, b, int(w), int(m)) for (t, b), (w, m) in masses.items()], 4, 5)
    assert (classes.tokens, classes.vocabulary) == (n.sum() + 50, len(n) + 1)
    cls, within = classes.of(np.concatenate([n, [0, 50]]), np.concatenate([topic, [0, 5]]))
    sums = np.bincount(cls, 10.0**within, minlength=classes.size)
    assert np.allclose(sums, 1)
    weights = rng.normal(size=(64, classes.size)).astype(np.float32)
    f = maxent.features(cls.astype("<u2"), (cls * 7).astype("<u2"), np.array([len(cls)]), classes.size, 64)
    p = np.exp(maxent._logits(weights, classes.bias, f))
    assert np.allclose((p / p.sum(1, keepdims=True)).sum(1), 1)


def test_features_do_not_cross_texts():
    cls, words = np.arange(9, dtype="<u2"), np.arange(10, 19, dtype="<u2")
    both = maxent.features(cls, words, np.array([4, 5]), 20, 1 << 14)
    assert (both[:, 4:] == maxent.features(cls[4:], words[4:], np.array([5]), 20, 1 << 14)).all()
    assert (maxent.features(cls, words, np.array([9]), 20, 1 << 14)[:, 4:6] != both[:, 4:6]).any()


def test_better_than_word_counts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = maxent.language_scores(docs).collect()
    same([tuple(r)[:6] for r in got], brute_base(rows))
    unseen = [r for r in got if r.held_out]
    gain = sum(r.score - r.base_score for r in unseen) / sum(r.n_tokens for r in unseen)
    assert gain > 0.3
    trained = [r for r in got if not r.held_out]
    assert sum(r.score - r.base_score for r in trained) / sum(r.n_tokens for r in trained) > 0.2
    flat = maxent.language_scores(docs, rounds=0).where("held_out").agg({"score": "sum"}).first()[0]
    assert sum(r.score for r in unseen) > flat  # the trained weights help beyond classes


def test_pairs_near_each_other(spark):
    rows = [(1, "x a y b b"), (3, "a q q q q b"), (4, "b a")]
    rows = [(i, t) for i, t in rows if not out_of(i)]
    blocks = maxent.text_blocks(frame(spark, rows), 1 << 18, "doc_id", "text")
    got = maxent.near_pairs(blocks, [b"a", b"b"], 3)
    want = np.zeros((2, 2))
    for _, t in rows:
        w = t.split()
        for p in range(len(w)):
            for q in range(p + 1, min(len(w), p + 4)):
                if {w[p], w[q]} <= {"a", "b"}:
                    i, j = "ab".index(w[p]), "ab".index(w[q])
                    want[i, j] += 1
                    want[j, i] += 1
    assert (got == want).all()


def test_blocks_lie_in_small_row_groups(spark, monkeypatch):
    """A reader holds the rows of a row group at once, so a task's memory would grow with the blocks in its files."""
    rows, at, write = [(i, f"a b{i} c{i % 7}") for i in range(40)], {}, maxent.written_at

    def kept(df, name, *more):
        table, at[name] = write(df, name, *more)
        return table, at[name]

    monkeypatch.setattr(maxent, "written_at", kept)
    monkeypatch.setattr(maxent, "removed", lambda *_: None)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = maxent.language_scores(frame(spark, rows).coalesce(1), block_tokens=1).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    same([tuple(r)[:6] for r in got], brute_base(rows))
    for name in ("blocks", "numbered"):
        files = [pq.ParquetFile(f).metadata for f in Path(at[name].removeprefix("file:")).glob("*.parquet")]
        groups = [m.row_group(k).num_rows for m in files for k in range(m.num_row_groups)]
        assert sum(groups) == len(rows)
        assert max(groups) <= 4, name


def test_blocks_of_long_words_have_fewer_tokens(spark):
    """So that a block's bytes are bounded as its tokens are."""
    rows = [(i, f"{i}".rjust(1000, "x")) for i in range(20)]
    assert maxent.text_blocks(frame(spark, rows).coalesce(1), 50, "doc_id", "text").count() == len(rows)
    same([tuple(r)[:6] for r in maxent.language_scores(frame(spark, rows), block_tokens=50).collect()], brute_base(rows))
