"""Every corpus operator against a brute-force version, and on nulls, empty and long texts, ties, repeats, no rows, odd columns."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
import xxhash

from docket.llm import decontaminate, exact_dedup, licences, mainpage, packing, pii, quality, rangecode, simhash, substrings, tokenfile, tokens
from docket.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, h string, t string, n long, fp long, item_id long, part int"
DATA = Path("/root/testdata/sf0.01")  # about 400 labelled documents, of which a fifth is held out


def frame(spark, rows):
    """Rows of (doc_id, text) with other columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", None, "x", None, 7, 3, 1, 2) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd_rows():
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "eps", "é", "ß", "naïve", "x1", "9"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long = prose(30_000)
    tie = prose(90)
    return [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, long), (6, long[:-1] + "!"), (7, tie), (8, tie), (8, tie), (9, "a  b\n\n c"), (10, "　\x85x\x1c"), (11, "\U0001f600 ok"), (12, "İ licence"), (13, tie + " more"), (14, "<|endoftext|> \0 nul")]


def test_exact_groups(spark, odd_rows):
    got = exact_dedup.exact_groups(frame(spark, odd_rows)).collect()
    groups = defaultdict(list)
    for i, t in odd_rows:
        groups[t or ""].append(i)
    want = Counter((i, max(groups[t or ""]), len(groups[t or ""]), i == max(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in odd_rows)
    assert Counter(tuple(r) for r in got) == want


def test_exact_groups_separate_texts_of_one_hash(spark):
    from pyspark.sql import functions as F

    rows = [(1, "ab"), (2, "cd"), (3, "ab"), (4, "xyz"), (5, "cd")]
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_groups(frame(spark, rows), content_hash=F.length, keep="min").collect()}
    assert got == {1: (1, 2), 3: (1, 2), 2: (2, 2), 5: (2, 2), 4: (4, 1)}


def test_drop_exact_copies_keeps_columns(spark, odd_rows):
    docs = frame(spark, odd_rows)
    out = exact_dedup.drop_exact_copies(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted([2, 3, 4, 5, 6, 8, 8, 9, 10, 11, 12, 13, 14])


def brute_ids(text):
    return [*tokens.encoder(tokens.default_vocabulary()).library.encode(text or "", add_special_tokens=False).ids, 0]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("window", [16, 1024])
def test_pack(spark, odd_rows, window):
    got = packing.pack(frame(spark, odd_rows), window=window).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert len(ids) == r.length
        pieces[r.doc_id].append((r.start, ids, r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, t in odd_rows:
        ids = brute_ids(t)
        own = sorted(pieces[i])
        if i == 8:
            own = own[::2]
        assert [x for _, p, _ in own for x in p] == ids and {n for *_, n in own} == {len(ids)}
    assert set(sequences) == set(range(len(sequences)))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= window
    padded = {r.padded_length for r in packing.with_padding(packing.pack(frame(spark, odd_rows), window=window), window).collect()}
    assert all(p == window or p & (p - 1) == 0 for p in padded)


def test_best_fit_is_best_fit_decreasing():
    rng = random.Random(1)
    for _ in range(60):
        counts = {rng.randint(1, 100): rng.randint(1, 30) for _ in range(rng.randint(1, 40))}
        left = []
        for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
            fit = min((k for k, r in enumerate(left) if r >= n), key=lambda k: left[k], default=None)
            if fit is None:
                left.append(100 - n)
            else:
                left[fit] -= n
        windows = defaultdict(int)
        for length, first, past, sequence, per, offset in packing.best_fit_rules(counts, 100):
            for k in range(past - first):
                windows[sequence + k // per] += length
                assert offset + (k % per + 1) * length <= 100
        assert sorted(100 - w for w in windows.values()) == sorted(left)


def test_tokens_are_the_librarys():
    texts = ["", " ", "\n", " a", "a ", "a\nb", "a\n\n b", "it's I'll,  12.3", "<|endoftext|>x", "a\0b c", "é　ß", "x" * 5000, "a\tb \x85 c"]
    encoder = tokens.encoder(tokens.default_vocabulary())
    for _ in range(2):
        assert encoder.encode(texts) == encoder.whole(texts)


def test_token_files(spark, odd_rows):
    path = tokenfile.write_token_files(frame(spark, odd_rows))
    got = sorted(tokenfile.read_token_files(spark, path).collect(), key=lambda r: r.start)
    at = 0
    for r, (i, t) in zip(got, sorted(odd_rows, key=lambda x: (x[0], x[1] or "")), strict=True):
        ids = brute_ids(t)
        assert (r.doc_id, r.start, r.n_tokens) == (i, at, len(ids))
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == ids
        at += len(ids)


def test_range_coder_round_trip_and_damage():
    rng = np.random.default_rng(2)
    blocks = [rng.integers(0, high, n).astype(np.uint32) for high, n in ((5, 4096), (50257, 4096), (65536, 77), (1, 4000), (300, 1))] + [np.zeros(0, np.uint32)]
    blocks.append(np.tile(np.arange(40, dtype=np.uint32), 100))
    packed = rangecode.encode_blocks(blocks)
    assert all(np.array_equal(a, b) for a, b in zip(blocks, rangecode.decode_blocks(packed), strict=True))
    assert len(packed[0]) < 4096 and len(packed[-1]) < 1000
    for k in range(len(blocks)):  # blocks do not depend on each other
        assert rangecode.encode_blocks([blocks[k]]) == [packed[k]]
    broken = bytearray(packed[0])
    broken[40] ^= 1
    with pytest.raises(ValueError, match="block 0"):
        rangecode.decode_blocks([bytes(broken)])
    with pytest.raises(ValueError):
        rangecode.decode_blocks([b"none"])


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[k : k + 3]), 42) for k in range(max(1, len(words) - 2))]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def brute_components(prints):
    ids, parent = sorted(prints), {i: i for i in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_near_duplicates(spark, odd_rows):
    rng = random.Random(8)
    base = [" ".join(f"w{rng.randint(0, 500)}" for _ in range(400)) for _ in range(12)]
    rows = list(dict.fromkeys(odd_rows)) + [(100 + 20 * b + k, t.replace(t.split()[rng.randrange(400)], "zz", 1) if k else t) for b, t in enumerate(base) for k in range(6)]
    prints = {i: brute_fingerprint(t) for i, t in rows}
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {r.doc_id: r.component_id for r in got} == brute_components(prints)
    kept = simhash.drop_near_copies(frame(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({*brute_components(prints).values()})


def test_links_join_all_fingerprints_within_the_distance(spark):
    rng = random.Random(5)
    seeds = [rng.getrandbits(64) for _ in range(60)]
    values = {s ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for s in seeds for _ in range(8)}
    signed = [int(np.array(v, np.uint64).view(np.int64)) for v in values]
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    want = brute_components(dict(zip(signed, values)))
    for chunk in (2048, 3):  # the smaller one splits signatures with many members
        got = {r.node: r.component for r in components(simhash.links(fps, 3, chunk=chunk)).collect()}
        mine = {v: got.get(v, v) for v in signed}
        assert len(set(mine.values())) == len(set(want.values()))
        assert all((mine[a] == mine[b]) == (want[a] == want[b]) for a in signed[:80] for b in signed)


def test_thresholds_follow_the_generalised_pigeonhole(spark):
    fps = spark.range(3000).selectExpr("xxhash64(id) fp")
    for distance in (1, 2, 3, 6):
        parts = simhash.plan(fps, distance)
        bits = [b for part, _ in parts for b in part]
        assert len(bits) == len(set(bits)) and all(t >= 0 for _, t in parts)
        assert sum(t + 1 for _, t in parts) == distance + 1


def test_components_of_long_paths(spark):
    edges = [(k, k + 1) for k in range(0, 300)] + [(1000, 999), (5000, 5000), (7, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(301)} | {999: 999, 1000: 999}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_contaminated(spark, odd_rows):
    item = "the quick brown fox jumps over the lazy dog and then rests under a tall green tree near the old river bank"
    words = item.split()
    changed = " ".join([*words[:20], "stream", words[21]])
    items = [(1, item), (2, "two words"), (3, None), (4, "?!"), (5, item)]
    rows = [*odd_rows, (50, f"{'lorem ipsum ' * 5000}. {item.upper()}! more"), (51, changed), (52, " ".join(words[:12])), (53, "x two, WORDS y"), (53, "x two, WORDS y")]
    got = Counter((r.doc_id, r.item_id, round(r.containment, 6)) for r in decontaminate.contaminated(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect())
    want = Counter()
    for d, t in rows:
        found = decontaminate.words(t or "")
        for i, it in items:
            w = decontaminate.words(it or "")
            if w:
                n = min(5, len(w))
                grams = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
                share = len(grams & {tuple(found[k : k + n]) for k in range(len(found) - n + 1)}) / len(grams)
                if share >= 0.8:
                    want[d, i, round(share, 6)] += 1
    assert got == want and {d for d, *_ in want} == {50, 51, 53}
    blocks = decontaminate.contaminated(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"), items_per_scan=1)
    assert Counter((r.doc_id, r.item_id, round(r.containment, 6)) for r in blocks.collect()) == want
    assert 50 not in {r.doc_id for r in decontaminate.drop_contaminated(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}


@pytest.mark.parametrize("scan", [1, 20_000])
def test_contaminated_by_items_of_null_and_repeated_ids(spark, scan):
    a, b, c, d = ("one two three four five six", "red green blue black white grey", "north south east west up down", "spring summer autumn winter day night")
    items = spark.createDataFrame([("0", a), ("0", b), (None, c), ("q7", d), ("0", a)], "item_id string, text string")
    docs = frame(spark, [(k, f"so {t} then") for k, t in enumerate((a, b, c, d, "no item at all is in here"))])
    got = sorted((r.doc_id, r.item_id, r.containment) for r in decontaminate.contaminated(docs, items, items_per_scan=scan).collect())
    assert got == [(0, 0, 1.0), (1, 0, 1.0), (2, None, 1.0), (3, None, 1.0)]
    assert [r.doc_id for r in decontaminate.drop_contaminated(docs, items, items_per_scan=scan).collect()] == [4]


def brute_repeats(rows, length):
    seen = Counter(raw[s : s + length] for _, t in rows for raw in [(t or "").encode()] for s in range(len(raw) - length + 1))
    out = Counter()
    for i, t in rows:
        raw = (t or "").encode()
        mask = np.zeros(len(raw) + 1, bool)
        for s in range(len(raw) - length + 1):
            if seen[raw[s : s + length]] > 1:
                mask[s : s + length] = True
        runs = int((mask[1:] & ~mask[:-1]).sum() + mask[0])
        out[i, len(raw), int(mask.sum()), runs, bytes(b for b, m in zip(raw, mask) if not m)] += 1
    return out


@pytest.mark.parametrize("options", [{}, {"most": 4}, {"chunk": 300}])
def test_remove_repeats(spark, odd_rows, options):
    rng = random.Random(6)
    words = ["ab", "cd", "e", "fgh", "é"]
    made = lambda n: "".join(rng.choice(words) for _ in range(n))
    shared = [made(rng.randint(5, 50)) for _ in range(9)]
    rows = [(i, "".join(rng.choice(shared) if rng.random() < 0.5 else made(rng.randint(1, 25)) for _ in range(rng.randint(0, 7)))) for i in range(90)]
    rows += [(900, None), (901, ""), (902, "a" * 200), (903, "ab" * 80), (904, "ab" * 80), (905, shared[0]), (905, shared[0]), *((2000 + i, t) for i, t in odd_rows if len(t or "") < 1000)]
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in substrings.remove_repeats(frame(spark, rows), length=24, k=8, **options).collect())
    assert got == brute_repeats(rows, 24)


@pytest.mark.parametrize("options", [{}, {"most": 1}])
def test_remove_repeats_across_borders_of_pieces(spark, options):
    rng = random.Random(9)
    made = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    shared = [made(rng.randint(24, 40)) for _ in range(12)]
    rows = [(i, "".join(x for s in rng.sample(shared, 6) for x in (made(rng.randint(3, 30)), s))) for i in range(12)]
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in substrings.remove_repeats(frame(spark, rows), length=24, k=8, piece=37, **options).collect())
    assert got == brute_repeats(rows, 24)


def test_colliding_hashes_remove_nothing(monkeypatch):
    """With a hash that calls everything equal, the byte comparison still decides."""
    monkeypatch.setattr(substrings.Occurrences, "_same", lambda self, x, y, n: np.ones(len(x), bool))
    o = substrings.Occurrences(np.zeros(2, np.int64), np.array([10, 10]), np.array([0, 0]), np.array([5, 5]), [b"abcdefghijklmnopqrstuvwxy", b"abcdefghijKlmnopqrstuvwxy"], 20)
    assert len(o.repeated()[0]) == 0


def test_pseudonyms(spark):
    text = "Mail jane.doe@example.org or JANE.DOE@EXAMPLE.ORG, call +1 (212) 555-0199 or 212-555-0199, card 4111 1111 1111 1111 = 4111-1111-1111-1111, not 4111111111111112, born 2001-02-28, 28.02.2001, never 2001-02-30, ssn 123-45-6789 at 10.20.30.40 not 300.1.1.1, key 0123456789abcdef0123456789abcdef."
    rows = [(1, text), (2, text), (3, None), (4, ""), (5, "nothing at all"), (5, "nothing at all"), (6, "x" * 200_000 + " 4111111111111111")]
    got = pii.pseudonymise(frame(spark, rows), "k").collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 7 and by[1].text == by[2].text and by[3].text == "" == by[4].text and by[5].text == "nothing at all"
    found = {f.value: f for f in by[1].found}
    assert "4111111111111112" in by[1].text and "2001-02-30" in by[1].text and "300.1.1.1" in by[1].text
    for value, f in found.items():
        assert value not in by[1].text and len(f.pseudonym) == len(value) or f.kind == "ip"
        assert [c.isdigit() for c in value] == [c.isdigit() for c in f.pseudonym] or f.kind in ("ip", "secret")
    card = found["4111 1111 1111 1111"].pseudonym
    assert card.replace(" ", "") == found["4111-1111-1111-1111"].pseudonym.replace("-", "") == by[6].text[-16:]
    digits = [int(c) for c in card if c.isdigit()][::-1]
    assert sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(digits)) % 10 == 0
    rebuilt = by[1].text
    for f in by[1].found:
        rebuilt = rebuilt.replace(f.pseudonym, f.value, 1)
    assert rebuilt == text
    other = pii.pseudonymise(frame(spark, rows[:1]), "another").first().text
    assert other != by[1].text


def test_pseudonyms_of_spaced_numbers(spark):
    card = "4111 1111 1111 1111"
    texts = {
        1: ("+49 30 12 34 56 78", [("phone", "+49 30 12 34 56 78")]), 2: ("call +33 12 34 56 78.", [("phone", "+33 12 34 56 78")]),
        3: ("41 11 11 11 11 11 11 11", [("card", "41 11 11 11 11 11 11 11")]), 4: (f"{card} 12/27", [("card", card)]),
        5: ("4111111111111111 123", [("card", "4111111111111111")]), 6: ("12 4111111111111111", [("card", "4111111111111111")]),
        7: (f"123456 {card} 99", [("card", card)]), 8: (f"{card} 3782-822463-10005", [("card", card), ("card", "3782-822463-10005")]),
        9: (f"{card} 2001-02-28 {card}", [("card", card), ("date", "2001-02-28"), ("card", card)]), 10: ("4111 1111 1111 1112 12", []),
        11: ("ab" * 16, [("secret", "ab" * 16)]), 12: ("1 " * 3000, None), 13: ("6304 0000 0000 0000 000", [("card", "6304 0000 0000 0000 000")]),
    }
    for r in pii.pseudonymise(frame(spark, [(i, t) for i, (t, _) in texts.items()]), "k").collect():
        text, want = texts[r.doc_id]
        assert want is None or [(f.kind, f.value) for f in r.found] == want, text
        rest = text
        for f in r.found:
            assert f.pseudonym != f.value
            rest = rest.replace(f.value, f.pseudonym, 1)
        assert want is None or (r.text == rest and r.n_found == len(want))


def test_pseudonyms_are_permutations(spark):
    from pyspark.sql import functions as F

    n = spark.range(400).select(pii.permute_number(F.col("id"), "x", "k", 20).alias("v"))
    assert sorted(r.v for r in n.collect()) == list(range(400))
    s = spark.range(1000).select(pii.permute_text(F.lpad(F.col("id").cast("string"), 3, "0"), "x", "k").alias("v"))
    assert sorted(r.v for r in s.collect()) == [f"{k:03d}" for k in range(1000)]


def test_licences(spark, odd_rows):
    model = licences.default_model()
    assert model.held_out_accuracy > 0.95
    for family, templates in licences.TEMPLATES.items():
        for text in templates:
            found = licences.find_licences(f"Some prose here.\n{text}\nAnd more of it.", model)
            assert family in {f[3] for f in found}, text
    for text in licences.DECOYS:
        assert not licences.find_licences(text, model), text
    rows = [*odd_rows, (60, "intro.\n\nReleased under the\nMIT License.\n" + "word " * 50_000)]
    got = {r.doc_id: r for r in licences.scan_licences(frame(spark, rows)).collect()}
    assert got[60].families == ["MIT"] and got[60].n_found == 1 and rows[-1][1][got[60].found[0].start : got[60].found[0].end] == "Released under the\nMIT License."
    assert all(got[i].n_found == 0 for i, _ in odd_rows)


def test_licences_skip_no_paragraph_that_would_be_confirmed():
    model = licences.default_model()
    for family, text in {"CC-BY-SA": "Content is available under CC-BY-SA-3.0.", "Public-domain": "This is free and unencumbered software released into the public\ndomain."}.items():
        assert [f[3] for f in licences.find_licences(text, model)] == [family]
    for words, _ in model.held_out:
        text = " ".join(words)
        found = [f[3] for f in licences.find_licences(text, model)]
        assert found == [f for f in [model.classify(text)[0]] if f != licences.UNKNOWN]
    for text in ("GPL-3.0-or-later", "MPL-2.0", "AGPL-3.0-only", "LGPL-2.1-only", "EPL-2.0"):
        assert [f[3] for f in licences.find_licences(text, model)] == [f for f in [model.classify(text)[0]] if f != licences.UNKNOWN]


def test_main_text_on_held_out_pages(spark):
    pages = mainpage.labelled_pages(150, seed=77)
    model = mainpage.default_model()
    assert sum(mainpage.main_text(h, model) == t for h, t in pages) >= 140
    rows = [(1, "u", None), (2, None, ""), (3, "u", "no tags at all"), (4, "u", "<p>&lt;a&gt; &amp;<article><p>x  y\n z<script>var a='</p>'</script>"), (4, "u", "<p>"), (5, "u", "<article><p>" + "word " * 100_000)]
    df = spark.createDataFrame([(*r, "en", 1, 2) for r in rows], "page_id long, url string, html string, text string, n_chars int, doc_id long")
    got = mainpage.extract_main(df).collect()
    assert len(got) == 6 and [r.text for r in got if r.page_id in (1, 2)] == ["", ""]
    assert all(r.n_chars == len(r.text) for r in got)
    assert max(r.n_chars for r in got) == 499_999


def test_viterbi_finds_the_best_labels():
    from itertools import product

    rng = random.Random(2)
    model = mainpage.ChainModel()
    model.weights = {f"f{k}": rng.uniform(-2, 2) for k in range(10)}
    model.step = np.array([[0.5, -1.0], [-0.3, 0.8]])
    for n in range(1, 8):
        rows = [[f"f{rng.randrange(10)}" for _ in range(2)] for _ in range(n)]
        value = lambda y: sum(model.weights[f] for x, v in zip(rows, y) if v for f in x) + sum(model.step[a, b] for a, b in zip(y, y[1:]))  # noqa: B023, E731
        assert value(model.decode(rows)) == pytest.approx(max(map(value, product((0, 1), repeat=n))))


def test_quality(spark, odd_rows):
    docs = spark.read.parquet(str(DATA / "documents.parquet"))
    labels = spark.read.parquet(str(DATA / "labels.parquet"))
    got = {r.doc_id: r for r in quality.quality_scores(docs, labels).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i, r in got.items() if r.held_out} == set(held)
    checked = [(got[i].predicted, truth[i]) for i in held if i in truth]
    assert np.mean([a == b for a, b in checked]) >= 0.9
    none = quality.quality_scores(frame(spark, odd_rows), labels.limit(0)).collect()
    assert len(none) == len(odd_rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in none)


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.AdditiveModel().fit(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.9 and (0, 1) in model.pair_tables
    by_hand = model.base + sum(t[np.searchsorted(c, v, side="right")] for t, c, v in zip(model.tables, model.cuts, x[0]))
    by_hand += sum(t[np.searchsorted(model.wide[i], x[0, i], side="right"), np.searchsorted(model.wide[j], x[0, j], side="right")] for (i, j), t in model.pair_tables.items())
    assert model.score(x[:1])[0] == pytest.approx(1 / (1 + np.exp(-by_hand)))


def test_empty_tables(spark):
    docs = frame(spark, [])
    items = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (
        exact_dedup.exact_groups(docs), exact_dedup.drop_exact_copies(docs), packing.pack(docs), simhash.near_duplicates(docs), simhash.drop_near_copies(docs),
        decontaminate.contaminated(docs, items), decontaminate.drop_contaminated(docs, items), substrings.remove_repeats(docs), pii.pseudonymise(docs, "k"),
        licences.scan_licences(docs), quality.quality_scores(docs, labels), quality.drop_poor(docs, labels),
        tokenfile.read_token_files(spark, tokenfile.write_token_files(docs)), mainpage.extract_main(spark.createDataFrame([], "page_id long, url string, html string")),
    ):
        assert out.count() == 0


def test_null_ids(spark):
    rows = [(None, "some text"), (None, None), (3, "some text")]
    docs, items, labels = frame(spark, rows), spark.createDataFrame([(1, "some text")], "item_id long, text string"), spark.createDataFrame([(3, 1), (None, 0)], "doc_id long, quality int")
    assert exact_dedup.exact_groups(docs).count() == 3
    assert packing.pack(docs).count() == 3
    assert simhash.near_duplicates(docs).count() == 3
    assert decontaminate.contaminated(docs, items).count() == 2
    assert substrings.remove_repeats(docs).count() == 3
    assert pii.pseudonymise(docs, "k").count() == 3
    assert quality.quality_scores(docs, labels).where("doc_id is null and held_out").count() == 2
    assert tokenfile.read_token_files(spark, tokenfile.write_token_files(docs)).count() == 3


@pytest.mark.parametrize("options", [{}, {"most": 20}, {"most": 2}])
def test_remove_repeats_of_common_passages_and_hashes_that_collide(spark, options):
    from pyspark.sql import functions as F

    rng = random.Random(3)
    made = lambda n: "".join(rng.choice("abcdefg ") for _ in range(n))
    passage, line, other = made(90), made(30), made(60)
    rows = [(i, made(rng.randint(0, 40)) + passage[rng.randint(0, 8) :] + made(rng.randint(0, 30))) for i in range(60)]
    rows += [(100 + i, made(10) + line * rng.randint(1, 6) + made(5)) for i in range(40)] + [(200 + i, other) for i in range(30)] + [(300, other)] * 25 + [(None, other), (None, line)]
    collide = lambda text: F.encode(F.concat(F.lit("h"), F.octet_length(text) % 3), "UTF-8")
    for more in ({}, {"content_hash": collide}):
        got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in substrings.remove_repeats(frame(spark, rows), length=24, k=8, **options, **more).collect())
        assert got == brute_repeats(rows, 24)


def test_parted_anchors_do_not_grow_with_the_square(spark, monkeypatch):
    """A passage in all documents: the levels of parting hold a few rows a document, however many windows run through its ends."""
    written, sizes = substrings.written, []
    monkeypatch.setattr(substrings, "written", lambda df, name, *a: (sizes.append((name, (out := written(df, name, *a)).count())), out)[1])
    rng = random.Random(4)
    made = lambda n: "".join(rng.choice("abcdefg ") for _ in range(n))
    passage = made(900)
    rows = [(i, made(300) + passage + made(300)) for i in range(80)]
    got = substrings.remove_repeats(frame(spark, rows), length=400, k=128, most=10).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == brute_repeats(rows, 400)
    assert max(n for name, n in sizes if name in ("level", "kinds")) < 80 * 60


def test_drops_are_by_id_and_text(spark):
    words = " ".join(f"w{k}" for k in range(200))
    rows = [(1, words), (2, words), (2, "some quite different text of its own"), (None, words), (None, "no other has this"), (None, None)]
    docs = frame(spark, rows).withColumnRenamed("h", "_id").withColumnRenamed("t", "_h")
    left = lambda out: sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    want = sorted([rows[0], rows[2], rows[4], rows[5]], key=str)
    assert left(simhash.drop_near_copies(docs)) == want
    assert left(exact_dedup.drop_exact_copies(docs, keep="min")) == want
    items = spark.createDataFrame([(1, "quite different text of its own")], "item_id long, text string")
    assert left(decontaminate.drop_contaminated(docs, items)) == sorted([r for r in rows if r != rows[2]], key=str)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert left(quality.drop_poor(docs, labels)) == sorted(rows, key=str)


def test_token_files_across_chunks(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice(["one", "two", "three", "4", "fünf"]) for _ in range(rng.randint(0, 3000)))) for i in range(40)] + [(100, "long " * 9000)]
    path = tokenfile.write_token_files(frame(spark, rows), chunk_blocks=1)
    assert spark.read.parquet(path).where("chunk > 1").count() > 0
    at = 0
    for r, (i, t) in zip(sorted(tokenfile.read_token_files(spark, path).collect(), key=lambda r: r.start), rows, strict=True):
        ids = brute_ids(t)
        assert (r.doc_id, r.start, r.n_tokens, bytes(r.ids)) == (i, at, len(ids), np.array(ids, "<u4").tobytes())
        at += len(ids)


def test_mixed_distribution_is_one():
    """The shares of all ids seen and of a new one adjoin and fill the whole."""
    rng = np.random.default_rng(5)
    model = rangecode.Model(3)
    for _ in range(300):
        token = rng.integers(0, 40, 3)
        model.mix()
        at = np.zeros(3, np.int64)
        place = np.full(3, -1)
        for p in range(int(model.seen.max())):
            start, size = model.find(np.full(3, p))
            here = p < model.seen
            assert (start[here] == at[here]).all() and (size[here] > 0).all()
            mid = model.at_value(np.where(here, start + size - 1, 0))
            assert (mid[here] == p).all()
            at += np.where(here, size, 0)
            place = np.where(here & (model.ids[:, p] == token), p, place)
        assert (at == model.known).all() and (model.known + model.fresh == model.whole).all()
        model.learn(token, np.where(place < 0, model.seen, place), place < 0, np.ones(3, bool))
