"""Language-model scoring: a hashed maximum-entropy model with a class-factored softmax.

P(word | history) = P(class | history) * P(word | class). The class factor is a maximum-entropy model: its features are n-grams
(the word before, the pair of classes before) and skips (the word two back, the pair of classes three and four back), hashed to rows of
one weight table with a column per class. Words are classed by the company they keep: the most frequent words are parted
into topics by which of them occur near each other, every word takes the topic of its neighbours, and the words of a topic
are cut into bands of equal mass by count. Words seen once or twice share one class with the unknown word, with Good-Turing weights; the
end of a text has a class of its own.

Work is cut into blocks of texts. A block is one row: texts as numbers of the block's own words, and those words. The words are dealt by hash to
tasks, each of which adds up the counts of its words over all blocks and answers each block with counts and topics, so no vocabulary is ever in one
place, and few and long rows are moved. Weights are trained in rounds: each task takes gradient steps over its blocks from the common weights, of words' features and of classes' features
in turn, and the next weights are the old ones plus the mean of the tasks' changes, row by row, weighted by how often a row was used.
Weights, topics, the most frequent words and the class table are of fixed size and go through the driver; nothing else does.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docket.llm.common import removed, slices, written_at

END = b""  # no word is empty
CHUNK = 256  # weight rows that travel together
GROUP = 4  # blocks that a task writes or reads at once
TOKEN_BYTES = 16  # a block has at most so many bytes of text for each of its tokens, on average
BLOCK = pa.schema([("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int32())), ("n_words", pa.int32()), ("tokens", pa.binary()), ("hashes", pa.binary()), ("words", pa.list_(pa.binary())), ("counts", pa.binary())])
BLOCK_SQL = "ids array<long>, held array<boolean>, lengths array<int>, n_words int, tokens binary, hashes binary, words array<binary>, counts binary"


def _pressed(v: np.ndarray) -> bytes:
    return pa.compress(v.tobytes(), codec="zstd", asbytes=True)


def _loose(cell: pa.Scalar, kind: str, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(cell.as_buffer(), n * np.dtype(kind).itemsize, codec="zstd"), kind)


def held_out(doc_id: "F.Column") -> "F.Column":
    """Texts that are never learned from: crc32 of the id as text leaves 2 modulo 7; a null id too."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(True))


def text_blocks(docs: DataFrame, block_tokens: int, id_col: str, text_col: str) -> DataFrame:
    """Rows of about ``block_tokens`` tokens, of whole texts, fewer where words are long; a longer text is a block of its own."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col).cast("long")).alias("held"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, bool, np.ndarray]] = []
        number: defaultdict[bytes, int] = defaultdict()
        number.default_factory = number.__len__

        def block() -> pa.RecordBatch:
            lengths = np.array([len(t) for _, _, t in held], np.int32)
            tokens = np.concatenate([t for _, _, t in held])
            trained = np.repeat([not h for _, h, _ in held], lengths)
            counts = np.bincount(tokens[trained], minlength=len(number)).astype("<i4")
            hashes = np.fromiter(map(zlib.crc32, number), np.uint32, len(number)).astype("<u2")
            cells = [[i for i, _, _ in held], [h for _, h, _ in held], lengths, len(number), _pressed(tokens.astype("<i4")), _pressed(hashes), list(number), _pressed(counts)]
            out = pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(cells, BLOCK)], schema=BLOCK)
            held.clear()
            number.clear()
            return out

        size = weight = 0
        for some in (s for batch in batches for s in slices(batch)):
            for doc_id, out_, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), some.column(2).to_pylist()):
                words = text.lower().split()  # of bytes: A-Z alone are lowered, and ASCII white space alone divides
                words.append(END)
                held.append((doc_id, out_, np.fromiter(map(number.__getitem__, words), np.int32, len(words))))
                size, weight = size + len(words), weight + len(text)
                if size >= block_tokens or weight >= TOKEN_BYTES * block_tokens:
                    yield block()
                    size = weight = 0
        if held:
            yield block()

    return rows.mapInArrow(of, BLOCK_SQL).select(F.monotonically_increasing_id().alias("block"), "*")


class Block:
    """One row of blocks, without Python objects for its words."""

    def __init__(self, batch: pa.RecordBatch, at: int):
        self.lengths = batch.column("lengths")[at].values.to_numpy().astype(np.int64)
        self.held = batch.column("held")[at].values.to_numpy(zero_copy_only=False).astype(bool)
        self.ids, n = batch.column("ids")[at].values, batch.column("n_words")[at].as_py()
        self.tokens, self.hashes = _loose(batch.column("tokens")[at], "<i4", int(self.lengths.sum())), _loose(batch.column("hashes")[at], "<u2", n)
        names = batch.schema.names
        self.words = batch.column("words")[at].values if "words" in names else None
        self.counts = _loose(batch.column("counts")[at], "<i4", n) if "counts" in names else None

    def text(self) -> np.ndarray:
        """The number of the text of each token, -1 in texts that are not learned from."""
        return np.repeat(np.where(self.held, -1, np.arange(len(self.lengths))), self.lengths)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    return (Block(b, k) for b in batches for k in range(b.num_rows))


def frequent_words(blocks: DataFrame, most: int, share: float) -> list[tuple[bytes, int]]:
    """The ``most`` most frequent words and their counts, summed where they are at least ``share`` of a block: so few rows leave a block."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            often = pa.array(np.flatnonzero(block.counts >= max(share * block.counts.sum(), 1)))
            yield pa.RecordBatch.from_arrays([block.words.take(often), pa.array(block.counts, pa.int64()).take(often)], schema=schema)

    found = blocks.mapInArrow(of, "word binary, n long").where(F.length("word") > 0).groupBy("word").agg(F.sum("n").alias("n"))
    return [(bytes(r.word), r.n) for r in found.orderBy(F.desc("n"), "word").limit(most).collect()]


def _places(block: Block, top: list[bytes]) -> np.ndarray:
    """For each token its word's place in ``top``, or -1."""
    return pc.index_in(block.words, pa.array(top, pa.binary())).fill_null(-1).to_numpy(zero_copy_only=False)[block.tokens]


def near_pairs(blocks: DataFrame, top: list[bytes], window: int) -> np.ndarray:
    """How often each pair of the words ``top`` lies within ``window`` tokens, over all texts learned from."""
    k = len(top)
    schema = pa.schema([("pair", pa.int32()), ("n", pa.int64())])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(k * k, np.int64)
        for block in _blocks(batches):
            t, text = _places(block, top), block.text()
            at = np.flatnonzero((t >= 0) & (text >= 0))  # the frequent words alone, so no more than ``window`` of them on
            t, text = t[at], text[at]
            for o in range(1, window + 1):
                good = (at[o:] - at[:-o] <= window) & (text[:-o] == text[o:])
                sums += np.bincount((t[:-o] * k + t[o:])[good], minlength=k * k)
        pair = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(pair, pa.int32()), pa.array(sums[pair])], schema=schema)

    out = np.zeros(k * k)
    for r in blocks.mapInArrow(of, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        out[r.pair] = r.n
    return out.reshape(k, k) + out.reshape(k, k).T


def topics_of(near: np.ndarray, topics: int) -> np.ndarray:
    """A topic for each frequent word: clusters of its neighbours' surplus over chance, from the farthest word on."""
    total = near.sum()
    if not total:
        return np.zeros(len(near), np.int64)
    share = near.sum(1) / total
    surplus = np.log((near / total + 1e-9) / (np.outer(share, share) + 1e-9)).clip(-3, 3)
    surplus /= np.linalg.norm(surplus, axis=1, keepdims=True) + 1e-9
    centres = [surplus[0]]
    while len(centres) < min(topics, len(near)):
        centres.append(surplus[np.max(surplus @ np.array(centres).T, 1).argmin()])
    centres = np.array(centres)
    for _ in range(20):
        own = (surplus @ centres.T).argmax(1)
        for t in np.unique(own):
            mean = (surplus[own == t] * share[own == t, None]).sum(0)
            centres[t] = mean / (np.linalg.norm(mean) + 1e-9)
    return (surplus @ centres.T).argmax(1)


def _dealt(hashes: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, ends): the words of a block by the part that their hash deals them to, and where each part ends."""
    part = hashes % parts
    return np.argsort(part, kind="stable"), np.cumsum(np.bincount(part, minlength=parts))


def numbered_blocks(blocks: DataFrame, top: list[tuple[bytes, int]], own: np.ndarray, topics: int, window: int, part_words: int = 400_000) -> DataFrame:
    """Blocks whose words have what the whole corpus says of them: told, for each part that words are dealt to its words' counts and topics.

    A word's count is that in the texts learned from. Its topic is the one whose frequent words are near it most, against their own number; each block has
    one vote, weighted by the word's count there. ``topics`` stands for no such word near, ``topics`` + 1 for the end. Of a word's blocks the
    lowest is marked as its first. A part holds about ``part_words`` words of blocks, so many parts as that takes.
    """
    names = [w for w, _ in top]
    size = np.array([sum(n for (_, n), t in zip(top, own) if t == k) for k in range(topics)], float) + 1
    parts = int(min(1 << 16, max(8, -(-(blocks.agg(F.sum("n_words")).first()[0] or 0) // part_words))))
    asked = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("words", pa.binary()), ("counts", pa.binary()), ("votes", pa.binary())])
    answered = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("told", pa.binary())])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):
                block = Block(b, at)
                topic = np.append(own, -1)[_places(block, names)] if names else np.full(len(block.tokens), -1)
                text = block.text()
                topic[text < 0] = -1
                here = np.flatnonzero(topic >= 0)
                n = len(block.words)
                sums = np.zeros(n * topics, np.int64)
                for o in (*range(-window, 0), *range(1, window + 1)):
                    some = here[: np.searchsorted(here, len(topic) - o)] if o > 0 else here[np.searchsorted(here, -o) :]
                    some = some[text[some] == text[some + o]]
                    sums += np.bincount(block.tokens[some + o].astype(np.int64) * topics + topic[some], minlength=n * topics)
                sums = sums.reshape(n, topics) / size
                votes = np.where(sums.max(1) > 0, sums.argmax(1), topics).astype(np.uint8)
                order, ends = _dealt(block.hashes, parts)
                words = block.words.take(pa.array(order)).to_pylist()
                counts, votes, rows, begin = block.counts[order], votes[order], [], 0
                for part, end in enumerate(ends.tolist()):
                    if end > begin:
                        rows.append((part, b" ".join(words[begin:end]), counts[begin:end].tobytes(), votes[begin:end].tobytes()))
                    begin = end
                part, joined, counts_, votes_ = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([b.column("block")[at].as_py()] * len(rows)), *(pa.array(v, pa.binary()) for v in (joined, counts_, votes_))], schema=asked)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: defaultdict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        rows: list[tuple[int, int, np.ndarray]] = []
        sums, first = np.zeros((1024, topics + 1), np.int64), np.full(1024, np.iinfo(np.int64).max)
        for b in batches:
            for part, block, words, counts, votes in zip(*(c.to_pylist() for c in b.columns)):
                split = words.split(b" ")
                at = np.fromiter(map(number.__getitem__, split), np.int32, len(split))
                if len(number) > len(sums):
                    more = len(number)
                    sums, first = np.concatenate([sums, np.zeros((more, topics + 1), np.int64)]), np.concatenate([first, np.full(more, np.iinfo(np.int64).max)])
                sums[at, np.frombuffer(votes, np.uint8)] += np.frombuffer(counts, "<i4")  # a word is in a row once
                first[at] = np.minimum(first[at], block)
                rows.append((part, block, at))
        n, best = sums.sum(1), sums[:, :topics]
        topic = np.where(best.max(1) > 0, best.argmax(1), topics)
        if END in number:
            topic[number[END]] = topics + 1
        for part, block, at in rows:
            told = n[at].astype("<i8").tobytes() + (topic[at] * 2 + (first[at] == block)).astype(np.uint8).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block]), pa.array([told], pa.binary())], schema=answered)

    questions = blocks.mapInArrow(ask, "part int, block long, words binary, counts binary, votes binary").repartitionById(parts, "part")
    answers = questions.mapInArrow(answer, "part int, block long, told binary").groupBy("block").agg(F.collect_list(F.struct("part", "told")).alias("told"))  # a row for each part
    return blocks.drop("words", "counts").withColumn("parts", F.lit(parts)).hint("merge").join(answers, "block", "left")


def _told(batch: pa.RecordBatch, at: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, topic, first) of each word of a numbered block."""
    n, marks = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.uint8)
    order, ends = _dealt(hashes, batch.column("parts")[at].as_py())
    for r in batch.column("told")[at].as_py():
        end = int(ends[r["part"]])
        k = len(r["told"]) // 9
        own = order[end - k : end]
        n[own], marks[own] = np.frombuffer(r["told"], "<i8", k), np.frombuffer(r["told"], np.uint8, k, 8 * k)
    return n, (marks >> 1).astype(np.int64), (marks & 1).astype(bool)


def word_masses(numbered: DataFrame) -> list[tuple[int, int, int, int]]:
    """(topic, bin of counts, words, mass): each word counted once, in the first of its blocks."""
    schema = pa.schema([("topic", pa.int32()), ("bin", pa.int32()), ("words", pa.int64()), ("mass", pa.int64())])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):
                n, topic, first = _told(b, at, _loose(b.column("hashes")[at], "<u2", b.column("n_words")[at].as_py()))
                n, topic = n[first & (n > 0)], topic[first & (n > 0)]
                code = topic * 256 + bins(n)
                words, mass = np.bincount(code), np.bincount(code, n)
                at_ = np.flatnonzero(words)
                yield pa.RecordBatch.from_arrays([pa.array(at_ // 256, pa.int32()), pa.array(at_ % 256, pa.int32()), pa.array(words[at_]), pa.array(mass[at_].astype(np.int64))], schema=schema)

    found = numbered.select("hashes", "n_words", "parts", "told").mapInArrow(of, "topic int, bin int, words long, mass long")
    return [tuple(r) for r in found.groupBy("topic", "bin").agg(F.sum("words"), F.sum("mass")).collect()]


class Classes:
    """What turns a word's count and topic into its class and its probability within the class."""

    def __init__(self, masses: list[tuple[int, int, int, int]], topics: int, bands: int):
        """``masses`` as word_masses() gives them."""
        rare = [sum(w for t, b, w, _ in masses if b == bin_ and t <= topics) for bin_ in (int(bins(np.array([k]))[0]) for k in (1, 2, 3))]
        self.tokens, self.vocabulary, self.end = sum(m for *_, m in masses), sum(w for *_, w, _ in masses), topics + 1
        ends = sum(m for t, _, _, m in masses if t == self.end)
        once, twice, thrice = rare
        self.single, self.double = (2 * twice / once if twice else 1.0) if once else 0.0, (3 * thrice / twice if thrice else 2.0) if twice else 0.0
        self.unknown = max(once, 1)
        self.mass = [once + 2 * twice, ends][: 1 + (ends > 0)]  # class 0: unknown and rare words; class 1: the end, unknown if no text ended
        self.weight = [self.unknown + once * self.single + twice * self.double, ends][: len(self.mass)]
        stats = [(t, b, m) for t, b, _, m in masses if t <= topics and b > int(bins(np.array([2]))[0])]
        self.table = np.zeros((topics + 2, 1 + max((b for _, b, _ in stats), default=0)), np.int64)
        for topic in sorted({t for t, _, _ in stats}):
            rows = sorted((-b, m) for t, b, m in stats if t == topic)
            whole, before, band = sum(m for _, m in rows), 0, -1
            for b, m in rows:
                if band != (band := min(bands - 1, bands * before // whole)) or before == 0:
                    self.mass.append(0)
                    self.weight.append(0)
                self.table[topic, -b] = len(self.mass) - 1
                self.mass[-1] += m
                self.weight[-1] += m
                before += m
        self.size = len(self.mass)
        self.bias = np.log(np.maximum(np.array(self.mass, float), 0.5) / max(self.tokens, 1)).astype(np.float32)

    def of(self, n: np.ndarray, topic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class, log10 probability within it); n is 0 for unknown words."""
        cls = np.where(n <= 2, 0, self.table[topic, np.minimum(bins(n), self.table.shape[1] - 1)])  # the bins of rare words may lie outside
        weight = np.select([n == 0, n == 1, n == 2], [self.unknown, self.single, self.double], n.astype(float))
        end = (topic == self.end) & (n > 0)
        cls, weight = np.where(end, 1, cls), np.where(end, n, weight)
        return cls, np.log10(weight / np.array(self.weight)[cls])


def bins(n: np.ndarray) -> np.ndarray:
    """Quarter powers of two of counts."""
    return np.floor(np.log2(np.maximum(n, 1)) * 4 + 1e-9).astype(np.int64)


class Coded:
    """A numbered block as the model reads it: each token's class and hash, each word's count and log10 probability within its class."""

    def __init__(self, batch: pa.RecordBatch, at: int, classes: Classes):
        self.block = Block(batch, at)
        self.n, topic, _ = _told(batch, at, self.block.hashes)
        cls, self.within = classes.of(self.n, topic)
        self.classes, self.hashes = cls.astype(np.uint16)[self.block.tokens], self.block.hashes[self.block.tokens]


def features(classes: np.ndarray, hashes: np.ndarray, lengths: np.ndarray, size: int, rows: int) -> np.ndarray:
    """Weight rows of each token's features, one feature after the other: word before, classes one and two before, word two before, classes three and four before."""
    if rows > 1 << 16:
        raise ValueError("weight rows are numbered by 16 bits")
    place = np.arange(len(classes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)

    def back(v: np.ndarray, o: int, start: int) -> np.ndarray:
        out = np.full(len(v), start, np.uint32)
        out[o:] = v[:-o]
        out[place < o] = start
        return out

    def row(kind: int, v: np.ndarray) -> np.ndarray:
        v = (v ^ np.uint32(kind * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x2C1B3C6D)
        return ((v >> np.uint32(12)) % np.uint32(rows)).astype(np.uint16)

    k = np.uint32(size + 1)
    c = [back(classes, o, size) for o in (1, 2, 3, 4)]
    return np.stack([row(1, back(hashes, 1, 1 << 16)), row(2, c[0] * k + c[1]), row(3, back(hashes, 2, 1 << 16)), row(4, c[2] * k + c[3])])


def _logits(weights: np.ndarray, bias: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Of tokens whose features are the columns of f; an offset of a row changes nothing, so each row's largest is 0."""
    z = weights[f[0]]
    for own in f[1:]:
        z += weights[own]
    z += bias
    z -= z.max(1, keepdims=True)
    return z


def gradient_round(numbered: DataFrame, classes: Classes, weights: np.ndarray, rate: float, batch: int) -> np.ndarray:
    """Weights after one round: every task steps through its blocks, and changes are averaged by row over the tasks that used it."""
    rows, size = weights.shape
    sent = numbered.sparkSession.sparkContext.broadcast((weights, classes))
    schema = pa.schema([("chunk", pa.int32()), ("change", pa.binary()), ("used", pa.binary())])

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, classes_ = sent.value
        now, power, used = start.copy(), np.full(rows, 1e-2, np.float32), np.zeros(rows, np.float32)
        for coded in (Coded(b, k, classes_) for b in batches for k in range(b.num_rows)):
            f = features(coded.classes, coded.hashes, coded.block.lengths, size, rows)
            learn = np.flatnonzero(~np.repeat(coded.block.held, coded.block.lengths))
            f, cls = f[:, learn], coded.classes[learn]
            for s in range(0, len(learn), batch):
                at = f[:, s : s + batch]
                n = at.shape[1]
                p = _logits(now, classes_.bias, at)
                np.exp(p, out=p)
                p /= p.sum(1, keepdims=True)
                p[np.arange(n), cls[s : s + batch]] -= 1
                flat = at[s // batch % 2 :: 2].ravel()  # the rows of words and those of classes in turn
                order = np.argsort(flat, kind="stable")
                heads = np.flatnonzero(np.diff(flat[order].astype(np.int32), prepend=-1))
                which, g = flat[order[heads]], np.add.reduceat(p[order % n], heads)
                power[which] += np.einsum("ij,ij->i", g, g)
                now[which] -= rate * g / np.sqrt(power[which])[:, None]
                used[which] += np.diff(heads, append=len(flat))
        change = (now - start) * used[:, None]
        for c in range(0, rows, CHUNK):
            if used[c : c + CHUNK].any():
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([change[c : c + CHUNK].tobytes()], pa.binary()), pa.array([used[c : c + CHUNK].tobytes()], pa.binary())], schema=schema)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[np.ndarray]] = {}  # at most all weights
        for row in (r for b in batches for r in b.to_pylist()):
            new = [np.frombuffer(row["change"], np.float32).astype(np.float64), np.frombuffer(row["used"], np.float32).astype(np.float64)]
            sums[row["chunk"]] = [a + b for a, b in zip(sums[row["chunk"]], new)] if row["chunk"] in sums else new
        for c, (change, used) in sorted(sums.items()):
            mean = (change.reshape(-1, size) / np.maximum(used, 1)[:, None]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([mean.tobytes()], pa.binary()), pa.array([b""], pa.binary())], schema=schema)

    sql = "chunk int, change binary, used binary"
    out = weights.copy()
    for r in numbered.mapInArrow(steps, sql).repartition("chunk").mapInArrow(add, sql).collect():
        out[r.chunk : r.chunk + CHUNK] += np.frombuffer(bytes(r.change), np.float32).reshape(-1, size)
    sent.unpersist()
    return out


def scored(numbered: DataFrame, classes: Classes, weights: np.ndarray) -> DataFrame:
    """One row per text of the blocks."""
    sent = numbered.sparkSession.sparkContext.broadcast((weights, classes))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, classes_ = sent.value
        for coded in (Coded(b, k, classes_) for b in batches for k in range(b.num_rows)):
            block, cls = coded.block, coded.classes
            f = features(cls, coded.hashes, block.lengths, w.shape[1], len(w))
            logs = np.zeros(len(cls))
            for s in range(0, len(cls), 4096):
                z = _logits(w, classes_.bias, f[:, s : s + 4096])
                own = z[np.arange(len(z)), cls[s : s + 4096]]
                logs[s : s + 4096] = own - np.log(np.exp(z, out=z).sum(1))
            per_text = lambda v, starts=np.cumsum(block.lengths) - block.lengths: np.add.reduceat(v, starts)
            base = np.log10((coded.n + 1) / (classes_.tokens + classes_.vocabulary + 1))
            known, score = per_text((coded.n > 0).astype(np.int64)[block.tokens]), per_text(logs / np.log(10) + coded.within[block.tokens])
            yield pa.RecordBatch.from_arrays([block.ids, pa.array(block.held), pa.array(block.lengths), pa.array(known), pa.array(np.full(len(known), classes_.tokens)), pa.array(per_text(base[block.tokens])), pa.array(score)], schema=schema)

    return numbered.mapInArrow(of, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def language_scores(
    docs: DataFrame, frequent: int = 256, share: float = 1 / 4096, topics: int = 6, bands: int = 6, window: int = 3, rows: int = 1 << 14, rounds: int = 3, rate: float = 1.0, batch: int = 2048, block_tokens: int = 1 << 19,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words of the text with A-Z lowered, and one end. The model and all counts come from all texts that are not held out; every text is
    scored whole. ``score`` is the model's log10 probability of the text, ``base_score`` that of add-one word counts. A null text is empty and
    has the end alone; a null id is held out. Texts of one id are rows of their own. Without a text to learn from, every token is unknown
    and both scores are 0. ``rounds`` rounds see each text once in all. Other columns are ignored.
    """
    blocks, at_blocks = written_at(text_blocks(docs, block_tokens, id_col, text_col), "blocks", GROUP)
    top = frequent_words(blocks, frequent, share)
    own = topics_of(near_pairs(blocks, [w for w, _ in top], window), topics) if top else np.zeros(0, np.int64)
    numbered, at_numbered = written_at(numbered_blocks(blocks, top, own, topics, window), "numbered", GROUP)
    spark = docs.sparkSession
    removed(spark, at_blocks)
    classes = Classes(word_masses(numbered), topics, bands)
    weights = np.zeros((rows, classes.size), np.float32)
    for r in range(rounds if classes.tokens else 0):
        weights = gradient_round(numbered.where(F.pmod(F.xxhash64("block"), F.lit(rounds)) == r), classes, weights, rate, batch)
    result, _ = written_at(scored(numbered, classes, weights), "scores")
    removed(spark, at_numbered)
    return result
