"""Adaptive context-mixing range coder for token ids, many blocks at a time.

A block is coded from nothing: its model starts empty and its bytes depend on no other block. Three models give each
a probability to every id seen in the block so far: counts of the block (order 0), of what followed the same id
(order 1) and of what followed the same two ids (order 2). Order 0 also has a share for an id not seen yet, whose 16 bits
stand plain behind the coded words. The three are mixed into one distribution, by which the id is coded in one step. The weights adapt, apart for each
standing of orders 1 and 2, by how often each model had named the id that came. Counts and weights take in a stretch of ids at a time (STRETCHES),
so within a stretch the distributions are plain tables: the encoder mixes those of many ids at once, the decoder looks an id up by its value.
All blocks of a batch advance together: each step is a few numpy operations over the blocks.

Block layout (little-endian): magic ``IDR3``, ids u32, crc32 of the ids u32, payload bytes u32,
crc32 of the payload u32, payload (u32 number of words, u16 words of the range coder, u16 ids where the block meets them first).
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"IDR3"
HEAD = struct.Struct("<4sIIII")
BLOCK_IDS = 4096
STRETCHES = (16, 32, 64, 128, 256, *range(512, BLOCK_IDS, 512))  # where stretches end
AT_ONCE = 16  # steps whose distributions the encoder mixes at once
HASH1, HASH2 = 11, 12  # bits of the contexts of orders 1 and 2
SETS = 16
BITS = 20
SCALE = 1 << BITS  # of the mixed distribution
LEAST = 16  # share of any id, so that each step moves one word at most
MOST = 0.93  # of the distribution for orders 1 and 2: SCALE * (1 - MOST) > LEAST * BLOCK_IDS
LOW = 1 << 32
UP = np.array([1, 2, 3, 3])  # standing of a named id after it came again


class Model:
    """The mixed model of every block in a batch: lane i is block i. Ids go by their place in order of first use. Arrays are one step of all lanes, or rows of such steps."""

    def __init__(self, lanes: int):
        self.lanes = lanes
        self.token, self.before = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.rows1, self.rows2, self.sets, self.rows = (np.arange(lanes) * n for n in (1 << HASH1, 1 << HASH2, SETS, BLOCK_IDS))
        self.follow = [np.zeros(lanes << bits, np.uint16) for bits in (HASH1, HASH2)]  # place * 4 + standing, 0 for none
        self.tried = np.zeros((lanes * SETS, 4))  # steps by what named the id that came: order 0 alone, order 1, order 2, none as it was not seen
        self.weight = np.zeros(lanes * SETS, np.int64)  # share of order 1's id, of order 2's << 20, and of each count of order 0 << 40
        self.ids = np.zeros((lanes, BLOCK_IDS), np.uint16)
        self.count = np.zeros((lanes, 1), np.int64)
        self.total, self.seen = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.whole = np.full(lanes, SCALE)
        self.recent: list[tuple] = []
        self.steps = 0
        self._tables()

    def _tables(self) -> None:
        """What order 0 looks up: how many ids stand below a place, and the place of the k-th of the sorted ids."""
        width = self.count.shape[1]
        below = np.zeros((self.lanes, width + 1), np.int64)
        np.cumsum(self.count, 1, out=below[:, 1:])
        self.below, self.below_rows = below.ravel(), np.arange(self.lanes) * (width + 1)
        self.sorted = np.append(np.repeat(np.tile(np.arange(width, dtype=np.uint16), self.lanes), self.count.ravel()), np.uint16(0))
        self.first, self.last = np.cumsum(self.total) - self.total, np.maximum(self.total - 1, 0)

    def mix(self, token=None, before=None) -> None:
        """The distributions after two ids, in whole numbers: orders 1 and 2 each name a place and have a share, each count of order 0 has ``base``, new ids have the rest."""
        token, before = (self.token, self.before) if token is None else (token, before)
        mixed = token * 0x9E3B
        self.at1 = (mixed >> 8 & (1 << HASH1) - 1) + self.rows1
        self.at2 = (mixed + before * 0xA2D5 >> 9 & (1 << HASH2) - 1) + self.rows2
        one, two = self.follow[0].take(self.at1).astype(np.int64), self.follow[1].take(self.at2).astype(np.int64)
        self.set = ((two & 3) << 2) + (one & 3) + self.sets
        self.one, self.two = one >> 2, two >> 2
        weight = self.weight.take(self.set)
        self.share1, self.share2, self.base = weight & SCALE - 1, weight >> BITS & SCALE - 1, weight >> 2 * BITS
        self.known = self.base * self.total + self.share1 + self.share2
        self.fresh = SCALE - self.known

    def find(self, place):
        """Where the share of ``place`` starts, and its size."""
        at = self.below_rows + place
        below = self.below.take(at)
        start = below * self.base + self.share1 * (self.one < place) + self.share2 * (self.two < place)
        return start, (self.below.take(at + 1) - below) * self.base + self.share1 * (self.one == place) + self.share2 * (self.two == place)

    def at_value(self, value):
        """The place whose share covers ``value``: a named id's share stands behind its counts, so without those shares the value tells the count."""
        row = self.below_rows + 1
        end1, end2 = self.below.take(row + self.one) * self.base, self.below.take(row + self.two) * self.base
        value = np.minimum(value, np.maximum(end1 + self.share2 * (end2 < end1) - 1, value - self.share1))
        value = np.minimum(value, np.maximum(end2 - 1, value - self.share2))
        k = (value / np.maximum(self.base, 1)).astype(np.int64)  # both are below 2^20, so the quotient's whole part is exact
        return self.sorted.take(self.first + np.minimum(np.maximum(k, 0), self.last)).astype(np.int64)

    def named(self):
        return self.at1, self.at2, self.set, self.one, self.two

    def learn(self, token, place, new, live) -> None:
        """Take in the id that came; at the end of a stretch, all of it."""
        self.recent.append((token, place, new, live, *self.named()))
        self.before, self.token = self.token, token
        self.steps += 1
        if self.steps in STRETCHES:
            token, place, new, live, *named = (np.array(x) for x in zip(*self.recent))
            self.recent = []
            step, lane = np.nonzero(new & live)
            keys, first, inverse = np.unique(lane << 16 | token[step, lane], return_index=True, return_inverse=True)
            order, number = np.lexsort((first, keys >> 16)), np.empty(len(keys), np.int64)
            number[order] = np.arange(len(keys)) - np.searchsorted(keys >> 16, keys >> 16)  # lanes ascend in keys, so both orders part them alike
            place[step, lane] = self.seen[lane] + number[inverse]
            self.take_in(token, place, new, live, *named)

    def take_in(self, token, place, new, live, at1, at2, sets, one, two) -> None:
        """A stretch, step after step, with the places of its new ids and what ``named`` told of each step."""
        step, lane = np.nonzero(new & live)
        self.ids[lane, place[step, lane]] = token[step, lane]
        width = max(self.count.shape[1], int(place.max(where=live, initial=0)) + 1)
        counted = place + np.arange(self.lanes) * width
        if not live.all():
            place, new, at1, at2, sets, one, two, counted = (x[live] for x in (place, new, at1, at2, sets, one, two, counted))
        right1, right2 = (one == place) & (sets & 3 > 0), (two == place) & (sets & 12 > 0)
        outcome = (sets << 2) + right1
        outcome[right2] = (sets[right2] << 2) + 2
        outcome[new] |= 3
        self.tried = self.tried * 0.5 + np.bincount(outcome.ravel(), minlength=4 * len(self.tried)).reshape(-1, 4)
        for follow, at, old, right, standing in zip(self.follow, (at1, at2), (one, two), (right1, right2), (sets & 3, sets >> 2 & 3)):
            place4 = place << 2
            value = np.where(right, place4 + UP.take(standing), np.where(standing > 1, (old << 2) + standing - 1, place4 + 1))
            follow[at.ravel()] = value.astype(np.uint16).ravel()  # the last of a context's ids stays
        count = np.bincount(counted.ravel(), minlength=self.lanes * width).reshape(-1, width)
        count[:, : self.count.shape[1]] += self.count
        self.count = count
        self.total, self.seen = count.sum(1), np.count_nonzero(count, 1)
        self._tables()
        self._weights()

    def _weights(self) -> None:
        by_two, by_one = np.divmod(np.tile(np.arange(SETS), self.lanes), 4)
        alone, right1, right2, new = self.tried.T
        each = MOST * SCALE / (self.tried.sum(1) + 1.6)
        share1, share2 = (each * (right1 + 0.4) * (by_one > 0)).astype(np.int64), (each * (right2 + 0.4) * (by_two > 0)).astype(np.int64)
        all_alone, all_new = (x.reshape(-1, SETS).sum(1).repeat(SETS) for x in (alone, new))
        share = (new + 4 * (all_new + 0.2) / (all_alone + all_new + 1)) / (alone + new + 4.8)
        total = self.total.repeat(SETS)
        base = np.where(total > 0, np.maximum((SCALE - share1 - share2) * (1 - share) / np.maximum(total, 1), LEAST), 0).astype(np.int64)
        self.weight = share1 | share2 << BITS | base << 2 * BITS


class Encoder:
    """Range coder of 48 bits that moves 16-bit words; a carry stays in the word that it comes with until all are out."""

    def __init__(self, lanes: int, words: int):
        self.low, self.range, self.n = np.zeros(lanes, np.int64), np.full(lanes, 1 << 48), np.arange(lanes) * words
        self.out, self.used, self.words = np.zeros(lanes * words, np.int32), np.zeros(lanes, np.int64), words

    def _move(self, go) -> None:
        self.out[self.n + self.used] = self.low >> 32
        self.used += go
        self.low = np.where(go, (self.low & LOW - 1) << 16, self.low)

    def put(self, start, size) -> None:
        part = self.range >> BITS
        self.low += part * start
        self.range = part * size
        go = self.range < LOW
        self._move(go)
        self.range <<= go * 16

    def finish(self) -> list[bytes]:
        for _ in range(3):
            self._move(np.ones(len(self.n), bool))
        out, carry = self.out.reshape(-1, self.words), 0
        for k in range(self.used.max() - 1, -1, -1):
            word = out[:, k] + carry
            word[k >= self.used] = 0
            out[:, k], carry = word & 0xFFFF, word >> 16
        return [row[:n].astype("<u2").tobytes() for row, n in zip(out, self.used)]


class Decoder:
    def __init__(self, payloads: list[bytes]):
        width = max(map(len, payloads)) // 2 + 4
        words = np.zeros((len(payloads), width), np.int64)
        for row, data in zip(words, payloads):
            row[: len(data) // 2] = np.frombuffer(data, "<u2")
        self.above, self.range = words[:, 0] << 32 | words[:, 1] << 16 | words[:, 2], np.full(len(payloads), 1 << 48)
        self.words, self.at, self.last = words.ravel(), np.arange(len(payloads)) * width + 3, np.arange(1, len(payloads) + 1) * width - 1

    def value(self):
        self.part = self.range >> BITS
        return np.minimum((self.above / self.part).astype(np.int64), SCALE - 1)  # below 2^48 by 2^28: the quotient's whole part is exact

    def get(self, start, size) -> None:
        self.above -= self.part * start
        self.range = self.part * size
        go = self.range < LOW
        self.above = np.where(go, self.above << 16 | self.words.take(np.minimum(self.at, self.last)), self.above)
        self.range <<= go * 16
        self.at += go


def _places(ids: np.ndarray) -> np.ndarray:
    """For each id of a block, its number in order of first use."""
    _, first, inverse = np.unique(ids, return_index=True, return_inverse=True)
    number = np.empty(len(first), np.int64)
    number[np.argsort(first)] = np.arange(len(first))
    return number[inverse]


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """Each block of at most BLOCK_IDS ids below 65536, as bytes of the block layout. A larger id is refused (ValueError): it would not come back."""
    if not blocks:
        return []
    if (most := max((int(b.max()) for b in blocks if len(b)), default=0)) >= 1 << 16:
        raise ValueError(f"id {most} does not fit the 16 bits of this coder: use a vocabulary of at most 65,536 ids")
    lanes, sizes = len(blocks), np.array([len(b) for b in blocks])
    steps = int(sizes.max())
    tokens, places = np.zeros((lanes, steps + 2), np.uint16), np.zeros((lanes, steps), np.uint16)
    for row, spot, ids in zip(tokens, places, blocks):
        row[2 : 2 + len(ids)] = ids
        spot[: len(ids)] = _places(ids.astype(np.uint16))
    tokens, places = np.ascontiguousarray(tokens.T), np.ascontiguousarray(places.T)
    model, coder, met = Model(lanes), Encoder(lanes, steps + 4), np.zeros((steps, lanes), bool)
    for begin, end in zip((0, *STRETCHES), (*STRETCHES, BLOCK_IDS)):
        end = min(end, steps)
        if begin >= end:
            break
        live = np.arange(begin, end)[:, None] < sizes
        new = met[begin:end] = live & (places[begin:end] >= model.seen)
        named = []
        for k in range(begin, end, AT_ONCE):
            some = slice(k, min(k + AT_ONCE, end))
            model.mix(*(tokens[k + j : some.stop + j].astype(np.int64) for j in (1, 0)))
            named.append(model.named())
            fresh, on = new[k - begin : some.stop - begin], live[k - begin : some.stop - begin]
            start, size = model.find(np.where(fresh, 0, places[some].astype(np.int64)))
            start, size = np.where(fresh, model.known, start), np.where(fresh, model.fresh, size)
            if not on.all():
                start, size = np.where(on, start, 0), np.where(on, size, SCALE)
            for a, b in zip(start, size):
                coder.put(a, b)
        if end in STRETCHES:
            model.take_in(tokens[begin + 2 : end + 2], places[begin:end].astype(np.int64), new, live, *(np.concatenate(x) for x in zip(*named)))
    packed = []
    for k, (ids, data) in enumerate(zip(blocks, coder.finish())):
        raw = np.asarray(ids, "<u4").tobytes()
        data = struct.pack("<I", len(data) // 2) + data + np.asarray(ids)[met[: len(ids), k]].astype("<u2").tobytes()
        packed.append(HEAD.pack(MAGIC, len(ids), zlib.crc32(raw), len(data), zlib.crc32(data)) + data)
    return packed


def decode_blocks(packed: list[bytes]) -> list[np.ndarray]:
    """The ids of each block; a ValueError names the first block that fails a checksum."""
    if not packed:
        return []
    heads, coded, plain = [], [], []
    for k, block in enumerate(packed):
        if len(block) < HEAD.size or block[:4] != MAGIC:
            raise ValueError(f"block {k}: no block header")
        head = HEAD.unpack_from(block)
        data = block[HEAD.size :]
        if len(data) != head[3] or zlib.crc32(data) != head[4]:
            raise ValueError(f"block {k}: payload is damaged")
        heads.append(head)
        past = 4 + 2 * struct.unpack_from("<I", data)[0]
        coded.append(data[4:past])
        plain.append(np.frombuffer(data[past:], "<u2"))
    lanes, sizes = len(packed), np.array([h[1] for h in heads])
    steps = int(sizes.max())
    model, coder = Model(lanes), Decoder(coded)
    met = np.append(np.concatenate(plain).astype(np.int64), 0)
    next_met = np.cumsum([len(p) for p in plain]) - [len(p) for p in plain]
    tokens, shortest = np.zeros((max(steps, 1), lanes), np.uint16), int(sizes.min())
    ids = model.ids.ravel()
    for step in range(steps):
        live = step < sizes
        model.mix()
        value = coder.value()
        new = value >= model.known
        place = model.at_value(value)
        start, size = model.find(place)
        start, size = np.where(new, model.known, start), np.where(new, model.fresh, size)
        if step >= shortest:
            new &= live
            start, size = np.where(live, start, 0), np.where(live, size, SCALE)
        coder.get(start, size)
        token = np.where(new, met.take(np.minimum(next_met, len(met) - 1)), ids.take(model.rows + place))
        next_met += new
        tokens[step] = token
        model.learn(token, place, new, live)
    out = [row[:n].astype(np.uint32) for row, n in zip(tokens.T, sizes)]
    for k, (found, head) in enumerate(zip(out, heads)):
        if zlib.crc32(found.astype("<u4").tobytes()) != head[2]:
            raise ValueError(f"block {k}: ids are damaged")
    return out
