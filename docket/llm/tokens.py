"""Token ids from the public tokenizers library, with each distinct space-delimited piece encoded once.

The byte-level vocabulary splits text before every single space or newline that stands between two
other characters, so the ids of a text are the ids of its pieces in order. Arrow finds the distinct pieces of a batch and looks them up
in the pieces that the worker has seen (a table bounded by entries and by their length, which sheds those not used for longest), only new ones go to the
library, and numpy puts the ids in place. Texts with runs of white space or a special token's string go to the library whole.
"""

from __future__ import annotations

import os
from functools import lru_cache
from itertools import compress, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Two white space characters in Unicode's sense (the class of Arrow's expressions is ASCII's), or what may be a special token's string.
RUN = r"[\s\v\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]{2}|<\|"
LETTER = "A-Za-zÀ-ÖØ-öø-ɏΑ-ΡΣ-ώЀ-ҁҊ-ԯ"  # blocks that gain no letters in later versions of Unicode
PUNCTUATION = r".,;:!?%*&#$|\"()"
MAY_PART = rf"(?s)^\n.|[{PUNCTUATION}]$"
PARTS = rf"(?s)^(?P<line>\n?)(?P<stem>.*[{LETTER}0-9])(?P<tail>[{PUNCTUATION}]*)$"
WORD = rf"^ ?[{LETTER}]+$"
MOST_PIECES = 700_000  # of at most LONGEST bytes: some 150 MB; longer ones are not kept
LONGEST = 64
AT_ONCE = 20_000  # pieces that the library encodes in one call

#: The vocabulary's letters for bytes: one that does not print has the next letter from 256 on; line ends stay, to part words.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
_OTHERS = [b for b in range(256) if b not in _PRINTED]
LETTERS = np.array([10 if b == 10 else b if b in _PRINTED else 256 + _OTHERS.index(b) for b in range(256)], "<u2")
LINE, NEWLINE = chr(256 + _OTHERS.index(10)), 198


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size, one span after another."""
    past = np.cumsum(size)
    out = np.repeat(start - past + size, size)
    out += np.arange(len(out))
    return out


def listed(pieces: pa.Array) -> list[bytes]:
    return pieces.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()


class PieceEncoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.words = Tokenizer(self.library.model)  # takes words in the vocabulary's letters, splits nothing
        self.place: dict[bytes, int] = {}  # of each piece in the arrays, in their order
        self.ids, self.start, self.size, self.used = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.turn = 0

    def whole(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def store(self, pieces: list[bytes], ids: np.ndarray, size: np.ndarray) -> None:
        self.place.update(zip(pieces, range(len(self.size), len(self.size) + len(size))))
        self.start = np.append(self.start, np.cumsum(size) - size + len(self.ids))
        self.ids, self.size = np.append(self.ids, ids), np.append(self.size, size)
        self.used = np.append(self.used, np.full(len(size), self.turn))

    def shed(self) -> None:
        """Forget long pieces, and if there are too many the half that was not used for longest."""
        keep = np.fromiter(map(len, self.place), np.int64, len(self.place)) <= LONGEST
        if len(keep) > MOST_PIECES:
            keep[np.argsort(self.used, kind="stable")[: len(keep) - MOST_PIECES // 2]] = False
        if not keep.all():
            self.place = {piece: k for k, piece in enumerate(compress(self.place, keep.tolist()))}
            self.used, self.ids, self.size = self.used[keep], self.ids[spans(self.start[keep], self.size[keep])], self.size[keep]
            self.start = np.cumsum(self.size) - self.size

    def learn(self, pieces: list[bytes]) -> None:
        """A newline before other characters, and punctuation that ends a piece after a letter or digit, are cut off by the vocabulary's own rule, so they are looked up apart."""
        texts = pa.array(pieces, pa.binary()).cast(pa.string())
        may = pc.match_substring_regex(texts, MAY_PART)
        some = texts.filter(may)
        parts = pc.extract_regex(some, PARTS)
        cut = parts.is_valid()
        three = [piece for k in range(3) for piece in listed(parts.filter(cut).field(k))]
        self.spell([*{*listed(texts.filter(pc.invert(may))), *listed(some.filter(pc.invert(cut))), *three}.difference(self.place)])
        if three:
            place = np.fromiter(map(self.place.__getitem__, three), np.int64, len(three)).reshape(3, -1).T.ravel()
            size = self.size[place]
            self.store(listed(some.filter(cut)), self.ids[spans(self.start[place], size)], size.reshape(-1, 3).sum(1))

    def spell(self, pieces: list[bytes]) -> None:
        """New pieces by the library: words of letters, which it would not split, many in one call, others each as a text."""
        texts = pa.array(pieces, pa.binary()).cast(pa.string())
        word = pc.match_substring_regex(texts, WORD)
        words, rest = listed(texts.filter(word)), texts.filter(pc.invert(word)).to_pylist()
        if words:
            joined = np.frombuffer(b"\n".join(words), np.uint8)
            names = LETTERS[joined].tobytes().decode("utf-16-le").split("\n")
            lined = [LINE] * (2 * len(names))
            lined[::2] = names
            found = [np.array(self.words.encode_batch_fast([lined[k : k + 2 * AT_ONCE]], is_pretokenized=True, add_special_tokens=False)[0].ids, "<u4") for k in range(0, len(lined), 2 * AT_ONCE)]
            ids = np.concatenate(found)
            ends = ids == NEWLINE
            self.store(words, ids[~ends], np.diff(np.flatnonzero(ends), prepend=-1) - 1)
        for k in range(0, len(rest), AT_ONCE):
            some = rest[k : k + AT_ONCE]
            found = self.whole(some)
            self.store([piece.encode() for piece in some], np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4)

    def find(self, pieces: list[bytes]) -> np.ndarray:
        """Where each of distinct pieces stands in the table; those that are new are learned."""
        if new := [piece for piece in pieces if piece not in self.place]:
            self.learn(new)
        return np.fromiter(map(self.place.__getitem__, pieces), np.int64, len(pieces))

    def pieced(self, texts: pa.StringArray) -> list[bytes]:
        ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
        if ends[0] == ends[-1]:
            return [b""] * len(texts)
        data, ends = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]], ends - ends[0]
        cut = (data == 32) | (data == 10)
        cut[ends[ends < len(data)]] = True
        at = np.append(np.flatnonzero(cut), len(data)).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)]).dictionary_encode()
        found = self.find(listed(coded.dictionary))
        self.turn += 1
        self.used[found] = self.turn
        place = found[coded.indices.to_numpy()]
        size = self.size[place]
        ids = self.ids[spans(self.start[place], size)].tobytes()
        self.shed()
        return [ids[a:b] for a, b in pairwise((4 * np.append(0, np.cumsum(size))[np.searchsorted(at[:-1], ends)]).tolist())]

    def encode(self, texts: pa.StringArray | list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts.cast(pa.string())
        odd = pc.match_substring_regex(texts, RUN)
        if not pc.any(odd).as_py():
            return self.pieced(texts)
        whole, pieced = iter(self.whole(texts.filter(odd).to_pylist())), iter(self.pieced(texts.filter(pc.invert(odd))))
        return [next(whole if o else pieced) for o in odd.to_pylist()]


@lru_cache(1)
def encoder(path: str) -> PieceEncoder:
    """One per worker process and vocabulary."""
    return PieceEncoder(path)
