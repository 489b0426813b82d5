"""The piece table of the tokenizer: ids are the library's on any text, and pieces in use stay when the table is full."""

import random
from collections import Counter

import pyarrow as pa

from docket.llm import tokens


def test_any_text_is_the_librarys():
    rng = random.Random(11)
    parts = [" ", "\n", " ", " ", "\t", "\r", "\x0b", "\x1c", "\x85", " ", " ", "　", "\0", "a", "Ab", "zß", "ñandú", "Жук", "λόγος", "͸", "˂", "é", "漢字", "١٢", "½", "12", "3", "'s", "'ll", "'", ".", ",", "!!", "###", "(\")", "—", "<|", "<|endoftext|>", "😀", "x" * 70, "ª"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(6000)] + ["", " ", "\n", "\na", "\na.", "a\n", "\n(", " (", "a b", ""]
    encoder = tokens.PieceEncoder(tokens.default_vocabulary())
    want = encoder.whole(texts)
    for k in range(0, len(texts), 1000):
        assert encoder.encode(texts[k : k + 1000]) == want[k : k + 1000]
    column = pa.array(texts)
    assert encoder.encode(column.slice(5, 4000)) == want[5:4005] and encoder.encode(column.slice(3, 0)) == []


def test_pieces_in_use_stay(monkeypatch):
    sent = Counter()

    class Recorded:
        def __init__(self, library):
            self.library = library

        def encode_batch_fast(self, texts, **options):
            sent.update(x.replace("Ġ", " ") for text in texts for x in ([text] if isinstance(text, str) else text))
            return self.library.encode_batch_fast(texts, **options)

    monkeypatch.setattr(tokens, "MOST_PIECES", 60)
    encoder, plain = tokens.PieceEncoder(tokens.default_vocabulary()), tokens.PieceEncoder(tokens.default_vocabulary())
    encoder.library, encoder.words = Recorded(encoder.library), Recorded(encoder.words)
    for k in range(30):
        texts = [" ".join(["always these words,", *("".join(random.Random(f"{k} {j}").choices("abcdefg", k=9)) for j in range(20))])]
        assert encoder.encode(texts) == plain.whole(texts)
        assert len(encoder.place) <= 60
    assert [sent[x] for x in ("always", " these", " words", ",")] == [1, 1, 1, 1]
