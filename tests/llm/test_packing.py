"""The packer on lengths that leave no window nearly full: what it holds and how often it packs a row stay bounded."""

import random

import pytest

from docket.llm import packing


def run(lengths, window, most):
    packer, out, packed, held = packing.Packer(window, 0, most), [], 0, 0
    for i, n in enumerate(lengths):
        packer.add(i, bytes(4 * n))
        held = max(held, packer.held)
        if packer.held >= most:
            packed += len(packer.rows)
            out += packer.placed(False)
    packed += len(packer.rows)
    out += packer.placed(True)
    return out, packed, held


@pytest.mark.parametrize("low,high", [(600, 600), (513, 1012), (1, 1024), (700, 3000)])
def test_bounded(low, high):
    rng, window, most = random.Random(low), 1024, 20_000
    lengths = [rng.randint(low, high) for _ in range(3000)]
    out, packed, held = run(lengths, window, most)
    assert held < 2 * most
    assert packed <= 3 * len(out)
    used, pieces = {}, {}
    for doc, start, length, _, n, _, turn, offset in out:
        used.setdefault(turn, []).append((offset, length))
        pieces.setdefault(doc, []).append((start, length))
    assert sorted(used) == list(range(len(used)))
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= window
    for doc, n in enumerate(lengths):
        assert sorted(pieces[doc]) == [(s, min(window, n - s)) for s in range(0, n, window)]


def test_still_full():
    rng = random.Random(7)
    lengths = [rng.choice([40, 90, 300, 700, 1500]) + rng.randint(0, 60) for _ in range(6000)]
    out, _, _ = run(lengths, 1024, 60_000)
    windows = 1 + max(r[6] for r in out)
    assert sum(lengths) >= 0.99 * 1024 * (windows - 1)


def test_range_coder_refuses_large_ids():
    import numpy as np

    from docket.llm import rangecode

    assert rangecode.encode_blocks([np.array([65535, 0])])
    with pytest.raises(ValueError, match="65536"):
        rangecode.encode_blocks([np.array([1]), np.array([3, 65536])])
