"""The coder on blocks of any length, and its time."""

import time

import numpy as np

from docket.llm import rangecode


def test_blocks_of_any_length_come_back():
    rng = np.random.default_rng(9)
    sizes = [0, 1, 15, 16, 17, 63, 64, 511, 512, 513, 1024, 4095, 4096]
    blocks = [rng.zipf(1.3, n).clip(max=65535).astype("<u4") for n in sizes] + [np.zeros(4096, "<u4"), np.arange(4096, dtype="<u4"), np.full(700, 65535, "<u4")]
    packed = rangecode.encode_blocks(blocks)
    assert all(np.array_equal(a, b) for a, b in zip(blocks, rangecode.decode_blocks(packed), strict=True))
    assert [rangecode.encode_blocks([b])[0] for b in blocks] == packed


def test_time_an_id():
    rng = np.random.default_rng(10)
    blocks = [rng.zipf(1.3, 4096).clip(max=50000).astype("<u4") for _ in range(256)]
    begin = time.process_time()
    assert all(np.array_equal(a, b) for a, b in zip(blocks, rangecode.decode_blocks(rangecode.encode_blocks(blocks)), strict=True))
    coded = time.process_time() - begin
    begin = time.process_time()
    for _ in range(20):
        sum(range(1_000_000))
    assert coded < 8 * (time.process_time() - begin)  # 2.3 times as long when measured; 19 times with one update an id
