"""Parity maps bound the difference of sets from below."""

import numpy as np

from plumbline.llm.jaccard_join import PARITY_BITS, parity_map


def test_bound_holds_and_bites():
    rng = np.random.default_rng(1)
    for _ in range(200):
        x = np.unique(rng.integers(0, 2**62, rng.integers(1, 600)).astype(np.uint64))
        keep = rng.random(len(x)) < rng.random()
        y = np.unique(np.concatenate([x[keep], rng.integers(0, 2**62, rng.integers(0, 200)).astype(np.uint64)]))
        a, b = parity_map(x), parity_map(y)
        assert len(a) == PARITY_BITS // 64
        differ = sum(int(v).bit_count() for v in (a ^ b).view(np.uint64))
        assert differ <= len(np.setxor1d(x, y))
    a, b = (parity_map(rng.integers(0, 2**62, 5000).astype(np.uint64)) for _ in range(2))
    assert sum(int(v).bit_count() for v in (a ^ b).view(np.uint64)) > PARITY_BITS // 3
