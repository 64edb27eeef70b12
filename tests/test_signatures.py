"""Signatures of near duplicates: the same values in a small, bounded matrix."""

import tracemalloc

import numpy as np

from lakefind.operators import near_duplicates as nd


def plain(text):
    c = np.frombuffer(" ".join(text.split()).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64) + np.uint64(1)
    width = min(nd.SHINGLE, len(c))
    h = np.zeros(len(c) - width + 1, np.uint64)
    for k in range(width):
        h = h * nd.BASE + c[k : k + len(h)]
    return nd._mix(np.unique(nd._mix(h))[:, None] ^ nd._seeds()[None]).min(0)


def test_signatures_are_the_least_permuted_hashes():
    r = np.random.default_rng(3)
    for n in (1, 3, 5, 6, 127, 132, 133, 1000, 5000):
        text = "".join(map(chr, r.integers(97, 20000, n)))
        assert (nd.signature(text) == plain(text)).all()


def test_a_signature_holds_a_small_matrix():
    text = "".join(map(chr, np.random.default_rng(4).integers(0x4E00, 0x9FFF, 20_000)))
    nd.signature(text)
    tracemalloc.start()
    nd.signature(text)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 3 << 20  # matrices of 4,096 shingles took 4 MB each, several at once
