"""Linked sets share a signature whose reach doesn't rule the link out, whatever is rare or frequent."""

import numpy as np
import pytest

from lakefind.llm.ngram_join import signatures


@pytest.mark.parametrize("percent", [80, 85])
@pytest.mark.parametrize("frequent", [1, 3, 20, 10**6])
def test_linked_sets_share_a_signature(frequent, percent):
    r = np.random.default_rng(frequent)
    linked = 0
    for size in (2, 3, 5, 7, 12, 30, 64, 140, 300, 700):
        base = r.integers(1, 2**63, size, dtype=np.uint64)
        sets = []
        for _ in range(16):
            x = base[r.random(size) > r.choice([0, 0.02, 0.07, 0.12])]
            x = np.concatenate((x, r.integers(1, 2**63, int(r.integers(0, max(1, size // 8) + 1)), dtype=np.uint64)))
            if len(x):
                sets.append(np.unique(x))
        tokens, count = np.unique(np.concatenate(sets), return_counts=True)
        count = count + tokens % np.uint64(3)  # as chance adds to counters
        signed = []
        for x in sets:
            s, reach = signatures(x, count[np.searchsorted(tokens, x)].astype(np.uint32), frequent, percent)
            best = {}
            for a, b in zip(s.tolist(), reach.tolist()):
                best[a] = max(b, best.get(a, 0))
            signed.append(best)
        for i, x in enumerate(sets):
            for j in range(i):
                y = sets[j]
                inter = len(np.intersect1d(x, y))
                union = len(x) + len(y) - inter
                if inter * 100 >= percent * union and union > inter:
                    linked += 1
                    most = [min(signed[i][k], signed[j][k]) for k in signed[i].keys() & signed[j].keys()]
                    assert any(100 * m >= percent * (len(x) + len(y) - m) for m in most), (size, inter, union)
    assert linked > 100
