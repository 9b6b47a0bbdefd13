"""Near copies of many documents: how often a fingerprint is sent."""

import numpy as np
import pytest

from scryline.llm import simhash


@pytest.mark.parametrize("n", [230_000, 2_800_000, 14_000_000, 35_000_000])
def test_copies_of_a_fingerprint_do_not_grow(n):
    """F1: five copies a table at most; before, 46 at 2.8 million fingerprints (6 GB), 79 at 14 million."""
    parts, k = simhash.dealing(n, 56, 2, simhash.WIDTH, 2, simhash.PARTS)
    assert parts * simhash.copies(k, 2) <= 5


@pytest.mark.parametrize("slice_bytes", [64, 1 << 12])
def test_parts_find_what_is_near(spark, monkeypatch, slice_bytes):
    """Rows that differ in at most four bits of a table are linked, whichever way they are dealt; no others."""
    monkeypatch.setattr(simhash, "SLICE_BYTES", slice_bytes)
    rng = np.random.default_rng(slice_bytes)
    base = rng.integers(0, 1 << 36, 150, dtype=np.uint64)
    keys = [base]
    for flips in (1, 2, 3, 4, 5, 9):
        more = base.copy()
        for i in range(len(more)):
            for b in rng.choice(36, flips, replace=False):
                more[i] ^= np.uint64(1 << int(b))
        keys.append(more)
    keys = np.unique(np.concatenate(keys))
    parts, k = simhash.dealing(len(keys), 16, 2, 36, 2, simhash.PARTS)
    assert parts == 5 and (k > 0) == (slice_bytes == 64)
    rows = [(i, bytes(np.array([x], "<u8").tobytes())) for i, x in enumerate(keys)]
    found = simhash.ball_links(spark.createDataFrame(rows, "node long, wide binary"), 2, 36, 1, slice_bits=2, sure=4, most=4, parts=simhash.PARTS).collect()
    roots = simhash.forest(np.array([r.a for r in found]), np.array([r.b for r in found]))[1]
    near = np.argwhere(np.triu(np.bitwise_count(keys[:, None] ^ keys) <= 4, 1))
    want = simhash.forest(near[:, 0], near[:, 1])[1]
    assert len(near) > 500 and roots.keys() == want.keys()
    of = lambda r: sorted(sorted(x for x in r if r[x] == c) for c in set(r.values()))
    assert of(roots) == of(want)
