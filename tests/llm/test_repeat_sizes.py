"""Planted passages on both sides of 400 bytes: what is removed of each size, and that clean documents stay whole."""

import hashlib
import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))

from spiketide.llm import suffixes

rng = np.random.default_rng(8)


def prose(size):
    """Words of random letters, so many bytes; no two of these share long strings."""
    words, n = [], 0
    while n <= size:
        words.append("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(3, 9))))
        n += len(words[-1]) + 1
    return " ".join(words)[:size]


@pytest.mark.parametrize("sizes", [(250, 350, 399, 400, 401, 500, 800, 2000)])
def test_passages_go_from_400_bytes_on(spark, sizes):
    rows, passages, clean = [], {}, {}
    for k, size in enumerate(sizes):
        passage = prose(size)
        for copy in range(5):
            doc = 100 * k + copy
            before, after = prose(int(rng.integers(100, 900))) + f"{copy}|", f"|{copy}" + prose(int(rng.integers(100, 900)))
            rows.append((doc, before + passage + after))
            passages[doc] = (size, before, after)
    for k in range(40):
        clean[10_000 + k] = prose(int(rng.integers(50, 3000)))
    rows += list(clean.items())
    found = {r["id"]: r for r in suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), digest=True).collect()}
    for doc, (size, before, after) in passages.items():
        # the bars around a passage are the same in all copies and belong to it, two bytes more; the digits beyond differ
        whole = size + 2 >= 400
        assert found[doc]["n_removed"] == (size + 2 if whole else 0), (size, found[doc])
        kept = before[:-1] + after[1:] if whole else dict(rows)[doc]
        assert found[doc]["kept_sha256"] == hashlib.sha256(kept.encode()).hexdigest()
    assert all(found[d]["n_removed"] == 0 and found[d]["n_spans"] == 0 for d in clean)
