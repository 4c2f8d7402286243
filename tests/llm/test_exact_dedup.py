import hashlib
import re
from collections import defaultdict

import pytest

from spindrift.llm.exact_dedup import drop_exact_copies, exact_dedup


def brute(rows):
    key = [(hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t or "").encode()).hexdigest(), len(t or ""), i) for i, t in rows]
    groups = defaultdict(list)
    for k, n, i in key:
        groups[k].append((-n, i is None, i or 0, i))
    best = {k: min(g) for k, g in groups.items()}
    return sorted(((i, best[k][3], len(groups[k]), k) for k, n, i in key), key=str), len(groups)


@pytest.mark.parametrize("max_bits", [1 << 26, 1 << 12])
def test_equals_brute_force(odd, max_bits):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    want, groups = brute(rows)
    got = exact_dedup(odd, max_bits=max_bits).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == want
    assert sum(r.kept for r in got) == groups
    kept = drop_exact_copies(odd)
    assert kept.columns == odd.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(r.doc_id) for r in got if r.kept)


def test_empty(empty):
    assert exact_dedup(empty).count() == 0
    assert drop_exact_copies(empty).columns == empty.columns
