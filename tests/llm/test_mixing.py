import re
from collections import defaultdict

import pytest

from spindrift.llm.mixing import mix, mixed


def targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, out, free = 1.5 * sum(sizes.values()), {}, set(order)
    while free:
        rest = total - sum(out.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            out |= share
            break
        out |= {s: 2.0 * sizes[s] for s in over}
        free -= over
    return out


@pytest.mark.parametrize("which", ["odd", "documents"])
def test_targets_and_taken(which, request):
    df = request.getfixturevalue(which)
    rows = [(r.doc_id, r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in df.collect()]
    sizes, largest = defaultdict(int), defaultdict(int)
    for _, s, n in rows:
        sizes[s] += n
        largest[s] = max(largest[s], n)
    want = targets(sizes)
    got = mix(df).collect()
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(i), n) for i, _, n in rows)
    by_id = {(i, n): s for i, s, n in rows}
    taken = defaultdict(int)
    for r in got:
        s = by_id[r.doc_id, r.size]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s]) and 0 <= r.copies <= 2
        taken[s] += r.copies * r.size
    for s, n in taken.items():
        assert abs(n - want[s]) <= max(1, largest[s])


def test_reruns_agree_and_rows_repeat(documents):
    a, b = mix(documents), mix(documents.repartition(5))
    assert sorted(a.collect()) == sorted(b.collect())
    out = mixed(documents)
    assert out.columns == documents.columns and out.count() == sum(r.copies for r in a.collect())


def test_empty(empty):
    assert mix(empty).count() == 0 and mixed(empty).count() == 0


def test_inclusion_follows_each_documents_own_probability(spark):
    """Of many documents of one size, the share taken is near the expected copies; larger ones are taken more often; some words are certain."""
    rows = [(i, " ".join(["w"] * (1, 3, 20)[i % 3]), "ab"[i % 2]) for i in range(6000)]
    got = mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(5, 2), budget=0.8).collect()
    share = defaultdict(list)
    for r in got:
        share[r.source_size, r.target, r.size].append(r.copies)
    for source in {k[:2] for k in share}:
        weight = {s: (1 + (s.bit_length() - 1) / 4) ** 0.5 for s in (1, 3, 20)}
        each = {s: len(share[(*source, s)]) for s in weight}
        factor = source[1] / sum(each[s] * s * weight[s] for s in weight)
        for s in weight:
            want = min(2, factor * weight[s])
            error = 5 * (max(0.01, want % 1 * (1 - want % 1)) / each[s]) ** 0.5
            assert abs(sum(share[(*source, s)]) / each[s] - want) < error + 0.01, (source, s, want)


def test_mixed_agrees_with_mix_on_odd_rows(odd):
    want = defaultdict(int)
    for r in mix(odd).collect():
        want[r.doc_id, r.size] += r.copies
    got = defaultdict(int)
    out = mixed(odd)
    for r in out.collect():
        got[r.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))] += 1
    assert out.columns == odd.columns and dict(got) == {k: int(n) for k, n in want.items() if n}


def test_the_plan_of_the_last_step_stays_small(spark, documents):
    """Driver memory of the pipeline: documents are joined with one small table, not with two, and the rows on a cut are read from a table."""
    plan = mixed(documents)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") <= 8, plan.count("Join ")


def test_few_cells_meet_documents_in_one_join_and_many_give_the_same_rows(documents, monkeypatch):
    """Driver memory of the pipeline: while cells are few, a step joins documents with them once, not three times."""
    out = mixed(documents)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") <= 2
    few = sorted(mix(documents).collect())
    monkeypatch.setattr("spindrift.llm.mixing.FEW_CELLS", 0)
    assert sorted(mix(documents).collect()) == few
    assert sorted(r.doc_id for r in mixed(documents).collect()) == sorted(r.doc_id for r in out.collect())
