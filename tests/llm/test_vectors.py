"""Near-duplicate vectors against all pairs."""

import numpy as np
import pytest

from gradeloom.llm.embedding_dedup import near_vectors

KIND = "vec_id long, embedding array<float>, label int, rep int"


def all_pairs(rows):
    usable = {}
    for i, v, label, _ in rows:
        if i is not None and v is not None and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            usable[i] = (label, np.array(v, dtype=np.float32).astype(np.float64))
    links = {i: set() for i, *_ in rows}
    for a, (la, x) in usable.items():
        for b, (lb, y) in usable.items():
            if a != b and la == lb and len(x) == len(y) and (np.array_equal(x, y) or x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.98):
                links[a].add(b)
    return links


@pytest.mark.parametrize("clusters", [3, 40])
def test_links_equal_all_pairs(spark, clusters):
    rng = np.random.RandomState(clusters)
    centres = rng.normal(size=(clusters, 16))
    rows = []
    for i in range(1500):
        v = centres[rng.randint(clusters)] * rng.uniform(0.5, 3) + rng.normal(size=16) * rng.choice([0.02, 0.12, 0.2, 1.0])
        rows.append((i, v.astype(np.float32).tolist(), int(rng.randint(3)), 0))
    rows += [(2000 + i, rows[5][1], rows[5][2], 0) for i in range(30)]
    rows += [(3000, None, 1, 0), (3001, [0.0] * 16, 1, 0), (3002, [1.0] * 15 + [None], 1, 0), (3003, [float("nan")] * 16, 1, 0), (3004, rows[0][1], None, 0),
             (3005, [float("inf")] + [1.0] * 15, 1, 0), (3006, [], 1, 0), (3007, [1.0], 1, 0), (3008, [2.0], 1, 0), (3009, [1e-30] * 16, 1, 0), (3010, [2e-30] * 16, 1, 0)]
    links = all_pairs(rows)
    got = {r.vec_id: r for r in near_vectors(spark.createDataFrame(rows, KIND).repartition(4)).collect()}
    assert {i: r.n_links for i, r in got.items()} == {i: len(x) for i, x in links.items()}
    seen = {}
    for i in sorted(links):
        if i not in seen:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen[x] = i
                    todo += links[x]
    assert {i: r.component_id for i, r in got.items()} == seen
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_odd_tables(spark):
    assert near_vectors(spark.createDataFrame([], KIND)).count() == 0
    got = near_vectors(spark.createDataFrame([(1, None, 1, 0), (2, [0.0], 1, 0)], KIND)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == [(1, 0, 1, True), (2, 0, 2, True)]
