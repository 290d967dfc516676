import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import itq, segment_search

SCHEMA = "vec_id long, embedding array<float>, label int, id string, code string, dim string"


def vectors(seed, count=400, length=32, labels=3):
    random = np.random.default_rng(seed)
    centres = random.standard_normal((count // 8, length))
    rows = []
    for i in range(count):
        vector = centres[random.integers(len(centres))] + random.standard_normal(length) * random.choice([0.02, 0.15, 0.3])
        rows.append((i, vector.astype("f4").tolist(), int(random.integers(labels)), "x", "y", "z"))
    return rows


ODD = [
    (900, None, 1), (901, [], 1), (902, [0.0] * 32, 1), (903, [1.0, None] * 16, 1), (904, [float("nan")] * 32, 1), (905, [float("inf")] * 32, 1),
    (906, [1.0] * 32, None), (907, [1.0] * 32, 1), (908, [1.0] * 32, 1), (909, [2.0] * 32, 1), (910, [1.0] * 31, 1), (911, [1e-30] * 32, 1), (908, [1.0] * 32, 1), (None, [1.0] * 32, 1),
]


def test_links_of_vectors(spark, frame):
    rows = vectors(1)
    found = {r.vec_id: r for r in itq.link_vectors(frame(rows, SCHEMA)).collect()}
    units = np.array([v[1] for v in rows], float)
    units /= np.linalg.norm(units, axis=1)[:, None]
    labels = np.array([v[2] for v in rows])
    linked = (units @ units.T >= 0.93) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(linked, False)
    counts = np.array([found[i].n_links for i in range(len(rows))])
    assert (counts <= linked.sum(1)).all() and counts.sum() >= 0.9 * linked.sum() > 100
    for i, row in found.items():
        assert row.kept == (row.component_id == i) and row.component_id <= i and (row.n_links > 0 or row.kept)


def test_links_of_odd_vectors(spark, frame):
    found = {r.vec_id: (r.n_links, r.component_id) for r in itq.link_vectors(frame([(*r, "x", "y", "z") for r in ODD], SCHEMA)).collect()}
    assert len(found) == 12 and None not in found
    for i in (907, 908, 909, 911):
        assert found[i] == (3, 907)
    for i in (900, 901, 902, 903, 904, 905, 906, 910):
        assert found[i] == (0, i)
    assert itq.link_vectors(frame([], SCHEMA)).count() == 0


def test_a_group_of_copies_larger_than_a_cell(spark, frame):
    random = np.random.default_rng(4)
    base = random.standard_normal(32)
    rows = [(i, (base + random.standard_normal(32) * 0.01).astype("f4").tolist(), 1, "x", "y", "z") for i in range(300)]
    found = itq.link_vectors(frame(rows, SCHEMA), cell=64).collect()
    assert all(r.n_links == 299 and r.component_id == 0 for r in found)


@pytest.mark.parametrize("scale", [1.0, 40.0, 1e17])
def test_top_k_is_exact(spark, frame, scale):
    rows = [(i, (np.array(v) * scale).astype("f4").tolist(), *rest) for i, v, *rest in vectors(2, 300)] + [(1000 + i, [0.5] * 32, 1, "x", "y", "z") for i in range(9)]
    found = segment_search.top_inner_products(frame(rows, SCHEMA), F.col("vec_id") % 50 == 0, queries_per_block=4, rows_per_block=16).collect()
    whole = {i: [int(np.floor(256.0 * float(np.float32(x)))) for x in v] for i, v, *_ in rows}
    expected = []
    for q in whole:
        if q % 50 == 0:
            scores = [(-min(max(sum(a * b for a, b in zip(whole[q], whole[i])), -(2**63)), 2**63 - 1), i) for i in whole if i != q]
            expected += [(q, rank, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:5], 1)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found) == sorted(expected)


def test_top_k_of_odd_vectors(spark, frame):
    rows = [(*r, "x", "y", "z") for r in ODD] + [(950, [1.0] * 32, 1, "x", "y", "z")]
    found = segment_search.top_inner_products(frame(rows, SCHEMA), F.col("vec_id") % 50 == 0).collect()
    assert {r.query_id for r in found} == {950}
    assert [(r["rank"], r.vec_id) for r in sorted(found, key=lambda r: r["rank"])] == [(1, 909), (2, 906), (3, 907), (4, 908), (5, 902)]
    assert segment_search.top_inner_products(frame([], SCHEMA), F.col("vec_id") % 50 == 0).count() == 0


def test_bounds_hold():
    random = np.random.default_rng(6)
    a, b = random.integers(-300, 300, (40, 30)).astype(float), random.integers(-300, 300, (50, 30)).astype(float)
    last = np.full((40, 50), np.inf)
    for n in (1, 3, 15, 30):
        bound = segment_search.statistics(a, n) @ segment_search.statistics(b, n).T
        assert (bound >= a @ b.T - 1e-6).all() and (bound <= last + 1e-6).all()
        last = bound


@pytest.mark.parametrize("size", [16, 32])
def test_links_just_above_the_bound_in_few_dimensions(spark, frame, size):
    random = np.random.default_rng(size)
    rows = []
    for i in range(600):
        a, b = np.linalg.qr(random.standard_normal((size, 2)))[0].T
        rows += [(2 * i, a.tolist(), str(i)), (2 * i + 1, (0.932 * a + (1 - 0.932**2) ** 0.5 * b).tolist(), str(i))]
    found = itq.link_vectors(frame(rows, "vec_id long, embedding array<double>, label string")).collect()
    assert sum(r.n_links for r in found) >= 2 * 600 * 0.95
