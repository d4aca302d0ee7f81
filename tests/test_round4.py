"""Findings of round 4 on the account operators."""

from itertools import combinations

from authscope.operators import graph


def test_clustering_broadcasts_nothing(spark):
    """the lists that go along the edges were broadcast by their file's size, which was a thousandth of theirs."""
    import random

    rng = random.Random(2)
    pairs = [(rng.randint(1, 40), rng.randint(1, 40) if i % 3 else 7) for i in range(300)] + [(5, None), (None, 6)]
    got = graph.clustering(spark.createDataFrame(pairs, "src long, dst long"))
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    near = {}
    for a, b in pairs:
        if a is not None and b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {n: (len(x), sum(b in near[a] for a, b in combinations(x, 2))) for n, x in near.items()}
    assert {r.account_id: (r.degree, r.triangles) for r in got.collect()} == want
    for r in got.collect():
        assert r.coefficient == round(2 * r.triangles / (r.degree * (r.degree - 1)), 4) if r.degree > 1 else r.coefficient == 0
