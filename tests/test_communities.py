import random

from lexmill.operators import graph as g


def planted(groups=5, size=9, seed=3):
    """Edges of dense groups with a few links between them."""
    rng, out = random.Random(seed), []
    names = [f"{c}{i}" for c in "vwxyz"[:groups] for i in range(size)]
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if rng.random() < (0.7 if a[0] == b[0] else 0.05):
                out.append((a, b, rng.randrange(1, 5)))
    return out


def test_communities_do_not_depend_on_the_size(spark, monkeypatch):
    edges = spark.createDataFrame(planted(), "a string, b string, w int")
    small = {r["node"]: r["community"] for r in g.communities(edges).collect()}
    monkeypatch.setattr(g, "COMMUNITY_EDGES", 1)
    large = {r["node"]: r["community"] for r in g.communities(edges).collect()}
    assert small == large == g.louvain(planted())
    assert small == {x: x[0] + "0" for x in small}


def test_rings_settle():
    ring = [(i, (i + 1) % 60, 1) for i in range(60)]
    found = g.louvain(ring)
    assert 4 <= len(set(found.values())) <= 20 and g.louvain(ring[::-1]) == found
