import random

from sparsewing.llm.graph import components
from tests.llm.brute import reach


def test_chains_stars_and_loops(spark):
    g = random.Random(3)
    edges = [(i, i + 1) for i in range(200)] + [(500 + i, 400) for i in range(50)] + [(700, 700), (800, 801), (801, 800), (None, 3)]
    edges += [(g.randrange(1000, 1300), g.randrange(1000, 1300)) for _ in range(180)]
    g.shuffle(edges)
    df = spark.createDataFrame(edges, "u long, v long")
    real = [e for e in edges if None not in e and e[0] != e[1]]
    want = reach({x for e in real for x in e}, real)
    assert {r.node: r.component for r in components(df).collect()} == want


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "u string, v string")).count() == 0
