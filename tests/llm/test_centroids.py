import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiquarry.llm import centroids
from lexiquarry.llm.centroids import Clustering, Step


def plain(rows, c):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == c.width and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(c.scale * x) for x in v]))
    if not kept:
        return [], set()

    def digest(i):
        return hashlib.sha256(f"{c.seed}:{i}".encode()).hexdigest()

    centres = [v for _, v in sorted(kept, key=lambda r: (r[0] is None, digest(r[0]), r[1]))[: c.clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), k) for k, m in enumerate(centres))

    for _ in range(c.rounds):
        own = [nearest(v)[1] for _, v in kept]
        for k in range(len(centres)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == k]
            if mine:
                centres[k] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    last = [(i, *nearest(v)) for i, v in kept]
    cluster = {}
    for _, d, k in last:
        cluster[k] = cluster.get(k, 0) + d
    total = sum(cluster.values())
    out = [(i, k, d, cluster[k], total, hashlib.sha256(",".join(map(str, centres[k])).encode()).hexdigest()) for i, d, k in last]
    return sorted(out, key=repr), set(cluster)


def clustered(spark, rows, c, kind="float"):
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], f"vec_id long, embedding array<{kind}>, cluster int, v string")
    return sorted((tuple(r) for r in centroids.assign(table, c).collect()), key=repr)


def vectors(seed, n, width, coarse=False):
    rng = random.Random(seed)
    if coarse:  # few values: many ties and repeated vectors
        return [(i, [rng.choice([-0.5, 0.0, 0.5, -1 / 1024]) for _ in range(width)]) for i in range(n)]
    return [(i, [rng.gauss(rng.choice([-2, 0, 2]), 0.5) for _ in range(width)]) for i in range(n)]


@pytest.mark.parametrize(("seed", "coarse", "c"), [(1, False, Clustering(7, 5, 2, 8)), (2, True, Clustering(9, 5, 2, 3)), (3, False, Clustering(1, 2, 2, 4)), (4, True, Clustering(40, 8, 3, 4)), (5, False, Clustering(5, 0, 2, 4))])
def test_equal_to_brute_force(spark, seed, coarse, c):
    rows = vectors(seed, 300, c.width, coarse)
    want, used = plain(rows, c)
    assert clustered(spark, rows, c, "double") == want
    if seed == 4:
        assert len(used) < 40  # some clusters stay empty


def test_odd_tables(spark):
    c = Clustering(4, 5, 2, 3)
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 1.0, -1.0]), (1, [0.5, 1.0, -1.0]), (2, None), (3, []), (4, [1.0, 2.0]), (5, [nan, 1.0, 1.0]), (6, [inf, 0.0, 0.0]), (7, [None, 0.0, 1.0]), (None, [9.0, 9.0, 9.0]), (8, [0.0, 0.0, 0.0]), (9, [-0.001, 0.0, 0.0])]
    assert clustered(spark, rows, c) == plain(rows, c)[0] and len(plain(rows, c)[0]) == 5
    assert clustered(spark, rows[2:8], c) == [] == clustered(spark, [], c)
    with pytest.raises(Exception, match="beyond"):
        clustered(spark, [(1, [1e30, 0.0, 0.0])], c)


def test_bounds_settle_only_what_is_certain():
    rng = np.random.default_rng(7)
    v = rng.integers(-60, 60, (3000, 4))
    centres = rng.integers(-60, 60, (12, 4))
    before = centres
    cluster, upper, lower = np.full(3000, -1), np.zeros(3000), np.zeros(3000)
    scanned = []
    for _ in range(12):
        cluster, upper, lower, n = Step(centres, before).moved(v, cluster, upper, lower)
        scanned.append(n)
        d = ((v[:, None] - centres) ** 2).sum(2)
        assert (cluster == d.argmin(1)).all()
        own = d[np.arange(len(v)), cluster]
        others = np.where(np.arange(12) == cluster[:, None], np.iinfo(np.int64).max, d).min(1)
        assert (upper >= np.sqrt(own)).all() and (lower <= np.sqrt(others) + 1e-9).all()
        before = centres
        centres = np.array([v[cluster == k].sum(0) // max((cluster == k).sum(), 1) if (cluster == k).any() else centres[k] for k in range(12)])
    assert scanned[0] == 3000 and scanned[-1] < 1000


def test_partitions_do_not_matter(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    one, many = ({tuple(r) for r in centroids.assign(t).collect()} for t in (table.coalesce(1), table.repartition(5, F.col("vec_id"))))
    assert one == many and len(one) > 40
