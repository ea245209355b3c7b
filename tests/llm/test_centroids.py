import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetplan.llm.centroids import Search, cluster_vectors
from fleetplan.llm.queries import op12_centroids


def brute(rows, clusters=16, rounds=3, d=64):
    """rows: (vec_id, list or None). Returns sorted reprs of the query's rows."""
    kept = [(k, [max(-(2**27), min(2**27, math.floor(64 * float(x)))) for x in v]) for k, v in rows
            if v is not None and len(v) == d and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), np.array(r[1], "<i8").tobytes()))
    centres = [list(v) for _, v in order[:clusters]]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [min((distance(v, c), i) for i, c in enumerate(centres)) for _, v in kept]
    for _ in range(rounds if kept else 0):
        own = assign()
        for i in range(len(centres)):
            mine = [v for (_, v), (_, c) in zip(kept, own) if c == i]
            if mine:
                centres[i] = [sum(x) // len(mine) for x in zip(*mine)]
    own = assign()
    total = sum(x for x, _ in own)
    inertia = lambda c: sum(x for x, i in own if i == c)
    sha = lambda c: hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()
    return sorted(repr((k, c, x, inertia(c), total, sha(c))) for (k, _), (x, c) in zip(kept, own))


def query(spark, tmp_path, rows, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>").withColumn("cluster", F.lit("x")).withColumn("v", F.lit(0))
    df.repartition(4).write.parquet(str(tmp_path / "embeddings.parquet"))
    found = op12_centroids(spark, str(tmp_path))
    return sorted(repr(tuple(r)) for r in found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect())


def test_whole_clustering(spark, tmp_path):
    rng = random.Random(3)
    half = lambda: [rng.randint(-40, 40) / 64 for _ in range(64)]
    rows = [(i, half()) for i in range(120)]
    same = [0.25] * 64
    rows += [(200 + i, same) for i in range(60)]  # ties and copies
    rows += [(5, rows[5][1])] * 3 + [(5, same), (None, half()), (None, None), (300, None), (301, [0.5] * 63), (302, []), (303, [None] + same[1:])]
    rows += [(304, [float("nan")] + same[1:]), (305, [float("inf")] + same[1:]), (306, [-0.015625] * 64), (307, [-1e-9] + [0.0] * 63)]
    assert query(spark, tmp_path, rows, "double") == brute(rows)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [0.5] * 64)], [(1, [3e38] * 64), (2, [-3e38] * 64), (3, [1e6] * 64), (4, [1.0] * 64)], [(9, [0.1] * 64)] * 40])
def test_few_vectors(spark, tmp_path, rows):
    rows = [(k, None if v is None else [float(np.float32(x)) for x in v]) for k, v in rows]
    assert query(spark, tmp_path, rows) == brute(rows)


@pytest.mark.parametrize("seed", range(4))
def test_search_is_exact_and_rejects(seed):
    rng = np.random.default_rng(seed)
    scale = [3, 50, 2**20, 2**27][seed]
    shift = rng.integers(-scale, scale, (400, 1)) // 2
    vectors = np.clip(rng.integers(-scale, scale + 1, (400, 64)) // 2 + shift, -(2**27), 2**27)
    centres = np.concatenate([vectors[:20], vectors[:4], vectors[30:40]])
    number, best, computed = Search(centres).nearest(vectors)
    every = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, c)) for c in centres] for v in vectors]
    assert best.tolist() == [min(row) for row in every]
    assert number.tolist() == [row.index(min(row)) for row in every]
    assert computed < len(vectors) * len(centres) * 0.8


def test_other_sizes(spark):
    rows = [(i, [float(i % 5), float(i)]) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    vectors, clusters = cluster_vectors(df, clusters=3, rounds=2, dimensions=2, scale=1)
    assert vectors.count() == 50 and clusters.agg(F.sum("n")).first()[0] == 50
