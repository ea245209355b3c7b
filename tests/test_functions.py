import hashlib

import pytest
from pyspark.sql import functions as F

from fleetplan.functions import (
    format_mib,
    format_millicores,
    image_hash,
    is_quantity,
    parse_dependency_csv,
    parse_mib,
    parse_millicores,
    pod_name,
)
from fleetplan.functions.frames import prefix_sums
from fleetplan.functions.numbering import positions

# text, millicores, MiB
QUANTITIES = [
    ("500m", 500, 0),
    ("1", 1000, 0),
    ("1.5", 1500, 0),
    ("0.1", 100, 0),
    (".5", 500, 0),
    ("2.", 2000, 0),
    ("100u", 1, 0),
    ("1n", 1, 0),
    ("0", 0, 0),
    ("512Mi", 536870912000, 512),
    ("2Gi", 2147483648000, 2048),
    ("1e3", 1000000, 0),
    ("1E3", 1000000, 0),
    ("5M", 5000000000, 4),
    ("1048576", 1048576000, 1),
    ("1048575", 1048575000, 0),
    ("128974848", 128974848000, 123),
    ("1.5Gi", 1610612736000, 1536),
    ("1Ki", 1024000, 0),
    ("1Ti", 1099511627776000, 1048576),
    ("bad", None, None),
    ("", None, None),
    ("1 Gi", None, None),
    ("1e1.5", None, None),
    ("Mi", None, None),
    (None, None, None),
]


@pytest.mark.parametrize("text, cpu, mem", QUANTITIES)
def test_quantity(spark, text, cpu, mem):
    df = spark.createDataFrame([(text,)], "q string")
    row = df.select(parse_millicores(F.col("q")), parse_mib(F.col("q"))).first()
    assert tuple(row) == (cpu, mem)


def test_quantity_beyond_long_is_null(spark):
    df = spark.createDataFrame([("9999999E",), ("999999999999999999999999999999",)], "q string")
    rows = df.select(parse_millicores(F.col("q")), parse_mib(F.col("q"))).collect()
    assert all(r[0] is None and r[1] is None for r in rows)


def test_is_quantity_follows_the_grammar(spark):
    df = spark.createDataFrame([("500m", True), ("+1.5e3", True), ("1K", False), ("x", False)], "q string, ok boolean")
    assert all(r.ok == r.got for r in df.select("ok", is_quantity(F.col("q")).alias("got")).collect())


def test_format_and_names(spark):
    df = spark.createDataFrame([(250, "Wf", "Task-A")], "n long, w string, t string")
    row = df.select(
        format_millicores(F.col("n")), format_mib(F.col("n")), pod_name(F.col("w"), F.col("t"))
    ).first()
    assert tuple(row) == ("250m", "250Mi", "wf-task-a")


def test_image_hash(spark):
    images = ["alpine:latest", "busybox", "ünï/code:1", ""]
    df = spark.createDataFrame([(i,) for i in images], "i string")
    expected = [int(hashlib.sha256(i.encode()).hexdigest()[:8], 16) / 16**8 for i in images]
    assert [r[0] for r in df.select(image_hash(F.col("i"))).collect()] == expected


def test_dependency_csv(spark):
    df = spark.createDataFrame([("a, b",), ("",), (None,), (" a ,, b,",)], "s string")
    got = [r[0] for r in df.select(parse_dependency_csv(F.col("s"))).collect()]
    assert got == [["a", "b"], [], [], ["a", "b"]]


def test_prefix_sums_across_cells(spark):
    rows = [(k, i, (i * 7 + k) % 11) for k in (1, 2) for i in range(50)]
    df = spark.createDataFrame(rows, "k int, i int, v long").repartition(5)
    df = df.withColumn("cell", F.floor(F.col("i") / 4))
    got = {(r.k, r.i): r.before for r in prefix_sums(df, ["k"], "cell", ["i"], {"before": "v"}).collect()}
    for k in (1, 2):
        total = 0
        for _, i, v in [r for r in rows if r[0] == k]:
            assert got[k, i] == total
            total += v


def test_positions_with_a_hot_key(spark):
    """One key holds most rows and is numbered in several ranges."""
    rows = [(0, (i * 37) % 1000, i) for i in range(1000)] + [(k, j, j) for k in range(1, 30) for j in range(5)]
    df = spark.createDataFrame(rows, "key int, a int, b int").repartition(7)
    got = positions(df, "key", ["a", "b"], max_group=100).collect()
    assert len(got) == len(rows)
    for key in range(30):
        mine = sorted((r.a, r.b, r.idx) for r in got if r.key == key)
        assert [m[2] for m in mine] == list(range(len(mine)))
    plain = positions(df, "key", ["a", "b"], max_group=10_000).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, plain))
