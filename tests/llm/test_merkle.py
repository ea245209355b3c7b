import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from fleetplan.llm import merkle
from fleetplan.llm.queries import op11_merkle

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    doc_id, text, lang, source, n_chars = row
    return sha("".join(map(part, [doc_id, source, lang, n_chars, text])))


def climb(nodes):
    """Root of a list of digests, and for each the (left, right) siblings of each level."""
    paths = [[] for _ in nodes]
    members = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(i, min(i + 8, len(nodes))) for i in range(0, len(nodes), 8)]
        for run in runs:
            for i in run:
                step = "".join(nodes[j] for j in run if j < i), "".join(nodes[j] for j in run if j > i)
                for m in members[i]:
                    paths[m].append(step)
        members = [[m for i in run for m in members[i]] for run in runs]
        nodes = [sha("".join(nodes[i] for i in run)) for run in runs]
    return nodes[0] if nodes else None, paths


def brute(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
    trees = [climb([leaf_of(r) for r in groups[g]]) for g in order]
    root, tops = climb([t[0] for t in trees])
    out = []
    for g, (subroot, paths), top in zip(order, trees, tops):
        for row, path in zip(groups[g], paths):
            path = path + top
            tampered = row[0] is not None and row[1] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0
            text = row[1].translate({i: i + 32 for i in range(65, 91)}) if tampered else row[1]
            h = leaf_of((row[0], text, *row[2:]))
            for left, right in path:
                h = sha(left + h + right)
            out.append((row[0], leaf_of(row), subroot, root, sha("".join(a + b for a, b in path)), h, h == root))
    return sorted(map(repr, out))


def texts(n, lang):
    return [(i, f"Text {i} of É" if i % 3 else f"text {i}", lang, None if i % 4 else "web", i if i % 5 else None) for i in range(n)]


ROWS = [
    *texts(75, "en"), *texts(8, "de"), *texts(9, None), *texts(1, "fr"), *texts(65, ""), *texts(2, "é"), *texts(3, "z"), *texts(2, "Z"), *texts(1, "aa"),
    (None, "No Key", "en", "x", 1), (None, "No Key", "en", "x", 1), (None, None, None, None, None),
    (3, "Other text", "en", None, 3), (3, "Other text", "en", None, 3), (10**18, "A" * 200_000, "en", "long", 200_000), (-5, "", "en", "empty", 0),
]


def digest(proofs):
    found = proofs.withColumn("folded_root", merkle.folded(F.coalesce("tampered", "leaf"), F.col("siblings")))
    rows = found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("siblings")), "folded_root", F.col("folded_root") == F.col("root")).collect()
    return sorted(repr(tuple(r)) for r in rows)


@pytest.mark.parametrize("digits", [1, 4])
def test_proofs_equal_a_plain_tree(spark, digits):
    docs = spark.createDataFrame(ROWS, SCHEMA).withColumn("tree", F.lit(1)).withColumn("h", F.lit("x")).withColumn("leaf", F.lit(2)).repartition(5)
    changed = [F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz") if c == "text" else F.col(c) for c in merkle.FIELDS]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, merkle.leaf_hash(changed))
    made = merkle.manifest(docs, carried={"tampered": tampered}, digits=digits)
    assert digest(made.proofs()) == brute(ROWS)
    assert made.subroots().count() == len({r[2] for r in ROWS}) and made.root().count() == 1


@pytest.mark.parametrize("rows", [[], [(1, "One", "en", "s", 3)], [(7, "Same", "en", "s", 4)] * 70])
def test_small_tables(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(repr(tuple(r)) for r in op11_merkle(spark, str(tmp_path)).collect())
    assert got == (brute(rows) if rows else [])
