"""Largest path values of any number of directed graphs at once, in few rounds.

The value of a node is the largest of its own base and of value + weight over its incoming arcs. Walking along the
arcs would take as many rounds as the graph is deep. Instead nodes are eliminated: a node goes, and each pair of an arc into
it and an arc out of it becomes one arc whose weight is their sum (of equal arcs the heaviest stays). A round
eliminates all nodes without arcs in (their value is known), all without arcs out (they wait for the others),
and of the remaining ones an independent set, chosen by the smallest hash among neighbours, of those whose elimination
hardly adds arcs. So a chain shrinks by a third in each round, wherever its tasks stand in the document. Eliminated nodes
get their values in the opposite order. A graph of few nodes is closed inside one row.

Weights and values are decimals, so sums do not depend on their order. A node on or behind a cycle has no largest value; it
is ``ENDLESS``. Where only the largest base among the ancestors is asked (weights 0), cycles do no harm.

Each round is stored; a hot node or graph is spread by keys of graph and node.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetplan.functions.exact import VALUE
from fleetplan.session import shared_dir, stage

#: Stands for no value; values stay below half of it.
ENDLESS = 10**18
#: Nodes of a graph that is closed inside one row.
CLOSE_NODES = 256
#: A node may be replaced by so many arcs, or by as many as it has.
FILL = 16

_GRAPH = "wf_id"


def is_endless(value: Column) -> Column:
    return value > ENDLESS // 2


def _plus(a: Column, b: Column) -> Column:
    return (a + b).cast(VALUE)


def _endless() -> Column:
    return F.lit(ENDLESS).cast(VALUE)


def _merged(arcs: DataFrame) -> DataFrame:
    return arcs.groupBy(_GRAPH, "src", "dst").agg(F.max("w").alias("w"))


def solve(nodes: DataFrame, arcs: DataFrame, cyclic: bool = True, close: int = CLOSE_NODES) -> DataFrame:
    """(wf_id, node, value) for nodes (wf_id, node, base) and arcs (wf_id, src, dst, w) between them.

    With ``cyclic`` the values of nodes on or behind cycles are ``ENDLESS``; without it weights must be 0 and cycles
    add nothing.
    """
    spark = nodes.sparkSession
    root = f"{shared_dir(spark)}/staged/{spark.sparkContext.applicationId}/values-{uuid.uuid4().hex}"
    parts = 0

    def keep(values: DataFrame) -> None:
        nonlocal parts
        values.select(_GRAPH, "node", F.col("value").cast(VALUE).alias("value")).write.parquet(f"{root}/part={parts}")
        parts += 1

    def kept() -> DataFrame:
        return spark.read.schema(nodes.select(_GRAPH, "node", F.lit(0).cast(VALUE).alias("value"), F.lit(0).alias("part")).schema).parquet(root).drop("part")

    nodes = stage(nodes.select(_GRAPH, "node", F.col("base").cast(VALUE).alias("base")), "nodes")
    nodes, arcs = _without_loops(nodes, _merged(arcs.select(_GRAPH, "src", "dst", F.col("w").cast(VALUE).alias("w"))), cyclic)
    waiting: list[tuple[DataFrame, DataFrame]] = []
    while True:
        sizes = stage(nodes.groupBy(_GRAPH).agg(F.count("*").alias("n")), "sizes")
        least, most = sizes.agg(F.min("n"), F.max("n")).first()
        if most is None:
            break
        if least <= close:
            small = sizes.where(F.col("n") <= close).select(_GRAPH)
            keep(_closed(nodes.join(small, _GRAPH, "left_semi"), arcs.join(small, _GRAPH, "left_semi"), cyclic))
            if most <= close:
                break
            nodes, arcs = (stage(df.join(small, _GRAPH, "left_anti"), "large-graphs") for df in (nodes, arcs))
        chosen, tagged = _chosen(nodes, arcs, len(waiting))
        keep(chosen.where("kind = 'source'").withColumnRenamed("base", "value"))
        waiting.append((chosen.where("kind <> 'source'").drop("kind"), tagged.where("dst_kind IN ('sink', 'inner')").select(_GRAPH, "src", F.col("dst").alias("node"), "w")))
        nodes, arcs = _reduced(nodes, chosen, tagged, cyclic)
    for own, into in reversed(waiting):
        known = kept().select(_GRAPH, F.col("node").alias("src"), "value")
        heard = into.join(known, [_GRAPH, "src"]).groupBy(_GRAPH, "node").agg(F.max(_plus(F.col("value"), F.col("w"))).alias("heard"))
        keep(own.join(heard, [_GRAPH, "node"], "left").withColumn("value", F.greatest("base", "heard")))
    values = kept() if parts else nodes.withColumnRenamed("base", "value")
    return values.withColumn("value", F.when(is_endless(F.col("value")), _endless()).otherwise(F.col("value"))) if cyclic else values


def _without_loops(nodes: DataFrame, arcs: DataFrame, cyclic: bool) -> tuple[DataFrame, DataFrame]:
    """A node with an arc to itself is endless, whatever leads to it."""
    arcs = stage(arcs, "arcs")
    loops = arcs.where("src = dst").select(_GRAPH, F.col("dst").alias("node"))
    if loops.isEmpty():
        return nodes, arcs
    if not cyclic:
        return nodes, arcs.where("src <> dst")
    marked = nodes.join(loops.withColumn("loop", F.lit(True)), [_GRAPH, "node"], "left")
    nodes = marked.select(_GRAPH, "node", F.when(F.col("loop"), _endless()).otherwise(F.col("base")).alias("base"))
    arcs = arcs.join(loops.withColumnRenamed("node", "dst"), [_GRAPH, "dst"], "left_anti").select(_GRAPH, "src", "dst", "w")
    return stage(nodes, "nodes"), stage(arcs, "arcs")


def _chosen(nodes: DataFrame, arcs: DataFrame, round_: int) -> tuple[DataFrame, DataFrame]:
    """The nodes to eliminate (wf_id, node, base, kind), and the arcs with the kinds of both ends."""
    ends = arcs.select(_GRAPH, F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o"))
    ends = ends.unionByName(arcs.select(_GRAPH, F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    degrees = ends.groupBy(_GRAPH, "node").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    i, o = F.coalesce("i", F.lit(0)), F.coalesce("o", F.lit(0))
    kind = F.when(i == 0, "source").when(o == 0, "sink").when(i * o <= F.greatest(i + o, F.lit(FILL)), "inner")
    # an inner node goes only if no neighbour goes; nodes at the ends go in any case
    rank = F.when(F.col("kind") == "inner", F.xxhash64(_GRAPH, "node", F.lit(round_))).when(F.col("kind").isNotNull(), F.lit(-(1 << 63)))
    marked = nodes.join(degrees, [_GRAPH, "node"], "left").select(_GRAPH, "node", "base", kind.alias("kind"))
    marked = stage(marked.where("kind IS NOT NULL").withColumn("rank", rank), "marked")
    ranks = marked.select(_GRAPH, "node", "rank")
    about = lambda own, other: arcs.select(_GRAPH, F.col(own).alias("asks"), F.col(other).alias("node")).join(ranks, [_GRAPH, "node"]).select(_GRAPH, F.col("asks").alias("node"), F.col("rank").alias("near"))
    near = about("dst", "src").unionByName(about("src", "dst")).groupBy(_GRAPH, "node").agg(F.min("near").alias("near"))
    beside = marked.join(near, [_GRAPH, "node"], "left")
    first = (F.col("kind") != "inner") | F.col("near").isNull() | (F.col("rank") < F.col("near"))
    chosen = stage(beside.where(first).select(_GRAPH, "node", "base", "kind"), "chosen")
    end = lambda name, base: chosen.select(_GRAPH, F.col("node").alias(name), F.col("kind").alias(f"{name}_kind"), *([F.col("base").alias("src_base")] if base else []))
    tagged = arcs.join(end("src", True), [_GRAPH, "src"], "left").join(end("dst", False), [_GRAPH, "dst"], "left")
    return chosen, stage(tagged.select(_GRAPH, "src", "dst", "w", "src_kind", "src_base", "dst_kind"), "tagged")


def _reduced(nodes: DataFrame, chosen: DataFrame, tagged: DataFrame, cyclic: bool) -> tuple[DataFrame, DataFrame]:
    """What is left without the chosen nodes."""
    into = tagged.where("dst_kind = 'inner'").select(_GRAPH, "src", F.col("dst").alias("via"), F.col("w").alias("w_in"))
    out = tagged.where("src_kind = 'inner'").select(_GRAPH, F.col("src").alias("via"), "dst", "w")
    through = into.join(out, [_GRAPH, "via"]).select(_GRAPH, "src", "dst", _plus(F.col("w_in"), F.col("w")).alias("w"))
    left = tagged.where("src_kind IS NULL AND dst_kind IS NULL").select(_GRAPH, "src", "dst", "w")
    told = tagged.where("src_kind IS NOT NULL AND dst_kind IS NULL")
    told = told.groupBy(_GRAPH, F.col("dst").alias("node")).agg(F.max(_plus(F.col("src_base"), F.col("w"))).alias("told"))
    rest = nodes.join(chosen.select(_GRAPH, "node"), [_GRAPH, "node"], "left_anti").join(told, [_GRAPH, "node"], "left")
    rest = stage(rest.select(_GRAPH, "node", F.greatest("base", "told").alias("base")), "nodes")
    return _without_loops(rest, _merged(left.unionByName(through)), cyclic)


def gathered(nodes: DataFrame, arcs: DataFrame, columns: list[str]) -> DataFrame:
    """One row (wf_id, queue) for each graph: its nodes in order, with ``columns`` and ``ins``, the places and weights of
    what leads to them. For graphs of few nodes."""
    ins = arcs.groupBy(_GRAPH, F.col("dst").alias("node")).agg(F.collect_list(F.struct("src", "w")).alias("ins"))
    body = F.struct("node", *columns, "ins")
    rows = nodes.join(ins, [_GRAPH, "node"], "left").groupBy(_GRAPH).agg(F.sort_array(F.collect_list(body)).alias("queue"))
    place = lambda a: F.struct((F.array_position(F.col("ids"), a["src"]) - 1).cast("int").alias("p"), a["w"].alias("w"))
    none = F.array().cast(f"array<struct<p:int,w:{VALUE}>>")
    placed = F.transform("queue", lambda t: F.struct(t["node"].alias("node"), *[t[c].alias(c) for c in columns], F.coalesce(F.transform(t["ins"], place), none).alias("ins")))
    return rows.withColumn("ids", F.col("queue.node")).select(_GRAPH, placed.alias("queue"))


def _closed(nodes: DataFrame, arcs: DataFrame, cyclic: bool) -> DataFrame:
    """Values of small graphs, by sweeps over all nodes inside a row. A node that is still reached by as many arcs as
    there are nodes lies on or behind a cycle."""
    rows = gathered(nodes, arcs, ["base"])
    item = f"struct<v:{VALUE},hops:int>"
    start = F.struct(
        F.transform("queue", lambda t: F.struct(t["base"].alias("v"), F.lit(0).alias("hops")).cast(item)).alias("at"), F.lit(True).alias("moved")
    )

    def swept(at: Column) -> Column:
        def step(t: Column) -> Column:
            heard = F.transform(t["ins"], lambda a: F.struct(_plus(F.get(at, a["p"])["v"], a["w"]).alias("v"), (F.get(at, a["p"])["hops"] + 1).alias("hops")).cast(item))
            best = F.array_max(F.transform(heard, lambda h: h["v"]))
            hops = F.coalesce(F.array_max(F.transform(heard, lambda h: h["hops"])), F.lit(0))
            return F.struct(F.greatest(t["base"], best).alias("v"), hops.alias("hops")).cast(item)

        return F.transform("queue", step)

    def sweep(state: Column, _: Column) -> Column:
        new = swept(state["at"])
        return F.when(state["moved"], F.struct(new.alias("at"), (new != state["at"]).alias("moved"))).otherwise(state)

    done = F.aggregate(F.sequence(F.lit(1), F.size("queue")), start, sweep)["at"]
    solved = rows.select(_GRAPH, F.size("queue").alias("n"), F.arrays_zip("queue", done.alias("at")).alias("all"))
    solved = solved.select(_GRAPH, "n", F.explode_outer("all").alias("t"))
    value = F.col("t.at.v")
    if cyclic:
        value = F.when(F.col("t.at.hops") >= F.col("n"), _endless()).otherwise(value)
    return solved.select(_GRAPH, F.col("t.queue.node").alias("node"), value.alias("value"))


def on_cycles(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    """The nodes (wf_id, node) that lie on a cycle, for graphs of any size: strongly connected components.

    Nodes that no cycle leads to, or that lead to none, are trimmed. Then each node takes the largest random number among its
    ancestors as its colour; the node that the number is from, and all of its colour that lead to it, are one component. What is left
    goes around again: components in a row are told apart in rounds whose number grows with the logarithm of theirs.
    """
    zero = F.lit(0).cast(VALUE)
    nodes = stage(nodes.select(_GRAPH, "node"), "graph-nodes")
    arcs = stage(arcs.select(_GRAPH, "src", "dst").distinct().withColumn("w", zero), "graph-arcs")
    back = lambda df: df.select(_GRAPH, F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    found = nodes.limit(0)
    round_ = 0
    while True:
        for way in (lambda df: df, back):
            solved = solve(nodes.withColumn("base", zero), way(arcs))
            nodes = stage(solved.where(is_endless(F.col("value"))).select(_GRAPH, "node"), "cyclic")
            arcs = stage(_among(arcs, nodes), "cyclic-arcs")
        if nodes.isEmpty():
            return found
        number = F.pmod(F.xxhash64(_GRAPH, "node", F.lit(round_)), F.lit(1 << 29)) * F.lit(1 << 31) + F.col("node")
        numbered = stage(nodes.withColumn("base", number.cast(VALUE)), "numbered")
        colours = stage(solve(numbered, arcs, cyclic=False).withColumnRenamed("value", "colour").join(numbered, [_GRAPH, "node"]), "colours")
        end = lambda name: colours.select(_GRAPH, F.col("node").alias(name), F.col("colour").alias(f"{name}_colour"))
        same = arcs.join(end("src"), [_GRAPH, "src"]).join(end("dst"), [_GRAPH, "dst"]).where("src_colour = dst_colour").select(_GRAPH, "src", "dst", "w")
        roots = colours.select(_GRAPH, "node", F.when(F.col("colour") == F.col("base"), 1).otherwise(0).cast(VALUE).alias("base"))
        members = stage(solve(roots, back(same), cyclic=False).where("value > 0").select(_GRAPH, "node").join(colours, [_GRAPH, "node"]), "members")
        loops = arcs.where("src = dst").select(_GRAPH, F.col("src").alias("node"), F.lit(True).alias("loop"))
        sized = members.join(members.groupBy(_GRAPH, "colour").agg(F.count("*").alias("n")), [_GRAPH, "colour"]).join(loops, [_GRAPH, "node"], "left")
        found = stage(found.unionByName(sized.where("n > 1 OR loop").select(_GRAPH, "node")), "on-cycles")
        nodes = stage(nodes.join(members, [_GRAPH, "node"], "left_anti"), "left-nodes")
        arcs = stage(_among(arcs, nodes), "left-arcs")
        round_ += 1


def _among(arcs: DataFrame, nodes: DataFrame) -> DataFrame:
    for end in ("src", "dst"):
        arcs = arcs.join(nodes.select(_GRAPH, F.col("node").alias(end)), [_GRAPH, end], "left_semi")
    return arcs.select(_GRAPH, "src", "dst", "w")
