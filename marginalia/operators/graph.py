"""A typed relation graph: bounded expansion, contradictions, PageRank.

Edges that leave a node with more than HUB of them are dealt by salts, and what walks from such a node is
copied to its salts; so no task has all edges of a hub, and rows at other nodes are not copied.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.config import Graph
from marginalia.sources.store import materialised


#: Edges of a node in one place.
HUB = 10_000
#: Hubs up to which their table is broadcast, about 50 bytes each; beyond it, it is joined by a shuffle.
BROADCAST_ROWS = 200_000


def both_ways(edges: DataFrame) -> DataFrame:
    """(at, to, via, backwards): each edge in both directions."""
    ahead = edges.select(F.col("src").alias("at"), F.col("dst").alias("to"), F.col("relation").alias("via"), F.lit(False).alias("backwards"))
    back = edges.select(F.col("dst").alias("at"), F.col("src").alias("to"), F.col("relation").alias("via"), F.lit(True).alias("backwards"))
    return ahead.union(back).distinct()


def hubs_of(steps: DataFrame, hub: int | None = None) -> DataFrame:
    """(at, salts) of the nodes that more than `hub` steps leave; one in `hub` steps at most."""
    hub = hub or HUB
    return steps.groupBy("at").agg(F.count("*").alias("n")).filter(F.col("n") > hub).select("at", F.ceil(F.col("n") / hub).cast("int").alias("salts"))


def _with_salts(rows: DataFrame, hubs: DataFrame, small: bool) -> DataFrame:
    return rows.join(F.broadcast(hubs) if small else hubs, "at", "left")


@dataclass(frozen=True)
class Steps:
    """Steps (at, to, via, backwards, salt) and the hubs (at, salts) by which they are dealt."""

    rows: DataFrame
    hubs: DataFrame
    small: bool

    def of(self, layer: DataFrame) -> DataFrame:
        """layer (at, ...) joined with the steps that leave its nodes; rows at hubs go to all their salts."""
        salts = F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)
        copied = _with_salts(layer, self.hubs, self.small).withColumn("salt", F.explode(salts)).drop("salts")
        return copied.join(self.rows, ["at", "salt"]).drop("salt")


def dealt(steps: DataFrame, hub: int | None = None, hubs: DataFrame | None = None) -> Steps:
    """Steps with salts. The hubs are worked out unless they are known."""
    hubs = materialised(hubs_of(steps, hub), "hubs") if hubs is None else hubs
    small = hubs.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    if "salt" not in steps.columns:
        steps = _with_salts(steps, hubs, small).withColumn("salt", F.coalesce(F.pmod(F.xxhash64("to"), "salts"), F.lit(0)).cast("int")).drop("salts")
    return Steps(steps, hubs, small)


def seed_roots(seeds: DataFrame, count: int = 5) -> DataFrame:
    """(qid, node, score): the first `count` lexical hits (qid, uid, position), weighted 1 / (position + 1)."""
    return seeds.filter(F.col("position") < count).select("qid", F.col("uid").alias("node"), (F.lit(1.0) / (F.col("position") + 1)).alias("score"))


def expand(roots: DataFrame, edges: DataFrame | Steps, config: Graph = Graph()) -> DataFrame:
    """(qid, node, score, hops, via, backwards): the best path to each node within max_hops; each hop multiplies by the decay and the edge's weight.

    Ties go to fewer hops, then to the smallest relation, forward edges and the smallest node before. A layer
    keeps one row for each question and node, so it grows with the nodes reached and not with the paths.
    Edges may come as steps that are dealt already, as an index keeps them.
    """
    steps = edges if isinstance(edges, Steps) else dealt(both_ways(edges))
    table = F.create_map(*[F.lit(x) for pair in config.weights().items() for x in pair])
    weighted = replace(steps, rows=steps.rows.withColumn("weight", F.element_at(table, F.col("via"))).filter("weight IS NOT NULL"))
    nodes = steps.rows.select(F.col("at").alias("node")).distinct()
    layer = roots.join(nodes, "node", "left_semi").groupBy("qid", "node").agg(F.max("score").alias("score"))
    reached = layer.select("qid", "node", "score", F.lit(0).alias("hops"), F.lit(None).cast("string").alias("via"), F.lit(False).alias("backwards"))
    best = W.partitionBy("qid", "node").orderBy(F.desc("score"), "via", "backwards", "at")
    for hop in range(1, config.max_hops + 1):
        out = weighted.of(layer.withColumnRenamed("node", "at"))
        out = out.select("qid", F.col("to").alias("node"), "at", (F.col("score") * config.hop_decay * F.col("weight")).alias("score"), "via", "backwards")
        out = out.withColumn("r", F.row_number().over(best)).filter("r = 1")
        layer = out.select("qid", "node", "score")
        reached = reached.union(out.select("qid", "node", "score", F.lit(hop).alias("hops"), "via", "backwards"))
    first = W.partitionBy("qid", "node").orderBy(F.desc("score"), "hops")
    return reached.withColumn("r", F.row_number().over(first)).filter("r = 1").drop("r")


def new_nodes(expanded: DataFrame, seeds: DataFrame, config: Graph = Graph()) -> DataFrame:
    """expanded without roots, weak nodes and anything among the seeds, with a position by score and node."""
    rest = expanded.filter((F.col("hops") > 0) & (F.col("score") >= config.min_weight)).join(seeds.select("qid", F.col("uid").alias("node")), ["qid", "node"], "left_anti")
    place = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "node"))
    return rest.withColumn("position", place - 1)


def contradictions(edges: DataFrame) -> DataFrame:
    """(a, b): pairs joined by `contradicts`, once each, the smaller first."""
    pairs = edges.filter(F.col("relation") == "contradicts")
    return pairs.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def unresolved_contradictions(edges: DataFrame, sections: DataFrame, uid: str = "section_uid") -> DataFrame:
    """Contradictions without a winner: neither side is obsolete and none supersedes the other."""
    settled = edges.filter(F.col("relation") == "supersedes").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    dead = sections.filter(F.col("status") == "obsolete").select(F.col(uid).alias("u"))
    pairs = contradictions(edges).join(settled, ["a", "b"], "left_anti")
    return pairs.join(dead, F.col("a") == F.col("u"), "left_anti").join(dead, F.col("b") == F.col("u"), "left_anti")


def pagerank(edges: DataFrame, iterations: int = 10, damping: float = 0.85) -> DataFrame:
    """(node, rank) after a fixed number of rounds; the rank of nodes without outgoing edges is dealt to all."""
    edges = materialised(edges.select("src", "dst").distinct(), "edges")
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    degree = edges.groupBy("src").agg(F.count("*").alias("degree"))
    nodes = nodes.join(degree, nodes.node == degree.src, "left").select("node", "degree")
    nodes = materialised(nodes, "nodes")
    n = nodes.count()
    ranks = nodes.select("node", "degree", F.lit(1.0 / max(n, 1)).alias("rank"))
    steps = dealt(edges.select(F.col("src").alias("at"), F.col("dst").alias("to")))
    for _ in range(iterations):
        sent = steps.of(ranks.filter("degree IS NOT NULL").select(F.col("node").alias("at"), (F.col("rank") / F.col("degree")).alias("share")))
        got = sent.groupBy(F.col("to").alias("node")).agg(F.sum("share").alias("got"))
        lost = ranks.agg(F.coalesce(F.sum(F.when(F.col("degree").isNull(), F.col("rank"))), F.lit(0.0)).alias("lost"))
        rank = (1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n)
        # Written each round: the ranks are read twice, and a plan of all rounds would double with each.
        ranks = materialised(nodes.join(got, "node", "left").crossJoin(F.broadcast(lost)).select("node", "degree", rank.alias("rank")), "ranks")
    return ranks.select("node", "rank")


def neighbourhood(edges: DataFrame, node: str) -> DataFrame:
    """(node, via, backwards): what one edge joins to a node."""
    ahead = edges.filter(F.col("src") == node).select(F.col("dst").alias("node"), F.col("relation").alias("via"), F.lit(False).alias("backwards"))
    back = edges.filter(F.col("dst") == node).select(F.col("src").alias("node"), F.col("relation").alias("via"), F.lit(True).alias("backwards"))
    return ahead.union(back).distinct()
