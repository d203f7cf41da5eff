"""Connected components of links between ids, by contraction over Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifloom.llm.shared import written


def components(edges: DataFrame, *, max_rounds: int = 60) -> DataFrame:
    """For links (u, v) the rows (node, component) of all nodes that occur: component is the smallest node reachable.

    Each round points every node to the smallest of its neighbours and itself, follows these pointers to their ends and
    replaces the ends of every link by theirs; links within a tree drop out.  A node that is still linked after two
    rounds was an end in both.  Had a neighbour pointed elsewhere in the first round, it would have brought a smaller
    node beside it and made it none in the second; so that neighbour is in its tree, and at most half of the nodes stay
    every two rounds, whatever the order of ids.  ``max_rounds`` is enough for 2**30 nodes; beyond it an error is raised.
    Minima are combined before the shuffle, so a node of very many links is no heavy key."""
    links = edges.where("u <> v")
    links = written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    rounds = []
    while not rounds or links.limit(1).count():
        if len(rounds) == max_rounds:
            raise RuntimeError(f"components: links are left after {max_rounds} rounds")
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        ends = _ends(written(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("up"))))
        rounds.append(ends)
        links = links.join(ends.select(F.col("node").alias("u"), F.col("up").alias("a")), "u").join(ends.select(F.col("node").alias("v"), F.col("up").alias("b")), "v")
        links = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    labels = rounds.pop().select("node", F.col("up").alias("component"))
    for ends in reversed(rounds):  # each round's ends are the next one's nodes, but for those that were done
        later = labels.select(F.col("node").alias("up"), "component")
        labels = written(ends.join(later, "up", "left").select("node", F.coalesce("component", "up").alias("component")))
    return labels


def _ends(up: DataFrame) -> DataFrame:
    """Pointers (node, up), which only fall, followed to their ends; the length of a path halves with each step."""
    while True:
        above = up.select(F.col("node").alias("up"), F.col("up").alias("end"))
        new = written(up.join(above, "up").select("node", "up", "end"))
        up = new.select("node", F.col("end").alias("up"))
        if not new.where("end < up").limit(1).count():
            return up
