"""Votes, ratings and message trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import written


def canonical_votes(rows: DataFrame, a: str, b: str, winner: Column) -> DataFrame:
    """(x, y, wins_x, wins_y, ties): votes on the same unordered pair; the winner, 'a', 'b' or other, turns with the sides."""
    flipped = F.col(a) > F.col(b)
    w = F.when(flipped & (winner == "a"), "b").when(flipped & (winner == "b"), "a").otherwise(winner)
    pairs = rows.select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y"), w.alias("w"))
    return pairs.groupBy("x", "y").agg(F.count_if(F.col("w") == "a").alias("wins_x"), F.count_if(F.col("w") == "b").alias("wins_y"), F.count_if(~F.col("w").isin("a", "b")).alias("ties"))


def rater_share(ratings: DataFrame, item: str, yes: Column, unsure: Column, *, least: int = 5) -> DataFrame:
    """(item, n, share): yes and half the unsure answers, of items with `least` answers or more."""
    return ratings.groupBy(item).agg(F.count("*").alias("n"), ((F.count_if(yes) + 0.5 * F.count_if(unsure)) / F.count("*")).alias("share")).where(F.col("n") >= least)


def tree_paths(messages: DataFrame) -> DataFrame:
    """(root, node, depth, path) of messages (node, parent) down from the roots, level by level, each a written table.

    Any depth; a node that is below itself raises ValueError, as its paths have no end.
    """
    children = messages.where("parent is not null").select("node", "parent")
    out = frontier = messages.where("parent is null").select(F.col("node").alias("root"), "node", F.lit(0).alias("depth"), F.array("node").alias("path"))
    while True:
        up = frontier.select("root", F.col("node").alias("parent"), "depth", "path")
        level = children.join(up, "parent").select("root", "node", (F.col("depth") + 1).alias("depth"), F.array_contains("path", F.col("node")).alias("again"), F.concat("path", F.array("node")).alias("path"))
        frontier = written(level, "level")
        if frontier.isEmpty():
            return out
        if (r := frontier.where("again").select("node").first()) is not None:
            raise ValueError(f"message {r.node} is below itself")
        frontier = frontier.drop("again")
        out = out.unionByName(frontier)
