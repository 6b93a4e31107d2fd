"""Exact knock-out brackets: the chance of each team to reach each round, from pairwise win probabilities.

A bracket is a small fixed tree, so each is one row of arrays (position = leaf) and rounds are array expressions: one
aggregate brings a bracket together, and no join follows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def elo_probability(a: Column, b: Column) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), (b - a) / 400))


def _winner(half: int, p: Column, t: Column):
    """Position -> its chance to get past the block of ``half`` positions beside its own."""

    def win(i):
        start = F.floor(i / half).cast("int").bitwiseXOR(F.lit(1)) * half
        met = F.sequence(start, start + (half - 1))
        return p[i] * F.aggregate(met, F.lit(0.0), lambda s, j: s + p[j] * elo_probability(t[i]["rating"], t[j]["rating"]))

    return win


def _rounds(teams: DataFrame, rounds: int, keys: list[str]) -> DataFrame:
    """(keys, t, p0..p<rounds>): the bracket's teams by position and their chances to win each round."""
    leaves = F.sequence(F.lit(0), F.lit((1 << rounds) - 1))
    g = teams.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("pos").cast("int").alias("pos"), "team", "rating"))).alias("t"))
    g = g.withColumn("p0", F.transform(leaves, lambda i: F.lit(1.0)))
    for r in range(1, rounds + 1):
        g = g.withColumn(f"p{r}", F.transform(leaves, _winner(1 << (r - 1), F.col(f"p{r - 1}"), F.col("t"))))
    return g


def bracket(teams: DataFrame, rounds: int = 3, keys: list[str] = ()) -> DataFrame:
    """(keys, pos, team, rating) with all 2**rounds positions from 0 -> the same with r1..r<rounds>."""
    g = _rounds(teams, rounds, list(keys))
    rows = F.transform("t", lambda x: F.struct(x["pos"].alias("pos"), x["team"].alias("team"), x["rating"].alias("rating"), *[F.col(f"p{r}")[x["pos"]].alias(f"r{r}") for r in range(1, rounds + 1)]))
    return g.select(*keys, F.inline(rows))


def final_paths(teams: DataFrame, rounds: int = 3, keys: list[str] = ()) -> DataFrame:
    """(keys, team, opponent, share): how much of a team's title chance comes by each final opponent."""
    g, half = _rounds(teams, rounds, list(keys)), 1 << (rounds - 1)
    p, t = F.col(f"p{rounds - 1}"), F.col("t")
    side = lambda i: F.floor(i / half).cast("int")

    def paths(x):
        other = F.filter(t, lambda y: side(y["pos"]) != side(x["pos"]))
        return F.transform(other, lambda y: F.struct(x["team"].alias("team"), y["team"].alias("opponent"), (p[x["pos"]] * p[y["pos"]] * elo_probability(x["rating"], y["rating"])).alias("share")))

    return g.select(*keys, F.inline(F.flatten(F.transform(t, paths))))
