"""Reachability and depth by path doubling.

Beside the edges stand the pairs that are exactly 2, 4, 8, ... steps apart, each
the square of the one before. What is reached in up to 2**k steps reaches, by
one join with the pairs 2**k steps apart, all that up to 2**(k+1) steps reach, so
rounds grow with the logarithm of the longest path. Where nodes have one edge
out, as in hierarchies, each square has at most as many rows as the edges.
Where a square would be larger than ``most`` times the edges, squaring ends,
and rounds go on by the longest jump there is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.session import written

#: Rows that a square may have: this many times the edges, and at least so many.
MOST, LEAST = 4, 100_000


class Jumps:
    """The pairs (a, b) exactly 2**k steps apart, made as far as they are asked for and stay small."""

    def __init__(self, edges: DataFrame, most: int = MOST, least: int = LEAST) -> None:
        self.all = [written(edges.select("a", "b").where("a is not null and b is not null").distinct(), "path-edges")]
        self.limit = max(most * self.all[0].count(), least)

    def at(self, k: int) -> tuple[DataFrame, int]:
        """(pairs, k'): the pairs 2**k' steps apart; k' is below k where squares have become too large."""
        while len(self.all) <= k:
            last = self.all[-1]
            out, into = last.groupBy("a").agg(F.count("*").alias("n")), last.groupBy("b").agg(F.count("*").alias("m"))
            size = out.join(into, F.col("a") == F.col("b")).agg(F.sum(F.col("n").cast("double") * F.col("m"))).first()[0]
            if (size or 0) > self.limit:
                break
            self.all.append(written(step(last, last), "path-jump"))
        return self.all[min(k, len(self.all) - 1)], min(k, len(self.all) - 1)


def step(pairs: DataFrame, jump: DataFrame) -> DataFrame:
    """(a, b): from a by a pair and a jump to b."""
    return pairs.join(jump.select(F.col("a").alias("b"), F.col("b").alias("_c")), "b").select("a", F.col("_c").alias("b")).distinct()


def closure(edges: DataFrame, start: DataFrame, zero: bool, rounds: list | None = None, most: int = MOST, least: int = LEAST) -> DataFrame:
    """(a, b): b is reachable from a over edges (a, b), a in start(a); with zero also a itself.

    Cycles end it: a round that finds nothing new is the last. Nulls reach
    nothing; without edges only zero steps are there. ``rounds`` gets an entry
    for each round.
    """
    jumps = Jumps(edges, most, least)
    begun = start.select("a").where("a is not null").distinct()
    seen = written(begun.select("a", F.col("a").alias("b")), "path-start")
    found = written(step(seen, jumps.all[0]), "path-found")
    front, k = found, 0
    while not front.isEmpty():
        jump, got = jumps.at(k)
        # while jumps double, all that was found must jump; where they have stopped to, only what is new since the last of them
        new = written(step(found if got >= k - 1 else front, jump).join(found, ["a", "b"], "left_anti"), "path-front")
        if rounds is not None:
            rounds.append(1 << got)
        if new.isEmpty():
            break
        front, found, k = new, written(found.unionByName(new), "path-found"), k + 1
    return found.unionByName(seen).distinct() if zero else found


def longest(edges: DataFrame, rounds: list | None = None, most: int = MOST, least: int = LEAST) -> int:
    """The edges of the longest path over (a, b) that begins at a node no edge leads to; 0 without such a path.

    A cycle that no such node leads to adds nothing; one that is led to raises
    RuntimeError, as paths through it have no end.
    """
    jumps = Jumps(edges, most, least)
    e = jumps.all[0]
    nodes = e.select("a").unionByName(e.select(F.col("b").alias("a"))).distinct().count()
    at = written(e.select("a").distinct().join(e.select(F.col("b").alias("a")), "a", "left_anti"), "path-roots")
    jumped = lambda here, jump: written(here.join(jump, "a").select(F.col("b").alias("a")).distinct(), "path-level")
    length, k = 0, 0
    # up by growing jumps from the roots, then the rest by falling ones
    while True:
        jump, got = jumps.at(k)
        there = jumped(at, jump)
        if rounds is not None:
            rounds.append(1 << got)
        if there.isEmpty():
            break
        length, at, k = length + (1 << got), there, k + 1
        if length >= nodes:
            raise RuntimeError("a root leads into a cycle")
    for down in range(min(k, len(jumps.all)) - 1, -1, -1):
        while not (there := jumped(at, jumps.all[down])).isEmpty():
            length, at = length + (1 << down), there
            if rounds is not None:
                rounds.append(1 << down)
            if length >= nodes:
                raise RuntimeError("a root leads into a cycle")
    return length
