"""Connected components of a large edge list by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import write_shared


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) -> (node, component), component being one of its nodes.

    In a round every node joins the neighbour of least priority (a fixed hash
    of the node), or stays if it is the least itself; edges then connect what
    the nodes joined.  The graph shrinks by a constant share each round.  Each
    round is two joins and a group-by on written tables; nothing is gathered.
    """
    def ranked(name: str):
        return F.struct(F.xxhash64(name).alias("h"), F.col(name).alias("n"))

    edges = write_shared(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                         .distinct(), "edges")
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = write_shared(both.groupBy("a").agg(F.min(ranked("b")).alias("m"))
                            .select(F.col("a").alias("node"), F.least(ranked("a"), F.col("m"))["n"].alias("to")), "joined")
        rounds.append(step)
        e = edges.join(step, F.col("a") == F.col("node")).select(F.col("to").alias("a"), "b")
        e = e.join(step, F.col("b") == F.col("node")).select("a", F.col("to").alias("b")).filter("a <> b")
        edges = write_shared(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = rounds[0].select("node", F.col("to").alias("component"))
    for step in rounds[1:]:
        s = step.select(F.col("node").alias("mid"), F.col("to").alias("next"))
        out = (out.join(s, F.col("component") == F.col("mid"), "left")
               .select("node", F.coalesce("next", "component").alias("component")))
    return write_shared(out, "components")
