"""Connected components of a graph given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buswright.llm.common import looked_up, materialise, release

#: Names of up to this many nodes are sent to all tasks (some 40 MB); more are joined by a shuffle.
_BROADCAST_ROWS = 1_000_000
#: Nodes that one task writes.
_PART_ROWS = 50_000


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each node that has a link; a component is named by its smallest node.

    Every node takes the smallest name among its neighbours' and its own and then
    that name's own name, until nothing changes: names run along long chains by
    doubling. Rounds are written to the shared folder, so none is computed twice.
    A node with very many links is combined in each task before the shuffle.
    """
    pairs = links.select(F.col(a).alias("node"), F.col(b).alias("other"))
    pairs = materialise(pairs.union(pairs.select("other", "node")), "links")
    names = pairs.groupBy("node").agg(F.min("other").alias("m"), F.count(F.lit(1)).alias("degree"))
    names = materialise(names.select("node", F.least("node", "m").alias("component"), "degree"), "names")
    nodes = names.count()
    few, total = nodes <= _BROADCAST_ROWS, 0 if nodes <= _BROADCAST_ROWS else pairs.count()
    # a round of few nodes is a few files, however many partitions shuffles have
    parts = -(-nodes // _PART_ROWS)
    while nodes:
        other = names.select(F.col("node").alias("other"), "component", "degree")
        seen = pairs.join(F.broadcast(other), "other") if few else looked_up(pairs, other, ["other"], "degree", total)
        seen = seen.select("node", "component", F.lit(None).cast("long").alias("before"), F.lit(None).cast("long").alias("degree"))
        lower = seen.union(names.select("node", "component", F.col("component").alias("before"), "degree"))
        lower = lower.groupBy("node").agg(F.min("component").alias("near"), F.max("before").alias("before"), F.max("degree").alias("degree"))
        jump = names.select(F.col("node").alias("near"), F.col("component").alias("far"))
        if few:
            new = lower.join(F.broadcast(jump), "near")
        else:
            # very many nodes may have one name
            lower = materialise(lower, "near")
            sizes = lower.groupBy("near").agg(F.count(F.lit(1)).alias("named"))
            new = looked_up(lower, jump.join(sizes, "near"), ["near"], "named", nodes)
        before = names
        new = materialise(new.select("node", F.least("near", "far").alias("component"), "before", "degree").coalesce(parts), "names")
        names = new
        release(before)
        if not new.agg(F.count_if(F.col("component") != F.col("before"))).first()[0]:
            break
    release(pairs)
    return names.select("node", "component")
