"""Connected components of a link table, by alternating large and small stars.

Each round is two joins-free grouped passes over the links; rounds are logarithmic in the
longest path in practice. Links live in tables of the shared folder between rounds, so no
link list reaches the driver and a lost executor costs only its tasks. Neighbours are never
gathered in one row: only the minimum of each node's neighbours is aggregated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import _text


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root), stored, for each node of ``links``, root the smallest node of its component.

    Self links, repeated links and links either way round are fine; links with a null end
    are ignored; an empty table gives no rows.
    """
    link = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).isNotNull().alias("x"), F.col(b).isNotNull().alias("y")).where("x and y").select("u", "v").distinct()
    link = _text.stored(link, "links")
    while True:
        # large star: every larger neighbour of a node goes to the node's smallest neighbour
        both = link.where("u <> v").select("u", "v").unionAll(link.where("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: every smaller neighbour of a node, and the node, go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("p")).select("p.u", "p.v").where("u <> v").distinct()
        new = _text.stored(small, "links")
        # done when every node has one link and no root has one
        state = new.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        busy = state.where("n > 1").limit(1).count() or new.join(state.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count()
        _text.discard(link)
        link = new
        if not busy:
            break
    roots = link.select(F.col("u").alias("node"), F.col("v").alias("root"))
    own = links.select(F.col(a).alias("node")).unionAll(links.select(F.col(b))).where("node is not null").distinct()
    out = _text.stored(own.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root")), "components")
    _text.discard(link)
    return out
