"""Tokens whose values lead back to themselves, as strongly connected components of the mapping's graph.

The graph has an edge from a token to every known token that its value mentions. Tokens with one such edge, the usual
case, form chains: jumps along a chain double in length, so a chain or cycle of n tokens takes log n joins. What is
left are the branching tokens, joined by edges that stand for whole chains. They are trimmed of dead ends, and split
into components by colours: every token takes the largest token that leads to it, and those of one colour that lead back
to that largest one are a component.

Memory is in proportion to the edges: no closure of pairs is built. Rounds grow with the logarithm of chains, and with
the number of branching tokens in a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakspark.functions import text as T
from cloakspark.sources import session


def stored(df: DataFrame) -> DataFrame:
    """`df` as a table whose joins are merges: broadcasts of some MB each would add up in the driver over the rounds."""
    return session.stored(df).hint("merge")


def dependencies(mapping: DataFrame) -> DataFrame:
    """source, target: a value that mentions another mapped token."""
    edges = mapping.select(F.col("placeholder").alias("source"), F.explode(F.array_distinct(T.tokens_in(F.col("original_value")))).alias("target"))
    return edges.join(mapping.select(F.col("placeholder").alias("target")), "target", "left_semi").select("source", "target")


def _jumps(chain: DataFrame, each=None) -> DataFrame:
    """node, to, low, on: where the longest jump along the chains ends, the smallest node on the way, and whether that end is in the chains.

    chain: node, to (one row per node). A jump that stays in the chains after as many steps as there are nodes is on a
    cycle. `each` is called with every doubled table, the single steps first.
    """
    jumps, n, steps = stored(chain.select("node", "to", F.least("node", "to").alias("low"))), chain.count(), 1
    nodes = jumps.select(F.col("node").alias("to"), F.lit(True).alias("on"))
    while True:
        if each:
            each(jumps)
        inside = jumps.join(nodes, "to", "left").select("node", "to", "low", F.coalesce("on", F.lit(False)).alias("on"))
        if steps >= n or inside.where("on").isEmpty():
            return inside
        far = jumps.select(F.col("node").alias("to"), F.col("to").alias("to2"), F.col("low").alias("low2"))
        # a jump that has left the chains stays where it is
        jumps = stored(jumps.join(far, "to", "left").select("node", F.coalesce("to2", "to").alias("to"), F.least("low", "low2").alias("low")))
        steps *= 2


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges without those from or to nodes that nothing leads to, or that lead nowhere, again and again. edges: a, b."""
    n = -1
    while n != (n := edges.count()) and n:
        edges = stored(edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(edges.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b"))
    return edges


def components(edges: DataFrame) -> DataFrame:
    """node, component: nodes on a cycle, with the largest node of their component. edges: a, b; an edge from a node to itself counts."""
    spark = edges.sparkSession
    found = spark.createDataFrame([], "node string, component string")
    edges = stored(edges.distinct())
    while not (edges := _trimmed(edges)).isEmpty():
        # forward: the largest node that leads to each
        colour = stored(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("c", F.col("node")))
        while True:
            better = edges.join(colour.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.max("c").alias("d"))
            new = stored(colour.join(better, "node", "left").select("node", F.greatest("c", "d").alias("c"), (F.col("d") > F.col("c")).alias("moved")))
            done, colour = new.where("moved").isEmpty(), new.drop("moved")
            if done:
                break
        own = stored(edges.join(colour.withColumnRenamed("node", "a").withColumnRenamed("c", "ca"), "a").join(colour.withColumnRenamed("node", "b").withColumnRenamed("c", "cb"), "b").where("ca = cb").select("a", "b", F.col("ca").alias("c")))
        # backward within a colour, from the node that gave it
        back = stored(own.where("b = c").select(F.col("a").alias("node"), "c").distinct())
        seen = back
        while not back.isEmpty():
            back = stored(own.join(back.select(F.col("node").alias("b")), "b").select(F.col("a").alias("node"), "c").distinct().join(seen, ["node", "c"], "left_anti"))
            seen = seen.unionByName(back)
        # the node that gave a colour is on a cycle only if it is met on the way back itself
        cyclic = stored(seen.join(seen.where("node = c").select("c"), "c", "left_semi").select("node", F.col("c").alias("component")))
        found = found.unionByName(cyclic)
        # what has been given a component, and the givers of colours, are done
        over = cyclic.select("node").union(colour.where("node = c").select("node")).distinct()
        rest = edges.join(over.withColumnRenamed("node", "a"), "a", "left_anti").join(over.withColumnRenamed("node", "b"), "b", "left_anti")
        edges = stored(rest.select("a", "b"))
    return found


def cycles(mapping: DataFrame, roots: DataFrame) -> DataFrame:
    """placeholder: tokens on a cycle that the returned tokens reach. roots: placeholder.

    A value that mentions its own token is a cycle of one. Chains of any length are followed; roots that aren't mapped
    are passed over, and an empty mapping has no cycles. Null placeholders and values have no edges.
    """
    edges = stored(dependencies(mapping).where("source is not null").distinct())
    degrees = stored(edges.groupBy(F.col("source").alias("node")).agg(F.count("*").alias("n"), F.min("target").alias("to")))
    chain = stored(degrees.where("n = 1").select("node", "to"))
    branch = stored(degrees.where("n > 1").select("node"))
    end = stored(_jumps(chain))
    # nodes on cycles of chains, each with the cycle's smallest node as its name
    ring = stored(end.where("on").select(F.col("to").alias("node")).distinct().join(end, "node").select("node", F.col("low").alias("component")))
    # where a chain leads: to a ring, to a branching node, or nowhere
    leads = stored(
        end.join(ring.select(F.col("node").alias("to"), F.col("component").alias("ring")), "to", "left").join(branch.select(F.col("node").alias("to"), F.lit(True).alias("b")), "to", "left")
        .select("node", "ring", F.when(F.col("b"), F.col("to")).alias("branch")).where("ring is not null or branch is not null")
    )
    whole = branch.select("node", F.lit(None).cast("string").alias("ring"), F.col("node").alias("branch")).unionByName(leads)
    # edges between branching nodes, by way of the chain that begins at `head`; and rings that they lead to
    ways = stored(edges.join(branch, edges["source"] == branch["node"], "left_semi").join(whole.withColumnRenamed("node", "target"), "target").select(F.col("source").alias("a"), F.col("branch").alias("b"), F.col("target").alias("head"), "ring"))
    between = ways.where("b is not null").select("a", "b").distinct()
    inner = stored(components(between))
    # what the roots reach among branching nodes
    first = stored(roots.select(F.col("placeholder").alias("node")).distinct().join(whole, "node"))
    reach = stored(first.where("branch is not null").select(F.col("branch").alias("node")).distinct())
    seen = reach
    while not reach.isEmpty():
        reach = stored(between.join(reach.withColumnRenamed("node", "a"), "a").select(F.col("b").alias("node")).distinct().join(seen, "node", "left_anti"))
        seen = seen.unionByName(reach)
    seen = stored(seen)
    rings = first.where("ring is not null").select("ring").union(ways.where("ring is not null").join(seen.withColumnRenamed("node", "a"), "a", "left_semi").select("ring")).distinct()
    out = ring.join(rings.withColumnRenamed("ring", "component"), "component", "left_semi").select("node")
    own = stored(inner.join(seen, "node", "left_semi"))
    if not own.isEmpty():
        a, b = (own.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in "ab")
        heads = stored(ways.join(a, "a").join(b, "b").where("ca = cb and head <> b").select(F.col("head").alias("node")).distinct())
        out = out.unionByName(own.select("node")).unionByName(_along(chain, heads, branch))
    return out.select(F.col("node").alias("placeholder")).distinct()


def _along(chain: DataFrame, heads: DataFrame, branch: DataFrame) -> DataFrame:
    """node: all nodes of chains from the given ones on, by jumps that double."""
    marked = [heads]

    def mark(jumps: DataFrame) -> None:
        further = jumps.join(marked[0], "node", "left_semi").select(F.col("to").alias("node"))
        marked[0] = stored(marked[0].unionByName(further).distinct())

    if not heads.isEmpty():
        _jumps(chain, mark)
    return marked[0].join(branch, "node", "left_anti")
