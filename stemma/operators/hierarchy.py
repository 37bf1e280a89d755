"""Parent-child links of unknown depth: depth, root, path, subtree size and descendants of every node, with cycles.

Bottom-up leaf peeling. A round takes off every leaf together with the chain of
only children above it (found by pointer doubling), and sends its subtree size
to the chain's parent; what can't be peeled lies on a cycle. As a parent stays
only where two peeled chains meet, there are at most log2(leaves) rounds, of at
most log2(longest chain) joins each, whatever the depth. In reverse peel order
the chains then take depth, root and path from the chains they hang on, each
round joined with the few that were peeled after it. Descendant lists go up as
rows, a chain at a time. Children are counted and sizes added on the map side,
so that a node with very many children costs no more than others.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.util import cut, cut_counting

ROOTED, ON_CYCLE, BELOW_CYCLE = "rooted", "cycle", "below"


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


@dataclass(frozen=True)
class Forest:
    """What peeling leaves behind.

    members: node, parent, chain (its lowest node), rank (from 0 at the lowest), size (of the subtree, itself included);
    chains: chain, length, top, entry (the top's parent), up and at (the entry's chain and rank; null for a root and on a cycle),
    root, depth (of the top), status, and path (down to the entry) if paths were asked for;
    cyclic: node, parent of the nodes on cycles.
    """

    members: DataFrame
    chains: DataFrame
    cyclic: DataFrame


#: Pointer jumps that one job makes: chains get JUMPS + 1 times longer each.
JUMPS = 3


def _boughs(told: DataFrame) -> DataFrame:
    """node, parent, chain, rank, size of the leaves and of the only children's parents above them; told: node, parent, own, kids, kid."""
    low = told.filter("kids <= 1")
    leaf = F.col("kids") == 0
    # size sums up from the node down to (not including) next; chain is known once the leaf is reached
    state = low.select("node", "parent", F.when(~leaf, F.col("kid")).alias("next"), F.when(leaf, 0).otherwise(1).alias("rank"), F.col("own").alias("size"), F.when(leaf, F.col("node")).alias("chain"))
    found = [state.filter("chain is not null")]
    rest = state.filter("chain is null")
    while True:
        on = reduce(DataFrame.unionByName, [*found, rest]).select(F.col("node").alias("next"), F.col("next").alias("then"), F.col("rank").alias("r"), F.col("size").alias("s"), F.col("chain").alias("c"), F.lit(True).alias("hit"))
        step = rest
        for _ in range(JUMPS):
            # who has arrived has no next; who points at a parent of several waits for a later round
            jump = F.coalesce("hit", F.lit(False))
            step = step.join(on, "next", "left").filter(F.col("chain").isNotNull() | jump).select(
                "node", "parent", F.when(jump, F.col("then")).alias("next"), (F.col("rank") + F.coalesce("r", F.lit(0))).alias("rank"), (F.col("size") + F.coalesce("s", F.lit(0).cast("long"))).alias("size"), F.coalesce("chain", "c").alias("chain")
            )
        step, n = cut_counting(step, arrived=F.col("chain").isNotNull(), open=F.col("chain").isNull())
        found.append(step.filter("chain is not null"))
        rest = step.filter("chain is null")
        if not n["arrived"] or not n["open"]:  # a longer chain would have had somebody at this distance: the rest goes round in cycles
            return reduce(DataFrame.unionByName, found).select("node", "parent", "chain", "rank", "size")


def peel(parents: DataFrame, node: str = "node", parent: str = "parent", nodes: DataFrame | None = None, paths: bool = False) -> Forest:
    """The forest of ``parents`` (at most one parent per node; of several the least is taken, rows with a null node or parent are
    ignored, repeated rows count once) and of further ``nodes``. A node on a cycle is in no chain. An empty table gives an empty forest."""
    links = parents.select(F.col(node).alias("node"), F.col(parent).alias("parent")).filter("node is not null and parent is not null")
    # one message per node, per parent and per peeled chain; added up by node
    messages = links.unionByName(links.select(F.col("parent").alias("node"), _null("string").alias("parent")))
    if nodes is not None:
        messages = messages.unionByName(nodes.select(F.col(node).alias("node"), _null("string").alias("parent")).filter("node is not null"))
    rest = messages.groupBy("node").agg(F.min("parent").alias("parent"), F.lit(1).cast("long").alias("own"))
    members, chains = [], []
    while True:
        kids = rest.filter("parent is not null").groupBy("parent").agg(F.count("*").alias("kids"), F.min("node").alias("kid"))
        told, n = cut_counting(rest.join(kids.withColumnRenamed("parent", "node"), "node", "left").select("node", "parent", "own", F.coalesce("kids", F.lit(0)).alias("kids"), "kid"), leaves=F.col("kids").isNull() | (F.col("kids") == 0))
        if not n["leaves"]:
            break
        peeled = _boughs(told)
        ends = (peeled.groupBy("chain").agg((F.max("rank") + 1).alias("length"), F.max_by(F.struct("node", "parent", "size"), "rank").alias("t")).select("chain", "length", F.col("t.node").alias("top"), F.col("t.parent").alias("entry"), F.col("t.size").alias("total")))
        members.append(peeled)
        chains.append(ends)
        zero, gone = F.lit(0).cast("long"), F.lit(True).alias("gone")
        sent = ends.filter("entry is not null").select(F.col("entry").alias("node"), _null("string").alias("parent"), F.col("total").alias("own"), _null("boolean").alias("gone"))
        left = told.select("node", "parent", "own", _null("boolean").alias("gone")).unionByName(peeled.select("node", _null("string").alias("parent"), zero.alias("own"), gone)).unionByName(sent)
        rest = left.groupBy("node").agg(F.max("parent").alias("parent"), F.sum("own").alias("own"), F.max("gone").alias("gone")).filter("gone is null").drop("gone")
    cyclic = told.select("node", "parent")
    if not members:
        none = told.limit(0)
        found = none.select("node", "parent", F.col("node").alias("chain"), F.lit(0).alias("rank"), F.col("own").alias("size"))
        ends = none.select(F.col("node").alias("chain"), F.lit(0).alias("length"), F.col("node").alias("top"), F.col("parent").alias("entry"), F.col("own").alias("total"))
        return Forest(found, _descend([ends], found, paths), cyclic)
    found = reduce(DataFrame.unionByName, members)
    return Forest(found, _descend(chains, found, paths), cyclic)


def _descend(rounds: list[DataFrame], members: DataFrame, paths: bool) -> DataFrame:
    """The chains with root, depth, status and path, in reverse peel order."""
    every = reduce(DataFrame.unionByName, [c.withColumn("round", F.lit(i)) for i, c in enumerate(rounds)])
    at = members.select(F.col("node").alias("entry"), F.col("chain").alias("up"), F.col("rank").alias("at"))
    linked = cut(every.drop("total").join(at, "entry", "left"))
    lists = None
    if paths:  # a chain's nodes from its top down
        lists = cut(members.groupBy("chain").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("rank")).alias("r"), "node"))), lambda x: x["node"]).alias("list")))
        linked = linked.join(lists.withColumnRenamed("chain", "up"), "up", "left")
    done = None
    for i in reversed(range(len(rounds))):
        own = linked.filter((F.col("round") == i) & F.col("up").isNull())
        first = own.select(
            "chain", "length", "top", "entry", "up", "at", F.when(F.col("entry").isNull(), F.col("top")).otherwise("").alias("root"), F.when(F.col("entry").isNull(), 0).otherwise(-2).alias("depth"),
            F.when(F.col("entry").isNull(), ROOTED).otherwise(BELOW_CYCLE).alias("status"), *([F.when(F.col("entry").isNull(), F.array().cast("array<string>")).alias("path")] if paths else []),
        )
        if done is not None:
            above = done.select(F.col("chain").alias("up"), F.col("length").alias("n"), "root", F.col("depth").alias("d"), "status", *(["path"] if paths else []))
            rooted = F.col("status") == ROOTED
            # the entry lies n - 1 - at below the top of its chain
            steps = F.col("n") - F.col("at")
            hung = linked.filter((F.col("round") == i) & F.col("up").isNotNull()).join(above, "up").select(
                "chain", "length", "top", "entry", "up", "at", "root", F.when(rooted, F.col("d") + steps).otherwise(-2).alias("depth"), "status", *([F.concat("path", F.slice("list", F.lit(1), steps)).alias("path")] if paths else [])
            )
            first = first.unionByName(hung)
        done = first if done is None else done.unionByName(first)
        if i % 3 == 0:  # three rounds a job
            done = cut(done)
    return done


def hierarchy(parents: DataFrame, node: str = "node", parent: str = "parent", nodes: DataFrame | None = None, paths: bool = True) -> DataFrame:
    """node, parent, size, root, depth, path, status for every node named in ``parents`` (see :func:`peel`).

    ``nodes`` may name further nodes. A node that has no parent is a root of depth 0. Nodes on a cycle get root
    '' and depth -1, nodes below one '' and -2; both have no path, and nodes on a cycle no size.
    size counts the node itself. With ``paths=False`` the path column is null.
    """
    return placed(peel(parents, node, parent, nodes, paths))


def placed(forest: Forest) -> DataFrame:
    """A forest's nodes as :func:`hierarchy` gives them."""
    paths = "path" in forest.chains.columns
    names = forest.chains.select("chain", "length", "root", F.col("depth").alias("d"), "status", *(["path"] if paths else []))
    m = forest.members
    path = _null("array<string>").alias("path")
    if paths:
        lists = m.groupBy("chain").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("rank")).alias("r"), "node"))), lambda x: x["node"]).alias("list"))
        names = names.join(lists, "chain")
        path = F.when(F.col("status") == ROOTED, F.concat("path", F.slice("list", F.lit(1), F.col("length") - F.col("rank")))).alias("path")
    depth = F.when(F.col("status") == ROOTED, F.col("d") + F.col("length") - 1 - F.col("rank")).otherwise(-2)
    tree = m.join(names, "chain").select("node", "parent", "size", "root", depth.alias("depth"), path, "status")
    on_cycle = forest.cyclic.select("node", "parent", _null("long").alias("size"), F.lit("").alias("root"), F.lit(-1).alias("depth"), _null("array<string>").alias("path"), F.lit(ON_CYCLE).alias("status"))
    return tree.unionByName(on_cycle)


def _lists(forest: Forest, rooted: bool) -> tuple[DataFrame, DataFrame]:
    """(node, chain, at, distance): where each node enters each chain above it, and its distance from there; and node, entry, distance where it meets a cycle.

    The lists that chains send up: each step sends all of a chain's to the chain that it hangs on.
    """
    chains = forest.chains.filter(F.col("status") == ROOTED) if rooted else forest.chains
    ends = chains.select("chain", "length", "entry", "up", F.col("at").alias("to"))
    here = forest.members.join(chains.select("chain"), "chain", "left_semi").select("node", "chain", F.col("rank").alias("at"), F.lit(0).alias("distance"))
    sent, out = [here], []
    while True:
        risen, n = cut_counting(
            here.join(ends.filter("entry is not null"), "chain").select("node", F.col("up").alias("chain"), F.col("to").alias("at"), (F.col("distance") + F.col("length") - F.col("at")).alias("distance"), "entry"), on=F.col("chain").isNotNull()
        )
        out.append(risen.filter("chain is null").select("node", "entry", "distance"))
        here = risen.filter("chain is not null").drop("entry")
        if not n["on"]:
            return reduce(DataFrame.unionByName, sent), reduce(DataFrame.unionByName, out)
        sent.append(here)


def _expanded(entries: DataFrame, members: DataFrame) -> DataFrame:
    """ancestor, node, distance: each entry with the chain's nodes from there up."""
    above = members.select("chain", F.col("node").alias("ancestor"), "rank")
    return entries.join(above, "chain").filter((F.col("rank") >= F.col("at")) & (F.col("ancestor") != F.col("node"))).select("ancestor", "node", (F.col("distance") + F.col("rank") - F.col("at")).alias("distance"))


def descendants(forest: Forest) -> DataFrame:
    """ancestor, node, distance: every node below every other, in the trees that have a root. What hangs on cycles has none; :func:`all_descendants` has these too."""
    return _expanded(_lists(forest, True)[0], forest.members)


def all_descendants(forest: Forest) -> DataFrame:
    """ancestor, node, distance: as :func:`descendants`, and also what is below nodes that hang on cycles or lie on one.

    A node on a cycle has all others on it and everything that hangs on it below it, by the least distance; nobody is below itself.
    """
    entries, met = _lists(forest, False)
    met = cut(met)
    around = _around(forest.cyclic)
    # a hanging node is below its chain's entry into the cycle, and below all around that
    entered = met.select(F.col("entry").alias("ancestor"), "node", "distance")
    onwards = met.withColumnRenamed("distance", "steps").join(around.select(F.col("node").alias("entry"), "ancestor", "distance"), "entry").select("ancestor", "node", (F.col("steps") + F.col("distance")).alias("distance"))
    return _expanded(entries, forest.members).unionByName(around).unionByName(entered).unionByName(onwards)


def _around(cyclic: DataFrame) -> DataFrame:
    """ancestor, node, distance of all pairs on each cycle (node, parent): the reach doubles each round, until it has gone round the longest cycle."""
    pairs = cut(cyclic.filter("node <> parent").select(F.col("parent").alias("ancestor"), "node", F.lit(1).alias("distance")))
    reach = 1
    while True:
        far = pairs.filter(F.col("distance") == reach).select("node", F.col("ancestor").alias("via"))
        on = pairs.select(F.col("node").alias("via"), "ancestor", (F.col("distance") + reach).alias("distance"))
        longer = far.join(on, "via").filter("ancestor <> node").select("ancestor", "node", "distance")
        new = cut(longer.join(pairs, ["ancestor", "node"], "left_anti").groupBy("ancestor", "node").agg(F.min("distance").alias("distance")))
        if new.isEmpty():
            return pairs
        pairs, reach = pairs.unionByName(new), 2 * reach


def preferred_parents(links: DataFrame, child: str, parent: str, rank: str, order: str) -> DataFrame:
    """node, parent: of each child's links the one of least (rank, order), as a map-side min over a struct."""
    return links.filter(F.col(child).isNotNull() & F.col(parent).isNotNull()).groupBy(F.col(child).alias("node")).agg(F.min_by(parent, F.struct(rank, order, parent)).alias("parent"))
