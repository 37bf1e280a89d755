"""Neighbourhoods in a graph of passages and entities, and the ring layout."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stemma.functions import text as T
from stemma.operators.crossrefs import book_matrix
from stemma.util import broadcast_if_small, cut


def reach(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """node, hop: what lies within ``hops`` undirected steps (a, b) of the seeds' nodes, with the least distance.

    Each hop is one join of the new frontier with the edges; the frontier is broadcast only while it is small.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    seen = cut(seeds.select("node").distinct().withColumn("hop", F.lit(0)))
    frontier = seen
    for hop in range(1, hops + 1):
        near = both.join(broadcast_if_small(frontier.select(F.col("node").alias("a"))), "a").select(F.col("b").alias("node")).distinct()
        frontier = cut(near.join(seen, "node", "left_anti").withColumn("hop", F.lit(hop)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def neighbourhood(links: DataFrame, mentions: DataFrame, seed: str, hops: int = 1, max_nodes: int = 120, types: Collection[str] | None = None, categories: Collection[str] = ("link", "mention"), kinds: Collection[str] | None = None) -> tuple[DataFrame, DataFrame, bool]:
    """Nodes (node, kind, hop, ord), edges (id, a, b, category, type) and whether it was cut off, of one passage.

    ``links``: id, source_verse, target_verse, type, seq. ``mentions``: osis_id, kind (person, place, event), entity_id, seq. Per hop the
    frontier's outgoing links come before its incoming ones, then the persons, places and events that it mentions; at
    most ``max_nodes`` nodes are taken, in that order. Entities are leaves. ``types`` only filters links; an edge
    needs both of its ends. An unknown seed gives itself alone.
    """
    spark = links.sparkSession
    order_of = F.when(F.col("kind") == "verse", 0).when(F.col("kind") == "person", 1).when(F.col("kind") == "place", 2).otherwise(3)
    nodes = spark.createDataFrame([(f"verse:{seed}", "verse", 0, 0)], "node string, kind string, hop int, ord int")
    edges = None
    frontier = nodes
    count, truncated = 1, False
    allowed = links.filter(F.col("type").isin(*types)) if types is not None else links
    for hop in range(1, hops + 1):
        f = F.broadcast(frontier.select(F.substring("node", 7, 1 << 20).alias("v"), F.col("ord").alias("from_ord")))  # at most max_nodes rows
        steps = []
        if "link" in categories and (kinds is None or "verse" in kinds):
            for side, a, b in ((0, "source_verse", "target_verse"), (1, "target_verse", "source_verse")):
                steps.append(allowed.join(f, F.col(a) == F.col("v")).select("id", F.concat(F.lit("verse:"), "source_verse").alias("a"), F.concat(F.lit("verse:"), "target_verse").alias("b"), F.lit("link").alias("category"), "type", F.concat(F.lit("verse:"), b).alias("node"), F.lit("verse").alias("kind"), "from_ord", F.lit(side).alias("side"), "seq"))
        if "mention" in categories:
            m = mentions.filter(F.col("kind").isin(*kinds)) if kinds is not None else mentions
            node = F.concat_ws(":", "kind", "entity_id")
            steps.append(m.join(f, F.col("osis_id") == F.col("v")).select(F.concat(F.lit("em:"), "osis_id", F.lit("→"), node).alias("id"), F.concat(F.lit("verse:"), "osis_id").alias("a"), node.alias("b"), F.lit("mention").alias("category"), F.lit(None).cast("string").alias("type"), node.alias("node"), "kind", "from_ord", (order_of + 1).alias("side"), "seq"))
        if not steps:
            break
        found = steps[0]
        for s in steps[1:]:
            found = found.unionByName(s)
        found = cut(found)
        edges = found if edges is None else edges.unionByName(found)
        new = found.groupBy("node", "kind").agg(F.min(F.struct("from_ord", "side", "seq", "id")).alias("first")).join(F.broadcast(nodes.select("node")), "node", "left_anti")
        taken = new.orderBy("first").limit(max_nodes - count + 1).select("node", "kind").collect()  # at most max_nodes + 1 rows
        truncated |= len(taken) > max_nodes - count
        taken = taken[: max_nodes - count]
        if not taken:
            break
        rows = [(r[0], r[1], hop, count + i) for i, r in enumerate(taken)]
        count += len(rows)
        added = spark.createDataFrame(rows, nodes.schema)
        nodes = nodes.unionByName(added)
        frontier = added.filter("kind = 'verse'")
        if count >= max_nodes and truncated:
            break
    if edges is None:
        return nodes, spark.createDataFrame([], "id string, a string, b string, category string, type string"), truncated
    ends = F.broadcast(nodes.select("node"))
    kept = edges.join(ends.withColumnRenamed("node", "a"), "a", "left_semi").join(ends.withColumnRenamed("node", "b"), "b", "left_semi")
    return nodes, kept.select("id", "a", "b", "category", "type").distinct(), truncated


def kept_matrix(links: DataFrame) -> DataFrame:
    """The matrix of books, computed once for all who read it."""
    return cut(book_matrix(links))


def fallback(books: DataFrame, seed: int, chords: int = 2) -> DataFrame:
    """a, b, weight of a graph to draw where there are no links: books (book, ord from 0) in a ring, and up to ``chords`` seeded others of each, the same in every run."""
    n = books.agg(F.count("*").alias("n"))
    rows = books.select("book", "ord").join(F.broadcast(n))
    ring_ = rows.select("ord", F.pmod(F.col("ord") + 1, F.col("n")).alias("to"), F.lit(5).alias("weight"))
    draw = lambda k: T.nth_random(F.lit(seed), F.col("ord") * 2 * chords + k)
    picked = rows.select("ord", F.explode(F.array(*[F.struct(F.floor(draw(2 * c + 1) * F.col("n")).alias("to"), (F.floor(draw(2 * c + 2) * 20) + 1).cast("int").alias("weight")) for c in range(chords)])).alias("x")).select("ord", F.col("x.to").alias("to"), "x.weight")
    pairs = ring_.unionByName(picked).filter(F.col("ord") != F.col("to")).groupBy(F.least("ord", "to").alias("i"), F.greatest("ord", "to").alias("j")).agg(F.max("weight").alias("weight"))
    at = lambda k, name: books.select(F.col("ord").alias(k), F.col("book").alias(name))
    return pairs.join(at("i", "a"), "i").join(at("j", "b"), "j").select("a", "b", "weight")


def ring(books: DataFrame, gap: float = 5.2, base: float = 6.0, scale: float = 1.5) -> DataFrame:
    """books (book, ord, section, chapters) with the angle in degrees and radius of each on a ring with a gap after every section."""
    total = books.agg(F.count("*").alias("n"), F.countDistinct("section").alias("g"))
    step = (360 - gap * F.col("g")) / F.col("n")
    angle = F.lit(-90 + gap / 2) + (F.col("ord") + 0.5) * step + F.col("section") * gap
    return books.join(F.broadcast(total)).withColumns({"angle": angle, "r": base + scale * F.sqrt("chapters")}).drop("n", "g")


def visits(history: DataFrame, who: str, at: str, entry: str, kept: int = 20) -> DataFrame:
    """The last ``kept`` entries of each reader without consecutive repeats, most recent first (rank from 1)."""
    w = Window.partitionBy(who).orderBy(at)
    moved = history.withColumn("__before", F.lag(entry).over(w)).filter(~F.col(entry).eqNullSafe(F.col("__before"))).drop("__before")
    ranked = moved.withColumn("rank", F.row_number().over(Window.partitionBy(who).orderBy(F.desc(at))))
    return ranked.filter(F.col("rank") <= kept)
