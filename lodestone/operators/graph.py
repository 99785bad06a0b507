"""Collaboration graphs as edge tables: building, neighbours, paths, centralities, components, communities."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from lodestone.functions.columns import HOPS_MOST
from lodestone.operators import blocks
from lodestone.operators.keys import add_surrogate_key
from lodestone.operators.spread import spread_join
from lodestone.sources.shared import bucketed, tasks_for, written

#: Items of one group that are paired in one piece; larger groups are paired in pairs of blocks.
PAIR_BLOCK = 256


def _plain(name: str):
    """Whether text is a whole number as Spark writes it, so that the number stands for it."""
    return F.coalesce(F.col(name).try_cast("bigint").cast("string") == F.col(name), F.lit(False))


def group_sizes(rows: DataFrame, numbers: bool = True) -> Row:
    """most rows of a group, pairs and rows of all groups (g, i), and with numbers whether all names are plain ones. Rows that repeat count, so these are the most that there can be."""
    n = F.col("n")
    plain = lambda test: (F.every(test) if numbers else F.lit(False)).alias("plain")
    size = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), plain(_plain("i")))
    return size.agg(F.max("n").alias("most"), F.sum(n * (n - 1) / 2).cast("long").alias("pairs"), F.sum("n").alias("rows"), plain(F.col("plain") & _plain("g"))).first()


def _pairs(df: DataFrame, group: str, item: str, numbers: bool = False) -> tuple[DataFrame, int, bool]:
    """counted_pairs, and whether its columns are numbers: with numbers they are where all names are plain ones, in the names' order as text."""
    rows = df.select(F.col(group).alias("g"), F.col(item).alias("i")).filter("g is not null and i is not null")
    numbers = numbers and {t for _, t in rows.dtypes} == {"string"}
    size = group_sizes(rows, numbers)
    tasks, numbers = tasks_for(df.sparkSession, size.pairs or 0), numbers and bool(size.plain)
    whole = (lambda c, kind: c.cast(kind)) if numbers else (lambda c, kind: c)
    if (size.most or 0) <= PAIR_BLOCK:
        dealt = rows.select(*(whole(F.col(c), "bigint").alias(c) for c in ("g", "i"))).repartition(max(tasks, tasks_for(df.sparkSession, size.rows or 0)), "g")
        items = F.collect_set("i")
        items = F.sort_array(items.cast("array<string>")).cast("array<bigint>") if numbers else F.sort_array(items)
        first = dealt.groupBy("g").agg(items.alias("items")).filter(F.size("items") > 1).select("g", "items", F.posexplode("items").alias("at", "node_a"))
        return first.select("g", "node_a", F.explode(F.slice("items", F.col("at") + 2, F.size("items"))).alias("node_b")), tasks, numbers
    rows = written(rows.repartition("g").distinct(), "members")
    sizes = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    rows = rows.join(sizes, "g").withColumn("blocks", F.ceil(F.col("n") / PAIR_BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("i"), F.col("blocks")).cast("int"))
    spread = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    a = spread.select("g", F.col("block").alias("x"), F.col("other").alias("y"), F.col("i").alias("node_a"))
    b = spread.select("g", F.col("other").alias("x"), F.col("block").alias("y"), F.col("i").alias("node_b"))
    return a.join(b, ["g", "x", "y"]).filter("node_a < node_b").select(*(whole(F.col(c), "bigint").alias(c) for c in ("g", "node_a", "node_b"))), tasks, numbers


def counted_pairs(df: DataFrame, group: str, item: str) -> tuple[DataFrame, int]:
    """(g, node_a, node_b), each unordered pair of items in each group once, and how many tasks they are for.

    A group is one list, paired in place. Where one has more than PAIR_BLOCK items, groups are cut in blocks and
    joined block by block, so no single key gathers all of it. The number of tasks follows the pairs.
    """
    return _pairs(df, group, item)[:2]


def collaboration_edges(df: DataFrame, group: str, item: str, least: int = 1) -> DataFrame:
    """(node_a, node_b, weight, via): unordered pairs of items in `least` groups or more, with the groups they share.

    A group has a pair once, so that its groups are counted and listed without a further look for repeats. Pairs go through
    the shuffle as they are, not as lists of one, to as many tasks as they need, and as numbers where their names are. With
    least they are counted there first, and only those that have it are listed.
    """
    pairs, tasks, numbers = _pairs(df, group, item, numbers=True)
    pairs = pairs.repartition(tasks, "node_a", "node_b")
    if least > 1:
        heavy = pairs.groupBy("node_a", "node_b").agg(F.count("g").alias("n")).filter(F.col("n") >= least).select("node_a", "node_b")
        pairs = pairs.join(heavy.hint("shuffle_hash"), ["node_a", "node_b"])
    via = F.collect_list("g")
    edges = pairs.groupBy("node_a", "node_b").agg(F.count(F.lit(1)).cast("int").alias("weight"), F.sort_array(via.cast("array<string>") if numbers else via).alias("via"))
    return edges.select(F.col("node_a").cast("string"), F.col("node_b").cast("string"), "weight", "via") if numbers else edges


def edges_of(df: DataFrame, group: str, item: str, nodes: DataFrame, least: int = 1) -> DataFrame:
    """The collaboration_edges that have one of nodes (a column node) at either end. Only the groups of these nodes are paired, and only with them."""
    rows = df.select(F.col(group).alias("g"), F.col(item).alias("i")).filter("g is not null and i is not null")
    own = written(rows.withColumnRenamed("i", "node").join(nodes.select("node"), "node", "left_semi").select("g", "node").distinct(), "asked-groups")
    pairs = rows.join(own, "g").filter("i <> node").select(F.least("i", "node").alias("node_a"), F.greatest("i", "node").alias("node_b"), "g").distinct()
    edges = pairs.groupBy("node_a", "node_b").agg(F.count(F.lit(1)).cast("int").alias("weight"), F.sort_array(F.collect_list("g")).alias("via"))
    return edges.filter(F.col("weight") >= least)


def collaboration_counts(df: DataFrame, group: str, item: str) -> DataFrame:
    """(node_a, node_b, weight) of collaboration_edges, for items that are few beside their groups: pairs are counted before the shuffle."""
    return counted_pairs(df, group, item)[0].groupBy("node_a", "node_b").agg(F.count(F.lit(1)).cast("int").alias("weight"))


def group_links(df: DataFrame, group: str, item: str) -> DataFrame:
    """(node_a, node_b): each item of a group with the group's least one. They connect what collaboration_edges connects, with a row for each item, not each pair."""
    rows = df.select(F.col(group).alias("g"), F.col(item).alias("node_b")).filter("g is not null and node_b is not null")
    least = rows.groupBy("g").agg(F.min("node_b").alias("node_a"))
    return rows.join(least.hint("shuffle_hash"), "g").filter("node_a < node_b").select("node_a", "node_b").distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge from either end: node, partner, weight, via. Edges are made once for both."""
    a, b = F.col("node_a"), F.col("node_b")
    ends = F.inline(F.array(F.struct(a.alias("node"), b.alias("partner")), F.struct(b.alias("node"), a.alias("partner"))))
    return edges.select(ends, "weight", "via")


def partners(edges: DataFrame, sources: DataFrame, n: int = 20) -> DataFrame:
    """The n heaviest partners of each source node (a column node)."""
    w = Window.partitionBy("node").orderBy(F.desc("weight"), "partner")
    near = both_ways(edges).join(sources, "node", "left_semi")
    return near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def paths(edges: DataFrame, sources: DataFrame, max_hops: int = HOPS_MOST, target: str | None = None) -> DataFrame:
    """All paths without a repeated node of up to max_hops from each source: source, target, path, hops, weight and via of the last edge.

    Paths grow by steps without their edges' columns, which are joined on at the end, once for each path. The
    last step is taken from the other side: with a target only its own neighbours are met there, and the step
    before is taken only towards them. Neighbours of a hub are dealt over tasks.
    """
    most = max(1, min(HOPS_MOST, max_hops))
    edges = written(edges.select("node_a", "node_b", "weight", "via"), "edges")
    steps = written(both_ways(edges).select("node", "partner"), "steps")
    final = steps if target is None else written(steps.filter(F.col("partner") == target), "final")
    now = written(sources.select(F.col("node").alias("source"), "node", F.array("node").alias("path")), "starts")
    out = None

    def longer(reached: DataFrame, by: DataFrame) -> DataFrame:
        met = spread_join(reached, by, ["node"]).filter(~F.array_contains("path", F.col("partner")))
        return met.select("source", F.col("partner").alias("node"), F.concat("path", F.array("partner")).alias("path"))

    for hop in range(1, most + 1):
        found = longer(now, final)
        if hop < most and target is not None:
            towards = steps if hop + 1 < most else steps.join(final.select(F.col("node").alias("partner")), "partner", "left_semi").select("node", "partner")
            now = written(longer(now, towards), "prefixes")
        elif hop < most:
            now = found = written(found, "prefixes")
        rows = found.select("source", F.col("node").alias("target"), "path", F.lit(hop).alias("hops"))
        out = rows if out is None else out.unionByName(rows)
    a, b = F.element_at("path", -2), F.element_at("path", -1)
    ended = out.withColumns({"node_a": F.least(a, b), "node_b": F.greatest(a, b)})
    known = edges.select(F.least("node_a", "node_b").alias("node_a"), F.greatest("node_a", "node_b").alias("node_b"), "weight", "via")
    return ended.join(known, ["node_a", "node_b"]).select("source", "target", "path", "hops", "weight", "via")


def normalize_edges(raw: DataFrame, min_weight: int = 1) -> tuple[DataFrame, DataFrame]:
    """Edges with ends in order, without loops and light ones, duplicates merged; and a report of what went."""
    ordered = raw.select(F.least("node_a", "node_b").alias("node_a"), F.greatest("node_a", "node_b").alias("node_b"), "weight", "via")
    good = ordered.filter((F.col("weight") >= min_weight) & (F.col("node_a") != F.col("node_b")))
    merged = good.groupBy("node_a", "node_b").agg(F.max("weight").alias("weight"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("via")))).alias("via"))
    report = ordered.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("weight") < min_weight).alias("light"), F.count_if(F.col("node_a") == F.col("node_b")).alias("loops"))
    return merged, report


def degrees(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Degree, weighted degree and degree centrality of each node; nodes (a column node) adds isolated ones."""
    found = both_ways(edges).groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("weighted_degree"))
    if nodes is not None:
        found = nodes.select("node").distinct().join(found, "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("weighted_degree", F.lit(0)).alias("weighted_degree"))
    total = found.agg(F.count(F.lit(1)).alias("total"))
    share = F.when(F.col("total") > 1, F.round(F.col("degree") / (F.col("total") - 1), 6)).otherwise(0.0)
    return found.crossJoin(F.broadcast(total)).select("node", "degree", "weighted_degree", share.alias("degree_centrality"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) with the least node of the component as root: every node takes its neighbours' least root until nothing changes.

    Nodes are numbered in their order, so that rounds compare and shuffle numbers. Joins by shuffled keys: tables of nodes,
    small as they may be when compressed, are not to be gathered by the driver.
    """
    links = written(edges.select(F.col("node_a").alias("u"), F.col("node_b").alias("v")).filter("u <> v").distinct(), "links")
    ends = links.select(F.explode(F.array("u", "v")).alias("name")).distinct()
    names = written(add_surrogate_key(ends, ["name"], "id"), "names")

    def named(column: str, out: str) -> DataFrame:
        return names.select(F.col("name").alias(column), F.col("id").alias(out)).hint("shuffle_hash")

    numbers = links.join(named("u", "a"), "u").join(named("v", "b"), "v").select("a", "b")
    both = written(numbers.unionByName(numbers.select(F.col("b").alias("a"), F.col("a").alias("b"))), "both")
    now = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "roots")
    while True:
        near = both.join(now.hint("shuffle_hash"), F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        # The root's own root shortens long paths by half each round. A root with many nodes is dealt in pieces.
        over = spread_join(now, now.select(F.col("node").alias("root"), F.col("root").alias("over")), ["root"], how="shuffle_hash")
        after = over.join(near.hint("shuffle_hash"), "node").select("node", F.least("root", "near", "over").alias("after"), F.col("root").alias("before"))
        after = written(after, "roots")
        settled = after.filter("after <> before").isEmpty()
        now = after.select("node", F.col("after").alias("root"))
        if settled:
            break
    found = now.join(names.select(F.col("id").alias("node"), "name").hint("shuffle_hash"), "node").select("name", "root")
    return spread_join(found, names.select(F.col("id").alias("root"), F.col("name").alias("root_name")), ["root"], how="shuffle_hash").select(F.col("name").alias("node"), F.col("root_name").alias("root"))


def ranked_components(edges: DataFrame) -> DataFrame:
    """node, component (1 for the largest; ties by least node) and its size."""
    roots = written(components(edges), "components")
    sizes = roots.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    ranks = add_surrogate_key(sizes, [F.desc("size"), F.asc("root")], "component")
    return spread_join(roots, ranks, ["root"], how="shuffle_hash").select("node", "component", "size")


def summary(edges: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """One row: nodes, edges, components, nodes of the largest, average degree. links: fewer edges that connect the same nodes."""
    n = edges.agg(F.count(F.lit(1)).alias("edges"))
    c = components(edges if links is None else links).groupBy("root").agg(F.count(F.lit(1)).alias("size")).agg(F.sum("size").alias("nodes"), F.count(F.lit(1)).alias("components"), F.max("size").alias("largest"))
    return c.crossJoin(n).select("nodes", "edges", "components", "largest", F.round(2 * F.col("edges") / F.col("nodes"), 6).alias("average_degree"))


def top_subgraph(edges: DataFrame, n: int) -> DataFrame:
    """Edges between the n nodes of the highest degree (ties by node)."""
    if n <= 0:
        raise ValueError("n must be positive")
    top = degrees(edges).orderBy(F.desc("degree"), "node").limit(n).select("node")
    return edges.join(top.select(F.col("node").alias("node_a")), "node_a", "left_semi").join(top.select(F.col("node").alias("node_b")), "node_b", "left_semi")


def betweenness(edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Betweenness centrality (unweighted, normalised): shortest paths counted level by level from many sources at once.

    Exact with all nodes as sources; with fewer (a column node) the sums are scaled up, and sources_used
    tells how many there were. A graph that tasks can hold is sent to them, and sources are dealt over tasks; in a larger
    one the paths of one batch of sources after the other spread over the cluster.
    """
    found = held(edges)
    whole = found is not None and edges_fit(found[0])
    return betweenness_in(*found, sources) if whole else betweenness_by_joins(edges, sources)


def edges_fit(graph: blocks.Adjacency) -> bool:
    """Whether every task can hold the graph's edges."""
    return (graph.blocks.agg(F.sum(F.length("partners"))).first()[0] or 0) <= 4 * blocks.EDGES_HELD


def betweenness_in(graph: blocks.Adjacency, names: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """betweenness of a graph in blocks that edges_fit."""
    starts = np.flatnonzero(graph.degree > 0)
    n = len(starts)
    if sources is not None:
        asked = names.join(sources.select(F.col("node").alias("name")).distinct(), "name", "left_semi").select("id").toArrow()
        starts = np.intersect1d(starts, asked.column("id").to_numpy())
    nodes = blocks.labelled(graph, names, np.arange(graph.n, dtype=np.int32)).select("node").join(names.select(F.col("name").alias("node"), "id"), "node")
    return _normalised(nodes.join(blocks.through_nodes(graph, starts), "id", "left"), n, len(starts))


def _normalised(sums: DataFrame, n: int, used: int) -> DataFrame:
    scale = (1.0 / ((n - 1) * (n - 2)) if n > 2 else 0.0) * (n / used if used else 0.0)
    return sums.select("node", F.round(F.coalesce("b", F.lit(0.0)) * scale, 6).alias("betweenness"), F.lit(used).alias("sources_used"))


#: Pairs of a source and a node in a batch of sources whose paths are kept at a time.
BATCH_PATHS = 1 << 26


def betweenness_by_joins(edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    steps = written(both_ways(edges.select("node_a", "node_b", F.lit(1).alias("weight"), F.lit(1).alias("via"))).select("node", "partner").distinct(), "steps")
    nodes = written(steps.select("node").distinct(), "nodes")
    n = nodes.count()
    starts = nodes if sources is None else sources.select("node").distinct().join(nodes, "node", "left_semi")
    starts = written(add_surrogate_key(starts, ["node"], "at"), "starts")
    used, batch = starts.count(), max(1, BATCH_PATHS // max(1, n))
    every = None
    for first in range(1, used + 1, batch):
        sums = written(_batch_sums(steps, starts.filter(F.col("at").between(first, first + batch - 1))), "sums")
        every = sums if every is None else every.unionByName(sums)
        every = written(every.groupBy("node").agg(F.sum("b").alias("b")), "sums")
    if every is None:
        return _normalised(nodes.withColumn("b", F.lit(0.0)), n, used)
    return _normalised(nodes.join(every, "node", "left"), n, used)


def _batch_sums(steps: DataFrame, starts: DataFrame) -> DataFrame:
    """(node, b): dependencies of the shortest paths from starts. The frontier, (source, node), spreads over the cluster; levels are written."""
    seen = written(starts.select(F.col("node").alias("s"), "node", F.lit(0).alias("level"), F.lit(1.0).alias("sigma")), "seen")
    level = 0
    while True:
        front = seen.filter(F.col("level") == level)
        reached = front.join(steps, "node").groupBy("s", F.col("partner").alias("node")).agg(F.sum("sigma").alias("sigma"))
        fresh = written(reached.join(seen.select("s", "node"), ["s", "node"], "left_anti").select("s", "node", F.lit(level + 1).alias("level"), "sigma"), "fresh")
        if fresh.isEmpty():
            break
        seen = seen.unionByName(fresh)
        level += 1
    seen = written(seen, "seen")
    delta = seen.filter(F.col("level") == level).select("s", "node", F.lit(0.0).alias("delta"))
    every = delta
    for at in range(level, 0, -1):
        below = seen.filter(F.col("level") == at).join(delta, ["s", "node"]).select("s", "node", "sigma", "delta")
        up = seen.filter(F.col("level") == at - 1).select("s", F.col("node").alias("parent"), F.col("sigma").alias("parent_sigma"))
        near = below.join(steps, "node").select("s", F.col("partner").alias("parent"), "sigma", "delta")
        given = near.join(up, ["s", "parent"]).groupBy("s", F.col("parent").alias("node")).agg(F.sum(F.col("parent_sigma") / F.col("sigma") * (1 + F.col("delta"))).alias("delta"))
        whole = seen.filter(F.col("level") == at - 1).select("s", "node").join(given, ["s", "node"], "left").select("s", "node", F.coalesce("delta", F.lit(0.0)).alias("delta"))
        delta = written(whole, "delta")
        every = every.unionByName(delta)
    return every.filter("s <> node").groupBy("node").agg(F.sum("delta").alias("b"))


def numbered(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """near (node, partner, weight), each edge from either end with nodes as numbers in their order, and names (name, id).

    near lies in buckets by partner, so that rounds over it shuffle what its nodes say and not the edges themselves.
    """
    pairs = written(edges.select("node_a", "node_b", F.col("weight").cast("long").alias("weight")), "pairs")
    names = written(add_surrogate_key(pairs.select(F.explode(F.array("node_a", "node_b")).alias("name")).distinct(), ["name"], "id"), "names")
    a = names.select(F.col("name").alias("node_a"), F.col("id").cast("long").alias("node"))
    b = names.select(F.col("name").alias("node_b"), F.col("id").cast("long").alias("partner"))
    numbers = pairs.join(a.hint("shuffle_hash"), "node_a").join(b.hint("shuffle_hash"), "node_b").select("node", "partner", "weight")
    both = numbers.select(F.explode(F.array(F.struct("node", "partner", "weight"), F.struct(F.col("partner").alias("node"), F.col("node").alias("partner"), "weight"))).alias("e")).select("e.*")
    return bucketed(both, "near", "partner", tasks_for(pairs.sparkSession, 2 * pairs.count())), names


def adjacency_of(df: DataFrame, group: str, item: str) -> tuple[blocks.Adjacency, DataFrame] | None:
    """The graph of collaboration_edges in blocks and the names of its nodes, without a row for each edge; None where there are more nodes than blocks hold."""
    rows = df.select(F.col(group).alias("g"), F.col(item).alias("i")).filter("g is not null and i is not null")
    names, n = blocks.names_of(rows, "i")
    if n > blocks.NODES_HELD:
        return None
    rows = written(rows.join(names.hint("shuffle_hash"), F.col("i") == F.col("name")).select("g", F.col("id").alias("i")), "numbered")
    most = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if most > PAIR_BLOCK:
        pairs, tasks = counted_pairs(rows, "g", "i")
        pairs = written(pairs.repartition(tasks, "node_a", "node_b").groupBy("node_a", "node_b").agg(F.count(F.lit(1)).alias("weight")), "pairs")
        ends = F.inline(F.array(F.struct(F.col("node_a").alias("node"), F.array("node_b").alias("partners")), F.struct(F.col("node_b").alias("node"), F.array("node_a").alias("partners"))))
        return blocks.adjacency(pairs.select(ends, "weight"), n, 2 * pairs.count()), names
    return blocks.of_lists(written(rows.groupBy("g").agg(F.collect_set("i").alias("items")).filter(F.size("items") > 1), "lists"), n), names


def held(edges: DataFrame) -> tuple[blocks.Adjacency, DataFrame] | None:
    """adjacency_of for edges (node_a, node_b, weight)."""
    edges = written(edges.select("node_a", "node_b", "weight"), "edges")
    names, n = blocks.names_of(edges, "node_a", "node_b")
    return None if n > blocks.NODES_HELD else (blocks.of_edges(edges, names, n), names)


def communities(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(node, community) by label propagation: each node takes the label with the most weight around it, the least of equals.

    Nodes keep their own label with the weight of a self edge, which stops labels from swapping back and forth. Where there are
    more nodes than blocks hold, votes are shuffled once a round, as numbers.
    """
    found = held(edges)
    return communities_by_joins(edges, rounds) if found is None else communities_in(*found, rounds)


def communities_in(graph: blocks.Adjacency, names: DataFrame, rounds: int = 5) -> DataFrame:
    """communities of a graph in blocks."""
    return blocks.labelled(graph, names, blocks.spread_labels(graph, rounds))


def communities_by_joins(edges: DataFrame, rounds: int = 5) -> DataFrame:
    near, names = numbered(edges)
    tasks = tasks_for(near.sparkSession, near.count())
    labels = written(near.groupBy("node").agg(F.max("weight").alias("weight")).select("node", F.col("node").alias("community"), "weight"), "labels")
    for _ in range(rounds):
        told = labels.select(F.col("node").alias("partner"), "community")
        votes = near.join(told.hint("shuffle_hash"), "partner").select("node", "community", "weight", F.lit(None).cast("long").alias("own"))
        votes = votes.unionByName(labels.select("node", "community", "weight", F.col("weight").alias("own"))).repartition(tasks, "node")
        tally = votes.groupBy("node", "community").agg(F.sum("weight").alias("w"), F.max("own").alias("own"))
        labels = written(tally.groupBy("node").agg(F.min_by("community", F.struct(-F.col("w"), "community")).alias("community"), F.max("own").alias("weight")), "labels")
    return named_labels(labels, names)


def named_labels(labels: DataFrame, names: DataFrame) -> DataFrame:
    """(node, community) with names for their numbers. Names are the built sides, so a large community only streams."""
    node, community = (names.select(F.col("id").alias(c), F.col("name").alias(f"{c}_name")).hint("shuffle_hash") for c in ("node", "community"))
    return labels.select("node", "community").join(node, "node").join(community, "community").select(F.col("node_name").alias("node"), F.col("community_name").alias("community"))


def _sized(labels: DataFrame) -> DataFrame:
    """Labels (node, community, degree, name) with their community's size, the sum of its degrees."""
    sizes = labels.groupBy("community").agg(F.sum("degree").alias("size"))
    return written(labels.join(sizes.hint("shuffle_hash"), "community").select("node", "community", "degree", "name", "size"), "sized")


def _moved(near: DataFrame, sized: DataFrame, total: float, turn: int, tasks: int) -> DataFrame:
    """Labels after half of the nodes, chosen by hash and turn, have taken the community around them with the greatest gain of modularity.

    Rows also have what tells the quality of the labels before: within, the weight towards the node's old community, and square,
    its degree times that community's size. Edges stay in their buckets; what partners say is shuffled once, by node.
    """
    told = sized.select(F.col("node").alias("partner"), "community", "size")
    said = near.join(told.hint("shuffle_hash"), "partner").select("node", "community", "size", F.when(F.col("node") != F.col("partner"), F.col("weight")).otherwise(0.0).alias("weight"))
    around = said.repartition(tasks, "node").groupBy("node", "community").agg(F.sum("weight").alias("inward"), F.max("size").alias("size"))
    half = F.pmod(F.xxhash64("name", F.lit(turn)), F.lit(2)) == 0
    home = sized.select("node", F.col("community").alias("home"), "degree", F.col("size").alias("home_size"), half.alias("half"))
    weighed = around.join(home.hint("shuffle_hash"), "node")
    at_home = F.col("community") == F.col("home")
    gain = F.round(F.col("inward") - F.col("degree") * (F.col("size") - F.when(at_home, F.col("degree")).otherwise(0)) / total, 9)
    best = weighed.withColumn("gain", gain).groupBy("node", "home", "degree", "home_size", "half").agg(
        F.min_by("community", F.struct(-F.col("gain"), "community")).alias("best"), F.max("gain").alias("gain"), F.max(F.when(at_home, F.col("gain"))).alias("stay"), F.sum(F.when(at_home, F.col("inward"))).alias("within")
    )
    # Where no neighbour is at home, staying gains what a community without links to the node would.
    alone = F.round(0.0 - F.col("degree") * (F.col("home_size") - F.col("degree")) / total, 9)
    goes = F.col("half") & (F.col("gain") > F.coalesce("stay", alone))
    square = F.col("degree") * F.col("home_size")
    return best.select("node", F.when(goes, F.col("best")).otherwise(F.col("home")).alias("community"), "degree", F.coalesce("within", F.lit(0.0)).alias("within"), square.alias("square"))


def louvain(edges: DataFrame, least: float = 1e-6, turns: int = 24) -> DataFrame:
    """(node, community) by modularity gain: nodes move, half of them at a time, then communities become nodes, until nothing is gained.

    A community is named by its least node. Moves of one turn do not see each other, so the labels of the best turn are
    kept, and a level ends after three turns without a gain of `least` (after `turns` at most). Edges are unique and without loops.
    The quality of labels comes with the next turn's moves, from the same pass over the edges, which shuffles nothing where
    blocks hold the nodes.
    """
    found = held(edges)
    return louvain_by_joins(edges, least, turns) if found is None else louvain_in(*found, least, turns)


def louvain_in(graph: blocks.Adjacency, names: DataFrame, least: float = 1e-6, turns: int = 24) -> DataFrame:
    """louvain of a graph in blocks."""
    return blocks.labelled(graph, names, blocks.least_members(blocks.best_communities(graph, blocks.hashes_of(names, graph.n), least, turns)))


def louvain_by_joins(edges: DataFrame, least: float = 1e-6, turns: int = 24) -> DataFrame:
    near, names = numbered(edges)
    near = near.withColumn("weight", F.col("weight").cast("double"))
    total = near.agg(F.sum("weight").alias("w")).first().w
    members = written(near.select("node").distinct().select("node", F.col("node").alias("community")), "members")
    if not total:
        return named_labels(members, names)
    known = names.select(F.col("id").alias("node"), "name").hint("shuffle_hash")
    top = None
    while True:
        tasks = tasks_for(near.sparkSession, near.count())
        degree = written(near.groupBy("node").agg(F.sum("weight").alias("degree")).join(known, "node"), "degree")
        loops = near.filter("node = partner").agg(F.sum("weight").alias("w")).first().w or 0.0
        now = _sized(degree.select("node", F.col("node").alias("community"), "degree", "name"))
        start = best = kept = None
        idle, turn = 0, 0
        while True:
            after = written(_moved(near, now, total, turn + 1, tasks), "labels")
            sums = after.agg(F.sum("within").alias("within"), F.sum("square").alias("square")).first()
            q = (sums.within + loops) / total - sums.square / total**2
            if best is None:
                start, best, kept = q, q, now
            else:
                idle = 0 if q > best + least else idle + 1
                if q > best:
                    best, kept = q, now
            if idle >= 3 or turn >= turns:
                break
            turn += 1
            now = _sized(after.select("node", "community", "degree").join(known, "node"))
        if best <= start + least and top is not None:
            break
        to = kept.select(F.col("node").alias("community"), F.col("community").alias("to"))
        members = written(members.join(to.hint("shuffle_hash"), "community").select("node", F.col("to").alias("community")), "members")
        if best <= start + least:
            break
        top = best
        a = kept.select("node", F.col("community").alias("a"))
        b = kept.select(F.col("node").alias("partner"), F.col("community").alias("b"))
        merged = near.join(b.hint("shuffle_hash"), "partner").join(a.hint("shuffle_hash"), "node").groupBy(F.col("a").alias("node"), F.col("b").alias("partner")).agg(F.sum("weight").alias("weight"))
        merged = written(merged, "merged")
        near = bucketed(merged, "near", "partner", tasks_for(merged.sparkSession, merged.count()))
    least_of = members.groupBy("community").agg(F.min("node").alias("name"))
    return named_labels(members.join(least_of.hint("shuffle_hash"), "community").select("node", F.col("name").alias("community")), names)


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: the modularity of a labelling."""
    total = edges.agg(F.sum("weight").alias("m"))
    a = labels.select(F.col("node").alias("node_a"), F.col("community").alias("ca"))
    b = labels.select(F.col("node").alias("node_b"), F.col("community").alias("cb"))
    inside = edges.join(a, "node_a").join(b, "node_b").filter("ca = cb").agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("inside"))
    degree = both_ways(edges).join(labels, "node").groupBy("community").agg(F.sum("weight").alias("d")).agg(F.sum(F.col("d") * F.col("d")).alias("squares"))
    return total.crossJoin(inside).crossJoin(degree).select(F.round(F.col("inside") / F.col("m") - F.col("squares") / (4.0 * F.col("m") * F.col("m")), 6).alias("modularity"))


def modularities(graph: blocks.Adjacency, names: DataFrame, rounds: int = 5, least: float = 1e-6, turns: int = 24) -> DataFrame:
    """(method, modularity, communities) by label propagation and by modularity gain, of a graph in blocks."""
    found = {"label_propagation": blocks.spread_labels(graph, rounds), "louvain": blocks.best_communities(graph, blocks.hashes_of(names, graph.n), least, turns)}
    rows = [(m, round(blocks.quality(graph, labels), 6) if graph.total else None, len(np.unique(labels[graph.degree > 0]))) for m, labels in found.items()]
    return graph.spark.createDataFrame(rows, "method string, modularity double, communities long")
