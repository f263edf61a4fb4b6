"""Reachability and structure of directed graphs given as ``edges(src, dst)``.

Node ids may be of any one comparable type. Every operator drops null ends and repeated edges first.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.operators.fixpoint import Known, RoundLimitError, Rounds, cut, rounds_of, semi_naive


def clean(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct()


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


#: Rounds that a search takes before it looks for chains to contract.
PATIENCE = 16
#: Call sites, and targets, that meet as one row.
BLOCK = 1024


def reach(edges: DataFrame, seeds: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(node, depth): every node on a path from ``seeds(node)``, the seeds included at depth 0.

    Where the search has not ended after PATIENCE rounds, chains among the nodes not yet reached are contracted
    by pointer jumping and the search goes on over what branches, so a chain takes the logarithm of its length.
    There is no limit of depth but one that the caller gives (``max_rounds``; deeper graphs raise RoundLimitError).
    """
    return _reach(cut(clean(edges)), seeds, max_rounds)


def _reach(edges: DataFrame, seeds: DataFrame, max_rounds: int | None = None) -> DataFrame:
    step = lambda new: new.join(edges, new.node == edges.src).select(F.col("dst").alias("node"))
    seeds = seeds.select("node").where("node IS NOT NULL")
    if max_rounds is not None:
        return semi_naive(seeds, step, ["node"], max_rounds).select("node", F.col("round").cast("bigint").alias("depth"))
    found, frontier = rounds_of(seeds, step, ["node"], PATIENCE)
    found = found.select("node", F.col("round").cast("bigint").alias("depth"))
    if frontier is None:
        return found
    frontier = frontier.select("node", F.col("round").cast("bigint").alias("depth"))
    left = edges.join(found.select(F.col("node").alias("dst")), "dst", "left_anti")
    left = cut(left.join(found.where(F.col("depth") < PATIENCE).select(F.col("node").alias("src")), "src", "left_anti").select("src", "dst"))
    return found.unionByName(_far(left, frontier))


def _far(edges: DataFrame, frontier: DataFrame) -> DataFrame:
    """(node, depth) of the nodes beyond ``frontier(node, depth)``, over edges that enter none of it."""
    # ends from which nothing goes on take no part in the search
    inner = cut(edges.join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
    links = chains(inner, frontier.select("node"))
    heads = links.select(F.col("node").alias("src"), "head", "steps")
    hops = inner.join(links.select(F.col("node").alias("dst")), "dst", "left_anti").join(heads, "src", "left")
    hops = cut(hops.groupBy(F.coalesce("head", "src").alias("src"), "dst").agg(F.min(F.coalesce("steps", F.lit(0)) + 1).alias("length")))
    rounds = Rounds(edges.sparkSession)
    known, n = rounds.write(frontier)
    new = known
    while n:
        told = new.join(hops, new.node == hops.src).groupBy(F.col("dst").alias("node")).agg(F.min(F.col("depth") + F.col("length")).alias("depth"))
        fresh, n = rounds.write(told.join(known.withColumnRenamed("depth", "had"), "node", "left").where("had IS NULL OR depth < had").select("node", "depth"))
        both, _ = rounds.write(known.unionByName(fresh).groupBy("node").agg(F.min("depth").alias("depth")))
        rounds.drop(new, known)
        new, known = fresh, both
    on_chains = links.join(known.withColumnRenamed("node", "head"), "head").select("node", (F.col("depth") + F.col("steps")).alias("depth"))
    reached = cut(known.unionByName(on_chains))
    rounds.drop(new, known)
    ends = edges.join(reached.withColumnRenamed("node", "src"), "src").join(reached.select(F.col("node").alias("dst")), "dst", "left_anti")
    ends = ends.groupBy(F.col("dst").alias("node")).agg((F.min("depth") + 1).alias("depth"))
    return reached.join(frontier.select("node"), "node", "left_anti").unionByName(ends)


def chains(edges: DataFrame, but: DataFrame | None = None) -> DataFrame:
    """(node, head, steps, tail, low): nodes with one edge in and one edge out (except ``but``); the nearest
    nodes before and after that have not, and how far ``head`` is. In a ring without such a node head and tail are null and ``low`` is
    its smallest node. By pointer jumping: as many rounds as the logarithm of the longest chain."""
    ends = edges.where("src <> dst").select(F.col("src").alias("node"), F.col("dst").alias("after"), F.lit(None).cast(edges.schema["src"].dataType).alias("before"))
    ends = ends.unionByName(edges.where("src <> dst").select(F.col("dst").alias("node"), F.lit(None).cast(edges.schema["src"].dataType).alias("after"), F.col("src").alias("before")))
    degrees = ends.groupBy("node").agg(F.count("before").alias("n_in"), F.count("after").alias("n_out"), F.min("before").alias("head"), F.min("after").alias("tail"))
    links = degrees.where("n_in = 1 AND n_out = 1").join(edges.where("src = dst").select(F.col("src").alias("node")), "node", "left_anti")
    if but is not None:
        links = links.join(but, "node", "left_anti")
    rounds = Rounds(edges.sparkSession)
    one = F.lit(1).cast("bigint")
    jump, total = rounds.write(links.select("node", "head", one.alias("steps"), "tail", F.col("node").alias("low")))
    if not total:
        return jump
    for _ in range(total.bit_length()):
        up = jump.select(F.col("node").alias("head"), F.col("head").alias("head2"), F.col("steps").alias("steps2"), F.col("low").alias("low2"))
        down = jump.select(F.col("node").alias("tail"), F.col("tail").alias("tail2"))
        both = jump.join(up, "head", "left").join(down, "tail", "left")
        moved = F.col("head2").isNotNull() | F.col("tail2").isNotNull()
        both = both.select(
            "node", F.coalesce("head2", "head").alias("head"), (F.col("steps") + F.coalesce("steps2", F.lit(0))).alias("steps"), F.coalesce("tail2", "tail").alias("tail"),
            F.least("low", F.coalesce("low2", "low")).alias("low"), moved.alias("moved"),
        )
        fresh, _ = rounds.write(both)
        rounds.drop(jump)
        jump = fresh
        if jump.where("moved").isEmpty():
            break
    inside = jump.select(F.col("node").alias("head"), F.lit(True).alias("ring"))
    out = jump.join(inside, "head", "left")
    real = F.col("ring").isNull()
    return cut(out.select("node", F.when(real, F.col("head")).alias("head"), "steps", F.when(real, F.col("tail")).alias("tail"), "low"))


def closure(edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(src, dst) for all pairs joined by a path of at least one edge, from all nodes or from ``sources(node)``.

    Edge by edge while that takes at most PATIENCE rounds. In deeper graphs strong components become one node each until the
    end, and the pairs of all nodes come by doubling (paths of up to 2^k edges, then all that a path of exactly 2^k
    more reaches); those of some sources go on edge by edge.
    """
    edges = cut(clean(edges))
    hop = edges.select(F.col("src").alias("mid"), F.col("dst").alias("to"))
    begin = edges if sources is None else edges.join(sources.select(F.col("node").alias("src")).distinct(), "src", "left_semi")
    found, left = rounds_of(begin, lambda new: new.join(hop, new.dst == hop.mid).select("src", F.col("to").alias("dst")), ["src", "dst"], PATIENCE)
    return found.select("src", "dst") if left is None else _condensed_closure(edges, sources)


def _condensed_closure(edges: DataFrame, sources: DataFrame | None) -> DataFrame:
    scc = cut(strong_components(edges))
    dag = cut(contract(edges, scc))
    if sources is None:
        pairs = _doubled(dag)
    else:
        hop = dag.select(F.col("src").alias("mid"), F.col("dst").alias("to"))
        seed = dag.join(scc.join(sources.select("node").distinct(), "node").select(F.col("scc").alias("src")).distinct(), "src", "left_semi")
        pairs = semi_naive(seed, lambda new: new.join(hop, new.dst == hop.mid).select("src", F.col("to").alias("dst")), ["src", "dst"]).select("src", "dst")
    loops = scc.groupBy("scc").agg(F.count("*").alias("n")).where("n > 1").select("scc").unionByName(edges.where("src = dst").join(scc.withColumnRenamed("node", "src"), "src").select("scc")).distinct()
    pairs = pairs.unionByName(loops.select(F.col("scc").alias("src"), F.col("scc").alias("dst")))
    begin = scc if sources is None else scc.join(sources.select("node").distinct(), "node", "left_semi")
    begin, end = begin.select(F.col("node").alias("a"), F.col("scc").alias("src")), scc.select(F.col("node").alias("b"), F.col("scc").alias("dst"))
    return pairs.join(begin, "src").join(end, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))


def _doubled(dag: DataFrame) -> DataFrame:
    """All pairs that a path of an acyclic graph joins."""
    rounds = Rounds(dag.sparkSession)
    pairs, n = rounds.write(dag)
    leap = dag
    while n:
        ahead = leap.select(F.col("src").alias("mid"), F.col("dst").alias("to"))
        over = lambda first, ahead=ahead: first.join(ahead, first.dst == ahead.mid).select("src", F.col("to").alias("dst"))
        more, _ = rounds.write(pairs.unionByName(over(pairs)).distinct())
        farther, n = rounds.write(over(leap).distinct())
        rounds.drop(pairs, leap)
        pairs, leap = more, farther
    return pairs


def can_reach(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """The demanded ``pairs(src, dst)`` that a path joins (a node reaches itself); only their sources are expanded."""
    pairs = pairs.select("src", "dst").distinct()
    linked = closure(edges, pairs.select(F.col("src").alias("node"))).union(pairs.where("src = dst")).distinct()
    return pairs.join(linked, ["src", "dst"], "left_semi")


def between(edges: DataFrame, start: DataFrame, end: DataFrame) -> DataFrame:
    """(node): nodes on some path from ``start(node)`` to ``end(node)``."""
    return reach(edges, start).select("node").intersect(reach(reversed_edges(edges), end).select("node"))


def simple_paths(edges: DataFrame, start: DataFrame, end: DataFrame, max_length: int = 6, max_paths: int = 1_000_000) -> DataFrame:
    """(path): all paths without repeated nodes of at most ``max_length`` edges. More than ``max_paths``
    open paths raise an error; nothing is cut off silently."""
    edges = cut(clean(edges))
    goal = end.select(F.col("node").alias("last")).distinct()
    paths = cut(start.select(F.array("node").alias("path")).distinct())
    done = paths.where("false")
    for _ in range(max_length):
        longer = paths.join(edges, F.element_at("path", -1) == edges.src).where(~F.array_contains("path", F.col("dst")))
        paths = cut(longer.select(F.concat("path", F.array("dst")).alias("path")))
        if (n := paths.count()) > max_paths:
            raise RoundLimitError(f"{n} open paths; the limit is max_paths={max_paths}")
        if not n:
            break
        done = done.union(paths.withColumn("last", F.element_at("path", -1)).join(goal, "last", "left_semi").select("path"))
    return done


def _trimmed(edges: DataFrame) -> tuple[DataFrame, int]:
    """Edges whose ends both have a predecessor and a successor, and their number: what no cycle can hold is taken off, round by round."""
    rounds = Rounds(edges.sparkSession)
    left, before = None, 0
    while left != before:
        kept = edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        kept, n = rounds.write(kept.join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        rounds.drop(edges)
        edges, before, left = kept, left, n
        if not left:
            break
    return edges, left


def _least_ancestor(edges: DataFrame) -> DataFrame:
    """(node, colour): the smallest node with a path to each node, itself included. Only nodes whose colour fell pass it on."""
    rounds = Rounds(edges.sparkSession)
    known = Known(rounds)
    fresh, n = rounds.write(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct().withColumn("colour", F.col("node")))
    while n:
        now = known.with_(fresh).groupBy("node").agg(F.min("colour").alias("colour"))
        told = fresh.join(edges, fresh.node == edges.src).groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("told"))
        lower, n = rounds.write(told.join(now, "node").where("told < colour").select("node", F.col("told").alias("colour")))
        known.add(fresh)
        fresh = lower
    return cut(known.with_(fresh).groupBy("node").agg(F.min("colour").alias("colour")))


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, scc): strongly connected components, named by their smallest node.

    Chains become one edge each and rings are found by pointer jumping. Then nodes on no cycle are trimmed, and the
    component of the node with most ways through it is what it reaches and is reached by. Of the rest each node
    takes as colour the smallest node that reaches it; the nodes that reach their colour's node within the colour are its
    component. What is left goes round again, without the edges between colours, as no component has two. No table
    holds more rows than there are edges or nodes.
    """
    edges = cut(clean(edges))
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    links = chains(edges)
    rings = links.where("head IS NULL").select("node", F.col("low").alias("name"))
    open_ = links.where("head IS NOT NULL")
    hops = edges.where("src <> dst").join(links.select(F.col("node").alias("dst")), "dst", "left_anti").join(open_.select(F.col("node").alias("src"), "head"), "src", "left")
    hops = hops.select(F.coalesce("head", "src").alias("src"), "dst").where("src <> dst").distinct()
    found = cut(_components(*_trimmed(hops)))
    # a chain lies on a cycle if its ends are one node, or of one component
    ends = [found.select(F.col("node").alias(end), F.col("name").alias(f"{end}_name")) for end in ("head", "tail")]
    named = open_.join(ends[0], "head", "left").join(ends[1], "tail", "left").withColumn("a", F.coalesce("head_name", "head")).where(F.col("a") == F.coalesce("tail_name", "tail"))
    whole = found.unionByName(rings).unionByName(named.select("node", F.col("a").alias("name")))
    whole = whole.unionByName(named.where("head = tail AND head_name IS NULL").select(F.col("head").alias("node"), F.col("head").alias("name"))).distinct()
    least = whole.groupBy("name").agg(F.min("node").alias("scc"))
    known = whole.join(least, "name").select("node", "scc")
    return nodes.join(known, "node", "left").select("node", F.coalesce("scc", "node").alias("scc"))


def _components(core: DataFrame, n_edges: int) -> DataFrame:
    """(node, name): components of more than one node."""
    found = core.select(F.col("src").alias("node"), F.col("src").alias("name")).where("false")
    if not n_edges:
        return found
    degrees = core.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(core.select("dst", F.lit(0), F.lit(1))).groupBy("node").agg((F.sum("o") * F.sum("i")).alias("ways"))
    pivot = degrees.orderBy(F.desc("ways"), "node").select("node").first()[0]
    # what it reaches, and what reaches it, in one search
    way = F.lit(True), F.lit(False)
    both = core.select("src", "dst", way[0].alias("forward")).union(core.select("dst", "src", way[1]))
    step = lambda new: new.join(both, (new.node == both.src) & (new.way == both.forward)).select(F.col("dst").alias("node"), "way")
    start = core.select(F.lit(pivot).cast(core.schema["src"].dataType).alias("node")).limit(1)
    side = semi_naive(start.select("node", way[0].alias("way")).union(start.select("node", way[1])), step, ["node", "way"])
    side = cut(side.groupBy("node").agg(F.sum(F.when(F.col("way"), 2).otherwise(1)).alias("side")))
    found = side.where("side = 3").select("node", F.lit(pivot).cast(core.schema["src"].dataType).alias("name"))
    of = lambda end: side.select(F.col("node").alias(end), F.col("side").alias(f"{end}_side"))
    rest = core.join(of("src"), "src", "left").join(of("dst"), "dst", "left").fillna(0, ["src_side", "dst_side"]).where("src_side = dst_side AND src_side < 3")
    core, n_edges = _trimmed(rest.select("src", "dst"))
    while n_edges:
        colours = _least_ancestor(core)
        of_src = colours.select(F.col("node").alias("src"), F.col("colour").alias("scc"))
        of_dst = colours.select(F.col("node").alias("dst"), F.col("colour").alias("other"))
        inside = cut(core.join(of_src, "src").join(of_dst, "dst").where("scc = other").select("src", "dst", "scc"))
        back = _reach(reversed_edges(inside), colours.where("node = colour").select("node"))
        new = cut(colours.join(back, "node", "left_semi").select("node", F.col("colour").alias("name")))
        found = found.unionByName(new)
        rest = inside.join(new.select(F.col("node").alias("src")), "src", "left_anti").join(new.select(F.col("node").alias("dst")), "dst", "left_anti")
        core, n_edges = _trimmed(rest.select("src", "dst"))
    return found


def contract(edges: DataFrame, scc: DataFrame) -> DataFrame:
    """Edges between components, without loops: an acyclic graph."""
    a, b = scc.select(F.col("node").alias("src"), F.col("scc").alias("s")), scc.select(F.col("node").alias("dst"), F.col("scc").alias("d"))
    return clean(edges).join(a, "src").join(b, "dst").where("s <> d").select(F.col("s").alias("src"), F.col("d").alias("dst")).distinct()


def bottom_up(edges: DataFrame, facts: DataFrame) -> DataFrame:
    """(node, fact): facts of callees flow to all callers. Where that takes more than PATIENCE rounds, strongly
    connected functions share one summary until the end."""
    edges = cut(clean(edges))
    callers = reversed_edges(edges)
    found, left = rounds_of(facts, lambda new: new.join(callers, new.node == callers.src).select(F.col("dst").alias("node"), "fact"), ["node", "fact"], PATIENCE)
    if left is None:
        return found.select("node", "fact")
    scc = cut(strong_components(edges))
    callers = cut(reversed_edges(contract(edges, scc)))
    named = found.select("node", "fact").join(scc, "node", "left").withColumn("scc", F.coalesce("scc", "node"))
    step = lambda new: new.join(callers, new.scc == callers.src).select(F.col("dst").alias("scc"), "fact")
    summaries = semi_naive(named, step, ["scc", "fact"]).select("scc", "fact")
    alone = facts.select("node").join(scc, "node", "left_anti").select("node", F.col("node").alias("scc"))
    return summaries.join(scc.unionByName(alone.distinct()), "scc").select("node", "fact")


def top_down(edges: DataFrame, facts: DataFrame) -> DataFrame:
    """(node, fact): facts of callers flow to all callees."""
    return bottom_up(reversed_edges(edges), facts)


def roots(nodes: DataFrame, edges: DataFrame, named: list[str] | None = None) -> DataFrame:
    """Entry points: nodes in ``named``, or where none are given those that no edge enters."""
    if named:
        return nodes.where(F.col("node").isin(named))
    return nodes.join(edges.select(F.col("dst").alias("node")).where("node IS NOT NULL"), "node", "left_anti")


def wrappers(flows: DataFrame, known: DataFrame) -> DataFrame:
    """(node, depth): names from which a known allocator's result flows out, found by growing the set."""
    return reach(flows, known)


def multi_sink(edges: DataFrame, sources: DataFrame, sinks: DataFrame, least: int = 2) -> DataFrame:
    """(src, n_sinks): sources that reach at least ``least`` different sinks."""
    pairs = closure(edges, sources)
    hits = pairs.join(sinks.select(F.col("node").alias("dst")).distinct(), "dst", "left_semi")
    return hits.groupBy("src").agg(F.count("*").alias("n_sinks")).where(F.col("n_sinks") >= least)


def violations(nodes: DataFrame, edges: DataFrame, marker: str = "*SummSource*", constant: str = "CONST[") -> DataFrame:
    """(label, const_name): constants that unlabelled sources reach.

    A node starts a search if it has a label and either no predecessor and no marker in its label, or one
    predecessor only, which is marked and has none itself. A node reaches itself.
    """
    edges = cut(clean(edges))
    entering = edges.groupBy(F.col("dst").alias("name")).agg(F.count("*").alias("n"), F.min("src").alias("sole"))
    known = nodes.select("name", "label").join(entering, "name", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    marked = F.col("label").contains(marker)
    marked_roots = known.where((F.col("n") == 0) & marked).select(F.col("name").alias("sole")).withColumn("root", F.lit(True))
    start = known.join(marked_roots, "sole", "left").where(F.col("label").isNotNull() & (((F.col("n") == 0) & ~marked) | ((F.col("n") == 1) & F.col("root"))))
    start = cut(start.select("name", "label"))
    pairs = closure(edges, start.select(F.col("name").alias("node"))).union(start.select("name", "name"))
    return pairs.join(start, pairs.src == start.name).where(F.col("dst").contains(constant)).select("label", F.col("dst").alias("const_name")).distinct()


def virtual_calls(sites: DataFrame, inherits: DataFrame, tables: DataFrame) -> DataFrame:
    """(site, fn): targets of calls ``sites(site, cls, slot)`` through a class: functions that the class or one that
    ``inherits(base, sub)`` from it, directly or not, holds in that slot (``tables(cls, slot, fn)``). Only the
    classes that calls name are expanded.

    Sites that name the same classes and slots have the same targets. Both come in blocks of about BLOCK, so what is dealt out
    are pairs of blocks; only the tasks that write the result hold its rows, and none of them is compared with another.
    """
    named = sites.select(F.col("cls").alias("node")).distinct()
    below = closure(inherits.select(F.col("base").alias("src"), F.col("sub").alias("dst")), named).union(named.select("node", "node")).distinct()
    held = below.select(F.col("src").alias("cls"), F.col("dst").alias("at")).join(tables.withColumnRenamed("cls", "at"), "at").select("cls", "slot", "fn").distinct()
    at = F.when(F.col("cls").isNotNull() & F.col("slot").isNotNull(), F.struct("cls", "slot"))
    calls = cut(sites.groupBy("site").agg(F.array_sort(F.collect_set(at)).alias("at")).where("size(at) > 0"))
    targets = calls.select("at").distinct().select("at", F.inline("at")).join(held, ["cls", "slot"]).select("at", "fn").distinct()
    pairs, n = Rounds(sites.sparkSession).write(_blocks(calls, "at", "site").join(_blocks(cut(targets), "at", "fn"), "at").select("sites", "fns"))
    return pairs.repartition(n // 8 + 1).select(F.inline("sites"), "fns").select("site", F.inline("fns"))


def _blocks(rows: DataFrame, key: str, item: str) -> DataFrame:
    """(key, <item>s): the items of each key in arrays of about BLOCK structs, dealt by their hash."""
    sizes = rows.groupBy(key).agg(F.ceil(F.count("*") / BLOCK).alias("_n"))
    dealt = rows.join(sizes, key).withColumn("_block", F.pmod(F.xxhash64(item), "_n"))
    return dealt.groupBy(key, "_block").agg(F.collect_list(F.struct(item)).alias(f"{item}s")).drop("_block")


def adjacency(nodes: DataFrame, edges: DataFrame, root: str = "< root >") -> DataFrame:
    """(caller, callees): one line of sorted callee names each; the root calls every node."""
    calls = edges.select(F.col("src").alias("caller"), F.col("dst").alias("callee")).distinct()
    calls = calls.union(nodes.select(F.lit(root), "node"))
    return calls.groupBy("caller").agg(F.array_join(F.array_sort(F.collect_set("callee")), " ").alias("callees"))


def dominators(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """(fn, node, dom): for each function graph ``edges(fn, src, dst)`` with ``entries(fn, entry)`` (several of one function count as
    one start), the dominators of each node that an entry reaches.

    A node is dominated by those without which no entry reaches it: the fixpoint follows, for every node left
    out, what is still reached, so functions of any size are dealt over the cluster by (node left out, node reached).
    """
    edges = cut(edges.select("fn", "src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    start = entries.select("fn", F.col("entry").alias("node")).where("node IS NOT NULL").distinct()
    hop = edges.select("fn", F.col("src").alias("node"), "dst")
    reached = cut(semi_naive(start, lambda new: new.join(hop, ["fn", "node"]).select("fn", F.col("dst").alias("node")), ["fn", "node"]).select("fn", "node"))
    without = reached.select("fn", F.col("node").alias("dom")).join(start, "fn").where("dom <> node")
    step = lambda new: new.join(hop, ["fn", "node"]).where("dst <> dom").select("fn", "dom", F.col("dst").alias("node"))
    free = semi_naive(without, step, ["fn", "dom", "node"]).select("fn", "dom", "node")
    pairs = reached.join(reached.select("fn", F.col("node").alias("dom")), "fn")
    return pairs.join(free, ["fn", "dom", "node"], "left_anti").select("fn", "node", "dom")


def _postorder(group: pd.DataFrame) -> pd.DataFrame:
    after: dict[int, list[int]] = {}
    for a, b in zip(group["src"], group["dst"], strict=True):
        after.setdefault(a, []).append(b)
    entry = group["entry"].iloc[0]
    order, seen, stack = [], {entry}, [(entry, iter(sorted(set(after.get(entry, [])))))]
    while stack:  # depth first, without recursion
        node, rest = stack[-1]
        for nxt in rest:
            if nxt not in seen:
                seen.add(nxt)
                stack.append((nxt, iter(sorted(set(after.get(nxt, []))))))
                break
        else:
            order.append(node)
            stack.pop()
    return pd.DataFrame({"fn": group["fn"].iloc[0], "node": order, "post": range(1, len(order) + 1)})


def postorder(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """(fn, node, post): post-order numbers of a depth-first walk, smaller nodes first. The walk is sequential by nature: a
    function's graph is one group, so it must fit one task; functions are dealt over the cluster."""
    return edges.select("fn", "src", "dst").distinct().join(entries, "fn").groupBy("fn").applyInPandas(_postorder, "fn bigint, node bigint, post bigint")


def control_dependence(edges: DataFrame, exits: DataFrame) -> DataFrame:
    """(fn, node, controls): B depends on A if B post-dominates a successor of A but does not strictly post-dominate A."""
    turned = edges.select("fn", F.col("dst").alias("src"), F.col("src").alias("dst"))
    post = cut(dominators(turned, exits).select("fn", F.col("node").alias("of"), F.col("dom").alias("controls")))
    flow = edges.select("fn", F.col("src").alias("node"), F.col("dst").alias("of")).distinct()
    after = flow.join(post, ["fn", "of"]).select("fn", "node", "controls").distinct()
    strict = post.where("of <> controls").select("fn", F.col("of").alias("node"), "controls")
    return after.join(strict, ["fn", "node", "controls"], "left_anti")
