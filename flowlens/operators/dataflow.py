"""Data flow over control-flow graphs and calls: reaching definitions with gen and kill, and flows whose calls and
returns match."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.operators.fixpoint import Dealt, Known, Rounds, cut, dealt_rounds, semi_naive
from flowlens.operators.graph import clean, reach


def through_pointers(accesses: DataFrame, pointing: DataFrame) -> DataFrame:
    """``accesses(block, pos, var, id)`` of *var as accesses of locations (block, pos, loc, id, strong): all that ``pointing(var,
    obj)`` gives for the variable; the access is of that location for sure (``strong``) if there is only one."""
    sole = pointing.groupBy("var").agg((F.count("*") == 1).alias("strong"))
    return accesses.join(sole, "var").join(pointing, "var").select("block", "pos", F.col("obj").alias("loc"), "id", "strong")


def reaching_definitions(flow: DataFrame, defs: DataFrame, uses: DataFrame) -> DataFrame:
    """(def_id, use_id): each use of a location with the definitions that may be the last before it.

    ``flow(src, dst)`` joins basic blocks; ``defs(block, pos, loc, id, strong)`` and ``uses(block, pos, loc, id)`` stand at
    places of blocks. A strong definition kills all others of its location; one that is not strong (through a pointer that
    may point elsewhere) kills none. Within a block strong definitions cut a location's places into segments, so a use
    meets one strong definition, not all before it; between blocks what a block generates goes to the entries of its
    successors, and on from there through blocks that do not kill it. Rows with a null block or location say nothing.
    """
    flow = cut(clean(flow))
    known = F.col("block").isNotNull() & F.col("loc").isNotNull()
    both = defs.where(known).select("block", "pos", "loc", "id", F.coalesce("strong", F.lit(False)).alias("strong"), F.lit(True).alias("is_def"))
    both = both.unionByName(uses.where(known).select("block", "pos", "loc", "id", F.lit(False).alias("strong"), F.lit(False).alias("is_def")))
    before = Window.partitionBy("block", "loc").orderBy("pos", "is_def").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # at one place uses come before the definition (x = x + 1)
    placed = cut(both.withColumn("segment", F.sum(F.col("strong").cast("int")).over(before)))
    last = placed.groupBy("block", "loc").agg(F.max("segment").alias("segment"))
    defined, used = placed.where("is_def"), placed.where("NOT is_def").select("block", "loc", "segment", F.col("pos").alias("use_pos"), F.col("id").alias("use_id"))
    inside = defined.join(used, ["block", "loc", "segment"]).where("pos < use_pos").select(F.col("id").alias("def_id"), "use_id")
    made = defined.join(last, ["block", "loc", "segment"]).select(F.col("id").alias("def_id"), "loc", F.col("block").alias("src"))
    kills = last.where("segment > 0").select("block", "loc")
    # each round reads kills, flow and all facts so far: all lie dealt as its joins want them, and only new facts travel
    keys, first = ["def_id", "loc", "block"], Rounds(flow.sparkSession)
    seed, n_seed = first.write(made.join(flow, "src").select("def_id", "loc", F.col("dst").alias("block")))
    facts, killing, flowing = (Dealt(flow.sparkSession, by, 1 + n_seed // Dealt.ROWS) for by in (keys, ["block", "loc"], ["src"]))
    try:
        kills, flow = killing.write(killing.deal(kills))[0], flowing.write(flowing.deal(flow))[0]
        step = lambda new: new.join(kills, ["block", "loc"], "left_anti").join(flow, F.col("block") == flow.src).select("def_id", "loc", F.col("dst").alias("block"))
        entries = dealt_rounds(seed, step, keys, facts)
        across, _ = first.write(entries.join(used.where("segment = 0"), ["block", "loc"]).select("def_id", "use_id"))
    finally:
        for rounds in (facts, killing, flowing):
            rounds.drop_all()
    first.drop(seed)
    return inside.unionByName(across).distinct()


def summaries(flow: DataFrame, calls: DataFrame, returns: DataFrame) -> DataFrame:
    """(src, dst): what a call's argument passes to its result: ``calls(site, src, dst)`` bind an argument to a parameter,
    ``returns(site, src, dst)`` a function's result to the caller's variable, and only those of one site belong together.

    Paths within functions and summaries of calls feed each other: a round joins the new paths with all edges and the
    new summaries with all paths.
    """
    return _summaries(cut(clean(flow)), _sites(calls), _sites(returns))


def _sites(bound: DataFrame) -> DataFrame:
    return cut(bound.select("site", "src", "dst").distinct())


def _summaries(flow: DataFrame, calls: DataFrame, returns: DataFrame) -> DataFrame:
    """``summaries`` of tables that are cut and distinct."""
    rounds = Rounds(flow.sparkSession)
    paths, n_paths = rounds.write(calls.select(F.col("dst").alias("entry"), F.col("dst").alias("node")).where("node IS NOT NULL").distinct())
    sums, n_sums = rounds.write(flow.where("false"))
    known_paths, known_sums = Known(rounds), Known(rounds)
    bind = calls.select("site", F.col("src").alias("argument"), F.col("dst").alias("entry"))
    back = returns.select("site", F.col("src").alias("result"), F.col("dst").alias("to"))
    while n_paths or n_sums:
        every, edges = known_paths.with_(paths), flow.unionByName(known_sums.with_(sums))
        on = paths.join(edges, paths.node == edges.src).select("entry", F.col("dst").alias("node"))
        again = every.join(sums, every.node == sums.src).select("entry", F.col("dst").alias("node"))
        more, n_more = rounds.write(on.unionByName(again).distinct().join(every, ["entry", "node"], "left_anti"))
        closed = more.unionByName(paths) if not known_paths.parts else more
        passed = closed.join(back, closed.node == back.result).join(bind, ["site", "entry"]).select(F.col("argument").alias("src"), F.col("to").alias("dst"))
        fresh, n_fresh = rounds.write(passed.where("src <> dst").distinct().join(known_sums.with_(sums), ["src", "dst"], "left_anti"))
        known_paths.add(paths)
        known_sums.add(sums)
        paths, n_paths, sums, n_sums = more, n_more, fresh, n_fresh
    return known_sums.with_(sums)


def context_reach(flow: DataFrame, calls: DataFrame, returns: DataFrame, sources: DataFrame) -> DataFrame:
    """(node, site): what ``sources(node)`` flow into along paths that return where they were called.

    First out of functions (through returns whose call the path has not seen), with whole calls taken as summaries; then
    into functions that do not return on the path. ``site`` names the call by which the path last went into one, one row for each (the call-stack tag of a report);
    it is null outside.
    """
    flow, calls, returns = cut(clean(flow)), _sites(calls), _sites(returns)  # computed once, though every round reads the calls
    inner = cut(flow.unionByName(_summaries(flow, calls, returns)).distinct())
    up = reach(inner.unionByName(returns.select("src", "dst")), sources).select("node")
    into = calls.select(F.col("site").alias("s"), "src", "dst")
    start = up.join(into, up.node == into.src).select(F.col("dst").alias("node"), F.col("s").alias("site")).where("node IS NOT NULL")
    stay = lambda new: new.join(inner, new.node == inner.src).select(F.col("dst").alias("node"), "site")
    call = lambda new: new.join(into, new.node == into.src).select(F.col("dst").alias("node"), F.col("s").alias("site"))
    down = semi_naive(start, lambda new: stay(new).unionByName(call(new)), ["node", "site"]).select("node", "site")
    return up.select("node", F.lit(None).cast(calls.schema["site"].dataType).alias("site")).unionByName(down)
