"""Information-flow constraints from instruction facts, and offsets of pointers.

``generate`` compiles instructions into ``constraints(lhs, rhs, kind, section)``: what taints lhs taints rhs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.operators.fixpoint import Rounds, cut

#: Operations whose result takes on what any operand holds. A constant or an address is no operand that carries taint.
VALUE_OPS = ("copy", "binop", "compare", "cast", "phi", "select")


def generate(
    insts: DataFrame, operands: DataFrame, pointing: DataFrame, elements: DataFrame | None = None, control: DataFrame | None = None, params: DataFrame | None = None, results: DataFrame | None = None, kind: str = "default"
) -> DataFrame:
    """(lhs, rhs, kind, section) of instructions ``insts(inst, op, result, block, fn)`` with ``operands(inst, pos, value)``.

    * A value operation passes each operand to its result; ``addr`` passes nothing, so the address of a tainted object is clean.
    * ``load`` (operand 0: the pointer) passes what each location of ``pointing(var, obj)`` holds to the result, ``store`` (operand 0: the
      pointer, 1: the value) the value to each location. With ``elements(obj, elem)`` a location stands for its elements: one for each
      field or constant index, all of them where a place is not known.
    * ``call`` with ``fn`` binds operands to ``params(fn, pos, value)`` and ``results(fn, value)`` to its own result. Of a
      function without parameters and results of its own nothing is known: each operand flows to the result and into all that
      the pointers among the operands reach.
    * A result in a block of ``control(block, cond)`` takes on the condition: section ``implicit``, as does a phi by the conditions of its block;
      stores there pass the condition to their locations.

    Each constraint comes once; null values, and values that flow to themselves, say nothing.
    """
    held = pointing.select("var", "obj")
    if elements is not None:
        held = held.join(elements, "obj", "left").select("var", F.coalesce("elem", "obj").alias("obj"))
    rounds = Rounds(insts.sparkSession)
    held, _ = rounds.write(held.distinct())
    use, _ = rounds.write(insts.select("inst", "op", "result", "block", "fn").join(operands, "inst"))
    first, second = use.where("pos = 0"), use.where("pos = 1 AND op = 'store'").select("inst", F.col("value").alias("given"))
    # a store meets its value before the locations of its pointer multiply it; one without a value still counts for its block
    stored = first.where("op = 'store'").join(second, "inst", "left").join(held, F.col("value") == held["var"]).select("block", "given", "obj")
    explicit = [
        use.where(F.col("op").isin(*VALUE_OPS)).select(F.col("value").alias("lhs"), F.col("result").alias("rhs")),
        first.where("op = 'load'").join(held, F.col("value") == held["var"]).select(F.col("obj").alias("lhs"), F.col("result").alias("rhs")),
        stored.select(F.col("given").alias("lhs"), F.col("obj").alias("rhs")),
    ]
    calls = use.where("op = 'call'")
    known = None
    if params is not None and results is not None:
        known = params.select("fn").union(results.select("fn")).distinct()
        explicit.append(calls.join(params.select("fn", "pos", F.col("value").alias("formal")), ["fn", "pos"]).select(F.col("value").alias("lhs"), F.col("formal").alias("rhs")))
        explicit.append(insts.where("op = 'call'").select("fn", "result").join(results, "fn").select(F.col("value").alias("lhs"), F.col("result").alias("rhs")))
    unknown = cut(calls if known is None else calls.join(known, "fn", "left_anti"))
    explicit.append(unknown.select(F.col("value").alias("lhs"), F.col("result").alias("rhs")))
    written = unknown.join(held, F.col("value") == held["var"]).select("inst", F.col("obj").alias("rhs"))
    read = unknown.select("inst", F.col("value").alias("lhs")).unionByName(written.select("inst", F.col("rhs").alias("lhs")))
    explicit.append(read.join(written, "inst").select("lhs", "rhs"))
    explicit.append(written.join(insts.select("inst", "result"), "inst").select(F.col("rhs").alias("lhs"), F.col("result").alias("rhs")))
    out = explicit[0]
    for part in explicit[1:]:
        out = out.unionByName(part)
    out = out.withColumn("section", F.lit("default"))
    if control is not None:
        decided = insts.where("result IS NOT NULL").select("block", F.col("result").alias("rhs")).unionByName(stored.select("block", F.col("obj").alias("rhs")))
        out = out.unionByName(decided.join(control, "block").select(F.col("cond").alias("lhs"), "rhs", F.lit("implicit").alias("section")))
    out = out.where("lhs IS NOT NULL AND rhs IS NOT NULL AND lhs <> rhs").distinct()
    return out.select("lhs", "rhs", F.lit(kind).alias("kind"), "section")


def pointer_offsets(roots: DataFrame, steps: DataFrame) -> DataFrame:
    """(root, node, offset): where pointers derived from ``roots(root)`` point, relative to it.

    ``steps(src, dst, offset)`` derive dst from src by a constant number of bytes, or by one that is not known (null). Two ways to
    a pointer with different offsets make it unknown (null), and so all that is derived from it: a loop that advances a pointer settles there.
    A fixpoint over values that only rise (none, known, unknown), so a pointer is visited at most twice; each round
    sends on what changed.
    """
    rounds = Rounds(steps.sparkSession)
    steps = cut(steps.where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    start = roots.where("root IS NOT NULL").select("root", F.col("root").alias("node"), F.lit(0).cast("bigint").alias("offset")).distinct()
    table, n = rounds.write(start)
    values = fresh = table
    while n:
        moved = fresh.join(steps.withColumnRenamed("offset", "by"), fresh.node == steps.src).select("root", F.col("dst").alias("node"), (F.col("offset") + F.col("by")).alias("to"))
        told = moved.groupBy("root", "node").agg(F.min("to").alias("a"), F.max("to").alias("b"), F.count_if(F.col("to").isNull()).alias("lost"))
        both = values.withColumn("seen", F.lit(True)).join(told, ["root", "node"], "full")
        sure = (F.col("lost") == 0) & (F.col("a") == F.col("b"))
        stays = F.coalesce(F.col("seen"), F.lit(False)) & (F.col("offset").isNull() | (sure & F.coalesce(F.col("a") == F.col("offset"), F.lit(False))))
        changed = F.col("lost").isNotNull() & ~stays
        value = F.when(~changed, F.col("offset")).otherwise(F.when(F.col("seen").isNull() & sure, F.col("a")))
        merged, _ = rounds.write(both.select("root", "node", value.alias("offset"), changed.alias("changed")))
        rounds.drop(table)
        table, values, fresh = merged, merged.drop("changed"), merged.where("changed").drop("changed")
        n = not fresh.isEmpty()
    return values
