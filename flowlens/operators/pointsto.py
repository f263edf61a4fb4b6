"""Inclusion-based points-to sets, aliases and escapes.

Statements: ``addr(var, obj)``: var = &obj; ``copy(to, from)``: to = from; ``load(to, from)``: to = *from; ``store(to, from)``:
*to = from. A location is a variable as well (what it holds), so variables and objects share one set of names.
Statements with a null end say nothing.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from flowlens.operators import bitsets
from flowlens.operators.fixpoint import Known, Rounds, cut
from flowlens.operators.graph import reach, strong_components

#: Cycles are looked for after so many rounds, then four times as many, and so on: a loop that goes on that long may be
#: one that circles, a shorter one costs less than the search.
PATIENCE = 16
#: Where names are numbers, 2^BLOCK_BITS neighbours are a block, and 2^CHUNK_BITS blocks are solved in one task: at most 2^(2 BLOCK_BITS + CHUNK_BITS)
#: different statements of a kind, however large the tables are.
BLOCK_BITS, CHUNK_BITS = 5, 9


def _renamed(df: DataFrame, merged: DataFrame, *columns: str) -> DataFrame:
    """``df`` with variables replaced by the representative ``merged(node, rep)`` gives them."""
    for c in columns:
        df = df.join(merged.select(F.col("node").alias(c), F.col("rep").alias("_rep")), c, "left").withColumn(c, F.coalesce("_rep", c)).drop("_rep")
    return df


def _cycles(flow: DataFrame) -> DataFrame:
    """(node, rep) of variables on a cycle of copies that are not its smallest."""
    return strong_components(flow.select(F.col("from").alias("src"), F.col("to").alias("dst"))).where("node <> scc").select("node", F.col("scc").alias("rep"))


def _settled(near: pa.Table, bits: int, edges: bool) -> pa.Table:
    """(edge, a, b): facts (var, obj) and, if wanted, copy edges (from, to) that statements ``near(kind, to, from)`` inside blocks give by
    themselves: boolean matrices of all blocks at a time."""
    kind, to, of = (near[c].to_numpy() for c in ("kind", "to", "from"))
    blocks, at = np.unique(to >> bits, return_inverse=True)
    width = 1 << bits
    p, e, loads, stores = np.zeros((4, len(blocks), width, width), np.float32)
    for k, (matrix, row, column) in enumerate([(p, to, of), (e, of, to), (loads, of, to), (stores, to, of)]):
        rows = kind == k
        matrix[at[rows], row[rows] & (width - 1), column[rows] & (width - 1)] = 1
    turned = lambda m: np.swapaxes(m, 1, 2)
    size = -1
    while size != (size := np.count_nonzero(p) + np.count_nonzero(e)):
        e = np.minimum(e + turned(p) @ loads + turned(stores) @ p, 1)
        p = np.minimum(p + turned(e) @ p, 1)
    out = []
    for edge, matrix in [(False, p), (True, e)][: 1 + edges]:
        block, a, b = np.nonzero(matrix)
        base = blocks[block] << bits
        out.append(pa.table({"edge": np.full(len(a), edge), "a": base + a, "b": base + b}))
    return pa.concat_tables(out)


def _near(statements: list[DataFrame], rounds: Rounds) -> tuple[DataFrame, DataFrame, list[DataFrame] | None]:
    """Facts and edges that statements between neighbours (both names in one block) give by themselves, each found in one task, and the
    other statements (None where there are none, and then no edges either)."""
    bits = BLOCK_BITS
    same = F.shiftright("to", bits) == F.shiftright("from", bits)
    far = [df.where(~same) for df in statements]
    tagged = [df.where(same).select(F.lit(k).alias("kind"), F.col("to").cast("bigint").alias("to"), F.col("from").cast("bigint").alias("from")) for k, df in enumerate(statements)]
    # rows of a chunk are brought together once; repeated statements go there, before the task sees them
    near = reduce(DataFrame.unionByName, tagged).withColumn("chunk", F.shiftright("to", bits + CHUNK_BITS)).repartition("chunk").distinct()
    edges = any(not df.isEmpty() for df in far)
    solved, _ = rounds.write(near.groupBy("chunk").applyInArrow(lambda t: _settled(t, bits, edges), "edge boolean, a bigint, b bigint"))
    kind = statements[0].schema["to"].dataType
    named = lambda edge, a, b: solved.where(F.col("edge") == edge).select(F.col("a").cast(kind).alias(a), F.col("b").cast(kind).alias(b))
    return named(False, "var", "obj"), named(True, "from", "to").where("to <> from"), far if edges else None


def points_to(addr: DataFrame, copy: DataFrame, load: DataFrame, store: DataFrame) -> DataFrame:
    """(var, obj): what each variable may point to.

    Facts and copy edges feed each other. A round joins the new facts with all edges and the new edges with all
    facts; loads and stores turn new facts into new edges. Variables on a cycle of copies hold the same set:
    cycles are merged in loops that go on for PATIENCE rounds, and again if edges were added; from then on the loop works on
    representatives, and members get their sets at the end. Where names are numbers, what neighbours say of each other is settled
    first, and the loop starts from the other statements.
    """
    rounds = Rounds(addr.sparkSession)
    two = lambda df, a, b: df.select(a, b).where(F.col(a).isNotNull() & F.col(b).isNotNull()).distinct()
    given = [addr.select(F.col("var").alias("to"), F.col("obj").alias("from")), copy, load, store]
    given = [df.select("to", "from").where(F.col("to").isNotNull() & F.col("from").isNotNull()) for df in given]
    kinds = {df.schema[c].dataType for df in given for c in ("to", "from")}
    known_facts, known_edges = Known(rounds), Known(rounds)
    facts, edges = two(addr, "var", "obj"), two(copy, "to", "from").where("to <> from")
    if len(kinds) == 1 and isinstance(kinds.pop(), IntegralType):
        near_facts, near_edges, far = _near(given, rounds)
        known_facts.add(near_facts)
        if far is None:
            return near_facts
        known_edges.add(near_edges)
        of = near_facts.select(F.col("var").alias("v"), F.col("obj").alias("o"))
        facts = far[0].select(F.col("to").alias("var"), F.col("from").alias("obj")).distinct()
        through = far[2].join(of, F.col("from") == F.col("v")).select("to", F.col("o").alias("from"))
        through = through.unionByName(far[3].join(of, F.col("to") == F.col("v")).select(F.col("o").alias("to"), "from"))
        edges = far[1].unionByName(through).where("to <> from").distinct().join(near_edges.select("to", "from"), ["to", "from"], "left_anti")
    loads, stores = cut(two(load, "to", "from")), cut(two(store, "to", "from"))
    merged = None  # (node, rep)
    new_facts, n_facts = rounds.write(facts)
    new_edges, n_edges = rounds.write(edges)
    number, next_check, grown = 0, PATIENCE, n_edges
    while n_facts or n_edges:
        if number >= next_check and grown:
            cycles, n = rounds.write(_cycles(known_edges.with_(new_edges)))
            if n:  # everything is rewritten to representatives; what a merged set must still pass on counts as new
                merged_now = cycles if merged is None else _renamed(merged, cycles, "rep").unionByName(cycles)
                merged_now, _ = rounds.write(merged_now)
                facts, n_facts = rounds.write(_renamed(known_facts.with_(new_facts), cycles, "var").distinct())
                edges, n_edges = rounds.write(_renamed(known_edges.with_(new_edges), cycles, "to", "from").where("to <> from").distinct())
                loads, stores = cut(_renamed(loads, cycles, "to", "from").distinct()), cut(_renamed(stores, cycles, "to", "from").distinct())
                known_facts.drop()
                known_edges.drop()
                rounds.drop(new_facts, new_edges, merged)
                merged, new_facts, new_edges = merged_now, facts, edges
            rounds.drop(cycles)
            next_check, grown = max(PATIENCE, 4 * number), 0
        of = new_facts.select(F.col("var").alias("v"), F.col("obj").alias("o"))
        every = known_facts.with_(new_facts).select(F.col("var").alias("v"), F.col("obj").alias("o"))
        all_edges = known_edges.with_(new_edges)
        flowed = of.join(all_edges, F.col("v") == F.col("from")).select(F.col("to").alias("var"), F.col("o").alias("obj"))
        flowed = flowed.unionByName(every.join(new_edges, F.col("v") == F.col("from")).select(F.col("to").alias("var"), F.col("o").alias("obj")))
        next_facts, next_n = rounds.write(flowed.distinct().join(known_facts.with_(new_facts), ["var", "obj"], "left_anti"))
        through = loads.join(of, loads["from"] == F.col("v")).select("to", F.col("o").alias("from"))
        through = through.unionByName(stores.join(of, stores["to"] == F.col("v")).select(F.col("o").alias("to"), "from"))
        if merged is not None:
            through = _renamed(through, merged, "to", "from")
        next_edges, next_e = rounds.write(through.where("to <> from").distinct().join(all_edges, ["to", "from"], "left_anti"))
        known_facts.add(new_facts)
        known_edges.add(new_edges)
        new_facts, n_facts, new_edges, n_edges = next_facts, next_n, next_edges, next_e
        number, grown = number + 1, grown + n_edges
    found = known_facts.with_(new_facts)
    if merged is None:
        return found.select("var", "obj")
    members = merged.unionByName(merged.select(F.col("rep").alias("node"), "rep").distinct())
    return found.join(members.withColumnRenamed("rep", "var"), "var", "left").select(F.coalesce("node", "var").alias("var"), "obj")


def aliases(pointing: DataFrame) -> DataFrame:
    """(a, b), a < b: variables whose points-to sets meet."""
    other = pointing.select(F.col("var").alias("b"), "obj")
    return pointing.select(F.col("var").alias("a"), "obj").join(other, "obj").where("a < b").select("a", "b").distinct()


def must_not_alias(pointing: DataFrame, pairs: DataFrame) -> DataFrame:
    """The demanded ``pairs(a, b)`` whose sets do not meet; only their sets are joined, words of 64 numbers at a time where objects are numbers."""
    if isinstance(pointing.schema["obj"].dataType, IntegralType):
        words = bitsets.packed(pointing, "var", "obj")
    else:
        words = pointing.select(F.col("var").alias("owner"), F.col("obj").alias("word"), F.lit(1).cast("bigint").alias("bits"))
    words, _ = Rounds(pointing.sparkSession).write(words)
    pairs = pairs.select("a", "b").distinct()
    of = lambda name, bits: words.select(F.col("owner").alias(name), "word", F.col("bits").alias(bits))
    meet = pairs.join(of("a", "x"), "a").join(of("b", "y"), ["b", "word"]).where(F.col("x").bitwiseAND(F.col("y")) != 0)
    return pairs.join(meet.select("a", "b"), ["a", "b"], "left_anti")


def escaped(pointing: DataFrame, external: DataFrame) -> DataFrame:
    """(obj): locations that code outside can reach: what ``external(var)`` (globals, arguments of unknown functions)
    may point to, and what those locations may point to in turn."""
    holds = pointing.select(F.col("var").alias("src"), F.col("obj").alias("dst"))
    seeds = pointing.join(external.select("var").distinct(), "var", "left_semi").select(F.col("obj").alias("node"))
    return reach(holds, seeds).select(F.col("node").alias("obj"))
