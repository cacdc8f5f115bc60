"""Graph operators over edge tables (src, dst)."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import reach
from .iterate import cut

IN_MEMORY = 2_000_000  # edges of a graph that is ordered on the driver: 32 MB


def following(rows: DataFrame, order: str, value: str, *, by: str | None = None, step: int = 4096, levels: int = 2) -> DataFrame:
    """rows with next: the value of the row after it in the order of a whole number (of its group `by`). Rows are ordered inside
    cells of `step` numbers; only each cell's first value goes on, to be ordered alike, so that no task orders more than a cell and, at the
    last level, the rows by step**levels."""
    keys = [by] if by else []
    if not levels:
        return rows.withColumn("next", F.lead(value).over(Window.partitionBy(*keys).orderBy(order)))
    celled = rows.withColumn("__cell", F.floor(F.col(order) / step))
    inside = F.lead(value).over(Window.partitionBy(*keys, "__cell").orderBy(order))
    first = celled.groupBy(*keys, F.col("__cell").alias("c")).agg(F.min_by(value, order).alias("v"))
    after = following(first, "c", "v", by=by, step=step, levels=levels - 1).select(*keys, F.col("c").alias("__cell"), F.col("next").alias("__after"))
    got = celled.withColumn("__in", inside).join(after, [*keys, "__cell"])
    return got.withColumn("next", F.coalesce("__in", "__after")).drop("__cell", "__in", "__after")


def adjacency(*edges: DataFrame) -> DataFrame:
    """The distinct edges of all tables, without self loops."""
    return reduce(DataFrame.union, (e.select("src", "dst") for e in edges)).where("src <> dst").distinct()


def fan_in(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("id")).agg(F.countDistinct("src").alias("fan_in"))


def levels(edges: DataFrame, start: DataFrame, depth: int, *, backward: bool = False) -> DataFrame:
    """(root, id, level) of all nodes within depth steps of each root, itself at level 0; the first level counts. start: id."""
    step = edges.select(*(("dst", "src") if backward else ("src", "dst"))).toDF("id", "next").where("id <> next").distinct()
    seen = start.select(F.col("id").alias("root"), "id", F.lit(0).alias("level"))
    front = seen
    for k in range(1, depth + 1):
        reached = front.join(step, "id").select("root", F.col("next").alias("id")).distinct()
        front = reached.join(seen.select("root", "id"), ["root", "id"], "left_anti").withColumn("level", F.lit(k))
        if depth > 3:
            front = cut(front)
        seen = seen.union(front)
    return seen


def within(edges: DataFrame, nodes: DataFrame, depth: int, *, backward: bool = False, width: int = 60) -> DataFrame:
    """(root, word, mask): the nodes (whole numbers) within depth steps of each node, itself among them. The bits of a mask are the nodes from
    word * width on, so that nodes of near numbers are carried and united as one row. nodes: id; ends of edges are roots too."""
    word = F.expr(f"(id - pmod(id, {width})) div {width}").alias("word")
    own = F.expr(f"shiftleft(1L, CAST(pmod(id, {width}) AS INT))").alias("mask")
    step = cut(edges.select(*(("dst", "src") if backward else ("src", "dst"))).toDF("root", "next").where("root <> next").distinct())
    base = nodes.select(F.col("id").cast("long")).union(step.select("root")).union(step.select("next")).distinct().select(F.col("id").alias("root"), word, own)
    reached = base
    for _ in range(depth):
        onward = step.join(reached.withColumnRenamed("root", "next"), "next").select("root", "word", "mask")
        reached = onward.union(base).groupBy("root", "word").agg(F.bit_or("mask").alias("mask"))
    return reached


def blast_radius(edges: DataFrame, depth: int = 3) -> DataFrame:
    """(id, blast_radius): the nodes other than id that reach it within depth edges."""
    e = edges.select("src", "dst").distinct()
    near, out = e, e
    for _ in range(depth - 1):
        near = near.toDF("src", "mid").join(e.toDF("mid", "dst"), "mid").select("src", "dst").distinct()
        out = out.union(near)
    return out.where("src <> dst").distinct().groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("blast_radius"))


def _ordered(edges: DataFrame) -> tuple[DataFrame, reach.Order | None]:
    """The distinct edges and their order, None where there are more than IN_MEMORY of them or their nodes are no whole numbers."""
    e = edges.select("src", "dst").distinct()
    if {x.dataType.simpleString() for x in e.schema} - {"int", "bigint"}:
        return e, None
    e = cut(e)
    whole = e.where("src IS NOT NULL AND dst IS NOT NULL").select(F.col("src").cast("long"), F.col("dst").cast("long"))
    if whole.count() > IN_MEMORY:
        return e, None
    held = whole.toArrow()
    return e, reach.order(held["src"].to_numpy(), held["dst"].to_numpy())


def _by_units(spark, o: reach.Order, run, schema: str, *, spread: bool = False) -> DataFrame:
    """The rows that run(order, unit) gives, arrays of columns, over all units of the order. spread: so many units that all tasks have some."""
    most = 4 * spark.sparkContext.defaultParallelism
    work = reach.units(o, most if spread else 1)
    held = spark.sparkContext.broadcast((o, work))
    names = [x.split()[0] for x in schema.split(", ")]

    def task(batches):
        order_, all_ = held.value
        for batch in batches:
            for k in batch.column(0).to_pylist():
                for columns in run(order_, all_[k]):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    parts = max(1, min(len(work), most))
    return spark.range(0, len(work), 1, parts).mapInArrow(task, schema)


def closure(edges: DataFrame) -> DataFrame:
    """All pairs (src, dst) joined by a path of one edge or more. Nulls are no node, only ends of edges."""
    e, o = _ordered(edges)
    if o is None:
        return closure_by_doubling(e)
    kinds = [x.dataType for x in e.schema]
    tc = _by_units(edges.sparkSession, o, reach.pairs, "src bigint, dst bigint", spread=True).select(F.col("src").cast(kinds[0]), F.col("dst").cast(kinds[1]))
    loose = e.where("src IS NULL OR dst IS NULL")
    if loose.isEmpty():
        return tc
    into = tc.join(loose.where("dst IS NULL").select(F.col("src").alias("end")), F.col("dst") == F.col("end")).select("src", F.lit(None).cast(kinds[1]).alias("dst"))
    out = loose.where("src IS NULL").toDF("src", "mid").join(tc.toDF("mid", "dst"), "mid").select("src", "dst")
    return tc.union(loose.union(into).union(out).distinct())


def closure_by_doubling(edges: DataFrame) -> DataFrame:
    """The same pairs in rounds that double the path, for graphs of any size and nodes of any type."""
    tc, n = cut(edges.select("src", "dst").distinct()), -1
    while True:
        now = tc.count()
        if now == n:
            return tc
        n = now
        longer = tc.toDF("src", "mid").join(tc.toDF("mid", "dst"), "mid").select("src", "dst")
        tc = cut(tc.union(longer).distinct())


def reach_count(tc: DataFrame) -> DataFrame:
    return tc.where("src <> dst").groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("reach_count"))


def reached_by(edges: DataFrame) -> DataFrame:
    """(id, reach_count) as reach_count gives it of the closure, without one row of which is made."""
    e, o = _ordered(edges)
    if o is None:
        return reach_count(closure_by_doubling(e))
    n = _by_units(edges.sparkSession, o, reach.counts, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("reach_count"))
    return n.where("reach_count > 0").select(F.col("id").cast(e.schema["dst"].dataType), "reach_count")


def cycle_nodes(tc: DataFrame) -> DataFrame:
    return tc.where("src = dst").select(F.col("src").alias("id"))


def components_of_cycles(tc: DataFrame) -> DataFrame:
    """(id, scc): nodes on cycles, by the least node that they reach and that reaches them."""
    both = tc.join(tc.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_semi")
    return both.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("scc"))


def strong_components(edges: DataFrame) -> DataFrame:
    """(id, scc) as components_of_cycles gives it of the closure, in a pass over the edges."""
    e, o = _ordered(edges)
    if o is None:
        return components_of_cycles(closure_by_doubling(e))
    size = np.diff(o.start)
    on = np.repeat(o.cyclic, size)
    kind = e.schema["src"].dataType
    found = edges.sparkSession.createDataFrame(pa.table({"id": o.ids[on], "scc": np.repeat(o.least, size)[on]}))
    return found.select(F.col("id").cast(kind), F.col("scc").cast(kind))


def pagerank(edges: DataFrame, nodes: DataFrame, *, damping: float = 0.85, rounds: int = 100, tolerance: float | None = 1e-6, seeds: DataFrame | None = None, start: DataFrame | None = None, every: int = 4) -> DataFrame:
    """(id, rank). Without seeds rank teleports evenly and dangling mass is spread evenly; with seeds (id, share) both return to them.
    start (id, rank) warms the first round. Stops early below tolerance; lineage is cut each `every` rounds."""
    e = cut(edges.select("src", "dst").where("src <> dst").distinct())
    degree = e.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    home = nodes.select("id").distinct()
    n = home.count()
    if not n:
        return home.withColumn("rank", F.lit(0.0))
    home = home.join(seeds.select("id", "share"), "id", "left").withColumn("share", F.coalesce("share", F.lit(0.0))) if seeds is not None else home.withColumn("share", F.lit(1.0 / n))
    base = home.join(degree, "id", "left")
    base = base.join(start.select("id", F.col("rank").alias("warm")), "id", "left") if start is not None else base.withColumn("warm", F.lit(None).cast("double"))
    rank = F.col("share") if seeds is not None else F.lit(1.0 / n)
    if start is not None:
        total = base.agg(F.sum(F.coalesce("warm", F.lit(1.0 / n))).alias("total"))  # one row
        base = base.join(F.broadcast(total))
        rank = F.coalesce("warm", F.lit(1.0 / n)) / F.col("total")
    base = cut(base.select("id", "share", "degree", rank.alias("rank")))
    fixed, now = base.select("id", "share", "degree"), base.select("id", "rank")
    for k in range(1, rounds + 1):
        held = fixed.join(now, "id")
        loose = held.agg(F.coalesce(F.sum(F.when(F.col("degree").isNull(), F.col("rank"))), F.lit(0.0)).alias("loose"))  # one row
        given = e.join(held.where("degree IS NOT NULL").select(F.col("id").alias("src"), (F.col("rank") / F.col("degree")).alias("part")), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("part").alias("got"))
        new = held.join(given, "id", "left").join(F.broadcast(loose)).select("id", ((1 - damping) * F.col("share") + damping * (F.coalesce("got", F.lit(0.0)) + F.col("loose") * F.col("share"))).alias("rank"))
        if k % every == 0 or k == rounds:
            new = cut(new)
            if tolerance is not None and new.join(now.toDF("id", "before"), "id").agg(F.max(F.abs(F.col("rank") - F.col("before")))).first()[0] < tolerance:
                return new
        now = new
    return now


def split_rank(ranks: DataFrame, parts: DataFrame) -> DataFrame:
    """A group's rank over its parts by references, evenly without any. ranks: id, rank; parts: id, part, refs."""
    w = Window.partitionBy("id")
    share = F.when(F.sum("refs").over(w) > 0, F.col("refs") / F.sum("refs").over(w)).otherwise(1 / F.count(F.lit(1)).over(w))
    return parts.withColumn("share", share).join(ranks, "id").select("id", "part", (F.col("rank") * F.col("share")).alias("rank"))


def undirected(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) as edges both ways, once each."""
    one = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return one.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(one.select(F.col("b").alias("src"), F.col("a").alias("dst")))


def weighted(pairs: DataFrame) -> DataFrame:
    """Weights (a, b, weight) summed over undirected pairs."""
    return pairs.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("weight").alias("weight"))


def communities(edges: DataFrame, *, rounds: int = 10) -> DataFrame:
    """(id, community) by label propagation over weighted undirected edges (a, b, weight): each node takes the label of most weight around
    it, the least of equals; nodes of odd and even hash take turns, so that pairs do not swap for ever."""
    both = cut(edges.select(F.col("a").alias("id"), F.col("b").alias("near"), "weight").union(edges.select(F.col("b").alias("id"), F.col("a").alias("near"), "weight")))
    label = cut(both.select("id").distinct().withColumn("community", F.col("id")))
    for k in range(rounds):
        mine = both.join(label.toDF("near", "theirs"), "near").groupBy("id", "theirs").agg(F.round(F.sum("weight"), 9).alias("weight"))
        best = mine.groupBy("id").agg(F.min_by("theirs", F.struct(-F.col("weight"), "theirs")).alias("best"))
        turn = F.pmod(F.xxhash64("id"), F.lit(2)) == k % 2
        new = cut(label.join(best, "id").select("id", F.when(turn, F.col("best")).otherwise(F.col("community")).alias("community")))
        if k % 2 and new.exceptAll(label).isEmpty():
            return new
        label = new
    return label


def split_large(groups: DataFrame, most: int = 12) -> DataFrame:
    """(id, community, part): communities over the limit in chunks of it, by id."""
    return groups.withColumn("part", F.floor((F.row_number().over(Window.partitionBy("community").orderBy("id")) - 1) / most).cast("long"))


def common_directory(paths: DataFrame, by: str, path: str) -> DataFrame:
    """(by, name): the longest directory that all paths of a group share, from the least and the greatest path alone."""
    ends = paths.groupBy(by).agg(F.min(path).alias("lo"), F.max(path).alias("hi"))
    a, b = (F.split(F.regexp_replace(c, "/[^/]*$", ""), "/") for c in ("lo", "hi"))
    pairs = F.arrays_zip(a.alias("x"), b.alias("y"))
    stop = F.array_position(F.transform(pairs, lambda p: ~p["x"].eqNullSafe(p["y"])), F.lit(True))
    size = F.when(stop > 0, stop - 1).otherwise(F.size(pairs))
    return ends.withColumn("a", a).withColumn("size", size.cast("int")).select(by, F.array_join(F.slice("a", 1, F.col("size")), "/").alias("name"))


def community_events(old: DataFrame, new: DataFrame, drift: float = 0.3) -> DataFrame:
    """merge, split and drift between two partitions (id, community): event, community, others."""
    both = old.select("id", F.col("community").alias("o")).join(new.select("id", F.col("community").alias("n")), "id")
    cells = both.groupBy("o", "n").agg(F.count(F.lit(1)).alias("k"))
    merged = cells.groupBy(F.col("n").alias("community")).agg(F.count(F.lit(1)).alias("others")).where("others > 1").select(F.lit("merge").alias("event"), "community", "others")
    split = cells.groupBy(F.col("o").alias("community")).agg(F.count(F.lit(1)).alias("others"), (1 - F.max("k") / F.sum("k")).alias("moved"))
    return merged.union(split.where("others > 1").select(F.lit("split"), "community", "others")).union(split.where(F.col("moved") > drift).select(F.lit("drift"), "community", "others"))
