"""Lookups, predicates, joins, windows and set operations, generic over column names."""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .iterate import cut


def glob_to_regex(pattern: str) -> str:
    """A glob as an anchored regular expression: ``*`` and ``?`` stay inside a path segment, ``**`` crosses segments."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(pattern[i]), i + 1
    return f"^{out}$"


def path_matches(path: Column, pattern: str) -> Column:
    """The pattern itself, a directory above the path, or a glob."""
    if not set(pattern) & set("*?["):
        return (path == pattern) | path.startswith(pattern.rstrip("/") + "/")
    return path.rlike(glob_to_regex(pattern))


def by_name(df: DataFrame, name_col: str, name: str, kind_col: str | None = None, kind: str | None = None) -> DataFrame:
    found = df.where(F.col(name_col) == name)
    return found if kind is None else found.where(F.col(kind_col) == kind)


def tiered(df: DataFrame, name_col: str, term: str, exact: float = 1.0, prefix: float = 0.6) -> DataFrame:
    """Exact matches with their confidence, or, where there is none at all, words that start with the term."""
    name = F.lower(F.col(name_col))
    word = rf"(^|[^a-z0-9]){re.escape(term.lower())}"
    hits = df.withColumn("tier", F.when(name == term.lower(), 0).when(name.rlike(word), 1)).where("tier IS NOT NULL")
    best = hits.agg(F.min("tier").alias("best"))  # one row
    return hits.join(F.broadcast(best), F.col("tier") == F.col("best")).drop("best").withColumn("confidence", F.when(F.col("tier") == 0, exact).otherwise(prefix))


def alternatives(df: DataFrame, name_col: str, pattern: str, order: list[str]) -> DataFrame:
    """Each row that equals one of the terms of ``A|B|C``, once, with the first term that found it."""
    terms = pattern.split("|")
    rank = F.coalesce(*(F.when(F.col(name_col) == t, F.lit(i)) for i, t in enumerate(terms)))
    return df.withColumn("term_no", rank).where("term_no IS NOT NULL")


def without(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.join(right.select(on).distinct(), on, "left_anti")


def pairs_of_only_kind(df: DataFrame, pair: list[str], kind_col: str, kind: str) -> DataFrame:
    """Pairs all of whose rows are of one kind."""
    return df.groupBy(pair).agg(F.bool_and(F.col(kind_col).eqNullSafe(kind)).alias("only")).where("only").select(pair)


def cochange(baskets: DataFrame, basket: str, item: str, *, cap: int | None = 30, size_col: str | None = None, threshold: float = 0.0) -> DataFrame:
    """Pairs of items by the baskets that they share: item_a < item_b, shared, jaccard.

    The cap on a basket's size (its stated size, or else what is here) is the feature that bounds the self join: it comes first."""
    rows = baskets.where(F.col(item).isNotNull())
    size = F.coalesce(F.max(size_col), F.countDistinct(item)) if size_col else F.countDistinct(item)
    single = rows.select(basket, item).distinct()
    if cap is not None:
        small = rows.groupBy(basket).agg(size.alias("__size")).where(F.col("__size") <= cap).select(basket)
        single = single.join(small, basket)
    lists = single.groupBy(basket).agg(F.sort_array(F.collect_set(item)).alias("items")) if cap is not None else None
    count = single.groupBy(item).agg(F.count(F.lit(1)).alias("n"))
    if lists is not None:  # baskets are short: their pairs come from arrays, without a second shuffle
        expand = "flatten(transform(items, (x, i) -> transform(slice(items, i + 2, size(items)), y -> named_struct('a', x, 'b', y))))"
        pairs = lists.select(F.explode(F.expr(expand)).alias("p")).select("p.a", "p.b")
    else:
        pairs = single.toDF(basket, "a").join(single.toDF(basket, "b"), basket).where("a < b").select("a", "b")
    shared = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    got = shared.join(count.toDF("a", "na"), "a").join(count.toDF("b", "nb"), "b")
    jaccard = F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))
    return got.withColumn("jaccard", jaccard).where(F.col("jaccard") >= threshold).select(F.col("a").alias("item_a"), F.col("b").alias("item_b"), "shared", "jaccard")


def cochange_of(baskets: DataFrame, basket: str, item: str, key, *, threshold: float = 0.0) -> DataFrame:
    """The partners of one item, without a cap: item, shared, jaccard."""
    single = baskets.select(basket, item).distinct()
    mine = single.where(F.col(item) == key).select(basket)
    n = mine.agg(F.count(F.lit(1)).alias("n"))  # one row
    shared = single.where(F.col(item) != key).join(mine, basket, "left_semi").groupBy(item).agg(F.count(F.lit(1)).alias("shared"))
    of = single.groupBy(item).agg(F.count(F.lit(1)).alias("m"))
    got = shared.join(of, item).join(F.broadcast(n))
    return got.withColumn("jaccard", F.col("shared") / (F.col("n") + F.col("m") - F.col("shared"))).where(F.col("jaccard") >= threshold).select(F.col(item).alias("item"), "shared", "jaccard")


def cochange_renamed(changes: DataFrame, name: str, *, cap: int = 50, least: int = 2) -> DataFrame:
    """Partners of an entity over its renames, one hop to either side. changes: commit, name, old_name. name, shared, jaccard, confidence."""
    cols = changes.select("commit", "name", "old_name")
    names = cols.where(F.col("name") == name).select(F.col("old_name").alias("name")).union(cols.where(F.col("old_name") == name).select("name")).where("name IS NOT NULL").distinct()
    names = names.union(changes.sparkSession.createDataFrame([(name,)], "name string")).distinct()
    small = cols.groupBy("commit").agg(F.countDistinct("name").alias("n")).where(F.col("n") <= cap).select("commit")
    rows = cols.select("commit", "name").distinct().join(small, "commit")
    mine = rows.join(names, "name", "left_semi").select("commit").distinct()
    total = mine.agg(F.count(F.lit(1)).alias("n"))
    of = rows.join(names, "name", "left_anti")
    shared = of.join(mine, "commit", "left_semi").groupBy("name").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= least)
    got = shared.join(of.groupBy("name").agg(F.count(F.lit(1)).alias("m")), "name").join(F.broadcast(total))
    return got.select("name", "shared", (F.col("shared") / (F.col("n") + F.col("m") - F.col("shared"))).alias("jaccard"), (F.col("shared") / F.least("n", "m")).alias("confidence"))


CELLS = 64


def narrowest(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, span_id: str, point_id: str) -> DataFrame:
    """Each point with the narrowest span of its key that holds it: point_id, span_id.

    The range join is bucketed: a span is listed under each stretch that it touches, and a point meets the spans of one stretch a
    level. Stretches are the key's typical span length, times CELLS a level: a long span goes to the level at which it touches
    CELLS + 1 stretches at most."""
    step = spans.select(F.greatest(F.lit(1), F.expr(f"percentile_approx({end} - {start}, 0.5)")).cast("long").alias("step"))  # one row
    long_ = (F.col(end) - F.col(start)) / (F.col("step") * CELLS)
    level = F.when(long_ <= 1, 0).otherwise(F.ceil(F.log(long_) / math.log(CELLS))).cast("int")
    size = (F.col("step") * F.pow(F.lit(CELLS), F.col("level"))).cast("long")
    levelled = spans.crossJoin(F.broadcast(step)).withColumn("level", level).withColumn("size", size)
    near = levelled.withColumn("cell", F.explode(F.sequence(F.floor(F.col(start) / F.col("size")), F.floor(F.col(end) / F.col("size")))))
    levels = levelled.agg(F.collect_set("level").alias("levels"), F.first("step").alias("step"))  # one row, a few levels
    here = points.crossJoin(F.broadcast(levels)).withColumn("level", F.explode("levels")).withColumn("cell", F.floor(F.col(at) / size)).drop("step", "levels")
    both = here.join(near.select(key, "level", "cell", start, end, span_id), [key, "level", "cell"]).where(F.col(at).between(F.col(start), F.col(end)))
    best = F.min(F.struct((F.col(end) - F.col(start)).alias("w"), F.col(start).alias("s"), F.col(span_id).alias("id")))
    return both.groupBy(point_id).agg(best.alias("x")).select(point_id, F.col("x.id").alias(span_id))


def match_in_order(old: DataFrame, new: DataFrame, keys: list[str], old_id: str, new_id: str) -> DataFrame:
    """One-to-one matches of equal keys, k-th with k-th."""
    number = lambda df, i: df.withColumn("__k", F.row_number().over(Window.partitionBy(keys).orderBy(i)))
    return number(old, old_id).join(number(new, new_id), [*keys, "__k"]).select(*keys, old_id, new_id)


def surplus(found: DataFrame, accepted: DataFrame, keys: list[str], order: list[str], count_col: str = "accepted") -> DataFrame:
    """The rows beyond the accepted count of their key, in order."""
    numbered = found.withColumn("__k", F.row_number().over(Window.partitionBy(keys).orderBy(order)))
    return numbered.join(accepted.select(*keys, count_col), keys, "left").where(F.col("__k") > F.coalesce(count_col, F.lit(0))).drop("__k", count_col)


def average_rank(df: DataFrame, value: str, by: list[str], out: str, *, cells: int = 64) -> DataFrame:
    """Rank in (0, 1) inside by, ties sharing the mean rank, nulls first; 1 for a row alone. value: a number. Distinct values are counted first and
    each group's are cut into cells at approximate quantiles; a task orders the values of one cell, and the few cells of a group."""
    counts = cut(df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("__ties")))  # read several times
    splits = counts.groupBy(*by).agg(F.percentile_approx(value, [k / cells for k in range(1, cells)], 1000).alias("__splits"))
    cell = F.size(F.filter(F.coalesce("__splits", F.array()), lambda x: x < F.col(value)))
    celled = alike(counts, splits, by).withColumn("__cell", cell).drop("__splits")
    before = (Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("__ties").over(Window.partitionBy(*by, "__cell").orderBy(value).rowsBetween(*before)), F.lit(0))
    each = celled.groupBy(*by, "__cell").agg(F.sum("__ties").alias("__held"))
    group = Window.partitionBy(*by)
    base = F.coalesce(F.sum("__held").over(group.orderBy("__cell").rowsBetween(*before)), F.lit(0))
    each = each.withColumn("__base", base).withColumn("__n", F.sum("__held").over(group)).drop("__held")
    below = F.col("__base") + F.col("__inside") + (F.col("__ties") - 1) / 2
    ranks = alike(celled.withColumn("__inside", inside), each, [*by, "__cell"]).select(*by, value, F.when(F.col("__n") <= 1, 1.0).otherwise(below / (F.col("__n") - 1)).alias(out))
    return alike(df, ranks, [*by, value])


def alike(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left with the other columns of right, where all keys are equal or null on both sides."""
    names = [f"__right{i}" for i in range(len(keys))]
    renamed = right.select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), *(c for c in right.columns if c not in keys))
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)]
    return left.join(renamed, same).drop(*names)


def top_per_group(df: DataFrame, by: list[str], order: list[Column], k, total: int | None = None) -> DataFrame:
    """The first k rows of each group and, of those, the first total."""
    some = df.withColumn("__k", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("__k") <= k).drop("__k")
    return some if total is None else some.orderBy(*order).limit(total)


def runs(df: DataFrame, by: list[str], pos: str) -> DataFrame:
    """Gaps and islands: the runs of consecutive positions: by, start, length."""
    island = F.col(pos) - F.row_number().over(Window.partitionBy(by).orderBy(pos))
    return df.withColumn("__i", island).groupBy(*by, "__i").agg(F.min(pos).alias("start"), F.count(F.lit(1)).alias("length")).drop("__i")


def sessions(df: DataFrame, by: list[str], at: str, gap: float, tie: str) -> DataFrame:
    """Rows no further than gap apart share a session number, from 0, inside by."""
    w = Window.partitionBy(by).orderBy(at, tie)
    new = F.when(F.col(at) - F.lag(at).over(w) > gap, 1).otherwise(0)
    return df.withColumn("__new", new).withColumn("session", F.sum("__new").over(w)).drop("__new")


def drift(stored: DataFrame, walked: DataFrame, key: str, mark: str, complete: bool = True) -> DataFrame:
    """added, changed and, if the walk was complete, removed keys."""
    both = stored.select(key, F.col(mark).alias("__old"), F.lit(True).alias("__s")).join(walked.select(key, F.col(mark).alias("__new"), F.lit(True).alias("__w")), key, "full_outer")
    state = F.when(F.col("__s").isNull(), "added").when(F.col("__w").isNull(), "removed" if complete else None).when(~F.col("__old").eqNullSafe(F.col("__new")), "changed")
    return both.select(key, state.alias("state")).where("state IS NOT NULL")


def replace_by_key(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old without the keys of new, and new."""
    return old.join(new.select(keys).distinct(), keys, "left_anti").select(new.columns).union(new)


def replace_all(df: DataFrame, path: str) -> DataFrame:
    """The table at a path, replaced by df as a whole."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def tiered_alternatives(df: DataFrame, column: str, terms: str, order: list[str]) -> DataFrame:
    """df's rows that a term of "A|B|C" finds, by its first such term: by equality where the term equals any value, else as a prefix.
    tier is exact only if all terms that find anything are. Terms are literals of the plan."""
    parts = [x for x in terms.split("|") if x]
    equal = df.agg(*(F.bool_or(F.col(column) == x).alias(f"e{i}") for i, x in enumerate(parts)), *(F.bool_or(F.col(column).startswith(x)).alias(f"p{i}") for i, x in enumerate(parts)))  # one row
    rows = df.join(F.broadcast(equal))
    hit = [F.when(F.when(F.col(f"e{i}"), F.col(column) == x).otherwise(F.col(column).startswith(x)), i) for i, x in enumerate(parts)]
    every = reduce(lambda p, q: p & q, (F.col(f"e{i}") | ~F.col(f"p{i}") for i in range(len(parts))))
    found = rows.withColumn("term_no", F.coalesce(*hit)).withColumn("tier", F.when(every, "exact").otherwise("prefix"))
    return found.where("term_no IS NOT NULL").select(*df.columns, "term_no", "tier")


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old, and the rows of new whose keys it lacks, one a key."""
    return old.union(new.join(old.select(keys), keys, "left_anti").dropDuplicates(keys).select(old.columns))


def newest(df: DataFrame, order: str, keep: int) -> DataFrame:
    return df.orderBy(F.desc(order)).limit(keep)
