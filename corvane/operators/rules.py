"""Reference resolution, dependency rules, waivers, diffs, lessons and histories as joins and folds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import path_matches

SEVERITIES = {"info": 0, "advisory": 1, "blocking": 2}


@dataclass(frozen=True)
class Rule:
    """A forbidden dependency from one path pattern to another."""

    kind: str
    source: str
    target: str
    name: str | None = None
    severity: str = "advisory"

    @property
    def id(self) -> str:
        return hashlib.sha256("\0".join((self.kind, self.source, self.target)).encode()).hexdigest()[:8]


def parse_rules(rows: list[dict]) -> list[Rule]:
    """Rules of a document in its order: the first of equal ids holds; a name may be given once."""
    out: dict[str, Rule] = {}
    names: set[str] = set()
    for row in rows:
        rule = Rule(row["kind"], row["from"], row["to"], row.get("name"), row.get("severity", "advisory"))
        if rule.severity not in SEVERITIES:
            raise ValueError(f"unknown severity: {rule.severity}")
        if rule.id in out:
            continue
        if rule.name in names:
            raise ValueError(f"duplicate rule name: {rule.name}")
        names |= {rule.name} - {None}
        out[rule.id] = rule
    return list(out.values())


def first_rule(edges: DataFrame, rules: list[Rule], source: str, target: str) -> DataFrame:
    """Edges that break a rule, with the first that they break. Rules are literals of the plan: one pass over the edges."""
    hits = [F.when(path_matches(F.col(source), r.source) & path_matches(F.col(target), r.target), F.struct(F.lit(r.id).alias("rule"), F.lit(r.severity).alias("severity"))) for r in rules]
    return edges.withColumn("__hit", F.coalesce(*hits)).where("__hit IS NOT NULL").select(*edges.columns, "__hit.rule", "__hit.severity")


def rule_coverage(paths: DataFrame, path: str, rules: list[Rule]) -> DataFrame:
    """(rule, sources, targets): how many paths each side of a rule matches; 0 shows a dead rule."""
    sums = [x for i, r in enumerate(rules) for x in (F.count_if(path_matches(F.col(path), r.source)).alias(f"s{i}"), F.count_if(path_matches(F.col(path), r.target)).alias(f"t{i}"))]
    row = paths.agg(*sums)
    return row.select(F.explode(F.array(*(F.struct(F.lit(r.id).alias("rule"), F.col(f"s{i}").alias("sources"), F.col(f"t{i}").alias("targets")) for i, r in enumerate(rules)))).alias("x")).select("x.*")


def resolve(refs: DataFrame, rungs: list[DataFrame], ref_id: str) -> DataFrame:
    """The ladder: rungs give (ref_id, target, order...) candidates; the first rung with any decides, by least order.
    Returns ref_id, target (null if none), rung."""
    ranked = [r.select(ref_id, F.lit(i).alias("rung"), F.struct(*[c for c in r.columns if c not in (ref_id, "target")], "target").alias("o"), "target") for i, r in enumerate(rungs)]
    typed = [r.select(ref_id, "rung", F.to_json("o").alias("o"), "target") if len({x.schema["o"].dataType.simpleString() for x in ranked}) > 1 else r for r in ranked]
    best = reduce(DataFrame.union, typed).groupBy(ref_id).agg(F.min_by(F.struct("target", "rung"), F.struct("rung", "o")).alias("b"))
    return refs.select(ref_id).join(best, ref_id, "left").select(ref_id, "b.target", "b.rung")


def best_of_key(candidates: DataFrame, key: str) -> DataFrame:
    """Candidates (key, target, order...) of a rung that depend on the key alone: the one that `resolve` would choose of each key, so that
    references that share a key do not meet all of its candidates."""
    order = F.struct(*[c for c in candidates.columns if c not in (key, "target")], "target")
    return candidates.groupBy(key).agg(F.min_by(F.struct(*[c for c in candidates.columns if c != key]), order).alias("b")).select(key, "b.*")


def first_candidate(imports: DataFrame, id_col: str, candidates: Column, files: DataFrame, path: str) -> DataFrame:
    """Imports by the first of their candidate paths that is a file: id, path."""
    rows = imports.select(id_col, F.posexplode(candidates).alias("priority", path))
    return rows.join(files.select(path).distinct(), path).groupBy(id_col).agg(F.min_by(path, "priority").alias(path))


def partition_by_waiver(findings: DataFrame, waivers: DataFrame, on: list[str]) -> DataFrame:
    """Findings with waived: whether a waiver holds for all its columns."""
    return findings.join(waivers.select(on).distinct().withColumn("__w", F.lit(True)), on, "left").withColumn("waived", F.coalesce("__w", F.lit(False))).drop("__w")


def ratchet_drift(ratchets: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, drift): recorded ratchets whose rule is gone or below its floor. ratchets: id, floor; rules: id, level."""
    both = ratchets.join(rules, "id", "left")
    drift = F.when(F.col("level").isNull(), "removed").when(F.col("level") < F.col("floor"), "below_floor")
    return both.select("id", drift.alias("drift")).where("drift IS NOT NULL")


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str], signature: str, body: str) -> DataFrame:
    """keys, change: added, deleted, signature, body or cosmetic, for what differs at all. Both: keys, signature, body, text."""
    cols = [signature, body, "text"]
    a = old.select(*keys, F.struct(*cols).alias("o"))
    both = a.join(new.select(*keys, F.struct(*cols).alias("n")), keys, "full_outer")
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "deleted").when(F.col(f"o.{signature}") != F.col(f"n.{signature}"), "signature").when(F.col(f"o.{body}") != F.col(f"n.{body}"), "body").when(F.col("o.text") != F.col("n.text"), "cosmetic")
    return both.select(*keys, change.alias("change")).where("change IS NOT NULL")


def greedy_matching(pairs: DataFrame, a: str, b: str, score: str, by: str) -> DataFrame:
    """One-to-one pairs by falling score inside each block; blocks are bounded by what makes them (equal kind and size class)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        left, right, keep = set(), set(), []
        for i, x, y in rows.sort_values([score, a, b], ascending=[False, True, True])[[a, b]].itertuples():
            if x not in left and y not in right:
                left.add(x)
                right.add(y)
                keep.append(i)
        return rows.loc[keep]

    return pairs.groupBy(by).applyInPandas(run, pairs.schema)


def fold_confidence(events: DataFrame, key: str) -> DataFrame:
    """(key, confidence, verified): citations, each user once, add one and anti-verifications take one; never below 0, in order.
    events: key, at, id, kind (cite or anti), by. The running floor is the sum less its running minimum."""
    first = F.row_number().over(Window.partitionBy(key, "kind", "by").orderBy("at", "id"))
    step = F.when((F.col("kind") == "cite") & (F.col("n") == 1), 1).when(F.col("kind") == "anti", -1).otherwise(0)
    w = Window.partitionBy(key).orderBy("at", "id")
    run = events.withColumn("n", first).withColumn("s", F.sum(step).over(w))
    run = run.withColumn("low", F.least(F.lit(0), F.min("s").over(w))).withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("at"), F.desc("id"))))
    return run.where("k = 1").select(key, (F.col("s") - F.col("low")).alias("confidence"), (F.col("s") - F.col("low") >= 2).alias("verified"))


def fold_sites(events: DataFrame, key: str) -> DataFrame:
    """(key, epoch, status): an event log per site, in order; a revert after a fire opens the next epoch. events: key, at, id, kind
    (fire, revert, delete; null changes nothing). Only the event before each is looked at, so no site is gathered."""
    w = Window.partitionBy(key).orderBy("at", "id")
    step = events.where("kind IS NOT NULL").withColumn("before", F.lag("kind").over(w))
    reverts = F.count_if((F.col("kind") == "revert") & (F.col("before") == "fire"))
    folded = step.groupBy(key).agg(reverts.alias("epoch"), F.max_by("kind", F.struct("at", "id")).alias("last"))
    status = F.when(F.col("last") == "fire", "present").when(F.col("last") == "revert", "changed").when(F.col("last") == "delete", "file_deleted").otherwise("unknown")
    return events.select(key).distinct().join(folded, key, "left").select(key, F.coalesce("epoch", F.lit(0)).alias("epoch"), status.alias("status"))


def normalised(path: Column) -> Column:
    """A path without empty and . segments, each .. taking the segment before it."""
    keep = lambda done, x: F.when(x.isin("", "."), done).when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, x))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), keep), "/")


def relative_to(path: Column, relative: Column) -> Column:
    """A relative path from the directory of a file."""
    return normalised(F.concat(F.regexp_replace(path, "[^/]*$", ""), relative))


def render(rows: Iterator[dict], columns: list[str]) -> str:
    """A Markdown table."""
    lines = [" | ".join(columns), " | ".join("---" for _ in columns)]
    return "\n".join(f"| {x} |" for x in [*lines, *(" | ".join(str(r[c]) for c in columns) for r in rows)])
