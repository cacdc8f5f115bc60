"""Git history, diffs and configuration as tables."""

from __future__ import annotations

import json
import re
import shlex
import subprocess
import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DAY = 86_400


def cutoff(now: int, days: int = 90) -> int:
    return now // DAY * DAY - days * DAY


def commit_files(spark: SparkSession, root: str, head: str = "HEAD", since: int = 0) -> DataFrame:
    """(hash, committed_at, author, file): files of commits by committer time, renames as two files."""
    out = subprocess.run(["git", "-C", root, "-c", "core.quotePath=false", "log", "--name-only", "--no-renames", "--format=%x01%H%x02%ct%x02%ae", head], capture_output=True, text=True, check=True).stdout
    rows = []
    for part in out.split("\x01")[1:]:
        head_, *names = part.split("\n")
        h, at, author = head_.split("\x02")
        if int(at) >= since:
            rows += [(h, int(at), author, n) for n in names if n]
    return spark.createDataFrame(rows, "hash string, committed_at long, author string, file string")


def first_parents(spark: SparkSession, root: str, most: int = 500) -> DataFrame:
    out = subprocess.run(["git", "-C", root, "log", "--first-parent", f"-n{most}", "--format=%H%x02%ct%x02%ae"], capture_output=True, text=True, check=True).stdout
    return spark.createDataFrame([(h, int(at), a) for h, at, a in (x.split("\x02") for x in out.splitlines())], "hash string, committed_at long, author string")


def hunks(lines: DataFrame, order: str = "n", text: str = "line") -> DataFrame:
    """(file, old_start, old_len, new_start, new_len) of a unified diff's numbered lines."""
    head = F.regexp_extract(text, r"^\+\+\+ (?:b/)?(.*)$", 1)
    w = Window.partitionBy("diff").orderBy(order)
    at = lambda i: F.regexp_extract(text, r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", i)
    size = lambda i: F.when(at(i) == "", 1).otherwise(F.try_to_number(at(i), F.lit("9999999"))).cast("int")
    rows = lines.withColumn("file", F.last(F.when(F.col(text).startswith("+++ "), head), True).over(w)).where(F.col(text).startswith("@@ "))
    return rows.select("diff", "file", at(1).cast("int").alias("old_start"), size(2).alias("old_len"), at(3).cast("int").alias("new_start"), size(4).alias("new_len"))


def name_status(spark: SparkSession, root: str, old: str, new: str) -> DataFrame:
    """(status, path, old_path): what changed between two revisions; a rename has both paths."""
    out = subprocess.run(["git", "-C", root, "diff", "--name-status", "-M", "-z", old, new], capture_output=True, text=True, check=True).stdout
    fields, rows = iter(out.split("\0")), []
    for status in fields:
        if status:
            first = next(fields)
            moved = status[0] in "RC"
            rows.append((status[0], next(fields) if moved else first, first if moved else None))
    return spark.createDataFrame(rows, "status string, path string, old_path string")


def at_revision(root: str, revision: str, path: str) -> str | None:
    got = subprocess.run(["git", "-C", root, "show", f"{revision}:{path}"], capture_output=True, text=True)
    return got.stdout if got.returncode == 0 else None


def load_toml(path: str) -> dict:
    return tomllib.loads(Path(path).read_text())


def load_jsonc(text: str) -> dict:
    """JSON with comments and trailing commas."""
    bare = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.S)
    return json.loads(re.sub(r",(\s*[}\]])", r"\1", bare))


def load_tsconfig(path: str) -> dict:
    """A tsconfig file with what it extends below it; paths stay relative to the file that states them."""
    own = load_jsonc(Path(path).read_text())
    bases = own.pop("extends", [])
    out: dict = {}
    for base in [bases] if isinstance(bases, str) else bases:
        at = Path(path).parent / base
        at = at if at.suffix == ".json" else at.with_name(at.name + ".json")
        if at.is_file():
            got = load_tsconfig(str(at))
            out = {**out, **got, "compilerOptions": {**out.get("compilerOptions", {}), **got.get("compilerOptions", {})}}
    return {**out, **own, "compilerOptions": {**out.get("compilerOptions", {}), **own.get("compilerOptions", {})}}


def cargo_dependencies(path: str) -> list[tuple[str, str, str]]:
    """(name in code, package, kind) of a Cargo manifest; a renamed package has another name in code."""
    manifest, out = load_toml(path), []
    for kind in ("dependencies", "dev-dependencies", "build-dependencies"):
        for name, value in manifest.get(kind, {}).items():
            package = value.get("package", name) if isinstance(value, dict) else name
            out.append((name.replace("-", "_"), package, kind))
    return out


def include_folders(path: str) -> dict[str, list[str]]:
    """Folders given by -I for each file of a compile_commands.json."""
    out: dict[str, list[str]] = {}
    for entry in json.loads(Path(path).read_text()):
        words = entry.get("arguments") or shlex.split(entry.get("command", ""))
        after = [b for a, b in zip(words, words[1:], strict=False) if a == "-I"]
        out[entry["file"]] = [x[2:] for x in words if x.startswith("-I") and len(x) > 2] + after
    return out
