"""A workspace's files and its Python code as tables: files, symbols, refs, imports, literals.

Only Python is parsed (with the standard library's ``ast``); symbols of other languages come as tables of the same shape."""

from __future__ import annotations

import ast
import fnmatch
import hashlib
import os
import re
from collections.abc import Iterator
from functools import reduce
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Directories that a walk never enters.
SKIP = frozenset(("target", "build", "node_modules", ".git", "dist", "out", "vendor", "__pycache__", ".claude"))
MOST_LINES, MOST_REFS, LITERAL_KEY = 100_000, 15_000, 40
SYMBOLS = "kind string, path string, qualified string, short string, symbol_kind string, start_line int, end_line int, parent string, docstring string, cyclomatic int, cognitive int, line int, name string, context string, imported string, alias string, text string"


def walk(root: str, extensions: tuple[str, ...] = (".py",)) -> tuple[list[str], bool]:
    """Paths below root, and whether the walk was complete. Hidden and skipped directories, links and what .gitignore names are left out."""
    ignored: list[str] = []
    complete = True

    def failed(_: OSError) -> None:
        nonlocal complete
        complete = False

    out = []
    for top, dirs, files in os.walk(root, onerror=failed):
        here = Path(top, ".gitignore")
        if here.is_file():
            ignored += [os.path.join(os.path.relpath(top, root), x.strip().strip("/")).removeprefix("./") for x in here.read_text(errors="replace").splitlines() if x.strip() and x[0] not in "#!"]
        rel = lambda name: os.path.relpath(os.path.join(top, name), root)  # noqa: E731, B023
        skip = lambda name: any(fnmatch.fnmatch(rel(name), p) or fnmatch.fnmatch(name, os.path.basename(p)) for p in ignored)  # noqa: E731, B023
        dirs[:] = sorted(d for d in dirs if d not in SKIP and d[0] != "." and not os.path.islink(os.path.join(top, d)) and not skip(d))
        out += [rel(f) for f in sorted(files) if f.endswith(extensions) and f[0] != "." and not os.path.islink(os.path.join(top, f)) and not skip(f)]
    return out, complete


def files(spark: SparkSession, root: str, extensions: tuple[str, ...] = (".py",)) -> DataFrame:
    """(path, content, content_hash): the driver lists the paths, the executors read the contents (root is a shared folder)."""
    paths, _ = walk(root, extensions)
    if not paths:
        return spark.createDataFrame([], "path string, content string, content_hash string")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [Path(root, p).read_text(errors="replace") for p in b["path"]]
            yield pd.DataFrame({"path": b["path"], "content": texts, "content_hash": [hashlib.sha256(t.encode()).hexdigest() for t in texts]})

    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths) // 64)).mapInPandas(read, "path string, content string, content_hash string")


_BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.comprehension, ast.Assert)


def complexity(node: ast.AST) -> tuple[int, int]:
    """Cyclomatic and cognitive complexity of a function; an ``elif`` costs no nesting."""
    cyclomatic, cognitive = 1, 0

    def visit(n: ast.AST, depth: int, elif_: bool = False) -> None:
        nonlocal cyclomatic, cognitive
        for child in ast.iter_child_nodes(n):
            chained = isinstance(n, ast.If) and child in n.orelse and isinstance(child, ast.If) and len(n.orelse) == 1
            if isinstance(child, ast.BoolOp):
                cyclomatic += len(child.values) - 1
                cognitive += 1
            if isinstance(child, _BRANCHES):
                cyclomatic += 1
                cognitive += 1 if chained else 1 + depth
                visit(child, depth if chained else depth + 1, chained)
            elif isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda)):
                visit(child, depth + 1)
            else:
                visit(child, depth)

    visit(node, 0)
    return cyclomatic, cognitive


def parse_python(path: str, content: str) -> list[dict]:
    """Tagged rows (symbol, ref, import, literal) of one file; none if it cannot be parsed or is over the limits."""
    if content.count("\n") > MOST_LINES:
        return []
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError):
        return []
    rows: list[dict] = []
    refs = 0

    def visit(node: ast.AST, scope: list[str], inside: str) -> None:
        nonlocal refs
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                kind = "class" if isinstance(child, ast.ClassDef) else "method" if inside == "class" else "function"
                c = complexity(child) if kind != "class" else (None, None)
                rows.append({"kind": "symbol", "path": path, "qualified": "::".join([*scope, child.name]), "short": child.name, "symbol_kind": kind, "start_line": child.lineno, "end_line": child.end_lineno, "parent": "::".join(scope) or None, "docstring": ast.get_docstring(child), "cyclomatic": c[0], "cognitive": c[1]})
                visit(child, [*scope, child.name], "class" if kind == "class" else "function")
                continue
            if isinstance(child, ast.Import):
                rows.extend({"kind": "import", "path": path, "line": child.lineno, "imported": a.name, "alias": a.asname, "context": "import"} for a in child.names)
            elif isinstance(child, ast.ImportFrom):
                rows.extend({"kind": "import", "path": path, "line": child.lineno, "imported": "." * child.level + (child.module or ""), "name": a.name, "alias": a.asname, "context": "from_import"} for a in child.names)
            elif isinstance(child, ast.Call):
                f = child.func
                name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
                if name and (refs := refs + 1) <= MOST_REFS:
                    rows.append({"kind": "ref", "path": path, "line": child.lineno, "name": name, "context": "construction" if name[:1].isupper() else "call"})
            elif isinstance(child, ast.Attribute) and isinstance(child.ctx, ast.Load) and (refs := refs + 1) <= MOST_REFS:
                rows.append({"kind": "ref", "path": path, "line": child.lineno, "name": child.attr, "context": "field_access"})
            elif isinstance(child, ast.Constant) and isinstance(child.value, str):
                text = re.sub(r"\s+", " ", child.value).strip()
                if len(text) >= 3:
                    rows.append({"kind": "literal", "path": path, "line": child.lineno, "text": text[:LITERAL_KEY]})
            elif inside != "function" and isinstance(child, ast.Assign):
                rows.extend({"kind": "symbol", "path": path, "qualified": "::".join([*scope, x.id]), "short": x.id, "symbol_kind": "const" if x.id.isupper() else "static", "start_line": child.lineno, "end_line": child.end_lineno, "parent": "::".join(scope) or None} for x in child.targets if isinstance(x, ast.Name))
            visit(child, scope, inside)

    visit(tree, [], "module")
    return rows


def index(sources: DataFrame) -> DataFrame:
    """Tagged rows of all Python files (path, content): one generator a file, so that memory follows the file."""
    names = [x.split()[0] for x in SYMBOLS.split(", ")]
    ints = [x.split()[0] for x in SYMBOLS.split(", ") if x.endswith(" int")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                rows = parse_python(path, content)
                if rows:
                    yield pd.DataFrame(rows).reindex(columns=names).astype({c: "Int32" for c in ints}).astype(object).where(lambda x: x.notna(), None)

    return sources.select("path", "content").mapInPandas(run, SYMBOLS)


def tables(rows: DataFrame) -> dict[str, DataFrame]:
    """symbols, refs, imports and literals of index()'s rows."""
    return {
        "symbols": rows.where("kind = 'symbol'").select("path", "qualified", "short", "symbol_kind", "start_line", "end_line", "parent", "docstring", "cyclomatic", "cognitive"),
        "refs": rows.where("kind = 'ref'").select("path", "line", "name", "context"),
        "imports": rows.where("kind = 'import'").select("path", "line", "imported", "name", "alias", F.col("context").alias("import_kind")),
        "literals": rows.where("kind = 'literal'").select("path", "line", "text"),
    }


def changed(sources: DataFrame, indexed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sources to parse, paths to drop): files whose content hash is not the one indexed, and indexed files that are gone.
    sources: path, content, content_hash; indexed: path, content_hash."""
    todo = sources.join(indexed.select("path", "content_hash"), ["path", "content_hash"], "left_anti")
    return todo.select(sources.columns), indexed.join(sources, "path", "left_anti").select("path").distinct()


def replace_files(old: DataFrame, new: DataFrame, parsed: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of an index (path, ...) with those of the files that were parsed again replaced and of files that are gone dropped.
    parsed, gone: path."""
    return old.join(parsed.select("path").union(gone.select("path")).distinct(), "path", "left_anti").select(new.columns).unionByName(new)


def package_roots(paths: DataFrame) -> DataFrame:
    """(root): directories that hold a top package, and the workspace itself, with a slash at the end."""
    packages = paths.where(F.col("path").endswith("__init__.py")).select(F.regexp_replace("path", "/?__init__[.]py$", "").alias("d")).where("d <> ''")
    parent = F.regexp_extract("d", "^(.*/)[^/]+$", 1)
    top = packages.join(packages.select(F.concat("d", F.lit("/")).alias("parent")), parent == F.col("parent"), "left_anti")
    return top.select(parent.alias("root")).union(paths.sparkSession.createDataFrame([("",)], "root string")).distinct()


def resolve_imports(imports: DataFrame, paths: DataFrame) -> DataFrame:
    """imports with target_path: the module's file, else the package's, of ``from m import n`` the submodule n first, below each
    package root; leading dots go up from the file's own directory. A file that would import itself, or none, gives null."""
    dots = F.length(F.regexp_extract("imported", "^([.]*)", 1))
    module = F.replace(F.regexp_replace("imported", "^[.]+", ""), F.lit("."), F.lit("/"))
    folder = F.split(F.regexp_replace("path", "/?[^/]*$", ""), "/")
    up = F.array_join(F.slice(folder, 1, F.greatest(F.size(folder) - (dots - 1), F.lit(0))), "/")
    keyed = imports.withColumn("__id", F.xxhash64("path", "line", "imported", "name", "alias"))
    under = keyed.select("__id", "path", "name", dots.alias("dots"), module.alias("module"), F.when(up == "", "").otherwise(F.concat(up, F.lit("/"))).alias("up")).distinct()
    rooted = under.where("dots = 0").join(F.broadcast(package_roots(paths))).select("__id", "path", "name", "module", F.col("root").alias("base"))  # roots are few: one a source folder
    both = rooted.union(under.where("dots > 0").select("__id", "path", "name", "module", "up"))
    at = F.concat("base", "module")
    inside = F.when(F.col("module") == "", F.col("base")).otherwise(F.concat(at, F.lit("/")))
    whole = F.when(F.col("module") != "", F.concat(at, F.lit(".py")))
    options = F.array(F.concat(inside, "name", F.lit(".py")), F.concat(inside, "name", F.lit("/__init__.py")), whole, F.concat(inside, F.lit("__init__.py")))
    rows = both.select("__id", "path", F.posexplode(options).alias("priority", "target_path")).where("target_path IS NOT NULL AND target_path <> path")
    best = rows.join(paths.select(F.col("path").alias("target_path")).distinct(), "target_path").groupBy("__id").agg(F.min_by("target_path", F.struct("priority", "target_path")).alias("target_path"))
    return keyed.join(best, "__id", "left").drop("__id")


RUNGS = ("same_file", "import", "external", "global")


def resolve_calls(t: dict[str, DataFrame]) -> DataFrame:
    """(path, line, name, target_path, target, rung): calls and constructions by the ladder. The nearest symbol of the file; else
    what an import of that name (or alias) leads to, in the module's file; a name from a module that is no file of the workspace is
    external and has no target; else the one symbol of that name anywhere, of several the one of the shortest qualified name."""
    at = ["path", "line", "name", "context"]
    refs, symbols = t["refs"].where("context IN ('call', 'construction')").select(at).distinct(), t["symbols"].where("symbol_kind IN ('function', 'method', 'class')")
    target = F.struct(F.col("path").alias("p"), "qualified")
    here = refs.join(symbols.select("path", F.col("short").alias("name"), "qualified", "start_line"), ["path", "name"])
    here = here.groupBy(at).agg(F.min_by(target, F.struct(F.abs(F.col("line") - F.col("start_line")), "start_line")).alias("t")).select(*at, F.lit(0).alias("rung"), "t")
    named = t["imports"].where("import_kind = 'from_import'") if "target_path" in t["imports"].columns else None
    rungs = [here]
    if named is not None:
        bound = named.select("path", F.coalesce("alias", "name").alias("name"), F.col("name").alias("original"), "target_path").distinct()
        met = refs.join(bound, ["path", "name"])
        there = met.join(symbols.select(F.col("path").alias("target_path"), F.col("short").alias("original"), "qualified"), ["target_path", "original"])
        rungs.append(there.groupBy(at).agg(F.min(F.struct(F.length("qualified").alias("n"), F.col("target_path").alias("p"), "qualified")).alias("x")).select(*at, F.lit(1).alias("rung"), F.struct("x.p", "x.qualified").alias("t")))
        none = F.lit(None).cast("struct<p:string,qualified:string>")
        rungs.append(met.where("target_path IS NULL").select(at).distinct().select(*at, F.lit(2).alias("rung"), none.alias("t")))
    short = F.struct(F.length("qualified").alias("n"), F.col("path").alias("p"), "qualified")
    single = symbols.groupBy(F.col("short").alias("name")).agg(F.min(short).alias("x")).select("name", F.struct("x.p", "x.qualified").alias("t"))
    rungs.append(refs.join(single, "name").select(*at, F.lit(3).alias("rung"), "t"))
    best = reduce(DataFrame.union, rungs).groupBy(at).agg(F.min_by(F.struct("rung", "t"), "rung").alias("b"))
    rung = F.element_at(F.array(*map(F.lit, RUNGS)), F.col("b.rung") + 1)
    return best.select("path", "line", "name", F.col("b.t.p").alias("target_path"), F.col("b.t.qualified").alias("target"), rung.alias("rung"))
