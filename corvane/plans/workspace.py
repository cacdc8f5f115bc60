"""Scans of a small Python workspace: files, symbols, imports and calls; the expected rows are stated in SQL by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import workspace as W
from .registry import Tables, query

FILES = {
    "app/main.py": "import os\nfrom lib.tools import shout as cry, Box\nfrom . import extra\nfrom .extra import more\n\ndef run(x):\n    if x:\n        return cry(x)\n    return helper(Box(more(x)))\n\ndef helper(y):\n    for a in y:\n        if a and y:\n            lonely(a)\n    return y\n",
    "app/__init__.py": "",
    "app/extra.py": "from os.path import join\n\ndef more(z):\n    return join(z, 'deep text')\n",
    "src/lib/__init__.py": "",
    "src/lib/tools.py": "class Box:\n    def open(self):\n        return shout(self)\n\ndef shout(s):\n    return s\n",
    "src/lib/far.py": "def lonely(q):\n    while q:\n        q = q - 1\n",
}


def _sources(t: Tables) -> DataFrame:
    rows = t.spark.createDataFrame(list(FILES.items()), "path string, content string")
    return rows.withColumn("content_hash", F.sha2(F.col("content").cast("binary"), 256))


def _index(t: Tables) -> dict[str, DataFrame]:
    sources = _sources(t)
    found = W.tables(W.index(sources))
    return found | {"imports": W.resolve_imports(found["imports"], sources.select("path"))}


def _values(columns: str, rows: list[tuple]) -> str:
    literal = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) AS v({columns})"


@query("S2_symbols", _values("path, qualified, symbol_kind, start_line, end_line", [
    ("app/main.py", "run", "function", 6, 9), ("app/main.py", "helper", "function", 11, 15), ("app/extra.py", "more", "function", 3, 4),
    ("src/lib/tools.py", "Box", "class", 1, 3), ("src/lib/tools.py", "Box::open", "method", 2, 3), ("src/lib/tools.py", "shout", "function", 5, 6), ("src/lib/far.py", "lonely", "function", 1, 3)]))
def s2(t: Tables) -> DataFrame:
    return _index(t)["symbols"].select("path", "qualified", "symbol_kind", "start_line", "end_line")


@query("S2_hash_skip", _values("path, what", [("app/extra.py", "parsed"), ("src/lib/far.py", "parsed"), ("src/lib/old.py", "dropped")]))
def s2_skip(t: Tables) -> DataFrame:
    """An index in which one file has another hash, one is missing and one is gone since."""
    sources = _sources(t)
    known = sources.where("path <> 'src/lib/far.py'").select("path", F.when(F.col("path") == "app/extra.py", "other").otherwise(F.col("content_hash")).alias("content_hash"))
    indexed = known.union(t.spark.createDataFrame([("src/lib/old.py", "x")], "path string, content_hash string"))
    todo, gone = W.changed(sources, indexed)
    return todo.select("path", F.lit("parsed").alias("what")).union(gone.select("path", F.lit("dropped")))


@query("K1_replace_files", _values("path, short, generation", [
    ("app/main.py", "run", 1), ("app/main.py", "helper", 1), ("app/extra.py", "more", 2), ("src/lib/tools.py", "Box", 1), ("src/lib/tools.py", "open", 1), ("src/lib/tools.py", "shout", 1), ("src/lib/far.py", "lonely", 2)]))
def k1_files(t: Tables) -> DataFrame:
    """The symbols of two files that were parsed again replace theirs; those of a file that is gone go; the generation tells which."""
    new = _index(t)["symbols"].select("path", "short")
    old = new.where("path <> 'src/lib/far.py'").union(t.spark.createDataFrame([("src/lib/old.py", "gone"), ("app/extra.py", "less")], "path string, short string")).withColumn("generation", F.lit(1))
    parsed = t.spark.createDataFrame([("app/extra.py",), ("src/lib/far.py",)], "path string")
    gone = t.spark.createDataFrame([("src/lib/old.py",)], "path string")
    return W.replace_files(old, new.join(parsed, "path", "left_semi").withColumn("generation", F.lit(2)), parsed, gone)


@query("M1_complexity", _values("qualified, cyclomatic, cognitive", [("run", 2, 1), ("helper", 4, 4), ("more", 1, 0), ("Box::open", 1, 0), ("shout", 1, 0), ("lonely", 2, 1)]))
def m1(t: Tables) -> DataFrame:
    return _index(t)["symbols"].where("symbol_kind <> 'class'").select("qualified", "cyclomatic", "cognitive")


@query("R2_python_imports", _values("path, imported, name, target_path", [
    ("app/main.py", "os", None, None), ("app/main.py", "lib.tools", "shout", "src/lib/tools.py"), ("app/main.py", "lib.tools", "Box", "src/lib/tools.py"),
    ("app/main.py", ".", "extra", "app/extra.py"), ("app/main.py", ".extra", "more", "app/extra.py"), ("app/extra.py", "os.path", "join", None)]))
def r2_python(t: Tables) -> DataFrame:
    return _index(t)["imports"].select("path", "imported", "name", "target_path")


@query("R1_python_ladder", _values("path, line, name, target_path, target, rung", [
    ("app/main.py", 8, "cry", "src/lib/tools.py", "shout", "import"), ("app/main.py", 9, "helper", "app/main.py", "helper", "same_file"),
    ("app/main.py", 9, "Box", "src/lib/tools.py", "Box", "import"), ("app/main.py", 9, "more", "app/extra.py", "more", "import"),
    ("app/main.py", 14, "lonely", "src/lib/far.py", "lonely", "global"), ("app/extra.py", 4, "join", None, None, "external"), ("src/lib/tools.py", 3, "shout", "src/lib/tools.py", "shout", "same_file")]))
def r1_python(t: Tables) -> DataFrame:
    return W.resolve_calls(_index(t))
