"""Co-change fixtures, lookups, rules and sources."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corvane.operators import relational as R
from corvane.operators import rules as U
from corvane.operators import text as T
from corvane.operators import vector as V
from corvane.sources import history as H
from corvane.sources import workspace as W


def baskets(spark, spec, size=None):
    rows = [(c, f, size) for c, fs in spec.items() for f in fs]
    return spark.createDataFrame(rows, "c string, f string, n long")


def test_partners(spark):
    got = {r["item"]: (r["shared"], r["jaccard"]) for r in R.cochange_of(baskets(spark, {"c1": "123", "c2": "12", "c3": "1"}), "c", "f", "1").collect()}
    assert got == {"2": (2, 2 / 3), "3": (1, 1 / 3)}


def test_pair_over_threshold(spark):
    b = baskets(spark, {"c1": "123", "c2": "12", "c3": "12", "c4": "12", "c5": "1"})
    assert [tuple(r) for r in R.cochange(b, "c", "f", threshold=0.5).collect()] == [("1", "2", 4, 0.8)]


@pytest.mark.parametrize(("size", "pairs"), [(99, 0), (5, 1), (None, 1)])
def test_fan_out_cap(spark, size, pairs):
    b = baskets(spark, {"c1": "12", "c2": "12", "c3": "12"}, size)
    assert R.cochange(b, "c", "f", size_col="n", threshold=0.5).count() == pairs


def test_cochange_over_renames(spark):
    rows = [("c1", "old", None), ("c1", "partner", None), ("c2", "new", "old"), ("c2", "partner", None), ("c3", "new", None), ("c3", "partner", None)]
    got = R.cochange_renamed(spark.createDataFrame(rows, "commit string, name string, old_name string"), "new").collect()
    assert [(r["name"], r["shared"]) for r in got] == [("partner", 3)]


def test_globs():
    import re

    match = lambda g, p: bool(re.match(R.glob_to_regex(g), p))
    assert match("src/*.rs", "src/a.rs") and not match("src/*.rs", "src/x/a.rs")
    assert match("src/**/*.rs", "src/x/y/a.rs") and match("src/**/*.rs", "src/a.rs")


def test_rules_first_of_equal_ids_holds():
    one = {"kind": "forbidden_dep", "from": "a", "to": "b", "severity": "blocking"}
    assert [r.severity for r in U.parse_rules([one, one | {"severity": "info"}])] == ["blocking"]
    with pytest.raises(ValueError, match="duplicate"):
        U.parse_rules([one | {"name": "x"}, {"kind": "boundary", "from": "a", "to": "c", "name": "x"}])


def test_binding_is_undone():
    a, b = V.symbol_vector("a"), V.symbol_vector("b")
    back = V.unbind(V.bind(a, b), b)
    assert back @ a / (abs(back @ back) ** 0.5 * (a @ a) ** 0.5) > 0.6
    assert (V.symbol_vector("a") == a).all()


def test_self_index(spark):
    root = str(Path(__file__).resolve().parent.parent)
    paths, complete = W.walk(root)
    assert complete and "corvane/sources/workspace.py" in paths and not any("__pycache__" in p for p in paths)
    t = W.tables(W.index(W.files(spark, root).where("path LIKE 'corvane/sources/%' OR path LIKE 'corvane/operators/%'")))
    symbols = {(r["path"], r["qualified"]): r for r in t["symbols"].collect()}
    assert symbols["corvane/sources/workspace.py", "walk::failed"]["symbol_kind"] == "function"
    assert symbols["corvane/operators/rules.py", "Rule::id"]["symbol_kind"] == "method"
    calls = {(r["name"], r["target_path"]) for r in W.resolve_calls(t).collect()}
    assert ("glob_to_regex", "corvane/operators/relational.py") in calls
    assert ("path_matches", "corvane/operators/relational.py") in calls
    assert t["imports"].where("imported = 'ast'").count() == 1 and t["literals"].count() > 50


def test_complexity():
    import ast

    code = "def f(x):\n  if x:\n    for y in x:\n      pass\n  elif x is None and x:\n    pass\n"
    assert W.complexity(ast.parse(code).body[0]) == (5, 5)


def test_broken_source_has_no_rows():
    assert W.parse_python("x.py", "def (") == []


def test_git_history_and_hunks(spark, tmp_path):
    import subprocess

    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@example.com", *a], check=True, capture_output=True)
    git("init", "-q")
    for i in range(2):
        (tmp_path / "a.txt").write_text(f"{i}\n")
        (tmp_path / f"b{i}.txt").write_text("x\n")
        git("add", ".")
        git("commit", "-qm", str(i))
    rows = H.commit_files(spark, str(tmp_path)).collect()
    assert sorted(r["file"] for r in rows) == ["a.txt", "a.txt", "b0.txt", "b1.txt"]
    assert H.first_parents(spark, str(tmp_path)).count() == 2
    assert H.at_revision(str(tmp_path), "HEAD~1", "a.txt") == "0\n"
    assert {r["author"] for r in rows} == {"t@example.com"}
    git("mv", "b1.txt", "ä b.txt")
    git("commit", "-qm", "2")
    assert sorted(map(tuple, H.name_status(spark, str(tmp_path), "HEAD~2", "HEAD~1").collect())) == [("A", "b1.txt", None), ("M", "a.txt", None)]
    assert [tuple(r) for r in H.name_status(spark, str(tmp_path), "HEAD~1", "HEAD").collect()] == [("R", "ä b.txt", "b1.txt")]
    assert "ä b.txt" in {r["file"] for r in H.commit_files(spark, str(tmp_path)).collect()}
    diff = "--- a/x\n+++ b/x\n@@ -1,2 +3 @@ f\n-a\n@@ -9 +8,4 @@\n".splitlines()
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(diff)], "diff int, n int, line string")
    assert [tuple(r) for r in H.hunks(lines).orderBy("old_start").collect()] == [(1, "x", 1, 2, 3, 1), (1, "x", 9, 1, 8, 4)]


def test_config_readers(tmp_path):
    assert H.load_jsonc('{"a": 1, // x\n "b": ["//y",],}') == {"a": 1, "b": ["//y"]}
    (tmp_path / "r.toml").write_text("[[rule]]\nfrom = 'a'\n")
    assert H.load_toml(str(tmp_path / "r.toml")) == {"rule": [{"from": "a"}]}
    (tmp_path / "base.json").write_text('{"compilerOptions": {"strict": true, "baseUrl": "a"}}')
    (tmp_path / "ts.json").write_text('{"extends": "./base", "compilerOptions": {"baseUrl": "b"}}')
    assert H.load_tsconfig(str(tmp_path / "ts.json")) == {"compilerOptions": {"strict": True, "baseUrl": "b"}}
    (tmp_path / "Cargo.toml").write_text("[dependencies]\nserde = '1'\nmy-json = {package = 'serde_json'}\n[dev-dependencies]\nproptest = '1'\n")
    assert H.cargo_dependencies(str(tmp_path / "Cargo.toml")) == [("serde", "serde", "dependencies"), ("my_json", "serde_json", "dependencies"), ("proptest", "proptest", "dev-dependencies")]
    (tmp_path / "cc.json").write_text('[{"file": "a.c", "command": "cc -Iinc -I other a.c"}]')
    assert H.include_folders(str(tmp_path / "cc.json")) == {"a.c": ["inc", "other"]}
    assert H.cutoff(86_400 * 100 + 5) == 86_400 * 10


def test_registered_functions(spark):
    from corvane.functions import register

    register(spark)
    row = spark.sql("SELECT tokenize('getUserName of the HTMLParser x9') AS t, token_estimate('one two three') AS n").first()
    assert row.t == ["user", "name", "htmlparser", "x9"] and row.n == 3


def test_render():
    assert U.render([{"a": 1, "b": 2}], ["a", "b"]).splitlines()[-1] == "| 1 | 2 |"


def test_average_rank_against_plain_counting(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, 1, 1, 1, 2]), rng.choice([None, *range(25)]), i) for i in range(400)] + [(9, 5, 400), (8, None, 401), (8, None, 402)]
    rows += [(7, i * i, 500 + i) for i in range(300)]
    df = spark.createDataFrame(rows, "g long, v long, id long")
    got = {r.id: r.rank for r in R.average_rank(df, "v", ["g"], "rank", cells=8).collect()}
    key = lambda v: -1 if v is None else v
    for g, v, i in rows:
        mine = [key(w) for h, w, _ in rows if h == g]
        below, ties = sum(w < key(v) for w in mine), mine.count(key(v))
        assert got[i] == (1.0 if len(mine) == 1 else pytest.approx((below + (ties - 1) / 2) / (len(mine) - 1)))
    assert len(got) == len(rows)
    assert R.average_rank(df.limit(0), "v", ["g"], "rank").count() == 0


def test_the_best_of_a_key_is_what_the_ladder_takes(spark):
    refs = spark.range(4).selectExpr("id AS ref", "id % 2 AS k")
    targets = spark.createDataFrame([(0, 5, 2), (0, 4, 2), (0, 9, 3), (1, 7, 1), (1, 6, None)], "k long, target long, o long")
    best = U.best_of_key(targets, "k")
    assert best.count() == 2
    few, all_ = (U.resolve(refs, [refs.join(x, "k").select("ref", "target", "o")], "ref") for x in (best, targets))
    assert {tuple(r) for r in few.collect()} == {tuple(r) for r in all_.collect()} == {(0, 4, 0), (2, 4, 0), (1, 6, 0), (3, 6, 0)}


@pytest.mark.parametrize("block", [60, 32 << 20])
def test_cosines_in_blocks_are_those_of_all_shared_tokens(spark, monkeypatch, block):
    monkeypatch.setattr(T, "BLOCK_BYTES", block)
    r = random.Random(3)
    words = ["all", *(f"w{k}" for k in range(12))]
    rows = [(i, " ".join(["all", *r.choices(words, k=r.randrange(1, 9))])) for i in range(30)]
    docs = spark.createDataFrame([*rows, (30, "all")], "id long, text string")  # the last has no weight at all
    n = spark.createDataFrame([(31,)], "n long")
    v = T.tf_idf(T.term_frequencies(docs, "id", "text"), n)
    want = {(x.a, x.b): x.cosine for x in T.sparse_cosines(v.where("id % 4 = 0"), v).collect()}
    got = T.cosines_to(docs, "id", "text", n, F.expr("id % 4 = 0")).collect()
    assert len(got) == len(want) and all(abs(want[x.query, x.id] - x.cosine) < 1e-9 for x in got)
