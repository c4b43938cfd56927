import json

import pytest
from pyspark.sql import functions as F

from quarry.sources import evalsets, tables, trees


def test_tree_is_filtered(spark, tmp_path):
    files = {
        "src/app.ts": b"const a = 1;\r\nconst b = 2;", "node_modules/lib/index.js": b"x", "image.png": b"\x89PNG", "package-lock.json": b"{}" * 40_000,
        "src/bin.py": b"\x00\x01", "docs/a.md": "hé é".encode() + b"\xff", "deep/vendor/x.py": b"x = 1", ".cache-1/y.py": b"y",
    }
    for name, content in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    rows = trees.scan_tree(spark, f"file://{tmp_path}").collect()
    assert [(r.file_path, r.language) for r in rows][-1] == ("src/app.ts", "typescript")
    assert {r.file_path for r in rows} <= {"docs/a.md", "src/app.ts"}
    assert next(r.text for r in rows if r.file_path == "src/app.ts") == "const a = 1;\nconst b = 2;"
    with pytest.raises(FileNotFoundError):
        trees.resolved(str(tmp_path / "none"))
    with pytest.raises(RuntimeError):
        trees.resolved("https://forge.example/x.git")


def test_eval_sets(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"question": "q", "expected_files": ["f"]}]))
    (tmp_path / "a.csv").write_text("question,expected_files,expected_answer_contains,must_not_contain\nq,f|g,,x\n")
    assert tuple(evalsets.read_eval_set(spark, str(tmp_path / "a.json")).first()) == ("q", ["f"], [], [])
    assert tuple(evalsets.read_eval_set(spark, str(tmp_path / "a.csv")).first()) == ("q", ["f", "g"], [], ["x"])
    with pytest.raises(ValueError):
        evalsets.read_eval_set(spark, "a.txt")


def test_tables_are_replaced_by_repository(spark, tmp_path):
    path = str(tmp_path / "chunks")
    make = lambda rows: spark.createDataFrame(rows, "repo_id string, v int")
    tables.replace_repos(make([("a", 1), ("b", 2)]), path)
    tables.replace_repos(make([("a", 3)]), path)
    assert sorted((r.repo_id, r.v) for r in spark.read.parquet(path).collect()) == [("a", 3), ("b", 2)]
    tables.delete_repo(spark, path, "a")
    assert [(r.repo_id, r.v) for r in spark.read.parquet(path).collect()] == [("b", 2)]
    assert sorted(tuple(r) for r in tables.upserted(make([("a", 1), ("b", 2)]), make([("b", 9)]), ["repo_id"]).collect()) == [("a", 1), ("b", 9)]
    cache = spark.createDataFrame([("p", "h1", [1.0])], "provider string, chunk_hash string, vector array<float>")
    new = spark.createDataFrame([("p", "h1", [2.0]), ("p", "h2", [3.0]), ("p", "h2", [3.0])], "provider string, chunk_hash string, vector array<float>")
    for _ in range(2):  # an attempt that is repeated adds nothing twice
        tables.append_new(cache, new, str(tmp_path / "cache"), "first")
    tables.append_new(cache, new.where("chunk_hash = 'h1'"), str(tmp_path / "cache"), "second")
    assert [r.chunk_hash for r in tables.cached(spark, str(tmp_path / "cache"), "p").collect()] == ["h2"]
    assert tables.cached(spark, str(tmp_path / "cache"), "p", "first").count() == tables.cached(spark, str(tmp_path / "none"), "p").count() == 0
    with pytest.raises(Exception, match="no vector"):
        tables.checked_vectors(new.withColumn("vector", F.lit(None).cast("array<float>"))).collect()


def test_unknown_repositories_are_told(spark):
    asked = spark.createDataFrame([("a", 1), ("z", 2), (None, 3)], "repo_id string, n int")
    repos = spark.createDataFrame([("a",), ("a",), (None,)], "repo_id string")
    got = {r.n: r.error for r in tables.with_known_repo(asked, repos).collect()}
    assert got == {1: None, 2: "repository z is not indexed", 3: "repository null is not indexed"}


def test_evaluations_are_saved_once(spark, tmp_path):
    rows = spark.createDataFrame([("a", "e1", 0.5), ("a", "e2", 0.7)], "repo_id string, eval_id string, mrr double")
    tables.save_evaluations(rows, str(tmp_path / "evals"))
    tables.save_evaluations(rows.where("eval_id = 'e1'").withColumn("mrr", F.lit(0.9)), str(tmp_path / "evals"))
    assert sorted((r.eval_id, r.mrr) for r in spark.read.parquet(str(tmp_path / "evals")).collect()) == [("e1", 0.9), ("e2", 0.7)]
