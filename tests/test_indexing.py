import json
import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import providers
from quarry.plans import indexing

TS = "import { fuse } from './fuse';\nexport async function run(a: string) {\n  return fuse(a);\n}\n\nexport class Panel {\n  render(x) {\n    if (x) {\n    }\n  }\n}\nconst tail = 1;\n"
PY = "import os\n\n@deco\ndef alpha():\n    return 1\n\n\nclass Beta:\n    def m(self):\n        return 2\n"


def test_regions_cover_every_line_once_outside_symbols(spark):
    files = [("a", "typescript", TS), ("b", "python", PY), ("c", "python", "def broken(:"), ("d", "yaml", "a: 1"), ("e", "tsx", "let x"), ("f", "python", ""), ("g", "python", "x = 1"), ("h", None, None)]
    rows = indexing.regions(spark.createDataFrame(files, "file_path string, language string, text string")).collect()
    got = {r.file_path: [tuple(x) for x in r["__regions"]] for r in rows}
    assert got["a"] == [
        ("function", "run", 2, 4), ("class", "Panel", 6, 11), ("method", "render", 7, 10), ("context", None, 1, 1), ("context", None, 5, 5), ("context", None, 12, 12),
    ]
    assert got["b"][:3] == [("function", "alpha", 4, 5), ("class", "Beta", 8, 10), ("function", "m", 9, 10)]
    assert got["c"] == [(None, None, 1, 1)] == got["d"] == got["e"] and got["g"] == [("context", None, 1, 1)]
    assert "f" not in got and "h" not in got


def test_chunks_of_files(spark):
    df = spark.createDataFrame([("a.ts", "typescript", TS), ("b.md", "markdown", "\n".join(f"l{i}" for i in range(100))), ("c.py", "python", None)], "file_path string, language string, text string")
    rows = indexing.chunked(df, "r", "u").collect()
    got = sorted((r.file_path, r.start_line, r.end_line, r.symbol_type or "", r.symbol_name or "") for r in rows)
    assert got == [
        ("a.ts", 1, 1, "context", ""), ("a.ts", 2, 4, "function", "run"), ("a.ts", 6, 11, "class", "Panel"), ("a.ts", 7, 10, "method", "render"), ("a.ts", 12, 12, "context", ""),
        ("b.md", 1, 80, "", ""), ("b.md", 61, 100, "", ""),
    ]
    assert all(r.id == f"r:{r.file_path}:{r.start_line}-{r.end_line}:{r.chunk_hash[:10]}" for r in rows)


def test_index_twice_embeds_once(spark, tmp_path):
    class Fake:
        def embed_documents(self, texts):
            return [[float(len(t))] for t in texts]

    tree = tmp_path / "tree"
    tree.mkdir()
    (tree / "a.ts").write_text(TS)
    (tree / "empty one.py").write_text("")
    paths, repos = (str(tmp_path / "chunks"), str(tmp_path / "cache")), str(tmp_path / "repos")
    repo = indexing.index(spark, str(tree), *paths, Fake, "fake", sha="abc", repos_path=repos)
    counts = lambda: (spark.read.parquet(paths[0]).count(), spark.read.parquet(paths[1]).count())
    assert counts() == (5, 5) and {r.commit_sha for r in spark.read.parquet(paths[0]).collect()} == {"abc"}
    row = spark.read.parquet(repos).first()
    assert (row.repo_id, row.commit_sha, row.files_indexed, row.chunks_indexed, row.metadata) == (repo, "abc", 2, 5, {"embedding_cache_hits": "0"})
    assert indexing.index(spark, str(tree), *paths, Fake, "fake", repos_path=repos) == repo and counts() == (5, 5)
    assert [(r.chunks_indexed, r.metadata["embedding_cache_hits"]) for r in spark.read.parquet(repos).collect()] == [(5, "5")]
    stream = lambda: indexing.embed_stream(spark.readStream.schema(indexing.CHUNKS).parquet(paths[0]), str(tmp_path / "other"), str(tmp_path / f"state{random.random()}"), Fake, "fake").awaitTermination()
    for _ in range(2):  # a stream that begins again repeats its batches
        stream()
        assert spark.read.parquet(str(tmp_path / "other")).count() == 5
    (tree / "a.ts").write_text("")
    indexing.index(spark, str(tree), *paths, Fake, "fake", repos_path=repos)
    assert spark.read.schema(indexing.CHUNKS).parquet(paths[0]).count() == 0
    assert [(r.files_indexed, r.chunks_indexed) for r in spark.read.parquet(repos).collect()] == [(2, 0)]


def test_payloads(spark):
    fenced = 'Here:\n```json\n{"answer": "in a.ts", "citations": ["C1", "C9"]}\n```'
    data = [
        ('{"candidates": [{"content": {"parts": [{"text": "x"}, {"text": "y"}]}}], "usageMetadata": {"promptTokenCount": 3, "totalTokenCount": 0}}', fenced),
        ("no json", '{"answer": "bare"}'), (None, "nothing"),
    ]
    df = spark.createDataFrame(data, "p string, t string").select(
        providers.payload_text(F.col("p")).alias("text"), providers.payload_usage(F.col("p"))["input_tokens"].alias("n"), providers.structured_answer(F.col("t")).alias("a")
    )
    lookup = F.create_map(F.lit("C1"), F.lit("a.ts:1-2"))
    rows = df.select("text", "n", "a.answer", providers.known_citations(F.col("a.citations"), lookup).alias("c")).collect()
    assert [tuple(r) for r in rows] == [("x\ny", 3, "in a.ts", ["a.ts:1-2"]), ("", None, "bare", []), ("", None, "I don't know from the indexed repo.", [])]


def test_embedding_responses(spark):
    df = spark.createDataFrame([('{"values": [1, 2.5]}',), ('{"embedding": {"values": [3]}}',), ('{"embeddings": {"values": []}}',)], "item string")
    assert [list(r[0]) for r in df.select(providers.embedding_values(F.col("item"))).collect()] == [[1.0, 2.5], [3.0], []]
    with pytest.raises(Exception, match="no vector"):
        spark.createDataFrame([("{}",)], "item string").select(providers.embedding_values(F.col("item"))).collect()


def test_answers_of_a_model(spark):
    rows = [("r", "q", 1, "a.py", 1, 3, "x = 1"), ("r", "q", 2, "b.py", 4, 5, "y"), ("r", "p", 1, "c.py", 1, 1, "z")]
    found = spark.createDataFrame(rows, "repo_id string, question string, rank int, file_path string, start_line int, end_line int, chunk_text string")

    def client():
        def call(prompt):
            assert prompt.startswith("Question: ") and "[C1] " in prompt
            said = json.dumps({"answer": "in b", "citations": ["C2", "C7"]}) if "b.py:4-5" in prompt else "no answer"
            return json.dumps({"candidates": [{"content": {"parts": [{"text": said}]}}], "usage_metadata": {"total_token_count": 9}})

        return call

    got = {r.question: (r.answer, [tuple(c) for c in r.citations], r.usage.total_tokens) for r in providers.answered_by_model(found, ["repo_id", "question"], client).collect()}
    assert got == {"q": ("in b", [("b.py", 4, 5)], 9), "p": ("I don't know from the indexed repo.", [], 9)}


def test_pair_scorer(spark):
    df = spark.createDataFrame([("q", "aa", 1), ("q", "bbbb", 2), ("q", None, 3)], "question string, t string, rank int")
    got = providers.rescored(df, ["question"], "question", "t", lambda: lambda pairs: [len(b) for _, b in pairs], 2).collect()
    assert sorted((r["rank"], r.t) for r in got) == [(1, "bbbb"), (2, "aa")]
    assert [r.payload for r in providers.generated(df, "t", lambda: str.upper).orderBy("rank").collect()] == ["AA", "BBBB", None]


def test_streamed_repositories_are_replaced(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "repo_id string, id string, chunk_text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda: indexing.replace_stream(spark.readStream.schema("repo_id string, id string, chunk_text string").parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    make([("a", "a1", "x"), ("a", "a1", "x"), ("a", "a2", "y"), ("b", "b1", "z")])
    run()
    make([("a", "a3", "w")])
    run()
    assert sorted((r.repo_id, r.id) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("a", "a3"), ("b", "b1")]
