import math
from collections import Counter

import numpy as np
import pytest

from quarry.functions import text as primitives
from quarry.operators import fusion, tokens, vectors
from quarry.operators.answers import UNKNOWN, answered
from quarry.operators.relevance import analyzed
from quarry.plans import retrieval
from quarry.plans.retrieval import bm25_leg, matching, retrieve, vector_leg

CHUNK = "id string, repo_id string, file_path string, start_line int, end_line int, symbol_name string, symbol_type string, chunk_text string"


def chunk(path, start, end, name, kind, text, repo="r"):
    return (f"{repo}:{path}:{start}-{end}", repo, path, start, end, name, kind, text)


CHUNKS = [
    chunk("src/retrieval/hybridRetriever.ts", 2, 7, "hybridRetrieve", "function", "export function hybridRetrieve() {\n  return fuse(vector, lexical);\n}"),
    chunk("src/retrieval/hybridRetriever.ts", 1, 1, None, "context", "import { fuse } from './fuse';"),
    chunk("src/server.ts", 1, 4, None, None, "import { hybridRetrieve } from './retrieval/hybridRetriever';\nstart(hybridRetrieve);"),
    chunk("config/default.yml", 1, 3, None, None, "retrieval:\n  top_k: 5"),
    chunk("README.md", 1, 3, None, None, "# Sample\n- fast retrieval\n- grounded answers"),
    chunk("src/x.ts", 1, 1, None, None, ""),
]


def code_tokens(text):
    """The plain statement of the tokenizer: a part is added unless it is in the output already."""
    import re

    out = []
    for raw in re.findall(r"[A-Za-z_][A-Za-z0-9_./-]*", text):
        out.append(raw.lower())
        parts = []
        for piece in re.split(r"[./_-]+", raw):
            parts += [p.lower() for p in re.split(r"(?<=[a-z0-9])(?=[A-Z])", piece) if p]
        out += [p for i, p in enumerate(parts) if p not in out and p not in parts[:i]]
    return out


def test_token_counts_as_plain_statement(spark):
    texts = ["server. server a.b b a", "requestLogger logger request RequestLogger", "x_y x_y y", "", "aB AB ab", "/ - 9", None]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, t string")
    counts = tokens.token_counts(df, ["id"], {"t": 1})
    assert counts._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    distinct = {r.id: set(r.said or ()) for r in df.select("id", primitives.code_tokens(df.t).alias("said")).collect()}
    got = {(r.id, r.token): r.tf for r in counts.collect()}
    assert {i: {t for j, t in got if j == i} for i in distinct} == distinct
    want = {(str(i), k): n for i, t in enumerate(texts) if t for k, n in Counter(code_tokens(t)).items()}
    assert got == want


@pytest.mark.parametrize("variant", ["simple", "okapi"])
def test_bm25_as_formula(spark, monkeypatch, variant):
    monkeypatch.setattr(retrieval, "SHARD", 2)  # several shards and blocks
    monkeypatch.setattr(retrieval, "BLOCK", 1)
    docs = {"a": "red fox red", "b": "fox", "c": "blue bird", "d": "fox", "e": "", "f": "fox owl"}
    df = spark.createDataFrame([chunk("", 1, i, None, None, v) for i, v in enumerate(docs.values())] + [chunk("", 1, 9, None, None, "red", "s")], CHUNK)
    asked = spark.createDataFrame([("r", "red red fox"), ("r", "bird"), ("r", "none"), ("s", "red")], "repo_id string, question string")
    got = {(r.question, r.id): (r.score, r["rank"]) for r in bm25_leg(df, asked, 10, variant).where("repo_id = 'r'").collect()}
    n, avg = len(docs), 9 / len(docs)
    df_of = Counter(w for v in docs.values() for w in set(v.split()))
    idf = {w: math.log(1 + (n - k + 0.5) / (k + 0.5)) if variant == "simple" else math.log(n - k + 0.5) - math.log(k + 0.5) for w, k in df_of.items()}
    if variant == "okapi":
        mean = sum(idf.values()) / len(idf)
        idf = {w: 0.25 * mean if x < 0 else x for w, x in idf.items()}

    def score(v, q):
        tf, dl = Counter(v.split()), len(v.split())
        return sum(idf[w] * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * max(dl, 1) / avg)) for w in q.split() if tf[w])

    want = {(q, f"r::1-{i}"): score(v, q) for q in ("red red fox", "bird") for i, v in enumerate(docs.values()) if score(v, q) > 0}
    assert {k: x for k, (x, _) in got.items()} == pytest.approx(want)
    ranks = [k[1] for k, _ in sorted(((k, x) for k, x in got.items() if k[0] == "red red fox"), key=lambda kx: kx[1][1])]
    assert ranks == [f"r::1-{i}" for i in (0, 1, 3, 5)]  # equal scores by place


@pytest.mark.parametrize("spread", [1.0, 0.05])
def test_nearest_as_brute_force(spark, spread):
    rng = np.random.default_rng(1)
    data = (rng.normal(size=(6, 8))[rng.integers(0, 6, 300)] + spread * rng.normal(size=(300, 8))).round(3)
    data[7] = data[3]
    data[40] = data[11] = 0
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)] + [(999, None)], "vec_id long, embedding array<double>")
    got = vectors.nearest(rows, rows.where("vec_id % 20 = 0"), 5, shard_rows=20, block_rows=4, centers=7).collect()
    unit = data / np.where((n := np.linalg.norm(data, axis=1, keepdims=True)) == 0, 1, n)
    for q in range(0, 300, 20):
        s = np.round(unit @ unit[q], 9)
        s[q] = -9
        want = list(np.lexsort((np.arange(300), -s))[:5])
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == want
    assert vectors.nearest(rows.limit(0), rows, 5).count() == vectors.nearest(rows, rows.limit(0), 5).count() == 0
    assert {r["rank"] for r in vectors.nearest(rows.where("vec_id < 3"), rows.where("vec_id = 1"), 5).collect()} == {1, 2}


@pytest.mark.parametrize("sizes", [(4096, 1024), (2, 1)])
def test_vector_leg_ranks_all_chunks_of_the_repository(spark, monkeypatch, sizes):
    monkeypatch.setattr(retrieval, "SHARD", sizes[0])
    monkeypatch.setattr(retrieval, "BLOCK", sizes[1])
    from quarry.functions.ids import bucket, sign

    words = spark.createDataFrame([(f"w{i}",) for i in range(3000)], "w string")
    placed = {r.w: (r.ix, r.s) for r in words.select("w", bucket(words.w, vectors.DIMENSIONS).alias("ix"), sign(words.w).alias("s")).collect()}
    against = next(w for w, (ix, s) in placed.items() if (ix, s) == (placed["w0"][0], -placed["w0"][1]))
    apart = [w for w, (ix, _) in placed.items() if ix != placed["w0"][0]][:2]
    texts = {"a": against, "b": apart[0], "c": "w0", "d": "123", "e": apart[1]}
    chunks = spark.createDataFrame([chunk(f"{k}.py", 1, 1, None, None, t) for k, t in texts.items()] + [chunk("x.py", 1, 1, None, None, "w0", "other")], CHUNK)
    asked = spark.createDataFrame([("r", "w0"), ("r", "??"), ("none", "w0")], "repo_id string, question string")

    def leg(most):
        rows = sorted(vector_leg(chunks, asked, most).collect(), key=lambda r: (r.question, r["rank"]))
        return [(r.question, r.id[2], round(r.score, 6)) for r in rows]

    empty = [("??", k, 0) for k in "abcde"]
    full = [("w0", "c", 1), ("w0", "b", 0), ("w0", "d", 0), ("w0", "e", 0), ("w0", "a", -1)]
    assert leg(60) == empty + full
    assert leg(3) == empty[:3] + full[:3] and leg(1) == empty[:1] + full[:1]


def test_fusion_and_diversity(spark):
    a = spark.createDataFrame([("q", "x", 1), ("q", "y", 2)], "q string, id string, rank int")
    b = spark.createDataFrame([("q", "y", 1), ("q", "z", 2)], "q string, id string, rank int")
    got = {r.id: r.score for r in fusion.fuse({"vector": (a, 0.45), "bm25": (b, 1.0)}, ["q"], "id").collect()}
    assert got == pytest.approx({"x": 0.45 / 41, "y": 0.45 / 42 + 1 / 41, "z": 1 / 42})
    ranked = spark.createDataFrame([("q", "f", i) for i in range(1, 5)] + [("q", "g", 5)], "q string, file string, rank int")
    assert sorted((r.file, r["rank"]) for r in fusion.diversified(ranked, ["q"], "file", 2, 3).collect()) == [("f", 1), ("f", 2), ("g", 3)]


@pytest.mark.parametrize("mode", ["vector", "bm25", "hybrid"])
def test_definition_is_found_and_cited(spark, mode):
    chunks = spark.createDataFrame(CHUNKS + CHUNKS[:2], CHUNK)
    asked = spark.createDataFrame([("r", "Which file defines the hybridRetrieve function?"), ("r", None), ("none", "what")], "repo_id string, question string")
    found = retrieve(chunks, asked, mode, 3)
    rows = sorted(found.collect(), key=lambda r: r["rank"])
    assert rows[0].file_path == "src/retrieval/hybridRetriever.ts" and rows[0].start_line == 2
    assert {r.repo_id for r in rows} == {"r"} and len(rows) <= 3
    if mode == "hybrid":
        # 0.35 + 0.15 + 0.45 + 0.35 + 0.12 + 0.05 and a fifth of the fused score of two first ranks
        assert rows[0].score == pytest.approx(1.47 + 0.2 * (0.45 / 41 + 1 / 41), abs=2e-3)
        answer = answered(analyzed(found), ["repo_id", "question"]).first()
        assert answer.answer.startswith("The `hybridRetrieve` function is defined in `src/retrieval/hybridRetriever.ts:2-7`.")
        assert [c.file_path for c in answer.citations] == ["src/retrieval/hybridRetriever.ts"]


def test_no_evidence_gives_the_unknown_sentence(spark):
    chunks = spark.createDataFrame([chunk("src/theme.ts", 1, 2, None, None, "// this is the theme")], CHUNK)
    asked = spark.createDataFrame([("r", "Which postgres is this?")], "repo_id string, question string")
    row = answered(analyzed(retrieve(chunks, asked, "hybrid", 3)), ["repo_id", "question"]).first()
    assert (row.answer, row.citations) == (UNKNOWN, [])


def test_empty_tables_and_clashing_columns(spark):
    chunks = spark.createDataFrame([], CHUNK + ", score double, rank int, token string")
    asked = spark.createDataFrame([("r", "x")], "repo_id string, question string")
    assert retrieve(chunks, asked).count() == 0
    with pytest.raises(ValueError):
        retrieve(chunks, asked, "fuzzy")


def test_embedding_cache(spark):
    class Fake:
        def embed_documents(self, texts):
            return [[float(len(t)), 1.0] for t in texts]

    chunks = spark.createDataFrame([("h1", "aa"), ("h1", "aa"), ("h2", "b"), (None, "c")], "chunk_hash string, t string")
    cache = spark.createDataFrame([("h2", [0.0])], "chunk_hash string, vector array<float>")
    missing = vectors.missing_from_cache(chunks, cache)
    assert [r.chunk_hash for r in missing.collect()] == ["h1"]
    made = vectors.embed_with(missing, "chunk_hash", "t", Fake)
    both = vectors.with_vectors(chunks, vectors.known_vectors(cache, made.unionByName(made).unionByName(cache)))
    assert {(r.chunk_hash, tuple(r.vector or ())) for r in both.collect()} == {("h1", (2.0, 1.0)), ("h2", (0.0,)), (None, ())}


def test_metadata_filters(spark):
    chunks = spark.createDataFrame(CHUNKS, CHUNK)
    assert {r.file_path for r in matching(chunks, {"symbol_type": "function", "repo_id": "r"}).collect()} == {"src/retrieval/hybridRetriever.ts"}
    assert matching(chunks, {}).count() == len(CHUNKS)
    with pytest.raises(ValueError):
        matching(chunks, {"colour": "red"})
