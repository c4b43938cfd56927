from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quarry.operators import evaluation as ev
from quarry.operators.answers import UNKNOWN
from quarry.plans import evaluating

ITEM = (
    "eval_id string, expected_files array<string>, retrieved_files array<string>, retrieval_hit_at_3 boolean, retrieval_hit_at_5 boolean, reciprocal_rank double, "
    "answer_contains_score double, groundedness_score double, hallucination_flags array<string>, latency_ms bigint, estimated_cost_usd double, answer string, "
    "citations array<struct<file_path:string,start_line:int,end_line:int>>"
)


def test_item_metrics(spark):
    rows = [
        ("e", ["b"], ["a", "b", "c"], True, True, 0.5, 1.0, 1.0, [], 10, 0.0, "see b", [("b", 1, 2), ("z", 1, 1)]),
        ("e", None, None, None, None, None, None, None, None, None, None, None, None),
        ("e", [], ["a"], False, False, 0.0, 0.0, 0.0, ["missing_citations"], 30, None, UNKNOWN, []),
    ]
    df = spark.createDataFrame(rows, ITEM)
    got = df.select(ev.hit_at(1), ev.hit_at(3), ev.reciprocal_rank(), ev.groundedness(), ev.flags()).collect()
    assert [tuple(r) for r in got] == [
        (False, True, 0.5, 0.5, ["citation_not_retrieved:z"]),
        (False, False, 0.0, 0.0, ["missing_citations"]),
        (False, False, 0.0, 1.0, []),
    ]
    one = ev.summary(df, ["eval_id"]).first()
    assert (one.total_queries, one.recall_at_3, one.mrr, one.flags, one.failure_rate) == (3, 1.0, 0.5, 1, 0.333333)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.integers(-5, 5)), max_size=40))
def test_nearest_rank_as_plain_statement(spark, values):
    df = spark.createDataFrame([("k", v) for v in values], "k string, v bigint")
    got = ev.nearest_rank(df, ["k"], "v", [50, 95]).collect()
    there = sorted(v for v in values if v is not None)
    assert [(r.n, r.p50, r.p95) for r in got] == ([(len(there), *(there[round(p / 100 * (len(there) - 1))] for p in (50, 95)))] if there else [])


def test_questions_are_answered_and_measured(spark):
    chunks = [("i1", "r", "src/run.py", "def load_rows(path):\n    return path", "load_rows", "function"), ("i2", "r", "README.md", "# Tool\nLicense\nMIT License", None, None), (None, "r", "x", None, None, None)]
    docs = spark.createDataFrame([(*c[:3], "python", 1, 2, *c[3:]) for c in chunks], "id string, repo_id string, file_path string, language string, start_line int, end_line int, chunk_text string, symbol_name string, symbol_type string")
    samples = spark.createDataFrame(
        [("e", 1, "r", "Where is load_rows defined?", ["src/run.py"], ["load_rows"], []), ("e", 2, "r", "Where is load_rows defined?", ["other.py"], [], ["RUN.py"]), ("e", 3, "gone", "What?", [], None, None)],
        "eval_id string, item_no int, repo_id string, question string, expected_files array<string>, expected_answer_contains array<string>, must_not_contain array<string>",
    )
    results = evaluating.evaluated(docs, samples, ["eval_id", "item_no"]).cache()
    got = {r.item_no: r for r in results.collect()}
    assert (got[1].retrieval_hit_at_3, got[1].reciprocal_rank, got[1].answer_contains_score, got[1].hallucination_flags) == (True, 1.0, 1.0, [])
    assert got[2].hallucination_flags == ["must_not_contain:RUN.py"] and not got[2].retrieval_hit_at_5
    assert (got[3].answer, got[3].retrieved_files, got[3].groundedness_score) == (UNKNOWN, [], 1.0)
    one = evaluating.summarized(results, ["eval_id"], "item_no").first()
    assert (one.total_queries, one.recall_at_5, one.failed_items, one.flags) == (3, 0.5, [2], 1)
