import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import ids, text


def rows(spark, values, column):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]


def test_identifier_parts_and_tokens(spark):
    assert rows(spark, ["requestLogger", "a_b-c.D", "_", "", None], text.identifier_parts) == [["request", "logger"], ["a", "b", "c", "d"], [], [], []]
    assert rows(spark, ["server. requestLogger()", "", None], text.code_tokens) == [["server.", "server", "requestlogger", "request", "logger"], [], []]
    assert rows(spark, ["My_Name.x", None], text.normalized_identifier) == ["mynamex", None]


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab \t\n\r  \x0b_AB.", max_size=12), min_size=1, max_size=30))
def test_lines_and_strip_as_python(spark, values):
    assert rows(spark, values, text.lines_of) == [v.splitlines() for v in values]
    assert rows(spark, values, text.stripped) == [v.strip() for v in values]


def test_summary_and_markdown(spark):
    long = "\n".join(f"line {i}" for i in range(12))
    assert rows(spark, [long, "", "  a \n\n b"], text.summary) == ["line 0 line 1 line 2 line 3", "Relevant code chunk", "a b"]
    assert rows(spark, ["## Title ", "> `- x"], text.without_markdown) == ["Title", "x"]
    assert rows(spark, ["a/b.TS", ".env", "x"], text.suffix) == [".ts", "", ""]


def test_hash_bucket_as_python(spark):
    import hashlib

    words = ["alpha", "beta_2", "é"]
    digests = [hashlib.sha256(w.encode()).digest() for w in words]
    assert rows(spark, words, ids.bucket) == [int.from_bytes(d[:4], "big") % 256 for d in digests]
    assert rows(spark, words, ids.sign) == [1 if d[4] % 2 == 0 else -1 for d in digests]


def test_repo_id(spark):
    df = spark.createDataFrame([("https://forge.example/a/My Repo/", None)], "u string, b string")
    built = df.select(ids.repo_id(F.col("u"), F.col("b"))).first()[0]
    assert re.fullmatch(r"forge-example-a-my-repo-[0-9a-f]{8}", built)
