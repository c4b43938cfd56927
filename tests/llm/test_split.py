import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm.split import aligned, cut_points, split_oversized, split_text


def sample(n, seed=0):
    random.seed(seed)
    return "\n".join(" ".join("w" * random.randint(1, 9) for _ in range(random.randint(0, 14))) for _ in range(n))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n\té😀", max_size=900), st.integers(20, 120), st.integers(0, 15))
def test_pieces_fit_overlap_and_join(text, limit, overlap):
    pieces = split_text(text, limit, overlap, 10)
    assert all(len(p[2]) <= limit for p in pieces)
    assert "".join(p[2] if i == 0 else p[2][overlap:] for i, p in enumerate(pieces)) == text
    for no, start, body, first, last in pieces:
        assert text[start : start + len(body)] == body
        assert first == 10 + text[:start].count("\n")
        assert last == 10 + text[: max(start, start + len(body) - 1)].count("\n")
    for a, b in zip(pieces, pieces[1:]):
        assert b[1] == a[1] + len(a[2]) - overlap


def test_edits_change_neighbours_only():
    text = sample(900)
    parts = lambda t: {t[a:b] for a, b in zip([0, *cut_points(t, 4000, 200)], cut_points(t, 4000, 200))}
    before, after = parts(text), parts(text[:9000] + "an inserted sentence. " + text[9000:])
    assert len(before) > 12 and len(before - after) <= 4
    at_lines = [p for p in cut_points(text, 4000, 200)[:-1] if text[p - 1] == "\n"]
    assert len(at_lines) == len(cut_points(text, 4000, 200)) - 1


def test_rows(spark):
    long = sample(300)
    data = [("a", long, 5, 304, 1), ("b", "short", 1, 1, 1), ("c", None, 1, 1, 1), ("d", "", 1, 1, 1), ("e", "x" * 9001, None, None, 1), ("f", "y" * 4000, 1, 1, 1), ("g", "z" * 4001, 1, 1, 1)]
    df = spark.createDataFrame(data, "id string, chunk_text string, start_line int, end_line int, piece_no int").drop("piece_no")
    got = split_oversized(df, "chunk_text", "start_line", "end_line", 4000, 200).collect()
    assert {r.id for r in got} == {"a", "e", "g"}
    assert all(len(r.piece_text) <= 4000 and r.n_pieces == sum(o.id == r.id for o in got) for r in got)
    mine = sorted((r for r in got if r.id == "a"), key=lambda r: r.piece_no)
    assert mine[0].piece_start_line == 5 and mine[-1].piece_end_line == 304
    with pytest.raises(ValueError):
        cut_points("abc", 10, 10)


def test_stripped_lines_are_placed(spark):
    lines = [f"line {i} " + "x" * 60 for i in range(1, 201)]
    lines[60] = lines[61] = lines[199] = ""
    window = lambda s, e: ("a", "f", s, e, "\n".join(lines[s - 1 : e]).strip())
    rows = [(f"w{s}", *window(s, e)) for s, e in ((1, 80), (61, 140), (121, 200))]
    df = spark.createDataFrame([*rows, rows[1]], "id string, repo_id string, file_path string, start_line int, end_line int, chunk_text string")
    got = sorted((r.id, r.start_line, r.end_line) for r in aligned(df, 80, 20, 4000).distinct().collect())
    assert got == [("w1", 1, 80), ("w121", 121, 200), ("w61", 63, 140)]


def test_long_texts_are_split_once(spark):
    df = spark.createDataFrame([("a", "x y " * 3000, 1, 1)], "id string, chunk_text string, start_line int, end_line int")
    cut = split_oversized(df, "chunk_text", "start_line", "end_line", 4000, 200).where("piece_no = 1").select("id")
    assert cut._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
