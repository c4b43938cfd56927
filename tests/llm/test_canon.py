import json
import random
import unicodedata

from quarry.llm import canon
from quarry.llm.canon import contents, content_keys, copies, fold

CHUNK = "id string, repo_id string, file_path string, language string, start_line int, chunk_text string, content_hash string"


def chunk(i, text, language="python", path=None, start=1):
    return (i, "r", path or f"{i}.x", language, start, text, "clash")


def test_copies_by_letters_and_digits(spark):
    base = "def merge_rows(first_list, second_list): return sorted(first_list + second_list) # straße 42"
    data = [
        chunk("c3", base), chunk("c1", base.upper().replace("_", "")), chunk("c2", base.replace(" ", "\r\n\t")), chunk("c1", base.upper().replace("_", "")),
        chunk("o1", base + "x"), chunk("s1", "short one"), chunk("s2", "Short, one"), chunk("s3", "short one"), chunk("n", None), chunk("e", ""), chunk(None, base),
    ]
    df = spark.createDataFrame(data, CHUNK)
    keys = canon.content_keys(df)
    assert sorted(map(tuple, canon.copies(keys).collect())) == [("c1", "c2"), ("c1", "c3")]
    counts = {r.id: (r.n_copies, r.n_rows) for r in canon.contents(keys).collect()}
    assert counts == {"c1": (3, 4), "o1": (1, 1), "s1": (2, 2), "s2": (1, 1), "e": (1, 1)}
    assert canon.copies(canon.content_keys(df.limit(0))).count() == 0


def test_whole_files_by_field(spark):
    a = {"name": "sample package", "items": ["one", "two", "three"], "deep": {"x": 1.50, "flag": True, "none": None}, "text": "long enough to be compared"}
    b = {"Text": "Long enough, to be compared!", "deep": {"none": None, "flag": True, "x": 1.50}, "items": ["one", "two", "three"], "name": "sample-package"}
    swapped = dict(a, items=["two", "one", "three"])
    data = [chunk("a", json.dumps(a), "json"), chunk("b", json.dumps(b, indent=3), "json"), chunk("s", json.dumps(swapped), "json"), chunk("y", json.dumps(b), "yaml")]
    data += [chunk("p", json.dumps(a), "json", "part.json"), chunk("q", json.dumps(a)[:60], "json", "part.json", 61)]
    got = sorted(map(tuple, canon.copies(canon.content_keys(spark.createDataFrame(data, CHUNK))).collect()))
    assert got == [("a", "b")]


def test_yaml_forms():
    block = "---\nname: 'a b'  # note\nlist:\n- x\n- y: 1\n  z: two\ndeep:\n    k: |\n      some text\n      more\n    e:\n"
    flow = '{list: [x, {z: two, y: 1}], deep: {k: "some text more", e: }, "name": "A-B"}'
    assert canon.fields(block, "yaml") == canon.fields(flow, "yaml") is not None
    assert canon.fields("- id: a\n    ref: b\n  - id: c\n    ref: d", "yaml") == "[{id:a,ref:b},{id:c,ref:d}]"
    for broken in ("[1, 2", "{", "a: [1", None, ""):
        assert canon.fields(broken, "yaml") is None


def test_hot_content_against_brute_force(spark):
    random.seed(1)
    texts = [f"the quick brown fox number {n} jumps over the lazy dog again and again" for n in range(8)]
    data = []
    for i in range(600):
        t = texts[0] if i % 3 == 0 else random.choice(texts)
        data.append(chunk(f"id{i:04}", "".join(c.upper() if random.random() < 0.3 else c for c in t).replace(" ", random.choice([" ", "\n", "_"]))))
    groups = {}
    for r in data:
        groups.setdefault(canon.fold(r[5]), []).append(r[0])
    want = sorted((min(v), x) for v in groups.values() for x in v if x != min(v))
    assert sorted(map(tuple, canon.copies(canon.content_keys(spark.createDataFrame(data, CHUNK))).collect())) == want


def test_compatibility_characters_are_the_same(spark):
    plain = "résumé of the office: ffi ligatures, full width ABC 123 and the strasse of Übermaß"
    decomposed = unicodedata.normalize("NFD", plain)
    wide = plain.replace("ffi", "\ufb03").replace("ABC 123", "\uff21\uff22\uff23 \uff11\uff12\uff13").replace("Übermaß", "ÜBERMASS").replace("strasse", "straße")
    assert fold(plain) == fold(decomposed) == fold(wide) == fold(wide.upper())
    rows = [("a", "r", "a.py", "python", 1, plain), ("b", "r", "b.py", "python", 1, decomposed), ("c", "r", "c.py", "python", 1, wide), ("d", "r", "d.py", "python", 1, plain.replace("é", "e"))]
    df = spark.createDataFrame(rows, "id string, repo_id string, file_path string, language string, start_line int, chunk_text string")
    assert sorted(tuple(r) for r in copies(content_keys(df)).collect()) == [("a", "b"), ("a", "c")]


def test_texts_are_read_once(spark):
    df = spark.createDataFrame([("a", "r", "a.py", "python", 1, "x" * 50)], "id string, repo_id string, file_path string, language string, start_line int, chunk_text string")
    plan = contents(content_keys(df))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
