import random

from pyspark.sql import functions as F

from quarry.llm.handwritten import classified_files

CHUNK = "repo_id string, file_path string, language string, start_line int, end_line int, chunk_text string, lines int, origin string"
CODE = "import os\n\n# Loads the minified bundle of x and maps it back.\n\n\ndef run(a, b):\n    total = a + b\n    for row in rows:\n        total += row.weight * 7\n    if total > 3:\n        return None\n    return total\n\n\nclass Store(Base):\n    name = 'store'\n\n    def put(self, key, value=None):\n        self.rows[key] = [value]\n        log.info('%s kept', key)\n        yield from (x * x for x in value if x)\n        raise KeyError(f'no {key}')\n"


def chunks(spark, rows):
    return spark.createDataFrame(rows, CHUNK).withColumn("symbol_type", F.lit(None).cast("string"))


def test_origins(spark):
    random.seed(0)
    getters = "\n".join(f"export function getValue{i}(msg) {{\n  return msg.field({i}, 'value{i}');\n}}" for i in range(20))
    blob = "DATA = [\n" + "\n".join(f'  "{"".join(random.choices("abcdefghABCDEFG0123456789+/", k=72))}",' for _ in range(30)) + "\n]"
    numbers = "T = [\n" + "\n".join("  [" + ", ".join(f"{random.uniform(-9, 9):.5f}" for _ in range(8)) + "]," for _ in range(30)) + "\n]"
    minified = "(()=>{" + "".join(f"var a{i}=function(e,t){{return e[{i}]^t}};" for i in range(60)) + "})();"
    files = {
        "src/own.py": ("python", CODE, None), "src/vendors/own.py": ("python", CODE, None), "buildtools/own.py": ("python", CODE, None),
        "third_party/x.py": ("python", CODE, "vendored"), "deps/x.py": ("python", CODE, "vendored"),
        "src/copied.py": ("python", "# This is an unmodified copy of fox 3.1, see upstream for changes\n" + CODE, "vendored"),
        "src/lib.js": ("javascript", "/*! fox v2.1.0 | (c) the fox contributors | permissive licence */\n" + CODE, "vendored"),
        "src/made.py": ("python", "# Copyright the fox authors\n# Code generated by fox-gen. DO NOT EDIT.\n" + CODE, "generated"),
        "src/made2.py": ("python", "# Diese Datei wurde automatisch von fox erzeugt. Nicht bearbeiten!\n" + CODE, "generated"),
        "src/banner.py": ("python", "# Writes a banner saying DO NOT EDIT into every file that fox emits.\n" + CODE, None),
        "src/hand.py": ("python", "# Please edit by hand: fox reads this table as it stands.\n" + CODE, None),
        "src/talk.py": ("python", "# Vendored copies of fox live elsewhere; this file only lists them.\n" + CODE, None),
        "src/get.ts": ("typescript", getters, "generated"), "app/package-lock.json": ("json", '{"name": "x", "lockfileVersion": 3}', "generated"),
        "src/blob.py": ("python", blob, "data"), "src/numbers.py": ("python", numbers, "data"), "public/app.js": ("javascript", minified, "minified"),
        "config/a.json": ("json", '{ "a": 1, "b": "' + "word " * 90 + '" }', None), "docs/a.md": ("markdown", "# T\n" + "- item: 5\n" * 40, None), "src/empty.py": ("python", "", None),
    }
    rows = [("r", path, language, 1, text.count("\n") + 1, text, 0, "clash") for path, (language, text, _) in files.items()]
    rows += [rows[0], ("r", "null.py", None, None, None, None, 0, ""), (None, "x.py", "python", 1, 9, CODE, 0, "")]
    got = {r.file_path: r.origin for r in classified_files(chunks(spark, rows)).collect()}
    assert got == {path: want for path, (_, _, want) in files.items()}


def test_notices_are_found_anywhere_outside_of_functions(spark):
    licence = "".join(f"# Line {i} of a long licence text that says nothing of this file at all.\n" for i in range(60))
    rows = [
        ("r", "late.py", "python", 1, 90, licence + "# Code generated by fox-gen. DO NOT EDIT.\n" + CODE, 0, ""),
        ("r", "middle.ts", "typescript", 1, 14, CODE, 0, ""), ("r", "middle.ts", "typescript", 15, 16, "// Archivo generado automáticamente por fox.", 0, ""),
        ("r", "body.ts", "typescript", 1, 14, "function banner() {\n  // Code generated by fox-gen. DO NOT EDIT.\n  return 1;\n}", 0, ""),
    ]
    df = spark.createDataFrame(rows, CHUNK).withColumn("symbol_type", F.when(F.col("file_path") == "body.ts", "function").when(F.col("start_line") == 15, "context"))
    assert {r.file_path: (r.origin, r.evidence) for r in classified_files(df).collect()} == {"late.py": ("generated", "notice"), "middle.ts": ("generated", "notice"), "body.ts": (None, None)}


def test_a_file_in_many_chunks_is_one(spark):
    parts = [("r", "a.ts", "typescript", 3 * i + 1, 3 * i + 3, f"export function getField{i}(msg) {{\n  return msg.field({i}, 'f{i}');\n}}", 0, "") for i in range(12)]
    rows = classified_files(chunks(spark, parts)).collect()
    assert [(r.origin, r.lines, r.n_shapes) for r in rows] == [("generated", 36, 3)]


def test_shapes_are_counted_exactly(spark):
    shapes = ["a" + c * n for n in range(1, 11) for c in "+-*/%&|^"]
    rows = [("r", "a.py", "python", 1 + 40 * i, 40 * i + 40, "\n".join(shapes[40 * i : 40 * i + 40]), 0, "") for i in range(2)]
    rows += [("r", f"{k}.py", "python", 1, 60, "\n".join(shapes[(j + k) % 80] for j in range(9) for _ in range(6)), 0, "") for k in range(80)]
    got = {r.file_path: (r.n_shapes, r.origin) for r in classified_files(chunks(spark, rows + rows[:1])).collect()}
    assert got.pop("a.py") == (80, None)
    assert set(got.values()) == {(9, None)}
