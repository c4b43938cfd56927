from quarry.operators import chunking


def test_windows(spark):
    text = "\n".join(f"line {i}" for i in range(1, 13))
    df = spark.createDataFrame([("a", text), ("b", ""), ("c", None), ("d", " \n \n"), ("e", "x\n")], "id string, t string")
    got = sorted((r.id, r.start_line, r.end_line) for r in chunking.line_windows(df, "t", 5, 2).collect())
    assert got == [("a", 1, 5), ("a", 4, 8), ("a", 7, 11), ("a", 10, 12), ("e", 1, 1)]


def test_uncovered_regions(spark):
    df = spark.createDataFrame([("f", 4, 6), ("f", 5, 9), ("f", 12, 12), ("f", 12, 12), ("g", 1, 3), ("h", None, None)], "k string, s int, e int")
    assert sorted(tuple(r) for r in chunking.uncovered(df, ["k"], "s", "e").collect()) == [("f", 1, 3), ("f", 10, 11)]


def test_the_run_after_the_last_region(spark):
    df = spark.createDataFrame([("f", 4, 6, 6), ("f", None, None, 20), ("g", 1, 3, 3), ("h", None, None, 9), ("i", 2, 2, None)], "k string, s int, e int, last int")
    assert sorted(tuple(r) for r in chunking.uncovered(df, ["k"], "s", "e", "last").collect()) == [("f", 1, 3), ("f", 7, 20), ("i", 1, 1)]


def test_block_ends(spark):
    df = spark.createDataFrame([(1, "f() {\n  if (x) {\n  }\n}\nrest"), (2, "no braces\nhere"), (3, "a {\n b"), (4, ""), (5, None)], "k int, t string")
    assert sorted(tuple(r) for r in chunking.block_ends(df, ["k"], "t").collect()) == [(1, 5, 4), (2, 2, 2), (3, 2, 2)]


def test_symbols(spark):
    js = "export default class Panel {\n  render() {\n    const go = () => {\n    };\n  }\n  class Inner {\n    draw() {}\n  }\n\u00a0 if (x) {\n  }\n}\nexport const go = async (a) => {\n}\nclean() {\n}\nfunction run(x) {"
    df = spark.createDataFrame([(1, js), (2, None), (3, "")], "k int, t string")
    assert [tuple(r)[1:] for r in chunking.script_symbols(df, ["k"], "t").collect()] == [
        ("class", "Panel", 1, 11), ("method", "render", 2, 5), ("class", "Inner", 6, 8), ("method", "draw", 7, 7), ("function", "go", 12, 13), ("function", "run", 16, 16),
    ]
    py = "@deco\ndef alpha():\n    pass\n\nclass Beta:\n    def m(self):\n        pass\n"
    df = spark.createDataFrame([(1, py), (2, "def broken(:"), (3, None)], "k int, t string")
    assert sorted((r.symbol_name, r.start_line, r.end_line) for r in chunking.python_symbols(df, ["k"], "t").collect()) == [("Beta", 5, 7), ("alpha", 2, 3), ("m", 6, 7)]


def test_symbols_of_windows_that_begin_or_end_inside_a_block(spark):
    begins = "return 1\n\n    def m(self,\n          a=1):\n        x = a\n\n        return x\n\n    async def n(self):\n        pass\n\nclass Gamma:\n    def k(self): return 2"
    ends = "class Delta(Base):\n    def one(self):\n        pass\n\n    def two(self):\n        call(\n            1,"
    stripped = 'def first(self):\n        """\n        def fake(): no\n        """\n        return 1\n\n    def second(self):\n        return 2'
    df = spark.createDataFrame([(1, begins), (2, ends), (3, stripped), (4, "def broken(:\n  x")], "k int, t string")
    got = sorted((r.k, r.symbol_name, r.symbol_type, r.start_line, r.end_line) for r in chunking.python_symbols(df, ["k"], "t").collect())
    assert got == [
        (1, "Gamma", "class", 12, 13), (1, "k", "function", 13, 13), (1, "m", "function", 3, 7), (1, "n", "function", 9, 10),
        (2, "Delta", "class", 1, 7), (2, "one", "function", 2, 3), (2, "two", "function", 5, 7),
        (3, "first", "function", 1, 5), (3, "second", "function", 7, 8),
    ]


def test_latest_row_wins(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "y"), ("b", None, "z")], "k string, t int, v string")
    assert sorted(tuple(r) for r in chunking.latest_by_key(df, ["k"], ["t"]).collect()) == [("a", 2, "y"), ("b", None, "z")]
