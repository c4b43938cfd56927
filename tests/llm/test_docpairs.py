import pytest

from quarry.llm import doctext
from quarry.llm.docpairs import code_pairs, documented_functions
from quarry.llm.syntax import parse

CHUNK = "id string, repo_id string, file_path string, language string, start_line int, end_line int, chunk_text string, symbol_name string, symbol_type string, token string"


def rows(*given):
    return [(f"i{i}", "r", *g, None) for i, g in enumerate(given)]


def test_what_documents():
    real = doctext.describe
    assert real(["/** Merges two lists of ranked rows.", " * @param a the first */"]) == "Merges two lists of ranked rows."
    assert real(["/*!", " * \\brief Keeps a running total per key.", " */"]) == "Keeps a running total per key."
    assert real(["// Prüft vor dem Schreiben, ob alles da ist. TODO: revisit later."]) == "Prüft vor dem Schreiben, ob alles da ist."
    for none in (
        ["// TODO: document this function properly please"], ["// eslint-disable-next-line no-console"], ["// ========================"], ["// ---- queue helpers in here ----"],
        ["// const a = load('x', 3);", "// total += a.weight * 2"], ["/* Copyright 2020 the authors.", " * Licensed under the terms in LICENSE. */"],
        ["// Code generated by tool. DO NOT EDIT this file."], ["# @param rows the rows to look at"], ["// N/A"], ["//"], [],
    ):
        assert real(none) is None, none


def test_comments_above_and_inside(spark):
    klass = "class Store {\n  /** Reads one row at a time and keeps it. */\n  @cached(\n    true\n  )\n  get(a) {\n    return a;\n  }\n\n  // Called by the scheduler after each run.\n  // prettier-ignore\n  put(b) { x = 1;\n  }\n}"
    py = "def load(a,\n         b=None):\n    '''Returns the first row that fits the key.'''\n    return a"
    data = rows(
        ("a.ts", "typescript", 1, 14, klass, "Store", "class"),
        ("a.ts", "typescript", 6, 8, "get(a) {\n    return a;\n  }", "get", "method"),
        ("a.ts", "typescript", 12, 13, "put(b) { x = 1;\n  }", "put", "method"),
        ("b.py", "python", 1, 3, "import os\n# Splits the input where it is allowed.\n@deco", None, "context"),
        ("b.py", "python", 4, 5, "def split(x):\n    return x", "split", "function"),
        ("b.py", "python", 7, 10, py, "load", "function"),
        ("b.py", "python", 12, 13, "def load_rows(x):\n    return x", "load_rows", "function"),
        ("c.go", "go", 1, 3, "package c\n\n// Load the rows of load rows.", None, "context"),
        ("c.go", "go", 4, 6, "func LoadRows() {\n}", "LoadRows", "function_declaration"),
        ("d.py", "python", 1, 2, None, "none", "function"),
        ("d.py", None, 5, 6, "", "empty", "function"),
    )
    df = spark.createDataFrame(data + data[:3], CHUNK)
    got = sorted((r.file_path, r.symbol_name, r.start_line, r.description) for r in documented_functions(df).collect())
    assert got == [
        ("a.ts", "get", 6, "Reads one row at a time and keeps it."), ("a.ts", "put", 12, "Called by the scheduler after each run."),
        ("b.py", "load", 7, "Returns the first row that fits the key."), ("b.py", "split", 4, "Splits the input where it is allowed."),
    ]
    assert documented_functions(df.limit(0)).count() == 0


def test_long_functions_are_one_pair(spark):
    lines = ["// Walks over all rows and keeps the good ones.", "function run() {", *[f"  step{i}();" for i in range(3, 150)], "}"]
    window = lambda s, e: "\n".join(lines[s - 1 : e]).strip()
    data = rows(
        ("a.js", "javascript", 1, 1, window(1, 1), None, "context"), ("a.js", "javascript", 2, 81, window(2, 81), "run", "function"),
        ("a.js", "javascript", 62, 141, window(62, 141), "run", "function"), ("a.js", "javascript", 122, 150, window(122, 150), "run", "function"),
    )
    df = spark.createDataFrame(data, CHUNK)
    pairs = code_pairs(df, documented_functions(df)).collect()
    assert len(pairs) == 1 and (pairs[0].start_line, pairs[0].end_line) == (2, 150)
    assert [x.strip() for x in pairs[0].code.split("\n")] == [x.strip() for x in lines[1:]]


@pytest.mark.parametrize("text", ['def f():\n    r"""Doc of\\d this one here."""', 'def f(a: "x" = (1, 2)):\n    # note\n    "Doc of this one here."'])
def test_python_strings_are_read_as_python_does(text):
    assert parse(text, "python").functions[0].literal.startswith("Doc of")


def test_nodes_of_brace_languages():
    java = "package a;\n\npublic class Store {\n    private int n = 1;\n\n    // Keeps one row in mind.\n    @Override\n    // and this too\n    public int get(String a,\n        int b) {\n        if (a) { return 1; }\n        return 2;\n    }\n\n    /** Saves it. */\n    void save(int a);\n}\n"
    assert [(f.name, f.first, f.line, f.last, [" ".join(x.strip() for x in u) for u in f.above]) for f in parse(java, "java").functions] == [
        ("get", 6, 8, 12, ["// Keeps one row in mind.", "// and this too"]), ("save", 15, 15, 15, ["/** Saves it. */"]),
    ]
    go = 'import "x"\n// about y\nvar y = 1\n\n// Run runs.\nfunc (s *T) Run(a int) error {\n    m := `{`\n    return func() error {\n    }\n}\n// the end'
    tree = parse(go, "go")
    assert [(f.name, f.line, f.last, f.above) for f in tree.functions] == [("Run", 5, 9, [["// Run runs."]])] and tree.tail == [["// the end"]]
    ts = "import { a } from 'b'\n// About go.\nexport const go = async ({ x, y }: { x: number }) => {\n  return x\n}\nclass P extends Q {\n  /* About m. */\n  static async m<T>(a: { b: number }): Promise<T> { const z = '}'\n  }\n  get v() { return 1 }\n}\ndescribe('it', () => {\n  // About inner.\n  function inner(a) {\n  }\n})"
    assert [(f.name, f.line, f.last, f.above) for f in parse(ts, "typescript").functions] == [
        ("go", 2, 4, [["// About go."]]), ("m", 7, 8, [["  /* About m. */"]]), ("v", 9, 9, []), ("inner", 13, 14, [["  // About inner."]]),
    ]
    cpp = "#include <a>\n// Adds.\ntemplate <typename T>\nint\nA::add(const T& x) const noexcept\n{\n  for (;;) { }\n}\n"
    assert [(f.name, f.first, f.line, f.last, f.above) for f in parse(cpp, "cpp").functions] == [("add", 2, 3, 7, [["// Adds."]])]


def test_nodes_of_ruby_and_cut_python():
    ruby = "class A\n  # Finds it.\n  def find(x)\n    return 1 if x\n    while x do\n    end\n    y = if x then 1 else 2 end\n    z.each do |a|\n    end\n  end\n\n  def one(x) = x + 1\n\n=begin\nAbout two.\n=end\n  def self.two?\n    'Says so.'\n  end\nend"
    assert [(f.name, f.line, f.last, f.literal) for f in parse(ruby, "ruby").functions] == [("find", 2, 9, None), ("one", 11, 11, None), ("two?", 16, 18, "Says so.")]
    cut = "def f(a):\n    '''Reads it.'''\n    try:\n        for x in a:\n            # next\n            call(1,\n                 2"
    tree = parse(cut, "python")
    assert tree.how == "completed" and [(f.name, f.literal) for f in tree.functions] == [("f", "Reads it.")]
    inside = 'return 1\n\n    # Saves it.\n    @deco\n    def g(self,\n          a=1):\n        """Writes it."""\n        x = a\n'
    tree = parse(inside, "python")
    assert tree.how == "headers" and [(f.name, f.first, f.line, f.literal, f.above) for f in tree.functions] == [("g", 3, 4, "Writes it.", [["    # Saves it."]])]


@pytest.mark.parametrize("language", ["python", "java", "go", "ruby", "tsx", "", "markdown"])
def test_any_text_has_a_tree(language):
    for text in ("", "}", "*/", "((((", "def", "'''", "/*", "`", "{" * 50, "end\n" * 5, "@a(\n", "\ud800 x() {"):
        parse(text, language)


def test_long_headers_and_declarations(spark):
    many = ", ".join(f"argument_{i}: dict[str, list[int]] = None" for i in range(250))
    shared = "public " + "Map<String, List<Integer>> " * 5 + "name"
    data = rows(
        ("a.py", "python", 1, 3, f"def run({many}):\n    'Returns the first row that fits.'\n    return 1", "run", "function"),
        ("b.java", "java", 1, 9, f"class A {{\n  // Counts the rows of one kind.\n  {shared}One(int a) {{\n  }}\n  {shared}Two(int a) {{\n  }}\n}}", "A", "class_declaration"),
        ("b.java", "java", 3, 4, f"{shared}One(int a) {{\n  }}", "nameOne", "method_declaration"),
        ("b.java", "java", 5, 6, f"{shared}Two(int a) {{\n  }}", "nameTwo", "method_declaration"),
    )
    got = sorted((r.symbol_name, r.description) for r in documented_functions(spark.createDataFrame(data, CHUNK)).collect())
    assert got == [("nameOne", "Counts the rows of one kind."), ("run", "Returns the first row that fits.")]
