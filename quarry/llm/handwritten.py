"""Problem 5: generated, minified, vendored and bulk data files told apart from hand-written source.

Every chunk is reduced to layout statistics inside the JVM: line lengths, shares of white space, letters and
digits, number literals and encoded runs, and the shapes of its lines, as 64-bit hashes. Statistics of chunks add up
to those of their file with map-side combining, whatever its size, and thresholds per language decide. Whole texts
are read. A copy of an outside package is laid out like any other source, so only its notice or folder tells it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.session import spread

#: Thresholds by language; ``*`` holds where a language has none of its own, None switches a test off.
#: long_line, mean_line and spaces: a file is minified whose longest line and mean line are at least so long, with
#: at most this share of white space. numbers, encoded and alnum: it is bulk data from this share of number literals or
#: encoded runs in its visible characters, or of letters and digits in all, on, if it has at least ``bulk`` characters.
#: shapes, lines and repeat: it is generated or bulk data if at least ``lines`` lines have at most ``shapes`` different
#: shapes, ``repeat`` lines or more to a shape. Set between the most extreme hand-written files of the test tables at
#: sf0.1 (3,400 files) and the least extreme cases, nearer to the cases.
THRESHOLDS: dict[str, dict[str, float | None]] = {
    "*": {"long_line": 500, "mean_line": 200, "spaces": 0.10, "numbers": 0.30, "encoded": 0.30, "alnum": 0.88, "bulk": 800, "shapes": 8, "lines": 15, "repeat": 5},
    "cpp": {"long_line": 500, "mean_line": 240, "spaces": 0.07, "numbers": 0.30, "encoded": 0.30, "alnum": 0.85, "lines": 20},
    "go": {"long_line": 500, "mean_line": 240, "spaces": 0.10, "numbers": 0.30, "encoded": 0.30, "alnum": 0.85, "lines": 20},
    "java": {"long_line": 520, "mean_line": 240, "spaces": 0.09, "numbers": 0.28, "encoded": 0.30, "alnum": 0.84, "lines": 20},
    "javascript": {"long_line": 600, "mean_line": 250, "spaces": 0.06, "numbers": 0.28, "encoded": 0.30, "alnum": 0.85, "lines": 15},
    "jsx": {"long_line": 600, "mean_line": 250, "spaces": 0.06, "numbers": 0.28, "encoded": 0.30, "alnum": 0.85, "lines": 15},
    "typescript": {"long_line": 600, "mean_line": 250, "spaces": 0.06, "numbers": 0.28, "encoded": 0.30, "alnum": 0.85, "lines": 15},
    "tsx": {"long_line": 600, "mean_line": 250, "spaces": 0.06, "numbers": 0.28, "encoded": 0.30, "alnum": 0.85, "lines": 15},
    "python": {"long_line": 520, "mean_line": 240, "spaces": 0.06, "numbers": 0.28, "encoded": 0.30, "alnum": 0.86, "lines": 15},
    "ruby": {"long_line": 500, "mean_line": 220, "spaces": 0.05, "numbers": 0.30, "encoded": 0.30, "alnum": 0.86, "lines": 20},
    "json": {"long_line": None, "numbers": 0.35, "encoded": 0.25, "alnum": 0.85, "shapes": 5, "lines": 20},
    "yaml": {"long_line": None, "numbers": 0.45, "encoded": 0.25, "alnum": 0.88, "shapes": 0, "lines": 20},
    "markdown": {"long_line": None, "numbers": None, "encoded": None, "alnum": None, "shapes": 0},
    "text": {"long_line": None, "numbers": None, "encoded": None, "alnum": None, "shapes": 0},
}

#: Folders that hold copies of outside packages.
VENDOR_FOLDERS = (
    "vendor", "_vendor", "vendored", "third_party", "third-party", "thirdparty", "3rdparty", "3rd_party", "3rd-party",
    "node_modules", "bower_components", "deps", "extern", "external", "externals", "contrib/ext", "assets/lib", "static/plugins", "libs", "Godeps", "Pods", "site-packages",
)
#: Names of dependency locks, and endings that only tools write.
LOCK_NAMES = r"(?i)(?:^|/)(?:package-lock\.json|npm-shrinkwrap\.json|yarn\.lock|pnpm-lock\.ya?ml|cargo\.lock|gemfile\.lock|composer\.lock|poetry\.lock|pipfile\.lock|go\.sum|[^/]*[-_.]lock\.(?:json|ya?ml|toml)|[^/]*[-_.]lock)$"
GENERATED_NAMES = r"(?:\.(?:pb|gen|generated|g|designer)\.\w+|\.generated\.\w+|_pb2(?:_grpc)?\.pyi?|[_.]gen\.\w+|_generated\.\w+|[a-z_]Autogen\.\w+|_autogen\.\w+)$"
MINIFIED_NAMES = r"\.(?:min|bundle|packed|chunk\.[0-9a-f]{6,})\.(?:js|css|mjs)$"

_COMMENT = r"(?m)^[ \t]*(?://+!?|#+!?|/\*+!?|\*+|--+|;+|<!--|%+|\"\"\"|''')[ \t]*"
#: Notices of generators, at the start of a comment line or of a sentence in it.
GENERATED_NOTICE = _COMMENT + (
    r"(?i:@generated\b|<auto-?generated|auto-?generated\b(?! \w+ (?:is|are) )|automatically generated|code generated by|generated (?:by|from|with|using) \S+|machine[- ](?:written|generated)|"
    r"(?:this |the )?(?:file|code|source|module) (?:is|was|has been) (?:auto-?|automatically |machine[- ])?(?:generated|produced|written) by|produced by (?:running )?\S+[^\n]*do not|"
    r"[^\n]*?\b(?:is|was|has been) (?:auto-?|automatically |machine[- ])generated\b|"
    r"(?:[^\n]*[.!:;,)(-] ?)?(?:please )?do not (?:edit|modify|change)(?: (?:it|this file|by hand|manually|directly))*\s*[.!*/-]*\s*$|"
    r"[^\n]*\b(?:changes|edits)\b[^\n]{0,20}\b(?:will be|are|get) (?:lost|overwritten)|"
    r"[^\n]*\bautomatisch\b[^\n]{0,80}\b(?:erzeugt|generiert|erstellt)\b|[^\n]*\bnicht (?:von hand )?(?:bearbeiten|ändern)\b\W*$|"
    r"[^\n]*\b(?:produit|généré|créé)e? automatiquement\b|[^\n]*\bne pas (?:modifier|éditer)\b\W*$|[^\n]*\b(?:generado|creado|producido) automáticamente\b|[^\n]*\bno (?:lo )?(?:modifique|editar|modificar)\b\W*$)"
)
#: Notices of outside packages.
VENDOR_NOTICE = _COMMENT + (
    r"(?i:[^\n]*\b(?:unmodified|verbatim|modified|vendored) copy of \S+|[^\n]*\bupstream\s*:|imported from \S+ at (?:revision|commit|version|tag)|"
    r"[^\n]*\blocal patches\s*:|\S+\s+v?\d+(?:\.\d+)+\S*\s*[|*-]\s*(?:\(c\)|©|copyright|https?:|licen[sc]e|\w+ licen[sc]e)|"
    r"[^\n]*\(c\) (?:the )?\S+ (?:contributors|authors)\s*[|-]|\S+\s*[-|]\s*(?:version|release|v)\s*\d[\w.]*\s*[-|]\s*https?://|part of the \S+ (?:distribution|package|library),? (?:release|version))"
)
LOCK_CONTENT = r"(?m)^\s*\"(?:lockfileVersion|_resolved|content-hash)\"\s*:|^(?:lockfileVersion|__metadata)\s*:"


def _share(part: str, whole: str) -> Column:
    return F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(whole)), F.lit(0.0))


def shape_counts(chunks: DataFrame) -> DataFrame:
    """``repo_id, file_path, n_shapes``: the number of different shapes of a file's lines that aren't blank; one row a shape is shuffled.

    In a shape words are ``a``, numbers ``9`` and runs of white space one space; white space at the ends doesn't count.
    """
    words = F.regexp_replace(F.regexp_replace(F.col("chunk_text"), r"\p{L}+", "a"), r"\d+", "9")
    lines = F.split(F.regexp_replace(words, r"[\s\u00A0&&[^\r\n]]+", " "), r"[\r\n]+")
    shapes = F.array_distinct(F.transform(F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != ""), lambda x: F.xxhash64(x)))
    kept = chunks.where(F.col("repo_id").isNotNull() & F.col("file_path").isNotNull() & F.col("chunk_text").isNotNull())
    # the outer form keeps the optimizer from making all shapes once more for a test of emptiness
    return (
        kept.select("repo_id", "file_path", F.explode_outer(shapes).alias("shape")).where(F.col("shape").isNotNull()).distinct()
        .groupBy("repo_id", "file_path").agg(F.count(F.lit(1)).alias("n_shapes"))
    )


def chunk_statistics(chunks: DataFrame) -> DataFrame:
    """One row per row of ``chunks`` with repo, path and text: the additive layout statistics, and notices.

    Notices count wherever they stand in a file, on comment lines outside of functions and classes.
    """
    text = F.col("chunk_text")

    def left_by(pattern: str) -> Column:
        return F.char_length(F.regexp_replace(text, pattern, ""))

    spaces = "".join(map(chr, (9, 10, 11, 12, 13, 32, 0xA0)))
    between = F.coalesce(F.col("symbol_type"), F.lit("context")) == "context"  # not a comment inside a function or class
    return chunks.where(F.col("repo_id").isNotNull() & F.col("file_path").isNotNull() & text.isNotNull()).select(
        "repo_id", "file_path", "language", "end_line",
        F.char_length(text).cast("long").alias("chars"),
        F.char_length(F.translate(text, spaces, "")).cast("long").alias("visible"),
        left_by(r"[^\p{L}\p{N}]+").cast("long").alias("alnum"),
        (F.char_length(text) - left_by(r"\b(?:0[xX][0-9a-fA-F]+|\d[\d_]*(?:\.\d+)?(?:[eE][+-]?\d+)?)\b")).cast("long").alias("number_chars"),
        (F.char_length(text) - left_by(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{60,}={0,2}|\b[0-9a-f]{16,}\b|(?:\\x[0-9a-fA-F]{2}){8,}")).cast("long").alias("encoded_chars"),
        F.array_max(F.transform(F.split(text, r"\R"), lambda x: F.char_length(x))).alias("max_line"),
        F.regexp_count(text, F.lit(r"[^\s\u00A0][^\r\n]*")).cast("long").alias("lines"),
        (between & text.rlike(GENERATED_NOTICE)).alias("generated_notice"),
        (between & text.rlike(VENDOR_NOTICE)).alias("vendor_notice"),
        (between & text.rlike(LOCK_CONTENT)).alias("lock_content"),
    )


def file_statistics(chunks: DataFrame) -> DataFrame:
    """One row per file: the sums, maxima and unions of its chunks' statistics, and the shares they give.

    Windows of a file overlap and repeated rows count again, in both parts of every share; ``lines`` is no more
    than the last line number. Rows of null repo, path or text are passed over; a file of empty texts has
    shares of 0.
    """
    total = chunk_statistics(chunks).groupBy("repo_id", "file_path").agg(
        F.max("language").alias("language"),
        *[F.sum(c).alias(c) for c in ("chars", "visible", "alnum", "number_chars", "encoded_chars")],
        F.sum("lines").alias("chunk_lines"), F.max("end_line").cast("long").alias("last_line"),
        F.max("max_line").alias("max_line"),
        *[F.bool_or(c).alias(c) for c in ("generated_notice", "vendor_notice", "lock_content")],
    )
    total = total.join(shape_counts(chunks), ["repo_id", "file_path"], "left").withColumn("n_shapes", F.coalesce("n_shapes", F.lit(0)))
    return total.withColumn("lines", F.least("chunk_lines", "last_line")).select(
        "*", _share("chars", "chunk_lines").alias("mean_line"), (1 - _share("visible", "chars")).alias("space_share"), _share("alnum", "chars").alias("alnum_share"),
        _share("number_chars", "visible").alias("number_share"), _share("encoded_chars", "visible").alias("encoded_share"),
    )


def _threshold(name: str) -> Column:
    common = THRESHOLDS["*"][name]
    found = F.lit(common).cast("double")
    for language, own in THRESHOLDS.items():
        if name in own and language != "*":
            found = F.when(F.col("language") == language, F.lit(own[name]).cast("double")).otherwise(found)
    return found


def classified_files(chunks: DataFrame) -> DataFrame:
    """``file_statistics`` with ``origin``: generated, minified, vendored, data, or null for hand-written files.

    Layout statistics and the thresholds of the language decide; ``evidence`` says ``layout`` where they do. Only
    a file of ordinary layout, such as a copy of an outside package, is told by a ``notice`` or by its ``path``. A null language
    has the common thresholds.
    """
    path = F.concat(F.lit("/"), F.col("file_path"))
    spaces = 1 - F.col("visible") / F.col("chars")
    minified = (F.col("max_line") >= _threshold("long_line")) & (F.col("mean_line") >= _threshold("mean_line")) & (spaces <= _threshold("spaces"))
    dense = (F.col("number_share") >= _threshold("numbers")) | (F.col("encoded_share") >= _threshold("encoded")) | (F.col("alnum_share") >= _threshold("alnum"))
    data = (F.col("chars") >= _threshold("bulk")) & dense
    repetitive = (F.col("lines") >= _threshold("lines")) & (F.col("n_shapes") <= _threshold("shapes")) & (F.col("n_shapes") * _threshold("repeat") <= F.col("lines"))
    by_layout = F.coalesce(minified, F.lit(False)) | F.coalesce(data, F.lit(False)) | F.coalesce(repetitive, F.lit(False))
    copied = path.rlike("/(?:" + "|".join(VENDOR_FOLDERS).replace(".", r"\.") + ")/")
    named = path.rlike(LOCK_NAMES) | path.rlike(GENERATED_NAMES)
    notice = F.col("vendor_notice") | F.col("generated_notice") | F.col("lock_content")
    origin = (
        F.when(F.col("vendor_notice") | copied, "vendored").when(minified | path.rlike(MINIFIED_NAMES), "minified")
        .when(F.col("generated_notice") | F.col("lock_content") | named, "generated").when(data, "data").when(repetitive, "generated")
    )
    evidence = F.when(by_layout, "layout").when(notice, "notice").otherwise("path")
    read = spread(chunks.select("repo_id", "file_path", "language", "start_line", "end_line", "symbol_type", "chunk_text"))
    return file_statistics(read).withColumn("origin", origin).withColumn("evidence", F.when(F.col("origin").isNotNull(), evidence))
