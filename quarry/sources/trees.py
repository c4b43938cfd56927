"""Source trees: scanning, filtering, decoding and indexing into chunk tables."""

from __future__ import annotations

from pathlib import Path
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import base_name, suffix

#: Folders that are pruned at any depth, endings that are read and their languages, lock file names.
IGNORED_FOLDERS = (".git", ".hg", ".svn", ".next", ".venv", "__pycache__", "build", "coverage", "dist", "node_modules", "target", "vendor")
LANGUAGES = {
    ".py": "python", ".ts": "typescript", ".tsx": "tsx", ".js": "javascript", ".jsx": "jsx", ".java": "java", ".rb": "ruby", ".go": "go",
    ".cpp": "cpp", ".h": "cpp", ".md": "markdown", ".yml": "yaml", ".yaml": "yaml", ".json": "json",
}
LOCK_FILES = ("Cargo.lock", "Gemfile.lock", "composer.lock", "package-lock.json", "pnpm-lock.yaml", "poetry.lock", "yarn.lock")
MAX_FILE, MAX_LOCK = 200_000, 75_000


def is_local(url: str) -> bool:
    return url.startswith(("file://", "/", "."))


def resolved(url: str) -> str:
    """The folder of a local source; an error if there is none. Remote sources are fetched outside the engine."""
    if not is_local(url):
        raise RuntimeError(f"{url} is remote: fetch it to shared storage first")
    path = Path(url.removeprefix("file://")).expanduser().resolve()
    if not path.is_dir():
        raise FileNotFoundError(f"{path} is no folder")
    return str(path)


def pruned(path: Column) -> Column:
    """Whether a relative path lies under an ignored folder."""
    names = "|".join(f.replace(".", r"\.") for f in IGNORED_FOLDERS)
    return path.rlike(rf"(^|/)(?:{names}|\.cache[^/]*)/")


def supported(path: Column, size: Column, max_file: int = MAX_FILE, max_lock: int = MAX_LOCK) -> Column:
    """Whether a file is read: a known ending, outside ignored folders, not too large, no large lock file."""
    return ~pruned(path) & suffix(path).isin(*LANGUAGES) & (size <= max_file) & ~(base_name(path).isin(*LOCK_FILES) & (size > max_lock))


def language(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, suffix(path)), F.lit("text"))


def printable_share(content: Column) -> Column:
    """Share of text bytes (tab to carriage return, space to tilde) in the first 1024; 1 for empty content."""
    head = F.decode(F.substring(content, 1, 1024), "ISO-8859-1")
    text = F.length(F.regexp_replace(head, r"[^\x09-\x0D\x20-\x7E]", ""))
    return F.when(F.length(head) == 0, 1.0).otherwise(text / F.length(head))


def is_binary(content: Column) -> Column:
    head = F.decode(F.substring(content, 1, 1024), "ISO-8859-1")
    return head.contains("\0") | (printable_share(content) < 0.75)


def decoded(content: Column) -> Column:
    """UTF-8 text without invalid bytes, with line feeds only."""
    text = F.replace(F.make_valid_utf8(content.cast("string")), F.lit("�"), F.lit(""))
    return F.regexp_replace(text, "\r\n?", "\n")


def scan_tree(spark: SparkSession, url: str, max_file: int = MAX_FILE) -> DataFrame:
    """``file_path, language, length, text`` of the supported text files of a local folder, ordered by path.

    File sizes are pushed down to the listing. The reader passes over empty files, so these are added from the listing:
    they hold no chunks but count as files.
    """
    root = resolved(url)
    every = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    relative = F.substring(F.col("path"), F.lit(1) + F.instr("path", root) + len(root), F.lit(1 << 20))
    listed = spark.createDataFrame([(unquote(urlparse(f).path),) for f in every.inputFiles()], "path string").select(relative.alias("file_path"))
    empty = listed.join(every.select(relative.alias("file_path")), "file_path", "left_anti").select("file_path", F.lit(0).cast("long").alias("length"), F.lit(b"").alias("content"))
    rows = every.where(F.col("length") <= max_file).select(relative.alias("file_path"), "length", "content").unionByName(empty)
    kept = rows.where(supported(F.col("file_path"), F.col("length"), max_file) & ~is_binary(F.col("content")))
    return kept.select("file_path", language(F.col("file_path")).alias("language"), "length", decoded(F.col("content")).alias("text")).orderBy("file_path")
