"""Repository scan: which files are kept, and for each other file the one reason it is skipped.

Files are read as a table ``path, content`` (binary) or ``path, size, head``; all rules are
expressions over the path and the size, so a scan is one projection. Ignore files become a
small table of rules that is broadcast; the last matching rule decides.

Defined results: a null path is skipped as ``unreadable``; a null size counts as the length
of the content.
"""

from __future__ import annotations

import os
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.session import bounded_rows

# Endings, the language a breakdown names and the language that is parsed.
LANGUAGES = {
    "cpp": ("C++", "C++"), "cc": ("C++", "C++"), "cxx": ("C++", "C++"), "hpp": ("C/C++ Header", "C++"), "hh": ("C/C++ Header", "C++"), "h": ("C/C++ Header", "C"), "c": ("C", "C"), "py": ("Python", "Python"), "java": ("Java", "Java"),
    "go": ("Go", "Go"), "rs": ("Rust", "Rust"), "js": ("JavaScript", "JavaScript"), "mjs": ("JavaScript", "JavaScript"), "jsx": ("JavaScript React", "JavaScript"), "ts": ("TypeScript", "TypeScript"),
    "tsx": ("TypeScript React", "TypeScript"), "html": ("HTML", "HTML"), "css": ("CSS", "CSS"), "scss": ("SCSS", "CSS"),
}
# Folders that are never part of a repository's own sources.
EXCLUDED = (".git", ".hg", ".svn", "node_modules", "build", "dist", "out", "target", "__pycache__", ".venv", "venv", ".idea", ".vscode", ".cache", "coverage", ".next", "bin", "obj")
SAFETY = (".git", ".hg", ".svn")
NORMAL_SIZE, HARD_SIZE, BINARY_HEAD = 2 * 1024 * 1024, 20 * 1024 * 1024, 512


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def language(path: Column, parsing: bool = False) -> Column:
    """Language by ending, ``Unknown`` otherwise."""
    pairs = [x for k, v in LANGUAGES.items() for x in (F.lit(k), F.lit(v[int(parsing)]))]
    return F.coalesce(F.create_map(*pairs)[extension(path)], F.lit("Unknown"))


def supported(path: Column) -> Column:
    return extension(path).isin(*LANGUAGES)


def excluded(path: Column, names: tuple[str, ...] = EXCLUDED) -> Column:
    """Whether a folder of the path has one of the names, in any case."""
    return F.arrays_overlap(F.split(F.lower(F.regexp_replace(path, r"[^/]*$", "")), "/"), F.array(*[F.lit(n.lower()) for n in names]))


def binary(content: Column) -> Column:
    """A zero byte among the first 512."""
    return F.position(F.lit(b"\x00"), F.substring(content, 1, BINARY_HEAD)) > 0


def glob_pattern(glob: str) -> str:
    """Regular expression of a glob: ``**`` crosses folders, ``*`` and ``?`` do not."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(glob[i], re.escape(glob[i]))
            i += 1
    return out


def ignore_rules(text: str, root: str = "") -> list[tuple[int, str, bool]]:
    """Rules of an ignore file: number, regular expression over paths, whether it re-includes."""
    rules = []
    for number, line in enumerate(text.splitlines()):
        rule = line.rstrip()
        if not rule or rule.startswith("#"):
            continue
        negated, rule = rule.startswith("!"), rule.removeprefix("!")
        folder_only, rule = rule.endswith("/"), rule.rstrip("/")
        anchored, rule = "/" in rule, rule.lstrip("/")
        prefix = re.escape(root.rstrip("/") + "/") if root else ""
        start = f"^{prefix}" if anchored else f"^{prefix}(?:.*/)?"
        rules.append((number, start + glob_pattern(rule) + ("/.*$" if folder_only else "(?:/.*)?$"), negated))
    return rules


def ignored(files: DataFrame, rules: list[tuple[int, str, bool]]) -> DataFrame:
    """Adds ``ignored``: whether the last rule that matches the path excludes it. Rules come from files on the driver."""
    state = F.lit(False)
    for _, pattern, negated in sorted(rules):
        state = F.when(F.col("path").rlike(pattern), F.lit(not negated)).otherwise(state)
    return files.withColumn("ignored", state)


def nested_rules(files: DataFrame, name: str = ".gitignore", most: int = 100_000) -> list[tuple[int, str, bool]]:
    """Rules of all ignore files of a table ``path, content``, those of a folder below its own, outer ones first; raises beyond ``most`` files."""
    own = files.where(F.regexp_extract("path", r"([^/]*)$", 1) == name).select("path", F.col("content").cast("string").alias("content")).dropDuplicates(["path"])
    found = bounded_rows(own, most)
    if found is None:
        raise ValueError(f"more than {most} ignore files")
    rules: list[tuple[int, str, bool]] = []
    for path, content in sorted(found, key=lambda r: (r[0].count("/"), r[0])):
        rules += [(len(rules) + number, pattern, negated) for number, pattern, negated in ignore_rules(content or "", path.rpartition("/")[0])]
    return [(number, pattern, negated) for number, (_, pattern, negated) in enumerate(rules)]


def scan(
    files: DataFrame, rules: list[tuple[int, str, bool]] | None = None, custom: tuple[str, ...] = (), include_large: bool = False, skip_binary: bool = True, vcs_rules: list[tuple[int, str, bool]] | None = None, tracked: DataFrame | None = None
) -> DataFrame:
    """Adds ``language`` and ``skip_reason`` (null for a kept file) to ``path, size`` and, where there is one, ``content``.

    ``vcs_rules`` are the rules of a version control system; they never skip a path of ``tracked``.
    """
    out = ignored(files, rules or [])
    vcs = F.lit(False)
    if vcs_rules:
        out = out.withColumn("_own", F.col("ignored"))
        out = ignored(out.drop("ignored"), vcs_rules).withColumnRenamed("ignored", "_vcs").withColumnRenamed("_own", "ignored")
        if tracked is not None:
            out = out.join(tracked.select("path").distinct().withColumn("_tracked", F.lit(True)), "path", "left").withColumn("_vcs", F.col("_vcs") & F.col("_tracked").isNull()).drop("_tracked")
        vcs = F.col("_vcs")
    size = F.coalesce("size", F.octet_length("content").cast("bigint")) if "content" in files.columns else F.col("size")
    reason = (
        F.when(F.col("path").isNull(), "unreadable")
        .when(excluded(F.col("path"), SAFETY), "internal_safety")
        .when(excluded(F.col("path"), custom) if custom else F.lit(False), "custom_exclusion")
        .when(F.col("ignored"), "ignore_rule")
        .when(vcs, "vcs_ignored")
        .when(excluded(F.col("path")), "default_exclusion")
        .when(~supported(F.col("path")), "unsupported_extension")
        .when(size > HARD_SIZE, "exceeds_hard_limit")
        .when(F.lit(not include_large) & (size > NORMAL_SIZE), "deferred_large_file")
    )
    if skip_binary and "content" in files.columns and dict(files.dtypes)["content"] == "binary":
        reason = reason.when(binary(F.col("content")), "binary")
    return out.withColumn("language", language(F.col("path"))).withColumn("skip_reason", reason).drop("ignored", "_vcs")


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """``path, size, content`` of all files below a folder that every worker sees, paths relative to it.

    Built-in file sources leave out names that begin with ``_`` or ``.``, as ``__init__.py``
    does, so workers walk the folders themselves, one entry of the first level a row.
    Unreadable files have null contents; a missing folder raises.
    """
    if not os.path.isdir(root):
        raise ValueError(f"no folder: {root}")

    def walk(batches):
        for pdf in batches:
            for entry in pdf["entry"]:
                start = os.path.join(root, entry)
                names = [start] if os.path.isfile(start) else [os.path.join(f, n) for f, _, found in os.walk(start) for n in found]
                for name in names:
                    try:
                        with open(name, "rb") as file:
                            content = file.read()
                    except OSError:
                        content = None
                    yield pd.DataFrame({"path": [os.path.relpath(name, root)], "size": [len(content) if content is not None else 0], "content": [content]})

    entries = sorted(os.listdir(root))
    rows = spark.createDataFrame([(e,) for e in entries], "entry string").repartition(max(1, min(len(entries), 64)))
    return rows.mapInPandas(walk, "path string, size bigint, content binary")


def breakdown(scanned: DataFrame) -> DataFrame:
    return scanned.where("skip_reason IS NULL").groupBy("language").agg(F.count("*").alias("n_files"))


def counters(scanned: DataFrame) -> DataFrame:
    """One row: files seen, kept, skipped, deferred, beyond the hard limit."""
    n = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0))
    r = F.col("skip_reason")
    return scanned.agg(F.count("*").alias("n_seen"), n(r.isNull()).alias("n_kept"), n(r.isNotNull()).alias("n_skipped"), n(r == "deferred_large_file").alias("n_deferred"), n(r == "exceeds_hard_limit").alias("n_hard"))
