"""Finding files: globs, recursive folders, extensions, ignored folders and ignore files; fingerprints."""

from __future__ import annotations

import os
import re
import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan.sources import parsers

IGNORED = tuple(sorted("venv env .venv node_modules build dist .tox .eggs __pycache__ .pytest_cache .mypy_cache .svn .hg .git".split()))
SCHEMA_VERSION = "3"


def _glob_regex(rule: str) -> str:
    """A glob of an ignore file as an expression: ``*`` and ``?`` within a name, ``**`` over folders, classes as they are."""
    out, at = "", 0
    for m in re.finditer(r"\*\*/?|\*|\?|\[!?\]?[^\]]*\]|\\\\.", rule):
        out += re.escape(rule[at : m.start()])
        x, at = m[0], m.end()
        if x.startswith("["):
            body = x[1:-1].replace("\\", "\\\\").replace("[", "\\[")
            out += f"[^/{body[1:]}]" if body.startswith("!") else f"[{body}]"
        elif x.startswith("\\"):
            out += re.escape(x[1:])
        else:
            out += {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}[x]
    return out + re.escape(rule[at:])


def ignore_rules(rules: list[str]) -> list[tuple[bool, str]]:
    """(taken back?, expression) of each rule of an ignore file, for paths below its folder."""
    out = []
    for rule in rules:
        rule = rule.rstrip("\r\n")
        rule = rule if rule.endswith("\\ ") else rule.rstrip()
        if not rule or rule.startswith("#"):
            continue
        back, rule = rule.startswith("!"), rule.removeprefix("!")
        anchored, rule = "/" in rule.rstrip("/"), rule.removeprefix("/")
        end, rule = "/" if rule.endswith("/") else "(/|$)", rule.rstrip("/")
        out.append((back, f"{'^' if anchored else '(^|/)'}{_glob_regex(rule)}{end}"))
    return out


def is_ignored(path: Column, rules: list[str]) -> Column:
    """Whether the last rule that fits ``path`` ignores it."""
    out = F.lit(False)
    for back, pattern in ignore_rules(rules):
        out = F.when(path.rlike(pattern), not back).otherwise(out)
    return out


def nearest_ignore_file(folder: str) -> tuple[str, list[str]] | None:
    """The nearest ``.gitignore`` at or above a local folder, up to the root of its repository."""
    at = os.path.abspath(folder)
    while True:
        path = os.path.join(at, ".gitignore")
        if os.path.isfile(path):
            with open(path, encoding="utf-8") as f:
                return at, f.read().split("\n")
        if os.path.isdir(os.path.join(at, ".git")) or os.path.dirname(at) == at:
            return None
        at = os.path.dirname(at)


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` as the file system writes it, the way listed paths begin."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path if "://" in path or path.startswith("file:") else os.path.abspath(path))
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    return found is not None and len(found) > 0


def listing(spark: SparkSession, paths: list[str], extensions: list[str] | None = None, respect_ignore: bool = True, max_files: int = 10_000, ignored: tuple[str, ...] = IGNORED) -> DataFrame:
    """(path, modificationTime, length, content) of the files under ``paths``, each once; content is read only if used.
    A path without a file only warns; more than ``max_files`` files (0: any number) are an error."""
    out = None
    for p in paths:
        if not exists(spark, p):
            warnings.warn(f"no such path: {p}", stacklevel=2)
            continue
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(p)
        if respect_ignore and "://" not in p and os.path.isdir(p) and (near := nearest_ignore_file(p)):
            below = F.regexp_replace("path", f"^file:/*{re.escape(near[0])}/", "")
            found = found.where(~is_ignored(below, near[1]))
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "path string, modificationTime timestamp, length long, content binary")
    if ignored:
        folders = "|".join(re.escape(x) for x in ignored)
        out = out.where(~F.col("path").rlike(f"/({folders}|[^/]*\\.egg-info)/"))
    out = out.where(extension_of(F.col("path")).isin([e.lower() for e in (extensions or list(parsers.SOURCE_TYPES))]))
    if len(paths) > 1:
        out = out.dropDuplicates(["path"])
    if max_files and out.select("path").limit(max_files + 1).count() > max_files:
        raise ValueError(f"more than {max_files} files")
    return out


def extension_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def fingerprint(mode: str = "stat") -> Column:
    """Of a listed file: its time and size, or its size and the md5 of all its content."""
    if mode == "stat":
        return F.concat_ws(":", F.lit(f"v{SCHEMA_VERSION}:stat"), F.unix_micros("modificationTime").cast("string"), F.col("length").cast("string"))
    return F.concat_ws(":", F.lit(f"v{SCHEMA_VERSION}:content"), F.col("length").cast("string"), F.md5("content"))
