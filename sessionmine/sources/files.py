"""Source file scan with ignore rules."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import wordlists as wl
from ..functions.paths import base_name, is_source
from ..operators.shared import cut


# What a piece of a glob stands for in a Java regular expression; the first that fits counts.
_GLOB = [(r"\*\*", ".*"), (r"\*", "[^/]*"), (r"[^*]+", None)]
_PIECES = re.compile("|".join(f"({piece})" for piece, _ in _GLOB))
# An ignore line: `!` takes back, `./` says nothing, a final `/` means directories only.
_LINE = re.compile(r"^(?!#)(?P<back>!?+)(?:\./)?(?P<glob>.+?)(?P<dirs>/*)$")


def glob_pattern(glob: str) -> str:
    """Java regex of a simple glob: `**` crosses directories, a leading `/` anchors; what lies
    below a match matches too."""
    body = "".join(re.escape(m[0]) if _GLOB[m.lastindex - 1][1] is None else _GLOB[m.lastindex - 1][1]
                   for m in _PIECES.finditer(glob.lstrip("/")))
    start = "^" if glob[:1] == "/" else "(?:^|.*/)"
    return f"{start}{body}(?:/.*)?$"


def ignore_rules(lines: list[str], exclude: list[str] = ()) -> list[tuple[str, bool, bool]]:
    """(pattern, negated, directories only) of ignore-file lines; later rules win."""
    found = [m for m in map(_LINE.match, map(str.strip, lines)) if m]
    return [(glob_pattern(m["glob"]), m["back"] == "!", m["dirs"] != "") for m in found] + [
        (glob_pattern(g), False, False) for g in exclude]


def ignored(path: Column, is_dir: bool, rules: list[tuple[str, bool, bool]]) -> Column:
    """The last rule that matches decides."""
    out = F.lit(False)
    for pattern, negated, dirs_only in rules:
        if dirs_only and not is_dir:
            continue
        out = F.when(path.rlike(pattern), F.lit(not negated)).otherwise(out)
    return out


def eligible(rules: list[tuple[str, bool, bool]], include: list[str] = ()) -> Column:
    """Filter on `path` (relative): not hidden, not ignored, a known source type."""
    path = F.col("path")
    parts = F.split(path, "/")
    dirs = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
                           lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    has_dir = F.size(parts) > 1
    hidden = F.exists(parts, lambda p: p.startswith(".") & (p != ".github"))
    skipped = F.exists(dirs, lambda d: d.isin(wl.SKIPPED_DIRS))
    dir_ignored = has_dir & F.exists(prefixes, lambda p: ignored(p, True, rules))
    keep = ~hidden & ~skipped & ~dir_ignored & ~ignored(path, False, rules) & is_source(path)
    if include:
        wanted = F.lit(False)
        for g in include:
            wanted = wanted | path.rlike(glob_pattern(g))
        keep = keep & wanted
    return keep


def select_files(files: DataFrame, rules: list[tuple[str, bool, bool]], max_bytes: int | None = None,
                 max_files: int | None = None, include: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(files, too large) of `files(path, length, ...)`; with `max_files`, shallow directories
    come first."""
    ok = files.filter(eligible(rules, include))
    fits = F.lit(True) if max_bytes is None else F.col("length") <= max_bytes
    large, small = ok.filter(~fits).select("path", "length"), ok.filter(fits)
    if max_files is not None:
        small = small.orderBy(*_shallow_first()).limit(max_files)
    return small, large


def _shallow_first() -> list[Column]:
    return [F.size(F.split("path", "/")), F.regexp_extract("path", "^(.*)/", 1), base_name("path")]


def _enters(rules: list[tuple[str, bool, bool]]) -> Column:
    """Filter on the `path` of a directory: not hidden, not skipped, not ignored."""
    name = base_name("path")
    return (~name.startswith(".") | (name == ".github")) & ~name.isin(wl.SKIPPED_DIRS) & ~ignored(F.col("path"), True, rules)


def list_files(spark: SparkSession, root: str, rules: list[tuple[str, bool, bool]] = ()) -> DataFrame:
    """`path, length` of all files below `root`, names with a leading `_` or `.` too.

    The tree is listed level by level, the directories of a level in parallel; directories
    that are hidden, skipped or ignored aren't entered. Links are left out. `root` is a path
    or an address that `pyarrow.fs` opens on the executors.
    """
    cores = spark.sparkContext.defaultParallelism

    def children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(root)
        for batch in batches:
            for below in batch.column(0).to_pylist():
                found = fs.get_file_info(pafs.FileSelector(f"{base}/{below}".rstrip("/")))
                if isinstance(fs, pafs.LocalFileSystem):
                    found = [f for f in found if not os.path.islink(f.path)]
                found = [f for f in found if f.type in (pafs.FileType.File, pafs.FileType.Directory)]
                yield pa.RecordBatch.from_pydict({
                    "path": pa.array([f"{below}/{f.base_name}".lstrip("/") for f in found], pa.string()),
                    "is_dir": pa.array([f.type == pafs.FileType.Directory for f in found], pa.bool_()),
                    "length": pa.array([f.size for f in found], pa.int64())})

    level, levels = spark.createDataFrame([("",)], "path string"), []
    while True:
        # A row is little data but much work, so the rows are spread by number, not by size.
        found = cut(level.repartition(cores * 4, "path").mapInArrow(children, "path string, is_dir boolean, length long"))
        levels.append(found.filter(~F.col("is_dir")).select("path", "length"))
        level = found.filter(F.col("is_dir") & _enters(list(rules))).select("path")
        if level.isEmpty():
            return reduce(DataFrame.unionByName, levels)


def read_files(files: DataFrame, root: str) -> DataFrame:
    """`files(path, length)` with the `content` of each file, one file at a time in a task."""
    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(root)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_stream(f"{base}/{row['path']}") as f:
                    data = f.read()
                yield pa.RecordBatch.from_pydict({"path": pa.array([row["path"]], pa.string()), "length": pa.array([row["length"]], pa.int64()),
                                                  "content": pa.array([data], pa.binary())})

    cores = files.sparkSession.sparkContext.defaultParallelism
    return files.select("path", "length").repartition(cores * 4, "path").mapInArrow(contents, "path string, length long, content binary")


def scan_files(spark: SparkSession, root: str, include: list[str] = (), exclude: list[str] = (),
               max_bytes: int | None = None, max_files: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Files below `root` as `repo, path, length, content`, and those too large as `path, length`.
    The lengths come from the listing, so files that are left out are never read."""
    base = root.rstrip("/").split("/")[-1]
    rules = ignore_rules(_ignore_lines(spark, root), list(exclude))
    picked, large = select_files(list_files(spark, root, rules), rules, max_bytes, max_files, list(include))
    read = read_files(picked, root) if max_files is None else read_files(picked, root).orderBy(*_shallow_first())
    return read.select(F.lit(base).alias("repo"), "path", "length", F.col("content").cast("string").alias("content")), large


def _ignore_lines(spark: SparkSession, root: str) -> list[str]:
    """The root ignore file, one small file.  Spark's readers skip names that start with a
    dot, so the file system is asked for it."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(root.rstrip("/") + "/.gitignore")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    stream = fs.open(path)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").splitlines()
    finally:
        stream.close()
