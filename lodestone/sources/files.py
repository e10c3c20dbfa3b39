"""Source trees as tables: one row per file, read by Spark's binaryFile source."""

from __future__ import annotations

import re
import subprocess
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import fixed as K
from lodestone.functions.text import language_of
from lodestone.runtime import Scratch


def gitignore_patterns(text: str) -> list[tuple[bool, bool, str]]:
    """(is a negation, only directories, Java regex over a relative path) of each rule, in order."""
    out = []
    for line in text.splitlines():
        rule = line.rstrip()
        if not rule or rule.startswith("#"):
            continue
        no = rule.startswith("!")
        rule = rule[1:] if no else rule
        folder = rule.endswith("/")
        rule = rule.rstrip("/")
        anchored = "/" in rule
        body = re.escape(rule.lstrip("/")).replace(r"\*\*/", "(?:.*/)?").replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
        out.append((no, folder, f"^{'' if anchored else '(?:.*/)?'}{body}{'/.*' if folder else '(?:/.*)?'}$"))
    return out


def ignored(path: Column, patterns: list[tuple[bool, bool, str]]) -> Column:
    """True if the last rule that fits is no negation."""
    out = F.lit(False)
    for no, _, p in patterns:
        out = F.when(path.rlike(p), F.lit(not no)).otherwise(out)
    return out


def is_binary(content: Column) -> Column:
    """A NUL among the first bytes."""
    return F.locate("\x00", F.decode(F.substring(content, 1, K.SNIFF_BYTES), "ISO-8859-1")) > 0


def _hidden_files(spark: SparkSession, base: str, skip_dirs: list[str]) -> list[tuple[str, int, str]]:
    """(path below base, length, whole path) of files that have a part that starts with `_` or a name that starts with `.`."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(base)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    top = fs.getFileStatus(root).getPath().toUri().getPath()
    out, todo = [], [root]
    while todo:
        for st in fs.listStatus(todo.pop()):
            name, rel = st.getPath().getName(), st.getPath().toUri().getPath()[len(top) :].lstrip("/")
            if st.isDirectory():
                if not name.startswith(".") and name not in skip_dirs:
                    todo.append(st.getPath())
            elif name.startswith((".", "_")) or any(p.startswith("_") for p in rel.split("/")):
                out.append((rel, st.getLen(), st.getPath().toString()))
    return out


def _read_hidden(spark: SparkSession, found: list[tuple[str, int, str]]) -> DataFrame:
    """(path, length, content) of files that Spark passes over, through copies under names that it reads.

    The file system streams the copies; no content comes to the driver's memory.
    """
    kind = "path string, length long, content binary"
    if not found:
        return spark.createDataFrame([], kind)
    scratch, jvm = Scratch(spark, "hidden"), spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    for i, (_, _, whole) in enumerate(found):
        src, dst = path(whole), path(f"{scratch.path('files')}/{i}")
        jvm.org.apache.hadoop.fs.FileUtil.copy(src.getFileSystem(conf), src, dst.getFileSystem(conf), dst, False, conf)
    names = spark.createDataFrame([(str(i), rel) for i, (rel, _, _) in enumerate(found)], "copy string, path string")
    read = spark.read.format("binaryFile").load(scratch.path("files")).select(F.element_at(F.split("path", "/"), -1).alias("copy"), "length", "content")
    return read.join(names, "copy").select("path", "length", "content")


def read_tree(spark: SparkSession, root: str, *, skip_dirs: list[str] = K.SKIP_DIRS) -> DataFrame:
    """(path, length, content, language) of the text files below root; path is relative.

    Dot-directories, skipped directories, what the root's .gitignore names and binary files
    are left out. Spark lists and reads, but it passes over names that start with `_` or `.`;
    those files (`__init__.py`, `.gitignore`) are copied beside the scratch tables and read there.
    """
    base = root.rstrip("/")
    hidden = _hidden_files(spark, base, skip_dirs)
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    inner = re.escape(base.split("://", 1)[-1])
    f = f.withColumn("path", F.regexp_extract("path", rf"^(?:[\w]+:/*)?.*?{inner.lstrip('/')}/(.*)$", 1))
    f = f.select("path", "length", "content").unionByName(_read_hidden(spark, hidden))
    rules = [r["rules"] for r in f.where("path = '.gitignore'").select(F.decode("content", "UTF-8").alias("rules")).collect()]  # one file
    parts = F.split("path", "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    skipped = F.exists(folders, lambda d: d.startswith(".") | d.isin(skip_dirs))
    f = f.where(~skipped & ~ignored(F.col("path"), gitignore_patterns(rules[0]) if rules else []))
    f = f.where(~is_binary(F.col("content")))
    return f.select("path", "length", F.decode("content", "UTF-8").alias("content"), language_of(F.col("path")).alias("language"))


def tree_bytes(spark: SparkSession, root: str, *, skip_dirs: list[str] = K.SKIP_DIRS) -> int:
    """Bytes below root outside skipped directories; no file is opened."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    seen = f.where(~F.exists(F.split("path", "/"), lambda d: d.isin(skip_dirs))).agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    return seen + sum(n for _, n, _ in _hidden_files(spark, root.rstrip("/"), skip_dirs))


def resolve_repo(spark: SparkSession, root: str, branch: str = "main") -> dict:
    """Path, commit and branch of a local repository; raises if it is no directory or too large."""
    p = Path(root)
    if not p.is_dir():
        raise FileNotFoundError(root)
    size = tree_bytes(spark, str(p))
    if size > K.MAX_REPO_BYTES:
        raise ValueError(f"{root}: {size} bytes, more than {K.MAX_REPO_BYTES}")
    return {"path": str(p.resolve()), "commit_sha": head_commit(str(p)), "branch": branch}


def head_commit(root: str) -> str:
    """The checked-out commit, or unknown."""
    try:
        got = subprocess.run(["git", "rev-parse", "HEAD"], cwd=root, capture_output=True, text=True, timeout=10, check=False)
    except (OSError, subprocess.TimeoutExpired):
        return "unknown"
    return got.stdout.strip() if got.returncode == 0 and got.stdout.strip() else "unknown"


def stand_in_commit(path: Column) -> Column:
    """What stands for a commit where there is none."""
    return F.substring(F.sha2(path, 256), 1, 40)
