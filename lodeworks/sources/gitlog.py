"""Change history of a working copy: one git process on the driver, its text as a table of blocks of commits.

Git writes a log in one go. The driver passes it on in blocks of ``BLOCK`` characters as they come and holds
``HELD`` of them at most; blocks are parsed by as many tasks.
"""

from __future__ import annotations

import subprocess
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.operators.history import MARK, parse_log
from lodeworks.shipping import work_folder

#: Characters of log in a block, and blocks that the driver holds.
BLOCK, HELD = 1 << 20, 64
EMPTY = "pos int, author string, ts timestamp, path string"


def _git(root: str, *args: str) -> str:
    done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, errors="replace", timeout=600)
    if done.returncode:
        raise RuntimeError(done.stderr.strip() or "git failed")
    return done.stdout


def _blocks(root: str, *args: str, size: int) -> Iterator[tuple[int, str]]:
    """(commits before, text) of blocks of whole commits of a log."""
    with subprocess.Popen(["git", "-C", root, *args], stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, text=True, errors="replace") as git:
        before, here, held, lines = 0, 0, 0, []
        for line in git.stdout:
            if line.startswith(MARK):
                if held >= size:
                    yield before, "".join(lines)
                    before, here, held, lines = before + here, 0, 0, []
                here += 1
            lines.append(line)
            held += len(line)
        if lines:
            yield before, "".join(lines)
    if git.returncode:
        raise RuntimeError("git gave no log.")


def _stored(spark: SparkSession, blocks: Iterator[tuple[int, str]]) -> DataFrame:
    """The blocks as a table in the shared folder, or as local rows if they are few."""
    folder, held, wrote = f"{work_folder(spark)}/lodeworks/log-{uuid.uuid4().hex}", [], False
    schema = "before int, log string"
    for block in blocks:
        held.append(block)
        if len(held) == HELD:
            spark.createDataFrame(held, schema).write.mode("append").parquet(folder)
            held, wrote = [], True
    rest = spark.createDataFrame(held, schema)
    return spark.read.schema(schema).parquet(folder).unionByName(rest) if wrote else rest


def git_log(spark: SparkSession, root: str, months: int | None = 24) -> tuple[str, str | None, DataFrame]:
    """(status, note, commits): Available, NotARepository, ShallowClone or GitUnavailable, why, and (pos, author, ts,
    path) rows with paths relative to root. months=None reads the whole history."""
    none = spark.createDataFrame([], EMPTY)
    try:
        if _git(root, "rev-parse", "--is-inside-work-tree").strip() != "true":
            return "NotARepository", "The directory is in no git working copy.", none
    except FileNotFoundError:
        return "GitUnavailable", "There is no git program.", none
    except (RuntimeError, subprocess.TimeoutExpired, OSError):
        return "NotARepository", "The directory is in no git working copy.", none
    try:
        if _git(root, "rev-parse", "--is-shallow-repository").strip() == "true":
            return "ShallowClone", "The clone is shallow, so its history is cut short.", none
        since = [f"--since={months} months ago"] if months is not None else []
        log = _stored(spark, _blocks(root, "log", *since, f"--pretty=format:{MARK}%an{MARK}%aI", "--name-only", "--no-merges", "--relative", size=BLOCK))
    except (RuntimeError, subprocess.TimeoutExpired, OSError) as e:
        return "GitUnavailable", str(e) or "git gave no log.", none
    return "Available", None, parse_log(log, keep=["before"]).select((F.col("before") + F.col("pos")).alias("pos"), "author", "ts", "path")
