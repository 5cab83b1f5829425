"""Commit histories as rows (commit_id, ts, author, path)."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession

COMMIT = "commit_id string, ts timestamp, author string, path string"


def git_history(spark: SparkSession, repo: str, most: int = 1000) -> DataFrame:
    """The newest ``most`` commits of a repository on the driver, first parents only; an unknown author is 'unknown'."""
    import datetime

    text = subprocess.run(["git", "-C", repo, "log", f"-n{most}", "--first-parent", "--name-only", "--pretty=format:%x01%H%x02%ct%x02%ae"], capture_output=True, text=True, check=True).stdout
    rows = []
    for block in text.split("\x01")[1:]:
        head, _, names = block.partition("\n")
        commit, at, author = head.split("\x02")
        when = datetime.datetime.fromtimestamp(int(at), datetime.timezone.utc).replace(tzinfo=None)
        rows += [(commit, when, author or "unknown", p) for p in names.splitlines() if p]
    return spark.createDataFrame(rows, COMMIT)
