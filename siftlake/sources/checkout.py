"""Shallow clones as a table of files, one repository after the other inside each partition."""

from __future__ import annotations

import os
import subprocess
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..storage import on_workers

FILES = "repo string, status string, detail string, path string, content string"
_SIGNS = ("fatal:", "error:", "not found", "could not", "denied", "rate limit")


def reason(output: str, token: str | None = None, most: int = 300) -> str:
    """The line of a failed clone's output that tells most, without the token."""
    lines = [x.strip() for x in output.splitlines() if x.strip()]
    told = next((x for x in lines if any(s in x.lower() for s in _SIGNS)), "git clone failed")
    return (told.replace(token, "***") if token else told)[:most]


def clone(url: str, folder: str, token: str | None = None, timeout: float = 300) -> str:
    """Clone into ``folder``; empty on success, else why it failed."""
    address = url.replace("https://", f"https://{token}@", 1) if token else url
    try:
        done = subprocess.run(["git", "clone", "--depth", "1", "--quiet", address, folder], capture_output=True, text=True, timeout=timeout, env=os.environ | {"GIT_TERMINAL_PROMPT": "0"})
    except subprocess.TimeoutExpired:
        return f"timed out after {timeout:g} s"
    return "" if done.returncode == 0 else reason(done.stderr or done.stdout, token)


def checkout(repos: DataFrame, *, suffixes: tuple[str, ...] = (), token: str | None = None, timeout: float = 300, max_bytes: int = 1 << 20) -> DataFrame:
    """Files of each repository, or one row with status ``clone_failed`` and the reason.

    Only files with one of the ``suffixes`` are read (all without any), up to
    ``max_bytes`` each; a larger one has a null content.  Clones lie in the task's own temporary
    folder and are gone before the next one starts; only rows leave the task.
    """

    def files(repo: str, folder: str) -> Iterator[tuple]:
        for at, folders, names in os.walk(folder):
            folders[:] = sorted(d for d in folders if d != ".git")
            for name in sorted(names):
                path = os.path.join(at, name)
                if os.path.islink(path) or (suffixes and not name.endswith(suffixes)):
                    continue
                content = None
                if os.path.getsize(path) <= max_bytes:
                    with open(path, encoding="utf-8", errors="replace") as f:
                        content = f.read()
                yield repo, "ok", "", os.path.relpath(path, folder).replace(os.sep, "/"), content

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for repo in batch["repo"]:
                with tempfile.TemporaryDirectory() as folder:
                    failed = clone(repo, os.path.join(folder, "r"), token, timeout)
                    rows = [(repo, "clone_failed", failed, None, None)] if failed else list(files(repo, os.path.join(folder, "r")))
                yield pd.DataFrame(rows, columns=["repo", "status", "detail", "path", "content"])

    return on_workers(repos.select("repo").distinct()).mapInPandas(run, FILES)
