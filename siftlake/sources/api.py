"""Repository metadata from a hosting API.

The transport is a parameter: any picklable callable ``(url) -> (status, headers,
body)`` that raises ``OSError`` for network trouble.  Requests are made where
the repositories' rows are, so collection scales with partitions; failures
become rows with a status, never lost rows.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar, text
from ..operators import statistics
from ..storage import on_workers

Transport = Callable[[str], tuple[int, dict[str, str], str]]

REPOSITORY = "stargazers_count long, forks_count long, subscribers_count long, size long, created_at string, updated_at string, pushed_at string, visibility string, topics array<string>, has_issues boolean, has_wiki boolean, has_discussions boolean"
RAW_ISSUE = "number int, title string, body string, labels array<struct<name: string>>, created_at timestamp, closed_at timestamp, comments int, pull_request struct<url: string>"


@dataclass(frozen=True)
class Client:
    """Requests with retries: waits for the limit's reset (``max_wait`` seconds at most) or backs off; 404 and other answers come back as they are."""

    transport: Transport
    base: str = "https://api.github.com"
    retries: int = 3
    max_wait: float = 3600.0
    sleep: Callable[[float], None] = time.sleep
    clock: Callable[[], float] = time.time

    def get(self, path: str) -> tuple[int, dict[str, str], str]:
        for attempt in range(self.retries):
            try:
                status, headers, body = self.transport(self.base + path)
            except OSError:
                self.sleep(2.0**attempt)
                continue
            if status not in (403, 429):
                return status, headers, body
            low = {k.lower(): v for k, v in headers.items()}
            if low.get("x-ratelimit-remaining") == "0" and low.get("x-ratelimit-reset"):
                self.sleep(min(self.max_wait, max(0.0, int(low["x-ratelimit-reset"]) - self.clock()) + 5))
            else:
                self.sleep(5 * 2.0**attempt)
        return -1, {}, ""


def fetch(repos: DataFrame, client: Client, path: str) -> DataFrame:
    """``repo, status, link, body`` of one endpoint; ``{owner}`` and ``{name}`` in ``path`` are filled in.  URLs that name no repository have status 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for repo, owner, name in batch.itertuples(index=False):
                status, headers, body = client.get(path.format(owner=quote(owner), name=quote(name))) if owner and name else (0, {}, "")
                rows.append((repo, status, next((v for k, v in headers.items() if k.lower() == "link"), None), body))
            yield pd.DataFrame(rows, columns=["repo", "status", "link", "body"])

    parts = scalar.owner_and_name(F.col("repo"))
    return on_workers(repos.select("repo", parts["owner"].alias("owner"), parts["name"].alias("name"))).mapInPandas(run, "repo string, status int, link string, body string")


def fetch_pages(repos: DataFrame, client: Client, path: str, page_size: int = 100, max_pages: int = 10) -> DataFrame:
    """``repo, page, body`` of a paged list; a short or bad page is the last."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for repo, owner, name in batch.itertuples(index=False):
                for page in range(1, max_pages + 1) if owner and name else ():
                    status, _, body = client.get(path.format(owner=quote(owner), name=quote(name)) + f"&per_page={page_size}&page={page}")
                    try:
                        items = json.loads(body) if status == 200 else []
                    except ValueError:
                        items = []
                    if isinstance(items, list) and items:
                        yield pd.DataFrame([(repo, page, body)], columns=["repo", "page", "body"])
                    if not isinstance(items, list) or len(items) < page_size:
                        break

    parts = scalar.owner_and_name(F.col("repo"))
    return on_workers(repos.select("repo", parts["owner"].alias("owner"), parts["name"].alias("name"))).mapInPandas(run, "repo string, page int, body string")


def repository_metrics(repos: DataFrame, client: Client) -> DataFrame:
    """One row for each repository: metadata, contributors and counts of issues and pull requests; blank where an endpoint has nothing."""
    main = fetch(repos, client, "/repos/{owner}/{name}")
    r = F.from_json(F.when(F.col("status") == 200, F.col("body")), REPOSITORY)
    out = main.select("repo", r.alias("r")).select(
        "repo", F.col("r").isNotNull().alias("currently_reachable"), F.col("r.stargazers_count").alias("stars"), F.col("r.forks_count").alias("forks"), F.col("r.subscribers_count").alias("watchers"), F.col("r.size").alias("size_kb"),
        "r.created_at", "r.updated_at", "r.pushed_at", "r.visibility", F.array_join("r.topics", ";").alias("topics"), "r.has_issues", "r.has_wiki", "r.has_discussions",
    )
    people = fetch(repos, client, "/repos/{owner}/{name}/contributors?per_page=1&anon=true")
    out = out.join(people.select("repo", _count_by_link().alias("contributors")), "repo", "left")
    for kind, state, column in (("issue", "open", "open_issues"), ("issue", "closed", "closed_issues"), ("pr", "open", "open_prs"), ("pr", "closed", "closed_prs")):
        found = fetch(repos, client, "/search/issues?q=repo:{owner}/{name}+is:" + f"{kind}+is:{state}&per_page=1")
        out = out.join(found.select("repo", total_count().alias(column)), "repo", "left")
    return out


def _count_by_link() -> F.Column:
    """Items of a list asked for one by one: the last page's number, else what the only page holds."""
    here = F.size(F.from_json("body", "array<struct<id: long>>"))
    return F.when(F.col("status") == 200, F.coalesce(scalar.last_page(F.col("link")), F.greatest(here, F.lit(0)).cast("long")))


def total_count() -> F.Column:
    """The count that a search answer states; null for other answers."""
    return F.when(F.col("status") == 200, F.from_json("body", "total_count long")["total_count"])


def repository_extras(repos: DataFrame, client: Client) -> DataFrame:
    """``repo, commit_count, size_kb, python_bytes, total_code_bytes, fetch_ok``; a repository that cannot be fetched stays, with ``fetch_ok`` false."""
    meta = fetch(repos, client, "/repos/{owner}/{name}").select("repo", F.from_json(F.when(F.col("status") == 200, F.col("body")), "size long")["size"].alias("size_kb"))
    spoken = fetch(repos, client, "/repos/{owner}/{name}/languages").select("repo", F.from_json(F.when(F.col("status") == 200, F.col("body")), "map<string, long>").alias("languages"))
    commits = fetch(repos, client, "/repos/{owner}/{name}/commits?per_page=1").select("repo", _count_by_link().alias("commit_count"))
    out = meta.join(statistics.language_bytes(spoken), "repo", "left").join(commits, "repo", "left")
    return out.select("repo", "commit_count", "size_kb", "python_bytes", "total_code_bytes", F.col("size_kb").isNotNull().alias("fetch_ok"))


def closed_issues(repos: DataFrame, client: Client, max_pages: int = 10) -> DataFrame:
    """Closed issues without pull requests, with keyword triage."""
    pages = fetch_pages(repos, client, "/repos/{owner}/{name}/issues?state=closed", max_pages=max_pages)
    rows = pages.select("repo", F.explode(F.from_json("body", f"array<struct<{_fields(RAW_ISSUE)}>>")).alias("i")).select("repo", "i.*").filter("pull_request is null")
    found = text.keywords(F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("body", F.lit(""))))
    names = F.transform("labels", lambda x: x["name"])
    parts = scalar.owner_and_name(F.col("repo"))
    return rows.withColumn("__k", found).select(
        F.concat_ws("/", parts["owner"], parts["name"]).alias("repo"), F.col("number").alias("issue_number"), F.substring("title", 1, 200).alias("title"), text.join_labels(names).alias("labels"), "created_at", "closed_at", "comments",
        (F.size("__k") > 0).alias("pipeline_relevance"), F.substring(F.array_join("__k", ";"), 1, 200).alias("matched_keywords"), text.excerpt(F.col("body")).alias("body_excerpt"),
    )


def _fields(ddl: str) -> str:
    """A column list as the inside of a struct type."""
    out, depth = [], 0
    for part in ddl.split(","):
        if depth == 0:
            name, _, kind = part.strip().partition(" ")
            out.append(f"{name}: {kind}")
        else:
            out[-1] += "," + part
        depth += part.count("<") - part.count(">")
    return ", ".join(out)
