"""Sources beyond files: a hosting API behind a fake transport, and clones of local repositories."""

import json
import subprocess
import sys

from pyspark import cloudpickle

from siftlake.sources import api, checkout

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import tests

ISSUES = [{"number": i, "title": f"GPU memory {i}", "body": None if i % 2 else "a\r\nb", "labels": [{"name": "x"}, {"name": "y"}], "comments": i, "created_at": "2024-01-01T00:00:00Z", "closed_at": None} for i in range(130)]
ISSUES[3]["pull_request"] = {"url": "u"}


def transport(url):
    path = url.removeprefix("https://api.github.com")
    if "/gone" in path:
        return 404, {}, "{}"
    if path.startswith("/search"):
        return 200, {}, json.dumps({"total_count": 7 if "is:pr" in path else 3})
    if path.startswith("/repos/o/n/issues"):
        page = int(path.rpartition("page=")[2])
        return 200, {}, json.dumps(ISSUES[(page - 1) * 100 : page * 100])
    if "/contributors" in path or "/commits" in path:
        return 200, {"Link": '<https://x?page=2>; rel="next", <https://x?page=41>; rel="last"'}, "[{}]"
    if path.endswith("/languages"):
        return 200, {}, json.dumps({"Python": 10, "C": 5})
    return 200, {}, json.dumps({"stargazers_count": 12, "forks_count": 1, "size": 99, "topics": ["a", "b"], "created_at": "2020-01-01T00:00:00Z"})


def test_client_waits_and_gives_up():
    slept, answers = [], [OSError(), (403, {"X-RateLimit-Remaining": "0", "X-RateLimit-Reset": "130"}, ""), (200, {}, "ok")]

    def flaky(url):
        a = answers.pop(0)
        if isinstance(a, Exception):
            raise a
        return a

    client = api.Client(flaky, sleep=slept.append, clock=lambda: 100.0)
    assert client.get("/x") == (200, {}, "ok") and slept == [1.0, 35.0]
    answers[:] = [(403, {}, "")] * 3
    assert client.get("/x")[0] == -1 and slept[2:] == [5.0, 10.0, 20.0]


def test_metrics_extras_and_issues(spark):
    repos = spark.createDataFrame([("https://github.com/o/n",), ("https://github.com/o/gone",), ("word",)], "repo string")
    client = api.Client(transport)
    rows = {r.repo: r for r in api.repository_metrics(repos, client).collect()}
    a = rows["https://github.com/o/n"]
    assert (a.stars, a.contributors, a.open_issues, a.closed_prs, a.topics, a.currently_reachable) == (12, 41, 3, 7, "a;b", True)
    assert not rows["https://github.com/o/gone"].currently_reachable and rows["https://github.com/o/gone"].stars is None
    assert len(rows) == 3
    extras = {r.repo: tuple(r)[1:] for r in api.repository_extras(repos, client).collect()}
    assert extras["https://github.com/o/n"] == (41, 99, 10, 15, True) and extras["word"][-1] is False
    issues = api.closed_issues(repos, client).collect()
    assert len(issues) == 129 and {r.repo for r in issues} == {"o/n"}
    first = next(r for r in issues if r.issue_number == 0)
    assert (first.labels, first.matched_keywords, first.pipeline_relevance, first.body_excerpt) == ("x;y", "gpu;memory", True, "a  b")
    assert api.closed_issues(repos, client, max_pages=1).count() == 99


def test_checkout(spark, tmp_path):
    source = tmp_path / "repo"
    source.mkdir()
    (source / "a.py").write_text("x = 1\n")
    (source / "b.txt").write_text("no")
    git = lambda *a: subprocess.run(["git", "-C", str(source), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", ".")
    git("commit", "-qm", "one")
    repos = spark.createDataFrame([(f"file://{source}",), (f"file://{tmp_path}/absent",)], "repo string")
    rows = sorted((r.status, r.path, r.content) for r in checkout.checkout(repos, suffixes=(".py",)).collect())
    assert rows[0][0] == "clone_failed" and rows[1:] == [("ok", "a.py", "x = 1\n")]


def test_reason_hides_the_token():
    assert checkout.reason("hint\nfatal: no access to https://tok@h/x\n", "tok") == "fatal: no access to https://***@h/x"
    assert checkout.reason("") == "git clone failed"
