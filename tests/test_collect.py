"""Issue links and hints against plain Python."""

import random
import re

from patchloom.operators import collect

LINK_WORDS = {"close", "closes", "closed", "fix", "fixes", "fixed", "resolve", "resolves", "resolved"}


def plain_links(title, body, messages):
    text = re.sub(r"(?s)<!--.*?-->", "", "\n".join([title or "", body or "", "\n".join(messages)]))
    return sorted({n for w, n in re.findall(r"(\w+)\s+\#(\d+)", text) if w.lower() in LINK_WORDS})


def test_links_over_message_borders(spark):
    rng = random.Random(6)
    bits = ["fixes", "Fix ", " #1", "#2", "<!-- ", " -->", "work", "", "  ", "closes #3", "éfix #4", "x.", "resolve\t"]
    pulls, commits, want = [], [], {}
    for n in range(700):
        text = lambda: "".join(rng.choices(bits, k=rng.randint(0, 3)))
        title, body = rng.choice([None, text()]), rng.choice([None, text()])
        messages = [text() for _ in range(rng.randint(0, 5))]
        pulls.append(("r", n, title, body))
        commits += [("r", n, i, m) for i, m in enumerate(messages)]
        want[n] = plain_links(title, body, messages)
    out = collect.resolved_issues(
        spark.createDataFrame(pulls, "repo string, number long, title string, body string"),
        spark.createDataFrame(commits, "repo string, number long, seq int, message string"),
    )
    assert {r["number"]: r["resolved_issues"] for r in out.collect()} == want


def test_hints_stop_at_the_first_late_comment(spark):
    pulls = spark.createDataFrame([("r", 1, ["7", "8", "9"])], "repo string, number long, resolved_issues array<string>")
    issues = spark.createDataFrame([("r", 7), ("r", 8)], "repo string, number long")
    commits = spark.createDataFrame([("r", 1, 0, "2020-01-02T00:00:00Z"), ("r", 1, 1, "2019-01-01T00:00:00Z")],
                                    "repo string, number long, seq int, author_date string")
    comments = spark.createDataFrame([
        ("r", 7, 0, "a", "2020-01-01T00:00:00Z"), ("r", 7, 1, "late", "2020-01-02T00:00:00Z"), ("r", 7, 2, "early again", "2019-01-01T00:00:00Z"),
        ("r", 8, 0, "b", "2019-01-01T00:00:00Z"), ("r", 9, 0, "no issue", "2019-01-01T00:00:00Z")],
        "repo string, issue long, seq int, body string, updated_at string")
    kept = collect.hint_comments(pulls, issues, comments, commits)
    assert sorted(r["body"] for r in kept.collect()) == ["a", "b"]
    assert collect.hints_text(pulls, issues, comments, commits).first()["hints_text"] == "a\nb"


def test_limit_keeps_the_row_that_trips_it(spark):
    rows = [("r", i, f"2020-01-{i:02d}T00:00:00Z") for i in range(1, 11)]
    pulls = spark.createDataFrame(rows, "repo string, number long, created_at string")
    assert sorted(r["number"] for r in collect.limit_pulls(pulls, max_pulls=3).collect()) == [7, 8, 9, 10]
    assert sorted(r["number"] for r in collect.limit_pulls(pulls, cutoff="20200108").collect()) == [7, 8, 9, 10]
    assert sorted(r["number"] for r in collect.limit_pulls(pulls, max_pulls=1, cutoff="20200108").collect()) == [9, 10]
