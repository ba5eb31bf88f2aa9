"""Diff quirks and response rules against plain Python."""

import random
import re

from pyspark.sql import functions as F

from patchloom.operators import diffs, ingest, prompts

PATCH = """diff --git a/x.py b/x.py
index 1..2 100644
--- a/x.py
+++ b/x.py
@@ -3,6 +3,6 @@ def f():
 one
 two
--- dashes
+++ plus
 three

 four
@@ -40,3 +40,4 @@
 a
+b
 c
 d
diff --git a/new.py b/new.py
new file mode 100644
--- /dev/null
+++ b/new.py
@@ -0,0 +1 @@
+n
"""


def frame(spark, *patches):
    return spark.createDataFrame(list(enumerate(patches)), "id int, patch string")


def test_lines_that_look_like_headers(spark):
    lines = diffs.diff_lines(frame(spark, PATCH))
    files = {r["path"]: r.asDict() for r in diffs.diff_files(lines).collect()}
    assert set(files) == {"x.py", "new.py"}
    assert (files["x.py"]["n_hunks"], files["x.py"]["n_added"], files["x.py"]["n_removed"]) == (2, 2, 1)
    assert files["new.py"]["kind"] == "added"


def test_minimal_patch(spark):
    out = {r["id"]: r["patch"] for r in diffs.rebuild_patch(frame(spark, PATCH, None, "", "no diff")).collect()}
    assert out[1] is None and out[2] == "" and out[3] == ""
    # the new file is dropped, hunks shrink to one line past the last change
    assert out[0] == (
        "--- a/x.py\n+++ b/x.py\n@@ -5,2 +5,2 @@\n--- dashes\n+++ plus\n three\n@@ -41,1 +41,2 @@\n+b\n c\n"
    )


def test_repair_keeps_content(spark):
    out = diffs.rebuild_patch(frame(spark, PATCH), trim=False).first()["patch"]
    assert "@@ -3,6 +3,6 @@ def f():\n one\n" in out and "new.py" not in out


def test_path_rules(spark):
    df = spark.createDataFrame([("lib/latest.py",), ("a_test/x.py",), ("tests/x.py",)], "path string")
    rows = df.select("path", diffs.is_test_path(F.col("path")).alias("w")).collect()
    assert [r["w"] for r in rows] == [False, True, True]
    split = diffs.split_patch(df.select(F.lit(1).alias("id"), F.monotonically_increasing_id().alias("file_no"), "path", F.col("path").alias("text"))).first()
    assert (split["patch"], split["test_patch"].count(".py")) == ("", 3)  # the substring rule counts latest.py


def plain_extract(response):
    if response is None:
        return None
    found = re.findall(r"<([\w-]+)>(.*?)</\1>", response, re.DOTALL) + re.findall(r"```(\w+)?\n(.*?)```", response, re.DOTALL)
    for name, body in found:
        if name in ("diff", "patch"):
            return body
    return found[0][1] if found else response.split("</s>")[0]


def test_extract_diff(spark):
    rng = random.Random(3)
    bits = ["<patch>", "</patch>", "<diff>", "</diff>", "<x-y>", "</x-y>", "```diff\n", "```\n", "```", "</s>", "text", "\n", "é"]
    texts = [None, ""] + ["".join(rng.choices(bits, k=rng.randint(1, 12))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: r["d"] for r in df.select("i", ingest.extract_diff(F.col("t")).alias("d")).collect()}
    assert [got[i] for i in range(len(texts))] == [plain_extract(t) for t in texts]


def plain_truncate(text, window, least):
    for end in range(window, len(text) + 1):
        if len(text) > window and len(set(text[end - window:end])) < least:
            return text[: end - window]
    return text


def test_truncate_on_repeat(spark):
    rng = random.Random(4)
    texts = []
    for _ in range(600):
        parts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(0, 25))), rng.choice("xé-") * rng.randint(0, 25)]
        texts.append("".join(rng.choices(parts, k=3)))
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for window, least in ((10, 4), (11, 3), (20, 10), (1, 2)):
        got = {r["i"]: r["x"] for r in df.select("i", ingest.truncate_on_repeat(F.col("t"), window, least).alias("x")).collect()}
        assert [got[i] for i in range(len(texts))] == [plain_truncate(t, window, least) for t in texts]


def test_budget_skips_and_goes_on(spark):
    ranked = spark.createDataFrame([("i", 1, "a", 5), ("i", 2, "b", 50), ("i", 3, "c", 4)], "instance_id string, rank int, docid string, n int")
    base = spark.createDataFrame([("i", 10), ("j", 3)], "instance_id string, base int")
    rows = {r["instance_id"]: (r["used"], r["files"]) for r in prompts.pack_budget(ranked, base, 20).collect()}
    assert rows == {"i": (19, ["a", "c"]), "j": (3, [])}
    assert prompts.pack_budget(ranked, base, 19).filter("instance_id = 'i'").first()["files"] == ["a"]  # strict


def test_train_labels(spark):
    ids, labels = prompts.train_labels(F.array(F.lit(1), F.lit(2), F.lit(3)), F.array(F.lit(7), F.lit(8)))
    row = spark.range(1).select(ids.alias("i"), labels.alias("l")).first()
    assert (row["i"], row["l"]) == ([1, 2, 3, 7], [-100, -100, 7, 8])


def test_cost_cap_keeps_the_crossing_row(spark):
    df = spark.createDataFrame([("m", i, 1.0) for i in range(6)], "model string, seq int, cost double")
    assert sorted(r["seq"] for r in ingest.cost_cap(df, ["seq"], 3.0).collect()) == [0, 1, 2]


def test_directives_of_single_exercises(spark):
    df = spark.createDataFrame([("i", "x/ex", ""), ("j", "django/django", "diff --git a/tests/a/b.py b/tests/a/b.py\n")],
                               "instance_id string, repo string, test_patch string")
    got = {r["instance_id"]: r["directive"] for r in diffs.test_directives(df, script_repos=("x/ex",)).collect()}
    assert got == {"i": "test.py", "j": "a.b"}


def test_tasks_grow_with_the_text_of_the_patches(spark, monkeypatch):
    """Partitions joined by their small shuffled size would sort far more lines than memory holds."""
    frame = spark.createDataFrame([(i, PATCH) for i in range(40)], "id int, patch string")
    few = sorted(map(repr, diffs.diff_lines(frame).collect()))
    monkeypatch.setattr(diffs, "TASK_BYTES", 4 * len(PATCH.encode()))
    lines = diffs.diff_lines(frame)
    assert lines.rdd.getNumPartitions() == 10
    assert sorted(map(repr, lines.collect())) == few
    assert diffs.diff_lines(frame.filter("false")).count() == 0
