"""Unified diffs as tables: files, hunks, lines; and patches rebuilt from them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from patchloom.functions import text as tx

TASK_BYTES = 32 << 20  # text of patches whose lines one task sorts

HUNK_HEADER = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"

# The patterns by which model patches are cut into files and hunks.
PATCH_PATTERN = (
    r"(?:diff[\w\_\.\ \/\-]+\n)?\-\-\-\s+a\/(?:.*?)\n\+\+\+\s+b\/(?:.*?)(?=diff\ |\-\-\-\ a\/|\z)"
)
PATCH_FILE_PATTERN = r"\-\-\-\s+a\/(?:.+)\n\+\+\+\s+b\/(?:.+)"
PATCH_HUNK_PATTERN = (
    r"\@\@\s+\-(\d+),(\d+)\s+\+(\d+),(\d+)\s+\@\@(.+?)(?=diff\ |\-\-\-\ a\/|\@\@\ \-|\z)"
)
DIFF_HEADER_PATTERN = r"^diff(?:.*)"
GOLD_FILE_PATTERN = r"\-\-\- a/(.+)"
DIRECTIVE_PATTERN = r"diff --git a/.* b/(.*)"

# Suffixes that mark a changed file as no test module.
NON_TEST_SUFFIXES = (
    ".json", ".png", "csv", ".txt", ".md", ".jpg", ".jpeg", ".pkl", ".yml", ".yaml", ".toml",
)
TEST_WORDS = ("test", "tests", "testing")
TEST_PATH_PARTS = ("test", "tests", "e2e", "testing")

# The test script of single exercises, the repository whose tests are
# modules, and the runner versions that select a test configuration.
SCRIPT_TEST = "test.py"
DOTTED_REPO = "django/django"
JS_CONFIG_VERSIONS = ("10.10.0", "10.12.0", "10.13.0", "10.14.0", "10.15.2", "10.16.3")
JSON_CONFIG_VERSIONS = (
    "6.11.5", "8.9.1", "8.9.3", "8.9.4", "8.11.0", "8.11.2", "10.4.1", "10.5.0", "10.6.0", "10.9.0",
)
SNAPSHOT_PATH = r"__snapshots__/(.*).js.snap$"


def _tasks(diffs: DataFrame, patch: str) -> int:
    """Tasks among which patches are dealt: their number grows with the text, so that the lines of each are sorted in memory.

    Patches shrink much when shuffled; partitions joined by their shuffled size would hold too many lines.
    """
    size = diffs.agg(F.sum(F.octet_length(patch)).alias("n")).first()["n"] or 0
    return max(2, diffs.sparkSession.sparkContext.defaultParallelism, math.ceil(size / TASK_BYTES))


def diff_lines(diffs: DataFrame, key: str = "id", patch: str = "patch") -> DataFrame:
    """(key, line_no, line, file_no, hunk_no, kind) of every line.

    A hunk owns as many lines as its header announces, so a removed line that reads
    ``--- x`` is not mistaken for a file header. ``kind`` is context, added, removed,
    hunk or meta. All windows share one sort; a group is one patch value.
    """
    line = F.col("line")
    w = Window.partitionBy(key).orderBy("line_no")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    p = tx.rx(HUNK_HEADER)

    def length(i: int) -> Column:
        digits = F.regexp_extract(line, p, i)
        return F.when(digits == "", F.lit(1)).otherwise(digits.try_cast("int"))

    is_hunk = F.col("is_hunk")
    first = F.substring(line, 1, 1)

    def seen(*heads: str) -> Column:
        return F.coalesce(F.sum(first.isin(*heads).cast("int")).over(before), F.lit(0))

    # patches travel to their partition whole; their lines are made there and stay
    rows = (
        diffs.select(key, patch).repartition(_tasks(diffs, patch), key)
        .select(key, F.posexplode(tx.lines(F.regexp_replace(patch, r"\n\z", ""))).alias("line_no", "line"))
        .filter((F.col("line_no") > 0) | (line != ""))
        .withColumn("is_hunk", line.startswith("@@ -") & line.rlike(p))
        .select(
            "*", F.sum(is_hunk.cast("int")).over(upto).alias("hunk_seq"),
            seen("", " ", "-").alias("_pre"), seen("", " ", "+").alias("_post"),
        )
        .select(
            "*",
            F.last(F.when(is_hunk, F.col("_pre") + length(2)), ignorenulls=True).over(upto).alias("_pre_end"),
            F.last(F.when(is_hunk, F.col("_post") + length(4)), ignorenulls=True).over(upto).alias("_post_end"),
        )
        .withColumn("in_hunk", ~is_hunk & F.coalesce(
            (F.col("_pre") < F.col("_pre_end")) | (F.col("_post") < F.col("_post_end")), F.lit(False)))
    )
    git = ~F.col("in_hunk") & line.startswith("diff --git ")
    minus = ~F.col("in_hunk") & line.startswith("--- ")
    # 1: a diff line opens a file; 2: so does a --- line that follows no open diff line
    marked = rows.withColumn("_mark", F.when(git, 1).when(minus, 2)).withColumn(
        "_last", F.last("_mark", ignorenulls=True).over(before)
    )
    starts = F.coalesce((F.col("_mark") == 1) | ((F.col("_mark") == 2) & (F.coalesce("_last", F.lit(0)) != 1)), F.lit(False))
    kind = (
        F.when(is_hunk, "hunk").when(~F.col("in_hunk"), "meta").when(first == "+", "added")
        .when(first == "-", "removed").when(first == "\\", "meta").otherwise("context")
    )
    return marked.select(
        key, "line_no", "line",
        F.sum(starts.cast("int")).over(upto).alias("file_no"),
        F.when(is_hunk | F.col("in_hunk"), F.col("hunk_seq")).alias("hunk_no"),
        kind.alias("kind"),
    )


def _header(prefix: str) -> Column:
    hit = (F.col("kind") == "meta") & F.col("line").startswith(prefix)
    name = F.regexp_extract("line", tx.rx(rf"^{prefix.replace('+', chr(92) + '+')}([^\t]*)"), 1)
    return F.min(F.when(hit, name))


def diff_files(lines: DataFrame, key: str = "id", with_text: bool = False) -> DataFrame:
    """(key, file_no, source, target, path, kind, n_hunks, n_added, n_removed[, text])."""
    git = F.col("line").startswith("diff --git ") & (F.col("kind") == "meta")
    git_p = tx.rx(r"^diff --git (a/[^\t]+) (b/[^\t]+)$")
    aggs = [
        _header("--- ").alias("_src"), _header("+++ ").alias("_dst"),
        F.min(F.when(git, F.regexp_extract("line", git_p, 1))).alias("_gsrc"),
        F.min(F.when(git, F.regexp_extract("line", git_p, 2))).alias("_gdst"),
        F.max((F.col("kind") == "meta") & F.col("line").startswith("new file mode")).alias("_new"),
        F.max((F.col("kind") == "meta") & F.col("line").startswith("deleted file mode")).alias("_del"),
        F.count_if(F.col("kind") == "hunk").alias("n_hunks"),
        F.count_if(F.col("kind") == "added").alias("n_added"),
        F.count_if(F.col("kind") == "removed").alias("n_removed"),
    ]
    if with_text:
        aggs.append(F.concat(tx.ordered_concat("line_no", F.col("line"), "\n"), F.lit("\n")).alias("text"))
    src, dst = F.coalesce("_src", "_gsrc"), F.coalesce("_dst", "_gdst")
    null = "/dev/null"
    added, removed = F.col("_new") | (src == null), F.col("_del") | (dst == null)
    renamed = (src != null) & (dst != null) & (tx.after_first(src, "a/") != tx.after_first(dst, "b/"))
    shown = F.when((src == null) | renamed, dst).otherwise(src)
    return (
        lines.filter("file_no > 0").groupBy(key, "file_no").agg(*aggs)
        .select(
            key, "file_no", src.alias("source"), dst.alias("target"),
            F.regexp_replace(shown, "^[ab]/", "").alias("path"),
            F.when(added, "added").when(removed, "removed").otherwise("modified").alias("kind"),
            "n_hunks", "n_added", "n_removed", *(["text"] if with_text else []),
        )
    )


def diff_hunks(lines: DataFrame, key: str = "id") -> DataFrame:
    """(key, file_no, hunk_no, source_start, source_len, target_start, target_len, n_context, n_added, n_removed)."""
    head = F.min(F.when(F.col("kind") == "hunk", F.col("line")))
    rows = lines.filter(F.col("hunk_no").isNotNull()).groupBy(key, "file_no", "hunk_no").agg(
        head.alias("h"),
        F.count_if(F.col("kind") == "context").alias("n_context"),
        F.count_if(F.col("kind") == "added").alias("n_added"),
        F.count_if(F.col("kind") == "removed").alias("n_removed"),
    )

    def number(i: int) -> Column:
        digits = F.regexp_extract("h", tx.rx(HUNK_HEADER), i)
        return F.when(digits == "", "1").otherwise(digits).cast("long")

    return rows.select(
        key, "file_no", "hunk_no", number(1).alias("source_start"), number(2).alias("source_len"),
        number(3).alias("target_start"), number(4).alias("target_len"), "n_context", "n_added", "n_removed",
    )


def modified_files(files: DataFrame, key: str = "id") -> DataFrame:
    """Source paths of files that existed before."""
    return files.filter(F.col("source").startswith("a/")).select(key, "file_no", F.substr("source", F.lit(3)).alias("path"))


def new_files(files: DataFrame, key: str = "id") -> DataFrame:
    return files.filter(F.col("source") == "/dev/null").select(
        key, "file_no", F.regexp_replace("target", "^b/", "").alias("path")
    )


def oracle_files(files: DataFrame, key: str = "id") -> DataFrame:
    """Distinct source paths after the first ``a/``; the null device stays."""
    return files.select(key, tx.after_first(F.col("source"), "a/").alias("path")).distinct()


def gold_files(patch: Column) -> Column:
    return F.array_distinct(tx.find_all(patch, GOLD_FILE_PATTERN, 1))


def split_patch(files: DataFrame, key: str = "id") -> DataFrame:
    """(key, patch, test_patch); ``files`` carries ``text``. A path with a test word anywhere in it is a test."""
    is_test = tx.contains_any(F.col("path"), TEST_PATH_PARTS)
    return files.groupBy(key).agg(
        tx.ordered_concat("file_no", F.when(~is_test, F.col("text")).otherwise(""), "").alias("patch"),
        tx.ordered_concat("file_no", F.when(is_test, F.col("text")).otherwise(""), "").alias("test_patch"),
    )


def is_test_path(path: Column) -> Column:
    """Any of the words between blanks, underscores, slashes and dots is a test word."""
    return F.arrays_overlap(F.split(F.lower(path), r"[ _/.]"), F.array(*[F.lit(t) for t in TEST_WORDS]))


def test_directives(instances: DataFrame, key: str = "instance_id", script_repos: tuple[str, ...] = ()) -> DataFrame:
    """(key, pos, directive): test targets named by the test patch.

    Repositories in ``script_repos`` are single exercises with one fixed test script.
    """
    paths = F.filter(
        tx.find_all(F.col("test_patch"), DIRECTIVE_PATTERN, 1), lambda d: ~tx.ends_with_any(d, NON_TEST_SUFFIXES)
    )
    dotted = F.transform(
        paths,
        lambda d: F.replace(F.regexp_replace(F.regexp_replace(d, r"\.py$", ""), "^tests/", ""), F.lit("/"), F.lit(".")),
    )
    out = (
        F.when(F.col("repo").isin(*script_repos), F.array(F.lit(SCRIPT_TEST)))
        .when(F.col("repo") == DOTTED_REPO, dotted)
        .otherwise(paths)
    )
    return instances.select(key, F.posexplode(out).alias("pos", "directive"))


def js_test_commands(files: DataFrame, key: str = "id") -> DataFrame:
    """(key, file_no, pos, command) from test files (path, version)."""
    raw = F.col("path")
    path = F.when(
        raw.rlike(tx.rx(SNAPSHOT_PATH)), F.array_join(F.slice(F.split(raw, "/"), 1, F.greatest(F.size(F.split(raw, "/")) - 2, F.lit(0))), "/")
    ).otherwise(raw)
    pkg = F.substring_index(path, "/", 1)
    version = F.col("version")

    def jest(ext: str) -> Column:
        return F.concat(F.lit("./node_modules/.bin/jest --verbose -c=test/"), pkg, F.lit(f"/jest.config.{ext} '"), path, F.lit("'"))

    unit = (
        F.when(version.isin(*JS_CONFIG_VERSIONS), jest("js")).when(version.isin(*JSON_CONFIG_VERSIONS), jest("json"))
        .otherwise(F.concat(F.lit("npm run test-"), pkg, F.lit(" --verbose '"), path, F.lit("'")))
    )
    e2e = F.array(
        F.lit("cd test/e2e"), F.concat(F.lit("NODE_CONFIG_ENV=test npm run test "), path), F.lit("cd ../..")
    )
    commands = F.when(tx.starts_with_any(path, ("client", "packages")), F.array(unit)).when(path.startswith("test/e2e"), e2e)
    return files.select(key, "file_no", F.posexplode(commands).alias("pos", "command"))


def default_test_commands(instances: DataFrame, spec: DataFrame, key: str = "instance_id") -> DataFrame:
    """(key, pos, command) from a (repo, version, test_cmd array) table."""
    return instances.join(spec, ["repo", "version"]).select(key, F.posexplode("test_cmd").alias("pos", "command"))


def image_assets(instances: DataFrame, key: str = "instance_id") -> DataFrame:
    """(key, pos, folder, path, url) of the images the test patch needs; assets are JSON text."""
    schema = "struct<test_patch: array<struct<path: string, url: string>>>"
    rows = instances.select(key, F.posexplode(F.from_json("image_assets", schema)["test_patch"]).alias("pos", "a"))
    head = F.regexp_extract("a.path", "^(.*)/[^/]*$", 1)
    folder = F.when(~F.col("a.path").contains("/"), ".").when(head == "", "/").otherwise(head)
    return rows.select(key, "pos", folder.alias("folder"), "a.path", "a.url")


def rebuild_patch(
    diffs: DataFrame, key: str = "id", patch: str = "patch", trim: bool = True, blank_as_space: bool = True
) -> DataFrame:
    """(key, patch): the patch with recomputed hunk headers.

    With ``trim``, each hunk is cut to the span from its first change to one line past
    its last, lines lose trailing space, and file headers before ``---`` are dropped.
    New and deleted files, and hunks with short headers, do not match the patterns and
    disappear. A null patch stays null.
    """
    text = tx.lstrip(F.col(patch), "\n")
    files = diffs.select(key, F.posexplode(tx.find_all(text, PATCH_PATTERN, 0, "s")).alias("file_no", "chunk"))
    hunks = F.arrays_zip(
        tx.find_all(F.col("chunk"), PATCH_HUNK_PATTERN, 1, "s").alias("start"),
        tx.find_all(F.col("chunk"), PATCH_HUNK_PATTERN, 5, "s").alias("content"),
    )
    head = tx.group(F.col("chunk"), PATCH_FILE_PATTERN, 0)
    if not trim:
        head = F.concat(
            F.when(F.col("chunk").startswith("diff"), F.concat(F.regexp_extract("chunk", tx.rx(DIFF_HEADER_PATTERN), 0), F.lit("\n"))).otherwise(""),
            head,
        )
    rows = files.select(key, "file_no", head.alias("head"), F.posexplode_outer(hunks).alias("hunk_no", "h")).select(
        key, "file_no", "head", "hunk_no", F.col("h.start").cast("long").alias("start"), F.col("h.content").alias("content")
    )
    if trim:
        lines = tx.lines(F.col("content"))
        changed = F.transform(lines, lambda s: tx.starts_with_any(s, ("-", "+")))
        n = F.size(lines)
        rows = rows.withColumn("_first", F.coalesce(F.nullif(F.array_position(changed, True), F.lit(0)) - 1, n)).withColumn(
            "_stop", n - F.coalesce(F.nullif(F.array_position(F.reverse(changed), True), F.lit(0)) - 1, n) + 1
        )
        kept = F.slice(lines, (F.col("_first") + 1).cast("int"), F.greatest(F.col("_stop") - F.col("_first"), F.lit(0)).cast("int"))
        clean = F.transform(kept, lambda s: tx.rstrip(s))
        if blank_as_space:
            clean = F.transform(clean, lambda s: F.when(s == "", " ").otherwise(s))
        rows = (
            rows.withColumn("_body", F.array_join(clean, "\n"))
            .withColumn("content", F.concat(F.lit("\n"), F.col("_body"), F.lit("\n")))
            .withColumn("start", F.col("start") + F.col("_first") - 1)
        )
    else:
        rows = rows.withColumn("_body", tx.after_first(F.col("content"), "\n"))
    counted = tx.lines(F.btrim(F.col("_body"), F.lit("\n")))
    rows = (
        rows.withColumn("_add", F.size(F.filter(counted, lambda s: s.startswith("+"))))
        .withColumn("_sub", F.size(F.filter(counted, lambda s: s.startswith("-"))))
        .withColumn("_ctx", F.size(counted) - F.col("_add") - F.col("_sub"))
        .repartition(key)  # serves the window over files and the aggregate over patches
    )
    earlier = Window.partitionBy(key, "file_no").orderBy("hunk_no").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum(F.col("_add") - F.col("_sub")).over(earlier), F.lit(0))
    header = F.concat(
        F.lit("@@ -"), F.col("start"), F.lit(","), F.col("_ctx") + F.col("_sub"),
        F.lit(" +"), F.col("start") + F.col("_shift"), F.lit(","), F.col("_ctx") + F.col("_add"), F.lit(" @@"), F.col("content"),
    )
    piece = F.concat(
        F.when(F.coalesce("hunk_no", F.lit(0)) == 0, F.concat("head", F.lit("\n"))).otherwise(""), F.coalesce(header, F.lit(""))
    )
    built = rows.withColumn("_shift", shift).groupBy(key).agg(
        tx.ordered_concat(["file_no", "hunk_no"], piece, "").alias("built")
    )
    return diffs.join(built, key, "left").select(
        key, F.when(F.col(patch).isNotNull(), F.coalesce("built", F.lit(""))).alias("patch")
    )
