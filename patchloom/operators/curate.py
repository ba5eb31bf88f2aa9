"""Filters that select the small, self-contained instances, and their funnel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from patchloom.functions import text as tx
from patchloom.operators.collect import ISSUE_LINK, LINK_WORDS

# What makes a statement depend on something outside it.
COMMIT_HASH = r"(?<!/)\b[0-9a-f]{40}\b"
TRAC_HASH = r"\[[0-9a-f]{23}\]"
HYPERLINK = r"https?://(?:www\.)?\S+"
IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".gif", ".bmp", ".tiff", ".svg", ".webp", ".ico", ".heif", ".bpg", ".avif")
VIDEO_SUFFIXES = (".mp4", ".avi", ".mkv", ".mov", ".wmv", ".flv", ".webm", ".mpeg")
GITLAB_ISSUE = r"https?:\/\/gitlab.com\/(.*)\/issues"
EXPECTS_MESSAGE = ("pytest.raises", "pytest.warns", "pytest.deprecated_call")
ASSERTS_OUTPUT = ("assertOutput", "assertRaises", "checks.Error")


def has_commit_hash(text: Column) -> Column:
    return text.rlike(tx.rx(COMMIT_HASH)) | text.rlike(TRAC_HASH)


def has_hyperlink(text: Column, repo: Column | None = None, exclude_own_repo: bool = False) -> Column:
    """A link in the text.

    With ``repo``, any ``http(s)://`` or ``www.`` that something follows counts. Links to
    the own repository count too, unless ``exclude_own_repo``.
    """
    if repo is None:
        return text.rlike(tx.rx(HYPERLINK))
    if exclude_own_repo:
        for scheme in ("https://", "http://"):
            text = F.replace(text, F.concat(F.lit(f"{scheme}github.com/"), repo), F.lit(""))
    return text.rlike(tx.rx(r"https?://.|www\.."))


def has_image(text: Column) -> Column:
    suffixes = "|".join("\\" + s for s in IMAGE_SUFFIXES + VIDEO_SUFFIXES)
    return text.rlike(tx.rx(rf"\b({suffixes})\b", "i"))


def has_link_word(text: Column) -> Column:
    return F.exists(tx.find_all(text, ISSUE_LINK, 1), lambda w: F.lower(w).isin(*LINK_WORDS)) | text.rlike(
        tx.rx(GITLAB_ISSUE)
    )


def issue_reference(rows: DataFrame, issues: DataFrame, key: str = "instance_id", text: str = "problem_statement") -> DataFrame:
    """Add ``has_issue_ref``: a link word, or ``#n`` that is a known issue of the repository."""
    named = rows.select(key, "repo", F.explode(F.array_distinct(tx.find_all(F.col(text), r"#(\d+)", 1))).alias("n")).select(
        key, "repo", F.expr("try_cast(n AS BIGINT)").alias("number")
    )
    known = named.join(issues.select("repo", "number"), ["repo", "number"], "left_semi").select(key).distinct()
    return (
        rows.join(known.withColumn("_known", F.lit(True)), key, "left")
        .withColumn("has_issue_ref", has_link_word(F.col(text)) | F.coalesce("_known", F.lit(False)))
        .drop("_known")
    )


def expects_message(test_patch: Column) -> Column:
    return F.when(tx.contains_any(test_patch, EXPECTS_MESSAGE), test_patch.contains("match")).otherwise(
        tx.contains_any(test_patch, ASSERTS_OUTPUT)
    )


def at_most_words(text: Column, n: int) -> Column:
    return tx.word_count(text) <= n


def statement_flags(text: Column, repo: Column) -> list[Column]:
    return [
        has_commit_hash(text).alias("has_hash"), has_hyperlink(text, repo).alias("has_link"),
        has_image(text).alias("has_image"), at_most_words(text, 40).alias("is_short"),
    ]


def patch_flags(files: DataFrame, key: str = "id", max_lines: int = 25, max_files: int = 1, max_hunks: int = 3) -> DataFrame:
    """Size flags of each patch from its file table. Only modified files count as files and hunks."""
    modified = F.col("kind") == "modified"
    n_hunks = F.sum(F.when(modified, F.col("n_hunks")).otherwise(0))
    return files.groupBy(key).agg(
        F.max(~modified).alias("adds_or_removes"),
        (F.sum(F.col("n_added") + F.col("n_removed")) <= max_lines).alias("few_lines"),
        (F.count_if(modified) <= max_files).alias("few_files"),
        ((n_hunks <= max_hunks) & (n_hunks > 0)).alias("few_hunks"),
    )


def lite_flags(instances: DataFrame, issues: DataFrame, files: DataFrame, key: str = "instance_id") -> DataFrame:
    """Three verdicts per instance: statement_ok, patch_ok, test_ok."""
    text = F.col("problem_statement")
    rows = issue_reference(instances, issues, key).join(patch_flags(files, key), key, "left")
    statement_ok = ~(
        at_most_words(text, 40) | has_hyperlink(text, F.col("repo")) | F.col("has_issue_ref")
        | has_commit_hash(text) | has_image(text)
    )
    patch_ok = ~F.col("adds_or_removes") & F.col("few_files") & F.col("few_hunks")
    return rows.select(
        *instances.columns, statement_ok.alias("statement_ok"), F.coalesce(patch_ok, F.lit(False)).alias("patch_ok"),
        (~expects_message(F.coalesce("test_patch", F.lit("")))).alias("test_ok"),
    )


def lite_filter(flags: DataFrame) -> DataFrame:
    return flags.filter("statement_ok AND patch_ok AND test_ok")


def lite_funnel(flags: DataFrame) -> DataFrame:
    """Rows left after each filter, in one pass."""
    a, b, c = F.col("statement_ok"), F.col("patch_ok"), F.col("test_ok")
    return flags.agg(
        F.count(F.lit(1)).alias("n_start"), F.count_if(a).alias("n_statement"),
        F.count_if(a & b).alias("n_patch"), F.count_if(a & b & c).alias("n_test"),
    )


def take_subset(rows: DataFrame, n: int, seed: int = 42, key: str = "instance_id") -> DataFrame:
    """``n`` rows in the order of md5(seed, id): a distributed top-n, no full sort."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), key)), key).limit(n)
