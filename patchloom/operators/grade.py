"""Grading: log text → status of each test → instance report → run report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from patchloom.functions import text as tx
from patchloom.operators.logs.base import ERROR, FAILED, PASSED, XFAIL
from patchloom.operators.logs.dispatch import (
    FAIL_ONLY_REPOS, PARSERS, UNKNOWN_FORMAT, parse_test_logs, parse_with, scan_logs, status_of_hits,
)
from patchloom.session import pin, refuse_unknown

# Markers an evaluation run writes into its log.
START_MARK = ">>>>> Start Test Output"
END_MARK = ">>>>> End Test Output"
BAD_MARKS = (
    ">>>>> Patch Apply Failed",
    ">>>>> Reset Failed",
    ">>>>> Tests Errored",
    ">>>>> Tests Timed Out",
)

# Names of test lists, outcomes and resolution grades.
FAIL_TO_PASS, PASS_TO_PASS = "FAIL_TO_PASS", "PASS_TO_PASS"
FAIL_TO_FAIL, PASS_TO_FAIL = "FAIL_TO_FAIL", "PASS_TO_FAIL"
FULL, PARTIAL, NO = "RESOLVED_FULL", "RESOLVED_PARTIAL", "RESOLVED_NO"


def latest_predictions(preds: DataFrame, keys: list[str] = ["instance_id"], seq: str = "seq") -> DataFrame:
    """The last row of each key; combined before the shuffle."""
    rest = [c for c in preds.columns if c not in keys]
    return preds.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("r")).select(*keys, "r.*")


def gold_predictions(instances: DataFrame) -> DataFrame:
    return instances.select("instance_id", F.col("patch").alias("model_patch"), F.lit("gold").alias("model_name_or_path"))


def log_window(logs: DataFrame, log: str = "log") -> DataFrame:
    """Add ``found`` (the run got as far as its tests) and ``body`` (text between the marks)."""
    c = F.col(log)
    found = ~tx.contains_any(c, BAD_MARKS) & c.contains(START_MARK) & c.contains(END_MARK)
    rest = tx.after_first(c, START_MARK)
    body = F.substring_index(F.substring_index(rest, START_MARK, 1), END_MARK, 1)
    return logs.withColumn("found", F.coalesce(found, F.lit(False))).withColumn("body", F.when(F.col("found"), body))


def parse_found_logs(logs: DataFrame, keys: list[str], parser: str | None = None) -> DataFrame:
    """Status rows of found logs: from the marked part, or, if that yields none, from the whole log.

    Without ``parser``, ``logs`` names the format of each log in a ``parser`` column.
    """
    found = log_window(logs).filter("found")
    if parser:
        return parse_with(found, keys, parser, body="body")
    return parse_test_logs(found, keys, body="body")


def grade_logs(logs: DataFrame, keys: list[str], parser: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(runs, status): runs has keys, repo, found, gradable and error; status has keys, test and status.

    Both come from one stored scan result, so the logs, by far the largest input, are read
    once, whatever their formats. Without ``parser``, ``logs`` names the format of each log in
    a ``parser`` column; a log of an unknown format is found but not gradable, and its
    ``error`` says why. Grade the gradable runs only.
    """
    columns = [*keys, "repo", "found"] + ([] if parser else ["parser"])
    scanned = pin(scan_logs(log_window(logs), keys, "body", parser).select(*columns, "hits"))
    known = F.lit(True) if parser else F.col("parser").isNotNull() & F.col("parser").isin(*PARSERS)
    runs = scanned.select(*keys, "repo", "found", (F.col("found") & known).alias("gradable"), F.when(F.col("found") & ~known, UNKNOWN_FORMAT).alias("error"))
    return runs, status_of_hits(scanned.filter("found"), keys)


def outcome(status: Column, fail_only: Column) -> Column:
    """'success', 'failure' or null for a gold test; ``status`` is null when the log has no such test.

    A skipped test is neither, so it leaves all counts.
    """
    strict = F.when(status.isin(PASSED, XFAIL), "success").when(
        status.isNull() | status.isin(FAILED, ERROR), "failure"
    )
    lenient = F.when(status == FAILED, "failure").otherwise("success")
    return F.when(fail_only, lenient).otherwise(strict)


def is_fail_only(repo: Column) -> Column:
    return repo.isin(*FAIL_ONLY_REPOS)


def grade_tests(
    runs: DataFrame, gold: DataFrame, status: DataFrame, keys: list[str], keep: Callable[[DataFrame], DataFrame] = lambda df: df
) -> DataFrame:
    """(keys, repo, category, test, outcome) for every gold test of every run.

    ``runs`` has keys + repo and one row per graded log; ``gold`` has instance_id,
    category and test; ``status`` has keys, test and status. All three grow with the logs, and
    stored runs are a small part of their size in memory, so no side is broadcast by its files.
    ``keep`` may store the gold tests of the runs, so that the shuffles before them can go.
    """
    wanted = keep(runs.select(*keys, "repo").hint("merge").join(gold.select("instance_id", "category", "test"), "instance_id"))
    joined = wanted.join(status.select(*keys, "test", "status").hint("merge"), [*keys, "test"], "left")
    return joined.select(
        *keys, "repo", "category", "test", "status", outcome(F.col("status"), is_fail_only(F.col("repo"))).alias("outcome")
    )


def _count(category: str, result: str) -> Column:
    return F.count_if((F.col("category") == category) & F.coalesce(F.col("outcome") == result, F.lit(False)))


def _rate(success: str, failure: str) -> Column:
    total = F.col(success) + F.col(failure)
    return F.when(total == 0, F.lit(1.0)).otherwise(F.col(success) / total)


def grade_rates(graded: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and rates of each run; an empty list scores 1."""
    return (
        graded.groupBy(*keys)
        .agg(
            _count(FAIL_TO_PASS, "success").alias("f2p_success"), _count(FAIL_TO_PASS, "failure").alias("f2p_failure"),
            _count(PASS_TO_PASS, "success").alias("p2p_success"), _count(PASS_TO_PASS, "failure").alias("p2p_failure"),
        )
        .withColumn("f2p_rate", _rate("f2p_success", "f2p_failure"))
        .withColumn("p2p_rate", _rate("p2p_success", "p2p_failure"))
    )


def resolution(f2p: Column, p2p: Column) -> Column:
    return F.when((f2p == 1) & (p2p == 1), FULL).when((f2p < 1) & (f2p > 0) & (p2p == 1), PARTIAL).otherwise(NO)


def instance_reports(preds: DataFrame, logs: DataFrame, rates: DataFrame, keys: list[str]) -> DataFrame:
    """Flags of each prediction. ``logs`` has keys + found, ``rates`` comes from :func:`grade_rates`.

    A run without gold rows has empty lists, hence rates of 1.
    """
    joined = preds.join(logs.select(*keys, "found").hint("merge"), keys, "left").join(
        rates.select(*keys, "f2p_rate", "p2p_rate").hint("merge"), keys, "left"
    )
    has_patch = F.col("model_patch").isNotNull()
    applied = has_patch & F.coalesce("found", F.lit(False))
    full = resolution(F.coalesce("f2p_rate", F.lit(1.0)), F.coalesce("p2p_rate", F.lit(1.0))) == FULL
    return joined.select(
        *keys,
        (~has_patch).alias("patch_is_none"),
        has_patch.alias("patch_exists"),
        applied.alias("patch_successfully_applied"),
        (applied & full).alias("resolved"),
    )


def run_states(dataset: DataFrame, preds: DataFrame, reports: DataFrame) -> DataFrame:
    """(instance_id, state, has_report) for each dataset row.

    ``reports`` has instance_id and ``resolved``; a null ``resolved`` is a report
    that is empty, malformed or lacks its key. Such a run counts as completed and
    as an error. Both sides grow with the dataset and may be stored, so they join by sorting.
    """
    joined = (
        dataset.select("instance_id")
        .join(preds.select("instance_id", "model_patch", F.lit(True).alias("has_pred")).hint("merge"), "instance_id", "left")
        .join(reports.select("instance_id", "resolved", F.lit(True).alias("has_report")).hint("merge"), "instance_id", "left")
    )
    no_patch = F.coalesce("model_patch", F.lit("")) == ""
    state = (
        F.when(F.col("has_pred").isNull(), "incomplete")
        .when(no_patch, "empty_patch")
        .when(F.col("has_report").isNull(), "error")
        .when(F.col("resolved").isNull(), "error")
        .when(F.col("resolved"), "resolved")
        .otherwise("unresolved")
    )
    ran = F.col("has_pred").isNotNull() & ~no_patch & F.col("has_report").isNotNull()
    return joined.select("instance_id", state.alias("state"), ran.alias("completed"))


def run_report(states: DataFrame, preds: DataFrame) -> DataFrame:
    """One row of counts. Submitted counts every prediction, also for unknown instances."""
    rows = states.select("state", "completed").unionByName(
        preds.select(F.lit("submitted").alias("state"), F.lit(False).alias("completed"))
    )
    in_data = F.col("state") != "submitted"
    return rows.agg(
        F.count_if(in_data).alias("total_instances"),
        F.count_if(~in_data).alias("submitted_instances"),
        F.count_if("completed").alias("completed_instances"),
        F.count_if(F.col("state") == "resolved").alias("resolved_instances"),
        F.count_if(F.col("state") == "unresolved").alias("unresolved_instances"),
        F.count_if(F.col("state") == "empty_patch").alias("empty_patch_instances"),
        F.count_if(F.col("state") == "error").alias("error_instances"),
    ).withColumn("schema_version", F.lit(2))


def run_report_ids(states: DataFrame, preds: DataFrame) -> DataFrame:
    """(list_name, instance_id): the id lists of the report, one row per id."""
    names = F.array_compact(F.array(
        F.concat("state", F.lit("_ids")), F.when(F.col("completed"), F.lit("completed_ids"))
    ))
    return states.select(F.explode(names).alias("list_name"), "instance_id").unionByName(
        preds.select(F.lit("submitted_ids").alias("list_name"), "instance_id")
    )


def unknown_predictions(preds: DataFrame, dataset: DataFrame) -> DataFrame:
    """Predictions for instances outside the dataset."""
    return preds.join(dataset.select("instance_id"), "instance_id", "left_anti")


def work_list(
    dataset: DataFrame,
    preds: DataFrame,
    done: DataFrame | None = None,
    ids: DataFrame | None = None,
    with_logs: DataFrame | None = None,
    check: bool = True,
) -> DataFrame:
    """Dataset rows still to be run.

    ``done`` lists ids that have a report, ``ids`` an optional subset, ``with_logs``
    switches to rewrite mode, which keeps instances that have a log. With ``check``,
    predictions for unknown instances raise an error that names the table of all of them.
    """
    if check:
        refuse_unknown(unknown_predictions(preds, dataset), "prediction ids not in the dataset")
    out = dataset
    if ids is not None:
        out = out.join(ids.select("instance_id").distinct(), "instance_id", "left_semi")
    if with_logs is not None:
        return out.join(preds, "instance_id", "left_semi").join(with_logs, "instance_id", "left_semi")
    if done is not None:
        out = out.join(done.select("instance_id"), "instance_id", "left_anti")
    return out.join(preds.filter(F.coalesce("model_patch", F.lit("")) != ""), "instance_id", "left_semi")


def transition_classes(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, test, category) from the statuses before and after the gold patch.

    An absent test has failed; a skipped one belongs to no class.
    """
    both = before.select(*keys, "test", F.col("status").alias("b")).join(
        after.select(*keys, "test", F.col("status").alias("a")), [*keys, "test"], "full_outer"
    )
    strict = F.lit(False)
    b, a = outcome(F.col("b"), strict), outcome(F.col("a"), strict)
    name = F.when(b == "failure", F.when(a == "success", FAIL_TO_PASS).when(a == "failure", FAIL_TO_FAIL)).when(
        b == "success", F.when(a == "success", PASS_TO_PASS).when(a == "failure", PASS_TO_FAIL)
    )
    return both.select(*keys, "test", name.alias("category")).filter(F.col("category").isNotNull())


def nontrivial(classes: DataFrame, keys: list[str]) -> DataFrame:
    """Runs with at least one test that went from fail to pass."""
    return classes.groupBy(*keys).agg(F.count_if(F.col("category") == FAIL_TO_PASS).alias("n_fail_to_pass")).filter(
        F.col("n_fail_to_pass") > 0
    )


def import_error_flag(log: Column) -> Column:
    """Some line with 'attribute' or 'import' also says 'error' or 'fail'.

    The lines are joined with a space first, but neither word holds a space, so the
    test can be made line by line.
    """
    low = F.lower(log)
    return low.rlike(r"(?d)(?:attribute|import).*(?:error|fail)|(?:error|fail).*(?:attribute|import)")


def first_success(attempts: DataFrame, key: str) -> DataFrame:
    """The earliest attempt of each key that ended with code 0; null when none did."""
    ok = F.col("exit_code") == 0
    return attempts.groupBy(key).agg(
        F.min(F.when(ok, F.col("ord"))).alias("ord"),
        F.min_by(F.when(ok, F.col("command")), F.when(ok, F.col("ord"))).alias("command"),
        F.count(F.lit(1)).alias("attempts"),
    )


def resolution_rate(reports: DataFrame, dims: list[str]) -> DataFrame:
    """Resolved share by ``dims`` with subtotals; subtotal columns read 'ALL'."""
    return (
        reports.rollup(*dims)
        .agg(
            F.count(F.lit(1)).alias("submitted"),
            F.count_if("resolved").alias("resolved"),
            *[F.grouping(d).alias(f"_g_{d}") for d in dims],
        )
        .select(
            *[F.when(F.col(f"_g_{d}") == 1, F.lit("ALL")).otherwise(F.col(d)).alias(d) for d in dims],
            "submitted", "resolved", F.round(F.col("resolved") / F.col("submitted"), 6).alias("rate"),
        )
    )
