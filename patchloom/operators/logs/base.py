"""Shared shape of the log parsers: log rows → lines → hits → one status per test."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from patchloom.functions import text as tx

# The status words of a test.
FAILED, PASSED, SKIPPED, ERROR, XFAIL = "FAILED", "PASSED", "SKIPPED", "ERROR", "XFAIL"
STATUS_WORDS = (FAILED, PASSED, SKIPPED, ERROR, XFAIL)

# Terminal escape sequences.
ANSI_ESCAPE = r"\x1B(?:[@-Z\\-_]|\[[0-?]*[ -/]*[@-~])"


@dataclass(frozen=True)
class Hit:
    """One rule on a line: when ``cond`` holds, ``test`` has ``status``.

    Hits of a higher ``rank`` are applied after all hits of a lower one.
    """

    cond: Column
    test: Column
    status: Column
    rank: int = 0


def ansi_strip(c: Column) -> Column:
    return F.regexp_replace(c, ANSI_ESCAPE, "")


def log_lines(logs: DataFrame, keys: list[str], log: str = "log") -> DataFrame:
    """(keys, line_no, line); no shuffle, a log stays in its task."""
    return logs.select(*keys, F.posexplode(tx.lines(F.col(log))).alias("line_no", "line"))


def fired(hits: list[Hit], line_no: Column) -> Column:
    """The rules that fired on one line, as an array of structs."""
    return F.filter(
        F.array(*[
            F.when(h.cond, F.struct(
                F.lit(h.rank).alias("rank"), line_no.cast("long").alias("line_no"), F.lit(i).alias("pos"),
                h.test.alias("test"), h.status.alias("status")))
            for i, h in enumerate(hits)
        ]),
        lambda s: s["test"].isNotNull() & s["status"].isNotNull(),
    )


def hits_of_log(log: Column, rule: Callable[[Column], list[Hit]]) -> Column:
    """All hits of a line rule in a log, without leaving the log's row."""
    return F.flatten(F.transform(tx.lines(log), lambda line, i: fired(rule(line), i)))


def first_non_empty(hits: Column, other: Column) -> Column:
    """``hits`` unless empty, else ``other``; the one-item array names ``hits`` so it runs once."""
    return F.get(F.transform(F.array(hits), lambda h: F.when(F.size(h) > 0, h).otherwise(other)), F.lit(0))


def last_wins(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The status of the last hit of each test; combined before the shuffle."""
    return rows.groupBy(*keys, "test").agg(
        F.max_by("status", F.struct("rank", "line_no", "pos")).alias("status")
    )
