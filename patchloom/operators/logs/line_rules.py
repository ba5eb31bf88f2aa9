"""Parsers whose rules look at one line only, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from patchloom.functions import text as tx
from patchloom.operators.logs.base import (
    ERROR, FAILED, Hit, PASSED, SKIPPED, STATUS_WORDS, ansi_strip,
)

# Line patterns of the test frameworks, the groups that hold the
# outcome word and the test name, and the status of each outcome word.
CODED_PATTERNS: dict[str, tuple[str, int, int, dict[str, str]]] = {
    "gotest": (r"^--- (PASS|FAIL|SKIP): (.+) \((.+)\)$", 1, 2, {"PASS": PASSED, "FAIL": FAILED, "SKIP": SKIPPED}),
    "cargo": (r"^test\s+(\S+)\s+\.\.\.\s+(\w+)$", 2, 1, {"ok": PASSED, "FAILED": FAILED}),
    "ant": (r"^\s*\[junit\]\s+\[(PASS|FAIL|ERR)\]\s+(.*)$", 1, 2, {"PASS": PASSED, "FAIL": FAILED, "ERR": FAILED}),
    "jest": (r"^\s*(✓|✕|○)\s(.+?)(?:\s\((\d+\s*m?s)\))?$", 1, 2, {"✓": PASSED, "✕": FAILED, "○": SKIPPED}),
    "jest_json": (r"^\[(PASSED|FAILED)\]\s(.+)$", 1, 2, {"PASSED": PASSED, "FAILED": FAILED}),
    "vitest": (r"^\s*(✓|×|↓)\s(.+?)(?:\s(\d+\s*m?s?|\[skipped\]))?$", 1, 2, {"✓": PASSED, "×": FAILED, "↓": SKIPPED}),
    "tap": (r"^(ok|not ok) (\d+) (.+)$", 1, 3, {"ok": PASSED, "not ok": FAILED}),
    "redis": (r"^\[(ok|err|skip|ignore)\]:\s(.+?)(?:\s\((\d+\s*m?s)\))?$", 1, 2,
              {"ok": PASSED, "err": FAILED, "skip": SKIPPED, "ignore": SKIPPED}),
    "jq": (r"^\s*(PASS|FAIL):\s(.+)$", 1, 2, {"PASS": PASSED, "FAIL": FAILED}),
    "micropython": (r"^(pass|FAIL|skip)\s+(.+)$", 1, 2, {"pass": PASSED, "FAIL": FAILED, "skip": SKIPPED}),
    "googletest": (r"^.*\[\s*(OK|FAILED)\s*\]\s(.*)\s\(.*\)$", 1, 2, {"OK": PASSED, "FAILED": FAILED}),
    "minitest": (r"^(.+)\. .*=.*(\.|F|E).*$", 2, 1, {".": PASSED, "F": FAILED, "E": FAILED}),
    "cucumber": (r"^(.*) \.+(\.|F)", 2, 1, {".": PASSED, "F": FAILED}),
    "ruby_unit": (r"^\s*(?:test: )?(.+):\s+(\.|E\b|F\b|O\b)", 2, 1, {".": PASSED, "E": FAILED, "F": FAILED, "O": SKIPPED}),
    "rspec": (r"^(.+) - (passed|failed)", 2, 1, {"passed": PASSED, "failed": FAILED}),
}

# Patterns of the remaining line parsers.
OPTION_PATTERN = r"(.*?)\[(.*)\]"
COLOUR_PATTERN = r"\[(\d+)m"
CONTROL_CHARS = "".join(chr(i) for i in range(1, 32))
SYMPY_PATTERN = r"(_*) (.*)\.py:(.*) (_*)"
MARKED_PATTERN = r"^\d+\)\s(.*)"
REDIS_PATH_SUFFIX = r"\s+in\s+\S+$"
REACT_PDF_TIMES = (r"\s\([\d\.]+ms\)", r"\s\([\d\.]+\ss\)", r"\s\([\d\.]+s\)", "")
MOUSE_BUTTONS = {"MouseButton.LEFT": "1", "MouseButton.RIGHT": "3"}

LineRule = Callable[[Column], list[Hit]]
LINE_RULES: dict[str, LineRule] = {}


def line_rule(name: str):
    def add(fn: LineRule) -> LineRule:
        LINE_RULES[name] = fn
        return fn

    return add


def _coded(name: str) -> LineRule:
    pattern, code_group, test_group, codes = CODED_PATTERNS[name]

    def rule(line: Column) -> list[Hit]:
        t = tx.strip(line)
        p = tx.rx(pattern)
        code = F.regexp_extract(t, p, code_group)
        status = F.lit(None).cast("string")
        for word, value in codes.items():
            status = F.when(code == word, F.lit(value)).otherwise(status)
        test = F.regexp_extract(t, p, test_group)
        if name == "redis":
            test = F.when(code == "err", F.regexp_replace(test, tx.rx(REDIS_PATH_SUFFIX), "")).otherwise(test)
        return [Hit(t.rlike(p), test, status)]

    return rule


for _name in CODED_PATTERNS:
    LINE_RULES[_name] = _coded(_name)


_TWO_WORDS = tx.rx(f"^{tx.NOT_SPACE}+{tx.SPACE}+{tx.NOT_SPACE}")


def _status_first(line: Column) -> tuple[Column, Column, Column]:
    """(condition, first word, second word) of a line that starts with a status word."""
    text = F.when(line.startswith(FAILED), F.replace(line, F.lit(" - "), F.lit(" "))).otherwise(line)
    cond = tx.starts_with_any(line, STATUS_WORDS) & text.rlike(_TWO_WORDS)
    return cond, tx.word(text, 0), tx.word(text, 1)


@line_rule("pytest")
def pytest_rule(line: Column) -> list[Hit]:
    cond, status, test = _status_first(line)
    return [Hit(cond, test, status)]


@line_rule("pytest_options")
def pytest_options_rule(line: Column) -> list[Hit]:
    cond, status, name = _status_first(line)
    p = tx.rx(OPTION_PATTERN)
    option = F.regexp_extract(name, p, 2)
    short = F.when(
        option.startswith("/") & ~option.startswith("//") & ~option.contains("*"),
        F.concat(F.lit("/"), F.substring_index(option, "/", -1)),
    ).otherwise(option)
    test = F.when(
        name.rlike(p), F.concat(F.regexp_extract(name, p, 1), F.lit("["), short, F.lit("]"))
    ).otherwise(name)
    return [Hit(cond, test, status)]


@line_rule("pytest_v2")
def pytest_v2_rule(line: Column) -> list[Hit]:
    clean = F.translate(F.regexp_replace(line, tx.rx(COLOUR_PATTERN), ""), CONTROL_CHARS, "")
    cond, status, test = _status_first(clean)
    ends = (
        ~tx.starts_with_any(clean, STATUS_WORDS)
        & tx.ends_with_any(clean, STATUS_WORDS)
        & tx.word(clean, 1).isNotNull()
    )
    return [Hit(cond, test, status), Hit(ends, tx.word(clean, 0), tx.word(clean, 1))]


@line_rule("matplotlib")
def matplotlib_rule(line: Column) -> list[Hit]:
    for name, number in MOUSE_BUTTONS.items():
        line = F.replace(line, F.lit(name), F.lit(number))
    return pytest_rule(line)


@line_rule("seaborn")
def seaborn_rule(line: Column) -> list[Hit]:
    first, second = tx.word(line, 0), tx.word(line, 1)
    failed = line.startswith(FAILED)
    middle = line.contains(f" {PASSED} ")
    return [
        Hit(failed, second, F.lit(FAILED)),
        Hit(~failed & middle & (second == PASSED), first, F.lit(PASSED)),
        Hit(~failed & ~middle & line.startswith(PASSED), second, F.lit(PASSED)),
    ]


@line_rule("sympy")
def sympy_rule(line: Column) -> list[Hit]:
    p = tx.rx(SYMPY_PATTERN)
    t = tx.strip(line)
    is_test = t.startswith("test_")
    heading = F.concat(F.regexp_extract(line, p, 2), F.lit(".py:"), F.regexp_extract(line, p, 3))
    return [
        Hit(line.rlike(p), heading, F.lit(FAILED)),
        Hit(is_test & t.endswith(" E"), tx.word(t, 0), F.lit(ERROR), rank=1),
        Hit(is_test & t.endswith(" F"), tx.word(t, 0), F.lit(FAILED), rank=1),
        Hit(is_test & t.endswith(" ok"), tx.word(t, 0), F.lit(PASSED), rank=1),
    ]


@line_rule("marked")
def marked_rule(line: Column) -> list[Hit]:
    p = tx.rx(MARKED_PATTERN)
    return [Hit(line.rlike(p), tx.strip(F.regexp_extract(line, p, 1)), F.lit(FAILED))]


@line_rule("react_pdf")
def react_pdf_rule(line: Column) -> list[Hit]:
    hits = []
    for word, status in (("PASS", PASSED), ("FAIL", FAILED)):
        name = F.coalesce(*[tx.group(line, rf"^{word}\s(.*){time}", 1) for time in REACT_PDF_TIMES])
        hits.append(Hit(line.startswith(word) & name.isNotNull(), name, F.lit(status)))
    return hits


# The failure line of a browser run.
CHART_JS_PATTERN = r"Chrome\s[\d\.]+[^\S\r\n]\(.+?\)[^\S\r\n](.*)FAILED$"


def chart_js_failures(log: Column) -> Column:
    """Names of failed tests in a whole log."""
    return tx.find_all(ansi_strip(log), CHART_JS_PATTERN, 1, flags="m")
