"""Choose the parser of each log and run all of them as one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from patchloom.operators.logs.base import first_non_empty, hits_of_log, last_wins
from patchloom.operators.logs.in_row import WHOLE_LOG
from patchloom.operators.logs.line_rules import LINE_RULES

# The log format of each repository, grouped by language.
REPO_PARSERS: dict[str, dict[str, str]] = {
    "c": {
        "redis/redis": "redis", "jqlang/jq": "jq", "nlohmann/json": "doctest",
        "micropython/micropython": "micropython", "valkey-io/valkey": "redis", "fmtlib/fmt": "googletest",
    },
    "go": {
        "caddyserver/caddy": "gotest", "hashicorp/terraform": "gotest", "prometheus/prometheus": "gotest",
        "gohugoio/hugo": "gotest", "gin-gonic/gin": "gotest",
    },
    "java": {
        "google/gson": "maven", "apache/druid": "maven", "javaparser/javaparser": "maven",
        "projectlombok/lombok": "ant", "apache/lucene": "gradle", "reactivex/rxjava": "gradle",
    },
    "js": {
        "Automattic/wp-calypso": "calypso", "chartjs/Chart.js": "chart_js", "markedjs/marked": "marked",
        "processing/p5.js": "p5js", "diegomura/react-pdf": "react_pdf", "babel/babel": "jest",
        "vuejs/core": "vitest", "facebook/docusaurus": "jest", "immutable-js/immutable-js": "by_instance",
        "mrdoob/three.js": "tap", "preactjs/preact": "karma", "axios/axios": "tap",
    },
    "php": {
        "phpoffice/phpspreadsheet": "phpunit", "laravel/framework": "phpunit",
        "php-cs-fixer/php-cs-fixer": "phpunit", "briannesbitt/carbon": "phpunit",
    },
    "py": {
        "astropy/astropy": "pytest_v2", "django/django": "django", "marshmallow-code/marshmallow": "pytest",
        "matplotlib/matplotlib": "matplotlib", "mwaskom/seaborn": "seaborn", "pallets/flask": "pytest",
        "psf/requests": "pytest_options", "pvlib/pvlib-python": "pytest", "pydata/xarray": "pytest",
        "pydicom/pydicom": "pytest_options", "pylint-dev/astroid": "pytest", "pylint-dev/pylint": "pytest_options",
        "pytest-dev/pytest": "pytest", "pyvista/pyvista": "pytest", "scikit-learn/scikit-learn": "pytest_v2",
        "sqlfluff/sqlfluff": "pytest", "sphinx-doc/sphinx": "pytest_v2", "sympy/sympy": "sympy",
    },
    "rb": {
        "jekyll/jekyll": "by_instance", "fluent/fluentd": "ruby_unit", "fastlane/fastlane": "rspec",
        "jordansissel/fpm": "rspec", "faker-ruby/faker": "ruby_unit", "rubocop/rubocop": "rspec",
    },
    "rs": {
        "burntsushi/ripgrep": "cargo", "sharkdp/bat": "cargo", "astral-sh/ruff": "cargo", "tokio-rs/tokio": "cargo",
        "uutils/coreutils": "cargo", "nushell/nushell": "cargo", "tokio-rs/axum": "cargo",
    },
}

# Repositories whose log format depends on the pull request.
INSTANCE_PARSERS: dict[tuple[str, str], str] = {
    ("immutable-js/immutable-js", "2006"): "jest",
    ("immutable-js/immutable-js", "2005"): "jest_json",
    ("jekyll/jekyll", "9141"): "minitest",
    ("jekyll/jekyll", "8047"): "minitest",
    ("jekyll/jekyll", "8167"): "minitest",
    ("jekyll/jekyll", "8761"): "cucumber",
    ("jekyll/jekyll", "8771"): "cucumber",
}

# Repositories graded by explicit failures only.
FAIL_ONLY_REPOS = ("chartjs/Chart.js", "processing/p5.js", "markedjs/marked")


def _lookup(table: dict[str, str], key: Column) -> Column:
    """Value of a small fixed table, null for an unknown key."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def language_of(repo: Column) -> Column:
    return _lookup({r: lang for lang, repos in REPO_PARSERS.items() for r in repos}, repo)


def parser_of(repo: Column, instance_id: Column) -> Column:
    """Parser name, or null when repository and pull request have none."""
    by_repo = {r: p for repos in REPO_PARSERS.values() for r, p in repos.items() if p != "by_instance"}
    by_pull = {f"{r}-{pr}": p for (r, pr), p in INSTANCE_PARSERS.items()}
    number = F.regexp_extract(instance_id, r"-([^-]*)$", 1)
    return F.coalesce(_lookup(by_repo, repo), _lookup(by_pull, F.concat(repo, F.lit("-"), number)))


PARSERS = sorted([*LINE_RULES, *WHOLE_LOG])
UNKNOWN_FORMAT = "unknown_format"


def _hits_in(name: str, log: Column) -> Column:
    return WHOLE_LOG[name](log) if name in WHOLE_LOG else hits_of_log(log, LINE_RULES[name])


def _hits_of(name: str, body: str | None) -> Column:
    """Hits of one format: those of ``body``, or, where it has none, those of the whole log."""
    if body is None:
        return _hits_in(name, F.col("log"))
    return first_non_empty(_hits_in(name, F.col(body)), _hits_in(name, F.col("log")))


def _status_of(logs: DataFrame, keys: list[str], hits: Column) -> DataFrame:
    return last_wins(logs.select(*keys, F.explode(hits).alias("h")).select(*keys, "h.*"), keys)


def _dispatched(names: list[str], body: str | None) -> Column:
    """Hits of a log in the format that its ``parser`` column names; null for other formats."""
    found = F.lit(None)
    for n in names:
        found = F.when(F.col("parser") == n, _hits_of(n, body)).otherwise(found)
    return found


def parse_with(logs: DataFrame, keys: list[str], parser: str, body: str | None = None) -> DataFrame:
    """(keys, test, status) of logs that all have one format.

    With ``body``, that column is parsed first and the whole ``log`` only where it
    yields nothing; the text is chosen and parsed in the log's own row.
    """
    return _status_of(logs, keys, _hits_of(parser, body))


def parse_test_logs(
    logs: DataFrame, keys: list[str], only: list[str] | None = None, body: str | None = None
) -> DataFrame:
    """(keys, test, status) for logs of mixed formats; ``logs`` has a ``parser`` column.

    All formats share one pass over the logs: each is read by the rules of its own format.
    """
    return _status_of(logs, keys, _dispatched(only or PARSERS, body))


def scan_logs(logs: DataFrame, keys: list[str], body: str, parser: str | None = None) -> DataFrame:
    """Logs with ``hits`` in place of their text, found in one read.

    ``hits`` is null for logs that were not ``found`` and for unknown formats.
    """
    hits = _hits_of(parser, body) if parser else _dispatched(PARSERS, body)
    return logs.withColumn("hits", F.when(F.col("found"), hits)).drop("log", body)


def status_of_hits(scanned: DataFrame, keys: list[str]) -> DataFrame:
    return _status_of(scanned, keys, F.col("hits"))
