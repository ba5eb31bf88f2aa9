"""Environment files, requirement texts, environment keys and specifications."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from patchloom.functions import text as tx
from patchloom.session import refuse_unknown

# Withdrawn package and its replacement; lines requirements drop.
REPLACED_PACKAGES = {"types-pkg_resources": "types-setuptools"}
DROPPED_PREFIXES = ("-e .", "#", ".[test")
PIP_LINE = r"^(\s*-\s*pip\s*:\s*\n)"
KEY_LENGTH = 22

# Where repositories keep requirement and environment files, by priority.
REQUIREMENT_PATHS = {
    "dbt-labs/dbt-core": ["dev-requirements.txt", "dev_requirements.txt"],
    "django/django": ["tests/requirements/py3.txt"],
    "matplotlib/matplotlib": ["requirements/dev/dev-requirements.txt", "requirements/testing/travis_all.txt"],
    "pallets/flask": ["requirements/dev.txt"],
    "pylint-dev/pylint": ["requirements_test.txt"],
    "pyvista/pyvista": ["requirements_test.txt", "requirements.txt"],
    "sqlfluff/sqlfluff": ["requirements_dev.txt"],
    "sympy/sympy": ["requirements-dev.txt", "requirements-test.txt"],
}
ENVIRONMENT_PATHS = {
    "matplotlib/matplotlib": ["environment.yml"],
    "pydata/xarray": ["ci/requirements/environment.yml", "environment.yml"],
}


def env_key(script: Column) -> Column:
    """Short hash of a setup script; equal scripts share one environment."""
    return F.substring(F.sha2(script, 256), 1, KEY_LENGTH)


def env_groups(instances: DataFrame, script: str = "script", existing: DataFrame | None = None) -> DataFrame:
    """(env_key, n, first_id) of environments not yet present."""
    groups = instances.groupBy(env_key(F.col(script)).alias("env_key")).agg(
        F.count(F.lit(1)).alias("n"), F.min("instance_id").alias("first_id")
    )
    return groups if existing is None else groups.join(existing.select("env_key"), "env_key", "left_anti")


def pending_keys(instances: DataFrame, ids: DataFrame, existing: DataFrame, force: bool = False, check: bool = True) -> DataFrame:
    """Instances of the id list whose ``env_key`` is not present, or all of them when forced."""
    if check:
        refuse_unknown(ids.join(instances, "instance_id", "left_anti"), "instance ids outside the list")
    chosen = instances.join(ids.select("instance_id").distinct(), "instance_id", "left_semi")
    return chosen if force else chosen.join(existing.select("env_key"), "env_key", "left_anti")


def _replace_package(text: Column, head: str) -> Column:
    for old, new in REPLACED_PACKAGES.items():
        text = F.regexp_replace(text, tx.rx(rf"^({head}){re.escape(old)}([<>=!~]=?.*|$)", "m"), f"$1{new}")
    return text


def clean_requirements(text: Column) -> Column:
    """Requirement text with withdrawn packages replaced, their version limits included."""
    return _replace_package(text, "")


def clean_environment(text: Column) -> Column:
    """Environment text with withdrawn packages replaced inside its pip section only.

    The section ends at the first line that is not indented deeper than its head.
    """
    head = F.regexp_extract(text, tx.rx(PIP_LINE, "m"), 1)
    at = F.regexp_instr(text, F.lit(tx.rx(PIP_LINE, "m")))
    indent = F.length(head) - F.length(tx.lstrip(head))
    cut = at + F.length(head)
    rest = F.substr(text, cut)
    lines = tx.lines(rest)
    leaves = F.transform(lines, lambda s: (tx.strip(s) != "") & (F.length(s) - F.length(tx.lstrip(s)) <= indent))
    end = F.array_position(leaves, True)  # 1-based, 0 when the section reaches the end of the text
    inside = F.when(end == 0, rest).when(end == 1, "").otherwise(
        F.concat(F.array_join(F.slice(lines, 1, F.greatest(end - 1, F.lit(0)).cast("int")), "\n"), F.lit("\n"))
    )
    after = F.when(end == 0, "").otherwise(
        F.array_join(F.slice(lines, F.greatest(end, F.lit(1)).cast("int"), F.size(lines)), "\n"))
    done = F.concat(F.substr(text, F.lit(1), cut - 1), _replace_package(inside, r"\s*-\s*"), after)
    return F.when(head == "", text).otherwise(done)


def flatten_requirements(roots: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, commit, text) of requirement files with included files put in.

    ``roots`` and ``files`` have repo, commit, path, text. Includes go one level deep
    and come first; a missing one adds nothing. Comments, editable installs and local
    test extras are dropped.
    """
    keys = ["repo", "commit"]
    line = F.col("line")
    keep = ~tx.starts_with_any(tx.strip(line), DROPPED_PREFIXES)
    rows = roots.select(*keys, "path", F.posexplode(tx.lines(F.col("text"))).alias("pos", "line"))
    is_include = tx.strip(line).startswith("-r")
    folder = F.when(F.col("path").contains("/"), F.concat(F.regexp_replace("path", "/[^/]*$", ""), F.lit("/"))).otherwise("")
    wanted = rows.filter(is_include).select(
        *keys, "pos", F.concat(folder, tx.strip(F.substr(line, F.lit(3)))).alias("path")
    )
    included = wanted.join(files.select(*keys, "path", "text"), [*keys, "path"]).select(
        *keys, F.lit(0).alias("part"), "pos", F.posexplode(tx.lines(F.col("text"))).alias("sub", "line")
    ).filter(keep)
    own = rows.filter(~is_include & keep).select(
        *keys, F.lit(1).alias("part"), "pos", F.lit(0).alias("sub"), "line"
    )
    extra = included.groupBy(*keys).agg(tx.ordered_concat(["pos", "sub"], line, "\n").alias("_e"))
    original = own.groupBy(*keys).agg(tx.ordered_concat("pos", line, "\n").alias("_o"))
    return roots.select(*keys).join(extra, keys, "left").join(original, keys, "left").select(
        *keys, F.concat_ws("\n", "_e", F.coalesce("_o", F.lit(""))).alias("text")
    )


def setup_commit(columns: list[str]) -> Column:
    """The commit whose environment counts: the setup commit when the table has one."""
    return F.col("environment_setup_commit") if "environment_setup_commit" in columns else F.col("base_commit")


def pick_env_file(instances: DataFrame, files: DataFrame, paths: dict[str, list[str]], env_name: str = "testbed") -> DataFrame:
    """(repo, commit, path, text, error) per distinct snapshot: the first listed file that exists.

    The path table is a fixed list. ``name:`` lines get the given environment name.
    """
    dim = files.sparkSession.createDataFrame(
        [(r, p, i) for r, ps in paths.items() for i, p in enumerate(ps)], "repo string, path string, prio int"
    )
    snapshots = instances.select("repo", setup_commit(instances.columns).alias("commit")).distinct()
    present = files.join(F.broadcast(dim), ["repo", "path"]).groupBy("repo", "commit").agg(
        F.min_by(F.struct("path", "content"), "prio").alias("f")
    )
    known = snapshots.join(F.broadcast(dim.select("repo").distinct()), "repo", "left_semi")
    return known.join(present, ["repo", "commit"], "left").select(
        "repo", "commit", "f.path",
        F.regexp_replace("f.content", tx.rx("^name:.*$", "m"), f"name: {env_name}").alias("text"),
        F.when(F.col("f").isNull(), F.lit("no such file")).alias("error"),
    )


def cached_env_lookup(ids: DataFrame, cache: DataFrame) -> DataFrame:
    """(instance_id, repo_key, number, text): the id split at its last hyphen, text null when not cached."""
    p = tx.rx(r"^(.*)-([^-]*)$", "s")
    keys = ids.select(
        "instance_id", tx.group(F.col("instance_id"), p, 1).alias("repo_key"), tx.group(F.col("instance_id"), p, 2).alias("number")
    )
    return keys.join(cache.select("repo_key", "number", "text"), ["repo_key", "number"], "left").select(
        "instance_id", "repo_key", "number", "text")


def test_list(col: Column) -> Column:
    """A test list stored as JSON text; absent lists are empty."""
    return F.coalesce(F.from_json(col, "array<string>"), F.array().cast("array<string>"))


def resolve_spec(instances: DataFrame, spec: DataFrame) -> DataFrame:
    """Instances with test command and parsed test lists; ``error`` names a missing specification.

    The specification table has one row per (repo, version) and holds configuration.
    """
    joined = instances.join(spec.select("repo", "version", "test_cmd", F.lit(True).alias("_s")), ["repo", "version"], "left")
    return joined.select(
        "instance_id", "repo", "version", "test_cmd",
        test_list(F.col("FAIL_TO_PASS")).alias("fail_to_pass"), test_list(F.col("PASS_TO_PASS")).alias("pass_to_pass"),
        F.when(F.col("_s").isNull(), F.lit("no specification")).alias("error"),
    )
