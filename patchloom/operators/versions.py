"""Assign versions: from files of a snapshot, or from a release calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from patchloom.functions import text as tx
from patchloom.functions.order import chunk_of, with_row_index

# The files that may name a version, in order of priority.
VERSION_PATHS: dict[str, list[str]] = {
    "dbt-labs/dbt-core": ["core/dbt/version.py", "core/dbt/__init__.py"],
    "django/django": ["django/__init__.py"],
    "huggingface/transformers": ["src/transformers/__init__.py"],
    "marshmallow-code/marshmallow": ["src/marshmallow/__init__.py"],
    "mwaskom/seaborn": ["seaborn/__init__.py"],
    "pallets/flask": ["src/flask/__init__.py", "flask/__init__.py"],
    "psf/requests": ["requests/__version__.py", "requests/__init__.py"],
    "pyca/cryptography": ["src/cryptography/__about__.py", "src/cryptography/__init__.py"],
    "pylint-dev/astroid": ["astroid/__pkginfo__.py", "astroid/__init__.py"],
    "pylint-dev/pylint": ["pylint/__pkginfo__.py", "pylint/__init__.py"],
    "pytest-dev/pytest": ["src/_pytest/_version.py", "_pytest/_version.py"],
    "pyvista/pyvista": ["pyvista/_version.py", "pyvista/__init__.py"],
    "Qiskit/qiskit": ["qiskit/VERSION.txt"],
    "scikit-learn/scikit-learn": ["sklearn/__init__.py"],
    "sphinx-doc/sphinx": ["sphinx/__init__.py"],
    "sympy/sympy": ["sympy/release.py", "sympy/__init__.py"],
}

# The version patterns, in order of priority.
DUNDER = r"""__version__ = [\'"](.*)[\'"]"""
DUNDER_TWICE = r"""__version__ = version = [\'"](.*)[\'"]"""
VERSION_TUPLE = r"VERSION = \((.*)\)"
WHOLE_LINE = r"(.*)"
VERSION_INFO = r"version_info = [\d]+,[\d\s]+,"
DOCSTRING = r'""".*?"""'
THREE_PATTERN_REPOS = ("pytest-dev/pytest", "matplotlib/matplotlib")
WHOLE_LINE_REPO = "Qiskit/qiskit"
VERSION_INFO_REPO = "pyvista/pyvista"


def _first_two(version: Column, sep: str) -> Column:
    parts = F.slice(F.split(tx.strip(version), f"[{sep}]"), 1, 2)
    return F.when(version.contains(sep), F.array_join(parts, ".")).otherwise(version)


def version_in_text(text: Column, repo: Column) -> Column:
    """Raw version named in a file, or null."""
    bare = F.regexp_replace(text, tx.rx(DOCSTRING, "s"), "")

    def first(*patterns: str) -> Column:
        return F.replace(F.coalesce(*[tx.group(bare, p, 1) for p in patterns]), F.lit(" "), F.lit(""))

    info = tx.strip(F.element_at(F.split(tx.group(bare, VERSION_INFO, 0), "="), -1))
    return (
        F.when(repo == VERSION_INFO_REPO, F.replace(info, F.lit(","), F.lit(".")))
        .when(repo == WHOLE_LINE_REPO, first(WHOLE_LINE))
        .when(repo.isin(*THREE_PATTERN_REPOS), first(DUNDER, DUNDER_TWICE, VERSION_TUPLE))
        .otherwise(first(DUNDER, VERSION_TUPLE))
    )


def short_version(version: Column) -> Column:
    """First two parts, split at dots and then at commas, digits and dots only."""
    return F.regexp_replace(_first_two(_first_two(version, "."), ","), r"[^0-9\.]", "")


def version_from_files(instances: DataFrame, files: DataFrame, paths: dict[str, list[str]] = VERSION_PATHS) -> DataFrame:
    """(repo, base_commit, version) per snapshot: the first path, by priority, that names one.

    Snapshots are made distinct first, so a file is parsed once however many
    instances share it. The path table is fixed, hence the broadcast.
    """
    dim = files.sparkSession.createDataFrame(
        [(r, p, i) for r, ps in paths.items() for i, p in enumerate(ps)], "repo string, path string, prio int"
    )
    # narrow the files to version files before they meet the instances
    wanted = files.join(F.broadcast(dim), ["repo", "path"]).select(
        "repo", F.col("commit").alias("base_commit"), "prio", version_in_text(F.col("content"), F.col("repo")).alias("raw")
    ).filter(F.col("raw").isNotNull())
    snapshots = instances.select("repo", "base_commit").distinct()
    return snapshots.join(wanted, ["repo", "base_commit"]).groupBy("repo", "base_commit").agg(
        short_version(F.min_by("raw", "prio")).alias("version")
    )


def _as_of(tasks: DataFrame, releases: DataFrame, value: Column) -> DataFrame:
    """(repo, day, version) for each distinct day of the tasks.

    ``value`` is a running aggregate over the releases strictly before the day. Days
    are made distinct first: the window then holds one row per (repository, day),
    however many tasks share them.
    """
    days = tasks.select("repo", F.substring_index("created_at", "T", 1).alias("day")).distinct()
    stream = days.select("repo", "day", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("v")).unionByName(
        releases.select("repo", F.col("date").alias("day"), F.lit(1).alias("kind"), F.col("version").alias("v"))
    )
    # on the same day the task row sorts before the release: only older releases count
    w = Window.partitionBy("repo").orderBy("day", "kind", "v")
    return stream.select("repo", "day", "kind", value.over(w).alias("version")).filter("kind = 0").drop("kind")


def _attach(tasks: DataFrame, days: DataFrame, keep_old: bool = False) -> DataFrame:
    found = days.select("repo", F.col("day").alias("_day"), F.col("version").alias("_found"))
    version = F.coalesce("_found", "version") if keep_old else F.col("_found")
    return tasks.withColumn("_day", F.substring_index("created_at", "T", 1)).join(found, ["repo", "_day"], "left").select(
        *[c for c in tasks.columns if c != "version"], version.alias("version")
    )


def asof_release(tasks: DataFrame, releases: DataFrame, fallback: str = "null") -> DataFrame:
    """Version of the newest release before the creation day.

    ``fallback`` for tasks older than every release: 'null', 'earliest' (the oldest
    release) or 'keep' (the version the task already has).
    """
    days = _as_of(tasks, releases, F.last("v", ignorenulls=True))
    if fallback == "earliest":
        oldest = releases.groupBy("repo").agg(F.min_by("version", F.struct("date", "version")).alias("_old"))
        days = days.join(oldest, "repo", "left").select("repo", "day", F.coalesce("version", "_old").alias("version"))
    return _attach(tasks, days, keep_old=fallback == "keep" and "version" in tasks.columns)


def asof_by_version(tasks: DataFrame, releases: DataFrame) -> DataFrame:
    """Highest version, compared as text, whose last release is before the creation day.

    Tasks older than every release get the lowest version. The highest version over a
    growing set of releases is a running maximum, so no range join is needed.
    """
    cutoffs = releases.groupBy("repo", "version").agg(F.max("date").alias("date"))
    days = _as_of(tasks, cutoffs, F.max("v"))
    lowest = releases.groupBy("repo").agg(F.min("version").alias("_low"))
    days = days.join(lowest, "repo", "left").select("repo", "day", F.coalesce("version", "_low").alias("version"))
    return _attach(tasks, days)


# Release anchors of documentation pages and release titles.
DOC_ANCHOR = r'<a class="reference internal nav-link( active)?" href="#v(.*)">v(.*) \((.*)\)</a>'
CHANGELOG_ANCHOR = r'<a class="reference internal nav-link" href="#version-(.*)">Version (.*)</a>'
NOTES_ANCHOR = r'<a class="reference internal" href="prev_whats_new/whats_new_(.*).html">What\'s new in Matplotlib (.*)</a>'
TITLE_DATED = r"\[[\d\.\w]*\] - \d*-\d*-\d*"
TITLE_PLAIN = r"\d\.\d\.[\d\.]*"
TITLE_PREFIXES = ("SQLFluff ", "Bugfix Release ")


def first_date(text: Column, formats: tuple[str, ...]) -> Column:
    """ISO date by the first format that parses, else null."""
    return F.coalesce(*[F.date_format(F.try_to_timestamp(text, F.lit(f)), "yyyy-MM-dd") for f in formats])


def releases_from_docs(pages: DataFrame, html: str = "html") -> DataFrame:
    """(repo, date, version) from anchors like ``#v0-16-0-january-2-2021``."""
    refs = pages.select("repo", F.explode(tx.find_all(F.col(html), DOC_ANCHOR, 2)).alias("ref")).distinct()
    parts = F.split("ref", "-")
    version = F.concat_ws(".", F.slice(parts, 1, 2))
    date = first_date(
        F.initcap(F.array_join(F.slice(parts, F.lit(4), F.size(parts)), " ")), ("MMMM d yyyy", "d MMMM yyyy")
    )
    return refs.select("repo", date.alias("date"), version.alias("version")).filter("date IS NOT NULL").distinct()


def releases_from_changelog(pages: DataFrame, html: str = "html") -> DataFrame:
    """(repo, date, version) from anchors like ``Version 4.3.1 (2021-08-11)``."""
    refs = pages.select("repo", F.explode(tx.find_all(F.col(html), CHANGELOG_ANCHOR, 2)).alias("t")).distinct()
    parts = F.split("t", " ")
    date = first_date(F.btrim(F.get(parts, F.lit(1)), F.lit("()")), ("yyyy-MM-dd",))
    return refs.select("repo", date.alias("date"), _first_two(F.get(parts, F.lit(0)), ".").alias("version")).filter(
        "date IS NOT NULL").distinct()


def releases_from_notes(pages: DataFrame, html: str = "html") -> DataFrame:
    """(repo, date, version) from anchors like ``What's new in Matplotlib 3.4.0 (Mar 26, 2021)``."""
    found = F.arrays_zip(
        tx.find_all(F.col(html), NOTES_ANCHOR, 1).alias("v"), tx.find_all(F.col(html), NOTES_ANCHOR, 2).alias("t"))
    refs = pages.select("repo", F.explode(found).alias("m")).select("repo", "m.*").distinct()
    date = first_date(F.regexp_extract("t", r"\((.*?)\)", 1), ("MMM d, yyyy",))
    return refs.select("repo", date.alias("date"), _first_two(F.col("v"), ".").alias("version")).filter(
        "date IS NOT NULL").distinct()


def releases_from_titles(releases: DataFrame) -> DataFrame:
    """(repo, date, version), last date per version, from release titles (repo, name, published_at)."""
    name = F.regexp_replace("name", f"^{TITLE_PREFIXES[0]}", "")
    dated, plain = name.rlike(tx.rx(TITLE_DATED)), name.rlike(tx.rx(TITLE_PLAIN))
    head = F.translate(F.substring_index(name, " - ", 1), "[]", "")
    raw = F.when(dated, head).when(plain, F.regexp_extract(name, tx.rx(TITLE_PLAIN), 0))
    version = F.regexp_replace(F.regexp_replace(raw, r"\.[^.]*$", ""), f"^{TITLE_PREFIXES[1]}", "")
    date = F.when(dated, F.get(F.split(name, " - "), F.lit(1))).otherwise(F.col("published_at"))
    return releases.select("repo", version.alias("version"), date.alias("date")).filter("version IS NOT NULL").groupBy(
        "repo", "version").agg(F.max("date").alias("date"))


def version_groups(instances: DataFrame) -> DataFrame:
    """Size and id range of each (repo, version); the members are the instances themselves."""
    return instances.groupBy("repo", "version").agg(
        F.count(F.lit(1)).alias("n"), F.min("instance_id").alias("first_id"), F.max("instance_id").alias("last_id")
    )


def version_coalesce(instances: DataFrame, from_files: DataFrame, from_calendar: DataFrame) -> DataFrame:
    """(instance_id, version, source): the file version where there is one, else the calendar's."""
    by_file = from_files.select("repo", "base_commit", F.col("version").alias("_f"))
    by_date = from_calendar.select("instance_id", F.col("version").alias("_c"))
    return (
        instances.select("instance_id", "repo", "base_commit")
        .join(by_file, ["repo", "base_commit"], "left").join(by_date, "instance_id", "left")
        .select("instance_id", F.coalesce("_f", "_c").alias("version"),
                F.when(F.col("_f").isNotNull(), "files").when(F.col("_c").isNotNull(), "calendar").otherwise("none").alias("source"))
    )


def balanced_split(rows: DataFrame, order: list, n: int) -> DataFrame:
    """Add ``chunk``: n contiguous chunks of the total order, sizes differing by at most one."""
    indexed = with_row_index(rows, order, "_i", total="_t")
    return indexed.withColumn("chunk", chunk_of(F.col("_i"), F.col("_t"), n)).drop("_i", "_t")
