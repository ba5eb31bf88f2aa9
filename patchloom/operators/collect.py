"""Pull requests → linked issues, statements, hints → candidate task instances."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from patchloom.functions import text as tx
from patchloom.functions.order import with_row_index
from patchloom.operators import diffs as D
from patchloom.session import pin

# Words that link a pull request to an issue, and the link patterns.
LINK_WORDS = ("close", "closes", "closed", "fix", "fixes", "fixed", "resolve", "resolves", "resolved")
ISSUE_LINK = r"(\w+)\s+\#(\d+)"
HTML_COMMENT = r"<!--.*?-->"
ISSUE_URL = r"github\.com\/(.+?)\/(.+?)\/issues\/(\d+)"
REPO_LINK_WORDS = ("source", "code", "homepage")

PULL = ["repo", "number"]


def resolved_issues(pulls: DataFrame, commits: DataFrame) -> DataFrame:
    """Pull requests with ``resolved_issues``: sorted distinct issue numbers (text).

    Comments are removed from title, body and commit messages as one text, so a
    comment opened in the title can hide a link in a commit. That needs the whole text
    of a pull request in one value; the code host lists at most 250 commits of one.
    Messages that can neither hold a link, nor open or close a comment, nor end in a
    link word whose number follows in the next message, travel as a single dot.
    """
    message = F.col("message")
    matters = (
        tx.contains_any(message, ("#", "<!--", "-->")) | (tx.strip(message) == "")
        | F.lower(F.regexp_extract(message, tx.rx(rf"(\w+){tx.SPACE}*\z"), 1)).isin(*LINK_WORDS)
    )
    messages = commits.groupBy(*PULL).agg(
        tx.ordered_concat("seq", F.when(matters, message).otherwise("."), "\n").alias("_commits")
    )
    empty = F.lit("")
    text = F.concat_ws(
        "\n", F.coalesce("title", empty), F.coalesce("body", empty), F.coalesce("_commits", empty)
    )
    clean = F.regexp_replace(text, tx.rx(HTML_COMMENT, "s"), "")
    links = F.arrays_zip(
        tx.find_all(clean, ISSUE_LINK, 1).alias("word"), tx.find_all(clean, ISSUE_LINK, 2).alias("issue")
    )
    kept = F.filter(links, lambda m: F.lower(m["word"]).isin(*LINK_WORDS))
    return pulls.join(messages, PULL, "left").select(
        *pulls.columns, F.array_sort(F.array_distinct(F.transform(kept, lambda m: m["issue"]))).alias("resolved_issues")
    )


def limit_pulls(pulls: DataFrame, max_pulls: int | None = None, cutoff: str | None = None) -> DataFrame:
    """Newest pull requests of each repository; the row that trips a limit is kept.

    ``cutoff`` is YYYYMMDD. The count limit is a ranked window, which Spark cuts to
    the first rows before the shuffle; the cutoff is one aggregate per repository.
    """
    out = pulls
    if max_pulls is not None:
        w = Window.partitionBy("repo").orderBy(F.desc("created_at"), F.desc("number"))
        out = out.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= max_pulls + 1).drop("_rn")
    if cutoff is not None:
        start = datetime.strptime(cutoff, "%Y%m%d").strftime("%Y-%m-%dT%H:%M:%SZ")
        older = F.col("created_at") < start
        first_older = pulls.filter(older).groupBy("repo").agg(
            F.max(F.struct("created_at", "number")).alias("_m")
        ).select("repo", F.col("_m.number").alias("number"))
        out = out.filter(~older).unionByName(out.filter(older).join(first_older, PULL, "left_semi"))
    return out


def single_pull(pulls: DataFrame, repo: str, number: int) -> DataFrame:
    return pulls.filter((F.col("repo") == repo) & (F.col("number") == number))


def valid_pulls(pulls: DataFrame) -> DataFrame:
    return pulls.filter(F.col("merged_at").isNotNull() & (F.size("resolved_issues") > 0))


def instance_id(repo: Column, number: Column) -> Column:
    return F.concat(F.replace(repo, F.lit("/"), F.lit("__")), F.lit("-"), number)


def linked_issues(pulls: DataFrame) -> DataFrame:
    """(repo, number, pos, issue) from ``resolved_issues``."""
    return pulls.select(*PULL, F.posexplode("resolved_issues").alias("pos", "issue")).withColumn(
        "issue", F.expr("try_cast(issue AS BIGINT)")
    )


def problem_statements(pulls: DataFrame, issues: DataFrame) -> DataFrame:
    """(repo, number, problem_statement); unknown issues are skipped, empty ones still count."""
    found = linked_issues(pulls).join(
        issues.select("repo", F.col("number").alias("issue"), "title", "body"), ["repo", "issue"]
    )
    empty = F.lit("")
    piece = F.concat(F.coalesce("title", empty), F.lit("\n"), F.coalesce("body", empty), F.lit("\n"))
    text = found.groupBy(*PULL).agg(tx.ordered_concat("pos", piece, "").alias("problem_statement"))
    return pulls.select(*PULL).join(text, PULL, "left").select(
        *PULL, F.coalesce("problem_statement", empty).alias("problem_statement")
    )


def hint_comments(pulls: DataFrame, issues: DataFrame, comments: DataFrame, commits: DataFrame) -> DataFrame:
    """(repo, number, pos, issue, seq, body): comments up to the first one not older than the first commit.

    A comment counts while the latest time among it and those before it is older than the
    commit. That time is one window over an issue's comments, whatever pulls link it, so the
    comments of a popular issue are joined to its pulls once.
    """
    first_commit = commits.groupBy(*PULL).agg(F.min_by("author_date", "seq").alias("_t"))
    links = (
        linked_issues(pulls).join(issues.select("repo", F.col("number").alias("issue")), ["repo", "issue"])
        .join(first_commit, PULL)
    )
    so_far = Window.partitionBy("repo", "issue").orderBy("seq")
    timed = comments.select("repo", "issue", "seq", "body", F.max("updated_at").over(so_far).alias("_latest"))
    return links.join(timed, ["repo", "issue"]).filter(F.coalesce(F.col("_latest") < F.col("_t"), F.lit(True))).select(
        *PULL, "pos", "issue", "seq", "body")


def hints_text(pulls: DataFrame, issues: DataFrame, comments: DataFrame, commits: DataFrame) -> DataFrame:
    """(repo, number, hints_text): hints of an issue joined by newline, then issues by newline.

    An issue without hints adds an empty piece.
    """
    per_issue = hint_comments(pulls, issues, comments, commits).groupBy(*PULL, "pos").agg(
        tx.ordered_concat("seq", F.coalesce("body", F.lit("")), "\n").alias("_h")
    )
    known = linked_issues(pulls).join(issues.select("repo", F.col("number").alias("issue")), ["repo", "issue"])
    joined = known.join(per_issue, [*PULL, "pos"], "left").groupBy(*PULL).agg(
        tx.ordered_concat("pos", F.coalesce("_h", F.lit("")), "\n").alias("hints_text")
    )
    return pulls.select(*PULL).join(joined, PULL, "left").select(*PULL, F.coalesce("hints_text", F.lit("")).alias("hints_text"))


def build_instances(
    pulls: DataFrame, commits: DataFrame, issues: DataFrame, comments: DataFrame
) -> DataFrame:
    """Candidate instances with non-empty patch and statement. ``pulls`` carries ``diff``."""
    # read by four branches below: link the pull requests once
    linked = pin(valid_pulls(resolved_issues(pulls, commits)))
    files = D.diff_files(
        D.diff_lines(linked.select(F.struct(*PULL).alias("id"), F.col("diff").alias("patch"))), with_text=True
    )
    patches = D.split_patch(files).select("id.*", "patch", "test_patch")
    return (
        linked.join(patches, PULL)
        .filter(F.col("patch") != "")
        .join(problem_statements(linked, issues), PULL)
        .filter(F.col("problem_statement") != "")
        .join(hints_text(linked, issues, comments, commits), PULL)
        .select(
            "repo", F.col("number").alias("pull_number"),
            instance_id(F.col("repo"), F.col("number").cast("string")).alias("instance_id"),
            F.col("resolved_issues").alias("issue_numbers"), "base_commit", "patch", "test_patch",
            "problem_statement", "hints_text", "created_at",
        )
    )


def with_tests(instances: DataFrame) -> DataFrame:
    return instances.filter(tx.strip(F.coalesce("test_patch", F.lit(""))) != "")


def skip_seen(rows: DataFrame, seen: DataFrame, key: str = "instance_id") -> DataFrame:
    return rows.join(seen.select(key), key, "left_anti")


def collection_stats(instances: DataFrame) -> DataFrame:
    """Instances and instances with tests per repository, and in total ('ALL')."""
    tests = tx.strip(F.coalesce("test_patch", F.lit(""))) != ""
    return (
        instances.rollup("repo")
        .agg(F.count(F.lit(1)).alias("n_instances"), F.count_if(tests).alias("n_with_tests"), F.grouping("repo").alias("_g"))
        .select(F.when(F.col("_g") == 1, "ALL").otherwise(F.col("repo")).alias("repo"), "n_instances", "n_with_tests")
    )


def finetune_pool(rows: DataFrame, eval_rows: DataFrame, cap: int = 500, seed: int = 42) -> DataFrame:
    """Rows whose full ``line`` is not an evaluation line, at most ``cap`` per repository.

    The random order is the md5 of seed and line. The ranked window is cut to ``cap``
    rows per repository and task before the shuffle.
    """
    left = rows.withColumn("_h", F.xxhash64("line"))
    right = eval_rows.select(F.xxhash64("line").alias("_h"), "line").distinct()
    w = Window.partitionBy("repo").orderBy(F.md5(F.concat(F.lit(f"{seed}:"), "line")), "line")
    return (
        left.join(right, ["_h", "line"], "left_anti")
        .withColumn("_rn", F.row_number().over(w))
        .filter(F.col("_rn") <= cap)
        .drop("_h", "_rn", "line", "test_patch")
    )


def strip_tags(html: Column) -> Column:
    """Text of an HTML fragment: tags out, the five basic entities decoded."""
    text = F.regexp_replace(html, r"(?s)<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def ticket_title(html: Column) -> Column:
    inner = F.regexp_extract(html, r"(?s)<h1[^>]*>(.*?)</h1>", 1)
    return tx.strip(F.regexp_replace(strip_tags(inner), tx.rx(tx.SPACE + "+"), " "))


def ticket_body(html: Column) -> Column:
    """Blank lines merged, four spaces to a tab, other runs of spaces to one."""
    text = strip_tags(F.regexp_extract(html, r"(?s)<article>(.*?)</article>", 1))
    text = F.regexp_replace(text, r"\n+", "\n")
    text = F.replace(text, F.lit("    "), F.lit("\t"))
    return tx.strip(F.regexp_replace(text, " {2,}", " "))


def ticket_time(stamp: Column) -> Column:
    """Time of a ticket comment in either of its two notations, else null."""
    bare = F.regexp_replace(stamp, "^See timeline at ", "")
    # two-digit years: 69 and later belong to the last century
    full_year = F.regexp_replace(F.regexp_replace(bare, r"/(69|[7-9]\d) ", "/19$1 "), r"/(\d\d) ", "/20$1 ")
    return F.when(bare.contains("/"), F.try_to_timestamp(full_year, F.lit("M/d/yyyy H:mm:ss"))).when(
        bare.contains(","), F.try_to_timestamp(bare, F.lit("MMM d, yyyy, h:mm:ss a"))
    )


def ticket_hints(links: DataFrame, comments: DataFrame, first_commit: DataFrame) -> DataFrame:
    """Ticket comments older than the first commit: a filter, not a take-while."""
    return (
        links.join(comments, ["repo", "issue"]).join(first_commit, PULL)
        .withColumn("at", ticket_time(F.col("stamp")))
        .filter(F.col("at") < F.try_to_timestamp("first_commit", F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")))
        .select(*PULL, "issue", "seq", F.col("body").alias("comment"), "at")
    )


def package_links(pages: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """(rank, name, url, github, owner, repo): the first source link of each package page.

    ``seen`` holds urls written by an earlier run.
    """
    tabs = r'(?s)<a class="vertical-tabs__tab--with-icon" href="([^"]*)">(.*?)</a>'
    links = F.arrays_zip(
        F.regexp_extract_all("html", F.lit(tabs), F.lit(1)).alias("href"), F.regexp_extract_all("html", F.lit(tabs), F.lit(2)).alias("label")
    )
    good = F.filter(
        links, lambda a: tx.contains_any(F.lower(strip_tags(a["label"])), REPO_LINK_WORDS) & F.lower(a["href"]).contains("github")
    )
    ranked = with_row_index(
        pages.select("page_id", "url", F.get(good, F.lit(0))["href"].alias("github"), ticket_title(F.col("html")).alias("name")),
        ["page_id"], "rank",
    )
    if seen is not None:
        ranked = ranked.join(seen.select("url").distinct(), "url", "left_anti")
    parts = F.split("github", "/")
    return ranked.select(
        "rank", "name", "url", "github", F.try_element_at(parts, F.lit(-2)).alias("owner"), F.try_element_at(parts, F.lit(-1)).alias("repo")
    )


def parse_issue_url(url: Column) -> Column:
    """struct(owner, repo, number, error); ``error`` is set when the text holds no issue url."""
    def part(i: int) -> Column:
        return tx.group(url, ISSUE_URL, i)

    return F.struct(
        part(1).alias("owner"), part(2).alias("repo"), part(3).alias("number"),
        F.when(~url.rlike(tx.rx(ISSUE_URL)), F.lit("not an issue url")).alias("error"),
    )


def issue_texts(issues: DataFrame, comments: DataFrame, include_comments: bool = False) -> DataFrame:
    """(repo, number, text): title and body, then each comment after a 'Comment: ' line head."""
    empty = F.lit("")
    base = F.concat_ws("\n", F.coalesce("title", empty), F.coalesce("body", empty))
    if not include_comments:
        return issues.select(*PULL, base.alias("text"))
    joined = comments.groupBy("repo", F.col("issue").alias("number")).agg(
        tx.ordered_concat("seq", F.concat(F.lit("\nComment: "), F.coalesce("body", empty)), "").alias("_c")
    )
    return issues.join(joined, PULL, "left").select(*PULL, F.concat(base, F.coalesce("_c", F.lit("\n"))).alias("text"))
