"""Prompts: file text, templates, token budgets, data splits, training labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from patchloom.functions import text as tx
from patchloom.operators import prompt_texts as P
from patchloom.operators.diffs import is_test_path

IGNORED_LABEL = -100
WINDOW_MARGIN = 15


def number_lines(content: Column) -> Column:
    """Each line after its number, from 1."""
    return F.array_join(_numbered(content), "\n")


def _numbered(content: Column) -> Column:
    return F.transform(tx.lines(content), lambda s, i: F.concat((i + 1).cast("string"), F.lit(" "), s))


def file_block(path: Column, content: Column, numbered: bool = True) -> Column:
    body = number_lines(content) if numbered else content
    return F.concat(F.lit("[start of "), path, F.lit("]\n"), body, F.lit("\n[end of "), path, F.lit("]\n"))


def with_blocks(files: DataFrame, numbered: bool = True) -> DataFrame:
    """Snapshot files with their prompt block: formatted once per file, not once per instance that shows it."""
    return files.withColumn("block", file_block(F.col("path"), F.col("content"), numbered))


def code_text(files: DataFrame, keys: list[str], numbered: bool = True) -> DataFrame:
    """(keys, code_text): file blocks in the order of their paths.

    A ``block`` column made by :func:`with_blocks` is used as it is.
    """
    block = F.col("block") if "block" in files.columns else file_block(F.col("path"), F.col("content"), numbered)
    return files.groupBy(*keys).agg(F.btrim(tx.ordered_concat("path", block, ""), F.lit("\n")).alias("code_text"))


def code_text_edits(files: DataFrame, hunks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, code_text): only the lines around each hunk (keys, path, hunk_no, source_start, source_len).

    A window starts ``WINDOW_MARGIN`` lines before its hunk, at the first line at the
    earliest; '...' marks text left out.
    """
    lines = F.col("lines")
    start = F.col("source_start") - WINDOW_MARGIN
    end = start + F.col("source_len") + WINDOW_MARGIN
    first = F.greatest(start, F.lit(0))
    part = F.slice(lines, (first + 1).cast("int"), F.greatest(end - first, F.lit(0)).cast("int"))
    window = F.concat(
        F.when(start > 0, "...\n").otherwise(""), F.array_join(part, "\n"), F.lit("\n"),
        F.when(end < F.size(lines), "...\n").otherwise(""),
    )
    shown = files.select(*keys, "path", _numbered(F.col("content")).alias("lines")).join(
        hunks.select(*keys, "path", "hunk_no", "source_start", "source_len"), [*keys, "path"], "left"
    )
    per_file = shown.groupBy(*keys, "path").agg(
        tx.ordered_concat("hunk_no", F.when(F.col("hunk_no").isNotNull(), window).otherwise(""), "").alias("body")
    )
    block = F.concat(
        F.rtrim(F.concat(F.lit("[start of "), "path", F.lit("]\n"), "body"), F.lit("\n")),
        F.lit("\n[end of "), "path", F.lit("]\n"),
    )
    return per_file.groupBy(*keys).agg(F.btrim(tx.ordered_concat("path", block, ""), F.lit("\n")).alias("code_text"))


def _style_2(statement: Column, readmes: Column, code: Column) -> list:
    return [P.PREMISE, "<issue>", statement, "</issue>", "<code>", readmes, code, "</code>",
            P.ASK_PATCH_FOLLOWING, "<patch>", P.PATCH_EXAMPLE, "</patch>"]


def _style_3(statement: Column, readmes: Column, code: Column) -> list:
    return [P.PREMISE, "<issue>", statement, "</issue>", "", "<code>", readmes, code, "</code>", "",
            P.EXPLAIN_PATCH, "<patch>", P.PATCH_EXAMPLE, "</patch>", "", P.ASK_PATCH_ABOVE, "Respond below:"]


def _full_files(statement: Column, readmes: Column, code: Column) -> list:
    return [P.PREMISE, "<issue>", statement, "</issue>", "<code>", readmes, code, "</code>",
            P.ASK_FULL_FILES, "<example>", P.FULL_GENERATION_EXAMPLE, "</example>"]


# Prompt styles by name: (statement, readme text, code text) → lines. Only
# full_file_gen shows files without line numbers; style-2-edits-only expects
# code text from code_text_edits.
PROMPT_STYLES = {
    "style-2": _style_2,
    "style-3": _style_3,
    "full_file_gen": _full_files,
    "style-2-edits-only": _style_2,
}


def render_prompt(style: str, statement: Column, readmes: Column, code: Column) -> Column:
    parts = PROMPT_STYLES[style](statement, readmes, code)
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("")) for p in parts])


def prompts(instances: DataFrame, readmes: DataFrame, code: DataFrame, style: str, keys: list[str]) -> DataFrame:
    """Instances with ``text_inputs``; ``readmes`` and ``code`` hold keys + code_text."""
    joined = instances.join(readmes.select(*keys, F.col("code_text").alias("_r")), keys, "left").join(
        code.select(*keys, F.col("code_text").alias("_c")), keys, "left"
    )
    text = render_prompt(style, F.col("problem_statement"), F.col("_r"), F.col("_c"))
    return joined.withColumn("text_inputs", text).drop("_r", "_c")


def context_files(
    source: str, instances: DataFrame, files: DataFrame,
    oracle: DataFrame | None = None, hits: DataFrame | None = None, k: int = 20,
) -> DataFrame:
    """(instance_id, rank, path, content) of the files a prompt shows, and ``block`` if the files have it.

    ``source``: 'oracle' (files of the gold patch: instance_id, path), 'bm25' (hits:
    instance_id, rank, docid), 'all' (every Python file outside tests) or 'none'.
    """
    snap = instances.select("instance_id", "repo", F.col("base_commit").alias("commit"))
    shown_columns = ["path", "content", *(c for c in ("block",) if c in files.columns)]
    if source == "oracle":
        chosen = snap.join(oracle.select("instance_id", "path"), "instance_id").withColumn("rank", F.lit(0))
        return chosen.join(files, ["repo", "commit", "path"]).select("instance_id", "rank", *shown_columns)
    if source == "bm25":
        chosen = snap.join(
            hits.filter(F.col("rank") <= k).select("instance_id", "rank", F.col("docid").alias("path")), "instance_id"
        )
        return chosen.join(files, ["repo", "commit", "path"]).select("instance_id", "rank", *shown_columns)
    if source == "all":
        shown = files.filter(F.col("path").endswith(".py") & ~is_test_path(F.col("path")))
        return snap.join(shown, ["repo", "commit"]).select("instance_id", F.lit(0).alias("rank"), *shown_columns)
    if source == "none":
        return snap.join(files, ["repo", "commit"]).filter(F.lit(False)).select(
            "instance_id", F.lit(0).alias("rank"), *shown_columns)
    raise ValueError(f"unknown file source {source}")


def check_source_arguments(source: str, max_len: int | None = None, k: int | None = None, tokenizer: str | None = None) -> None:
    if max_len is not None and tokenizer is None:
        raise ValueError("a token budget needs a tokenizer")
    if source in ("all", "oracle") and (max_len is not None or k is not None):
        raise ValueError(f"source {source} takes neither a token budget nor k")


def pack_budget(ranked: DataFrame, base: DataFrame, max_len: int, key: str = "instance_id") -> DataFrame:
    """(key, used, files): ranked files that fit the budget, smaller later ones included.

    ``ranked`` has key, rank, docid and n (tokens), at most the k hits of retrieval per
    key; ``base`` has key and base (tokens without files). A file fits while the sum
    stays strictly below ``max_len``; one that does not fit is passed over.
    """
    hits = ranked.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "docid", "n"))).alias("_h"))
    state = F.struct(F.col("base").cast("long").alias("used"), F.array().cast("array<string>").alias("files"))

    def take(acc: Column, h: Column) -> Column:
        fits = acc["used"] + h["n"] < max_len
        return F.struct(
            F.when(fits, acc["used"] + h["n"]).otherwise(acc["used"]).alias("used"),
            F.when(fits, F.concat(acc["files"], F.array(h["docid"]))).otherwise(acc["files"]).alias("files"),
        )

    joined = base.join(hits, key, "left").withColumn(
        "_r", F.aggregate(F.coalesce("_h", F.array().cast("array<struct<rank:int,docid:string,n:int>>")), state, take)
    )
    return joined.select(key, "_r.used", "_r.files")


TEXT_COLUMNS = [
    "instance_id", "text", "repo", "base_commit", "problem_statement", "hints_text", "created_at", "patch",
    "test_patch", "version", "FAIL_TO_PASS", "PASS_TO_PASS", "environment_setup_commit",
]


def text_dataset(rows: DataFrame, split: DataFrame) -> DataFrame:
    """Rows with text and patch, limited to the ids of the split; other nulls become ''."""
    kept = rows.filter(F.col("text_inputs").isNotNull() & F.col("patch").isNotNull()).join(
        split.select("instance_id"), "instance_id", "left_semi"
    )
    text = F.concat(tx.strip(F.col("text_inputs")), F.lit("\n\n"))
    patch = F.concat(F.lit("<patch>\n"), "patch", F.lit("\n</patch>"))
    done = kept.withColumns({"text": text, "patch": patch})
    return done.select(*[
        F.coalesce(F.col(c), F.lit("")).alias(c) if c in done.columns else F.lit("").alias(c) for c in TEXT_COLUMNS
    ])


def train_eval_split(raw: DataFrame, evaluation: DataFrame) -> DataFrame:
    """Both sets with a ``split`` column; training keeps only repositories that evaluation lacks."""
    train = raw.join(evaluation.select("repo").distinct(), "repo", "left_anti").withColumn("split", F.lit("train"))
    return train.unionByName(evaluation.withColumn("split", F.lit("eval")))


def validation_split(rows: DataFrame, ratio: float = 0.01, seed: int = 42, key: str = "instance_id") -> DataFrame:
    """Add ``split`` ('validation' or 'train') by a hash of seed and id: stable and without a shuffle."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key)))
    bucket = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 1_000_000
    return rows.withColumn("split", F.when(bucket < int(ratio * 1_000_000), "validation").otherwise("train"))


def train_labels(inputs: Column, labels: Column) -> tuple[Column, Column]:
    """(input_ids, labels) for training: the label's last token is no input, and every input but the last is masked."""
    n = F.size(labels)
    ids = F.concat(inputs, F.slice(labels, 1, F.greatest(n - 1, F.lit(0))))
    mask = F.array_repeat(F.lit(IGNORED_LABEL), F.greatest(F.size(inputs) - 1, F.lit(0)))
    return ids, F.concat(mask, labels)


def eval_labels(inputs: Column, labels: Column) -> tuple[Column, Column]:
    return inputs, labels


def append_terminator(ids: Column, token: int = 13) -> Column:
    """End a row in two newline tokens when it has fewer: one token is appended."""
    tail = F.slice(ids, F.greatest(F.size(ids) - 1, F.lit(1)), 2)
    done = tail == F.array(F.lit(token), F.lit(token))
    return F.when(done, ids).otherwise(F.concat(ids, F.array(F.lit(token))))
