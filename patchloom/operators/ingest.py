"""Model responses → predictions: extraction, length rules, sharding, cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from patchloom.functions import text as tx
from patchloom.functions.order import chunk_of, with_row_index, with_running_sum

# How a response marks its diff.
TAGGED = r"\<([\w-]+)\>(.*?)\<\/\1\>"
FENCED = r"```(\w+)?\n(.*?)```"
DIFF_NAMES = ("diff", "patch")
END_TOKEN = "</s>"

# Context limits of models, in tokens.
MODEL_LIMITS = {
    "claude-instant-1": 100_000, "claude-2": 100_000, "claude-3-opus-20240229": 200_000,
    "claude-3-sonnet-20240229": 200_000, "claude-3-haiku-20240307": 200_000,
    "gpt-3.5-turbo-16k-0613": 16_385, "gpt-3.5-turbo-0613": 4_097, "gpt-3.5-turbo-1106": 16_385,
    "gpt-4-32k-0613": 32_768, "gpt-4-0613": 8_192, "gpt-4-1106-preview": 128_000, "gpt-4-0125-preview": 128_000,
}

# Price per token, as decimal text: input, output.
MODEL_PRICES = {
    "claude-instant-1": ("0.00000163", "0.00000551"),
    "claude-2": ("0.00001102", "0.00003268"),
    "claude-3-opus-20240229": ("0.000015", "0.000075"),
    "claude-3-sonnet-20240229": ("0.000003", "0.000015"),
    "claude-3-haiku-20240307": ("0.00000025", "0.00000125"),
    "gpt-3.5-turbo-16k-0613": ("0.0000015", "0.000002"),
    "gpt-3.5-turbo-0613": ("0.0000015", None),
    "gpt-3.5-turbo-16k": (None, "0.000002"),
    "gpt-3.5-turbo-1106": ("0.000001", "0.000002"),
    "gpt-35-turbo-0613": ("0.0000015", "0.000002"),
    "gpt-35-turbo": ("0.0000015", "0.000002"),
    "gpt-4-0613": ("0.00003", "0.00006"),
    "gpt-4-32k-0613": ("0.00006", "0.00012"),
    "gpt-4-32k": ("0.00006", "0.00012"),
    "gpt-4-1106-preview": ("0.00001", "0.00003"),
    "gpt-4-0125-preview": ("0.00001", "0.00003"),
}

TRUE_WORDS, FALSE_WORDS = ("yes", "true", "t", "y", "1"), ("no", "false", "f", "n", "0")
NULL_WORDS = ("none", "null", "")


def extract_diff(response: Column) -> Column:
    """The first diff or patch block, else the first other block, else the text before the end token."""
    def blocks(pattern: str) -> Column:
        return F.arrays_zip(
            tx.find_all(response, pattern, 1, "s").alias("name"), tx.find_all(response, pattern, 2, "s").alias("body")
        )

    found = F.concat(blocks(TAGGED), blocks(FENCED))
    is_diff = lambda b: b["name"].isin(*DIFF_NAMES)
    first_diff = F.get(F.filter(found, is_diff), F.lit(0))["body"]
    return F.coalesce(first_diff, F.get(found, F.lit(0))["body"], F.substring_index(response, END_TOKEN, 1))


def length_filter(rows: DataFrame, n: Column, min_len: int | None = None, max_len: int | None = None) -> DataFrame:
    """Rows with ``min_len <= n < max_len``."""
    if min_len is not None:
        rows = rows.filter(n >= min_len)
    return rows if max_len is None else rows.filter(n < max_len)


def model_table(spark) -> DataFrame:
    """(model, max_tokens, cost_in, cost_out): the fixed limits and prices."""
    names = sorted({*MODEL_LIMITS, *MODEL_PRICES})
    rows = [(m, MODEL_LIMITS.get(m), *MODEL_PRICES.get(m, (None, None))) for m in names]
    return spark.createDataFrame(rows, "model string, max_tokens long, cost_in string, cost_out string").select(
        "model", "max_tokens", F.col("cost_in").cast("decimal(18,10)").alias("cost_in"),
        F.col("cost_out").cast("decimal(18,10)").alias("cost_out"),
    )


def context_limit(rows: DataFrame, models: DataFrame) -> DataFrame:
    """Rows (model, n_tokens) that fit their model's context, and with an ``error`` those of unknown models."""
    known = rows.join(models.select("model", "max_tokens"), "model", "left")
    return known.filter(F.col("max_tokens").isNull() | F.col("n_tokens").isNull() | (F.col("n_tokens") <= F.col("max_tokens"))).withColumn(
        "error", F.when(F.col("max_tokens").isNull(), F.lit("unknown model"))).drop("max_tokens")


def short_first(rows: DataFrame, length: str, key: str) -> DataFrame:
    """Add ``position``: 0-based rank by length, then id."""
    return with_row_index(rows, [length, key], "position")


def shard_contiguous(rows: DataFrame, length: str, key: str, n: int) -> DataFrame:
    indexed = with_row_index(rows, [length, key], "position", total="_t")
    return indexed.withColumn("shard", chunk_of(F.col("position"), F.col("_t"), n)).drop("_t")


def shard_modulo(rows: DataFrame, length: str, key: str, n: int) -> DataFrame:
    return with_row_index(rows, [length, key], "position").withColumn("shard", F.col("position") % n)


def existing_ids(lines: DataFrame, line: str = "value") -> DataFrame:
    """Ids in earlier output lines; lines that are no JSON or have no id are ignored."""
    return lines.select(F.get_json_object(line, "$.instance_id").alias("instance_id")).filter(
        F.col("instance_id").isNotNull()).distinct()


def subset(rows: DataFrame, ids: DataFrame | None = None, limit: int | None = None, order: list | None = None) -> DataFrame:
    if ids is not None:
        rows = rows.join(ids.select("instance_id").distinct(), "instance_id", "left_semi")
    return rows if limit is None else rows.orderBy(*(order or ["instance_id"])).limit(limit)


def estimate_text_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 3) + 32)


def estimate_chat_tokens(messages: DataFrame, key: str, content: str = "text") -> DataFrame:
    """(key, n_tokens) of chats given one message per row."""
    chars = F.sum(F.length(F.coalesce(content, F.lit(""))))
    return messages.groupBy(key).agg(
        F.greatest(F.lit(1), F.floor(chars / 3) + 16 + 4 * F.count(F.lit(1))).alias("n_tokens")
    )


def output_budget(prompt: Column, max_new: Column, context: Column, margin: int = 0) -> Column:
    """Tokens that may still be produced; null when the prompt leaves no room."""
    rest = context - prompt - margin
    wish = max_new > 0
    return (
        F.when(context.isNull(), F.when(wish, max_new).otherwise(200))
        .when(rest <= 0, None)
        .when(wish, F.least(max_new, rest))
        .otherwise(rest)
    )


def skip_summary(budgets: DataFrame, dims: list[str]) -> DataFrame:
    """Skipped rows (null ``budget``) and their share."""
    skipped = F.count_if(F.col("budget").isNull())
    return budgets.groupBy(*dims).agg(
        F.count(F.lit(1)).alias("total"), skipped.alias("skipped"),
        F.round(100.0 * skipped / F.count(F.lit(1)), 6).alias("percent"),
    )


def repeat_start(items: Column, window: int, least: int) -> Column:
    """0-based start of the first window with fewer than ``least`` distinct items, or null.

    Every window holds a whole aligned block of half its length, so only windows around
    a poor block are looked at. Ordinary text has none, and costs one pass.
    """
    half = max(window // 2, 1)
    none = F.array().cast("array<int>")
    few = lambda a: F.size(F.array_distinct(a)) < least

    def find(it: Column) -> Column:
        n = F.size(it)
        n_blocks = F.floor(n / half).cast("int")
        blocks = F.when(n_blocks > 0, F.sequence(F.lit(0), n_blocks - 1)).otherwise(none)
        poor = F.filter(blocks, lambda b: few(F.slice(it, b * half + 1, half)))

        def around(b: Column) -> Column:
            low, high = F.greatest(b * half - (window - half), F.lit(0)), F.least(b * half, n - window)
            return F.when(low <= high, F.sequence(low, high)).otherwise(none)

        starts = F.array_distinct(F.flatten(F.transform(poor, around)))
        return F.array_min(F.filter(starts, lambda s: few(F.slice(it, s + 1, window))))

    # the one-item array names the items, so they are made once and not per block
    return F.get(F.transform(F.array(items), find), F.lit(0))


def truncate_on_repeat(text: Column, window: int = 100, min_unique: int = 10) -> Column:
    """Text before the first window of characters with fewer than ``min_unique`` different ones."""
    if window <= 0 or min_unique <= 0:
        return text
    start = repeat_start(F.filter(F.split(text, ""), lambda c: c != ""), window, min_unique)
    return F.when(F.length(text) <= window, text).otherwise(
        F.coalesce(F.substr(text, F.lit(1), start), text)
    )


def truncate_tokens_on_repeat(ids: Column, window: int = 100, min_unique: int = 10) -> Column:
    """Token flavour: at most ``min_unique`` different tokens stop the text, at the end of the window."""
    start = repeat_start(ids, window, min_unique + 1)
    return F.when(start.isNull(), ids).otherwise(F.slice(ids, 1, start + window))


def costs(rows: DataFrame, models: DataFrame) -> DataFrame:
    """Rows (model, tokens_in, tokens_out) with ``cost`` as an exact decimal; without a price it is null and ``error`` says so."""
    cost = F.col("cost_in") * F.col("tokens_in").cast("decimal(10,0)") + F.col("cost_out") * F.col("tokens_out").cast("decimal(10,0)")
    return rows.join(models.select("model", "cost_in", "cost_out"), "model", "left").withColumn("cost", cost.cast("decimal(28,10)")).withColumn(
        "error", F.when(F.col("cost_in").isNull() | F.col("cost_out").isNull(), F.lit("no price"))).drop("cost_in", "cost_out")


def cost_by_model(rows: DataFrame) -> DataFrame:
    """(model, n, cost, error) per model; the cost of a model without a price is null."""
    return rows.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.sum("cost").alias("cost"), F.max("error").alias("error"))


def cost_cap(rows: DataFrame, order: list, cap: float, keys: list[str] = ["model"]) -> DataFrame:
    """Rows of each key, in order, until the running cost reaches ``cap``; the row that reaches it is kept.

    A row without a cost adds nothing and stays like the others.
    """
    summed = with_running_sum(rows, keys, order, "cost", "cost_before")
    return summed.withColumn("cost_before", F.coalesce("cost_before", F.lit(0).cast("decimal(38,10)"))).filter(F.col("cost_before") < cap)


def typed_arguments(rows: DataFrame, key: str, args: str = "args") -> DataFrame:
    """(key, name, kind, value) from 'a=1,b=x' texts, with the kind a value looks like."""
    pair = F.col("pair")
    value = F.substring_index(pair, "=", -1)
    digits = lambda c: c.rlike(r"^\p{N}+$")
    first_dot_out = F.when(
        value.contains("."), F.concat(F.substring_index(value, ".", 1), tx.after_first(value, "."))
    ).otherwise(value)
    quoted = (F.length(value) >= 2) & (
        (value.startswith("'") & value.endswith("'")) | (value.startswith('"') & value.endswith('"'))
    )
    kind = (
        F.when(value.isin("True", "False"), "bool").when(digits(value), "int").when(digits(first_dot_out), "float")
        .when(value == "None", "none").when(value == "[]", "list").when(value == "{}", "dict").otherwise("str")
    )
    shown = F.when(quoted, F.substr(value, F.lit(2), F.length(value) - 2)).when(value == "None", None).otherwise(value)
    return rows.select(key, F.explode(F.split(args, ",")).alias("pair")).select(
        key, F.substring_index(pair, "=", 1).alias("name"), kind.alias("kind"), shown.alias("value")
    )


def build_messages(rows: DataFrame, key: str, prompt: str = "text", system: str = "system_prompt") -> DataFrame:
    """(key, pos, role, content): an optional system message, then the prompt."""
    has_system = tx.strip(F.coalesce(F.col(system), F.lit(""))) != ""
    both = F.array_compact(F.array(
        F.when(has_system, F.struct(F.lit("system").alias("role"), F.col(system).alias("content"))),
        F.struct(F.lit("user").alias("role"), F.col(prompt).alias("content")),
    ))
    return rows.select(key, F.posexplode(both).alias("pos", "m")).select(key, "pos", "m.role", "m.content")


def split_system_user(prompt: Column) -> tuple[Column, Column]:
    """The first line, and the rest (null when there is no second line)."""
    parts = F.split(prompt, "\n", 2)
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1))


def normalize_flag(value: Column) -> Column:
    """struct(flag, error): a yes/no word in any case as a boolean."""
    low = F.lower(value)
    flag = F.when(low.isin(*TRUE_WORDS), True).when(low.isin(*FALSE_WORDS), False)
    return F.struct(flag.alias("flag"), F.when(flag.isNull(), F.lit("boolean value expected")).alias("error"))


def normalize_null(value: Column) -> Column:
    return F.when(F.lower(value).isin(*NULL_WORDS), None).otherwise(value)


def failure_runs(rows: DataFrame, order: list[str], abort_after: int = 5) -> DataFrame:
    """(run, first, length, aborts): runs of consecutive failures (``ok`` false) in the total order.

    The number of successes before a failure names its run.
    """
    marked = rows.withColumn("_ok", F.col("ok").cast("long"))
    numbered = with_running_sum(marked, [], order, "_ok", "run")
    return numbered.filter(~F.col("ok")).groupBy("run").agg(
        F.min(order[0]).alias("first"), F.count(F.lit(1)).alias("length")
    ).withColumn("aborts", F.col("length") >= abort_after)
