"""Word and token analysis as column expressions, and a vocabulary job."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from patchloom.functions import text as tx
from patchloom.functions.order import with_row_index
from patchloom.session import pin

WORD = r"\w+"
TOKEN = r"\w+|[^\w\s]"
NEWLINE_TOKEN = 13
CHUNK_TOKENS = 4_000_000  # a task holds the tokens of one chunk, or of one document that has more

Tokenizer = Callable[[Column], Column]


def analyse(text: Column) -> Column:
    """Lower-case words, the terms of the ranking function."""
    return tx.find_all(F.lower(text), WORD)


def tokens(text: Column) -> Column:
    """Words and single punctuation marks."""
    return tx.find_all(text, TOKEN)


def token_count(text: Column) -> Column:
    return F.size(tokens(text))


# Tokenizers by name: text column → array of token strings. Register own ones here, for
# instance a pandas UDF around a model's tokenizer.
TOKENIZERS: dict[str, Tokenizer] = {"regex": tokens, "words": analyse}


@dataclass(frozen=True)
class Coded:
    """Documents whose tokens are numbered within chunks of documents, stored by ``coded``.

    ``rows``: (_chunk, key, _codes), one per document. ``words``: (_of, _code, token, n), one
    per distinct token of a chunk, so a frequent token has one row a chunk and fills no task.
    """

    rows: DataFrame
    words: DataFrame


def _lengths(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Tables (key, tokens) that end with the document in which they reach ``most`` tokens and documents."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        sizes = _lengths(batch.column(1))
        start = 0
        for end, n in enumerate(sizes.tolist(), 1):
            size += n + 1  # a document without tokens takes room too
            if size >= most:
                yield pa.Table.from_batches([*held, batch.slice(start, end - start)])
                held, start, size = [], end, 0
        if start < batch.num_rows:
            held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def coded(docs: DataFrame, key: str, text: str = "text", tokenizer: str = "regex") -> Coded:
    """Tokenize each document once and keep it as numbers of its chunk's distinct tokens."""
    most = CHUNK_TOKENS
    schema = StructType([
        StructField("_chunk", LongType()), StructField(key, docs.schema[key].dataType), StructField("_codes", ArrayType(IntegerType())),
        StructField("_code", IntegerType()), StructField("_token", StringType()), StructField("_n", LongType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 33
        for i, table in enumerate(_chunks(batches, most)):
            keys, lists = (table.column(c).combine_chunks() for c in (0, 1))
            borders = pa.array(np.concatenate([[0], np.cumsum(_lengths(lists))]), pa.int32())
            flat = lists.flatten().dictionary_encode(null_encoding="encode")
            words, codes = flat.dictionary, flat.indices
            rows, distinct = len(keys), len(words)
            n = np.bincount(codes.to_numpy(), minlength=distinct)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(rows, part + i)), keys, pa.ListArray.from_arrays(borders, codes),
                pa.nulls(rows, pa.int32()), pa.nulls(rows, words.type), pa.nulls(rows, pa.int64()),
            ], names=schema.names)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(distinct, part + i)), pa.nulls(distinct, keys.type), pa.nulls(distinct, pa.list_(pa.int32())),
                pa.array(np.arange(distinct, dtype=np.int32)), words, pa.array(n, pa.int64()),
            ], names=schema.names)

    found = docs.select(key, TOKENIZERS[tokenizer](F.col(text)).alias("_tokens")).mapInArrow(run, schema)
    stored = pin(found)
    return Coded(
        stored.filter(F.col("_code").isNull()).select("_chunk", key, "_codes"),
        stored.filter(F.col("_code").isNotNull()).select(F.col("_chunk").alias("_of"), "_code", F.col("_token").alias("token"), F.col("_n").alias("n")),
    )


def vocabulary(docs: DataFrame | Coded, text: str = "text", tokenizer: str = "regex") -> DataFrame:
    """(token, n, id): dense ids by falling count, then token."""
    if isinstance(docs, Coded):
        counts = docs.words.groupBy("token").agg(F.sum("n").alias("n"))
    else:
        counts = docs.select(F.explode(TOKENIZERS[tokenizer](F.col(text))).alias("token")).groupBy("token").agg(
            F.count(F.lit(1)).alias("n")
        )
    return with_row_index(counts, [F.desc("n"), F.col("token")], "id")


def _decode(rows: pa.Table, words: pa.Table, places: bool) -> pa.Table:
    """(key, _ids, _at) of a chunk; ``words``: ids of its codes, of which a vocabulary may hold several or none.

    ``_at``: places of the ids in the token list, null unless ``places``.
    """
    key, lists = rows.column(1), rows.column("_codes").combine_chunks()
    words = words.sort_by([("_code", "ascending"), ("id", "ascending")])
    codes = lists.flatten().to_numpy()
    known = np.bincount(words.column("_code").to_numpy(), minlength=int(codes.max(initial=-1)) + 1)
    n = known[codes]
    ends = np.concatenate([[0], np.cumsum(n)])
    found = np.repeat((np.cumsum(known) - known)[codes] - ends[:-1], n) + np.arange(ends[-1])
    ids = words.column("id").combine_chunks().take(pa.array(found))
    starts = np.concatenate([[0], np.cumsum(_lengths(lists))])
    borders = pa.array(ends[starts], pa.int32())
    at = pa.nulls(len(lists), pa.list_(pa.int32()))
    if places:
        place = np.arange(len(codes)) - np.repeat(starts[:-1], np.diff(starts))
        at = pa.ListArray.from_arrays(borders, pa.array(np.repeat(place, n), pa.int32()))
    return pa.table({rows.column_names[1]: key, "_ids": pa.ListArray.from_arrays(borders, ids), "_at": at})


def token_ids(docs: DataFrame | Coded, vocab: DataFrame, key: str, text: str = "text", tokenizer: str = "regex") -> DataFrame:
    """(key, input_ids) for each document; rows that share a key share the ids of all of them, by position.

    Tokens meet the vocabulary once per chunk, not once per occurrence, and ids are then set
    in place chunk by chunk: the tokens themselves are neither joined nor sorted.
    """
    made = docs if isinstance(docs, Coded) else coded(docs, key, text, tokenizer)
    shared = bool(made.rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").take(1))
    words = made.words.join(vocab.select("token", F.col("id").cast("int").alias("id")), "token").select("_of", "_code", "id")
    schema = StructType([made.rows.schema[key], StructField("_ids", ArrayType(IntegerType())), StructField("_at", ArrayType(IntegerType()))])
    ids = made.rows.groupBy("_chunk").cogroup(words.groupBy("_of")).applyInArrow(lambda rows, found: _decode(rows, found, shared), schema)
    none = F.array().cast("array<int>")
    if not shared:
        return ids.select(key, F.when(F.col(key).isNull(), none).otherwise(F.col("_ids")).alias("input_ids"))
    merged = ids.groupBy(key).agg(
        F.transform(F.array_sort(F.flatten(F.collect_list(F.arrays_zip("_at", "_ids")))), lambda s: s["_ids"]).alias("_ids")
    )
    return made.rows.select(key).join(merged, key, "left").select(key, F.coalesce("_ids", none).alias("input_ids"))
