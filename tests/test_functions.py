"""Order, join and text helpers; the hot-key cases."""

import random
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from patchloom.functions import text as tx, tokens as tk
from patchloom.functions.joins import salted_join
from patchloom.functions.order import chunk_of, with_row_index, with_running_sum
from patchloom.plans.catalog import prompting


def test_row_index_is_the_total_order(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, 5), i) for i in range(5000)]
    df = spark.createDataFrame(rows, "n int, id int").repartition(16)
    got = [(r["n"], r["id"], r["i"], r["t"]) for r in with_row_index(df, ["n", "id"], "i", total="t").collect()]
    assert sorted(got, key=lambda r: r[2]) == [(n, i, k, 5000) for k, (n, i) in enumerate(sorted(rows))]


def test_chunks_differ_by_at_most_one(spark):
    for total, n in ((10, 3), (3, 5), (7, 7), (20, 6)):
        chunks = [r[0] for r in spark.range(total).select(chunk_of(F.col("id"), F.lit(total), n)).collect()]
        sizes = [total // n + (i < total % n) for i in range(n)]
        assert chunks == [i for i, s in enumerate(sizes) for _ in range(s)]


def test_running_sum_of_a_hot_key(spark):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randint(0, 20)}", i, rng.randint(0, 9)) for i in range(6000)]
    out = with_running_sum(spark.createDataFrame(rows, "k string, i int, v int"), ["k"], ["i"], "v", "s")
    seen, want = {}, {}
    for k, i, v in rows:
        want[i] = seen.get(k, 0)
        seen[k] = want[i] + v
    assert {r["i"]: r["s"] for r in out.collect()} == want


def test_salted_join_of_a_hot_key(spark):
    big = spark.createDataFrame([("hot" if i % 3 else f"k{i % 40}", i) for i in range(4000)], "k string, i int")
    side = spark.createDataFrame([("hot", 1), ("hot", 2), ("k3", 3), ("none", 4)], "k string, v int")
    got = sorted(tuple(r) for r in salted_join(big, side, ["k"], ["i"], rows_per_slice=100).collect())
    assert got == sorted(tuple(r) for r in big.join(side, "k").collect())


def test_python_text_rules(spark):
    samples = ["", "  a  b\u00a0c\x1cd ", "\u2028x\u3000", "\x85", "é\tö\x0b", "one", " one", "a\x1f b"]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    rows = df.select("s", tx.strip(F.col("s")).alias("strip"), tx.words(F.col("s")).alias("words"),
                     tx.word(F.col("s"), 0).alias("w0"), tx.word(F.col("s"), 1).alias("w1"), tx.word_count(F.col("s")).alias("n")).collect()
    for r in rows:
        w = r["s"].split()
        assert (r["strip"], r["words"], r["n"]) == (r["s"].strip(), w, len(w))
        assert (r["w0"], r["w1"]) == (w[0] if w else None, w[1] if len(w) > 1 else None)


def test_after_first(spark):
    df = spark.createDataFrame([("a/b/a/c",), ("x",), ("/dev/null",)], "s string")
    assert [r[0] for r in df.select(tx.after_first(F.col("s"), "a/")).collect()] == ["b/a/c", "x", "/dev/null"]


def test_documents_are_tokenized_once(spark, tmp_path, monkeypatch):
    """Neither the vocabulary nor the ids read the texts again."""
    spark.createDataFrame([(i, f"a b {i}") for i in range(30)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    calls = spark.sparkContext.accumulator(0)

    def split(text):
        calls.add(1)
        return text.split(" ")

    # deterministic ones may be run again by the optimizer
    monkeypatch.setitem(tk.TOKENIZERS, "regex", F.udf(split, "array<string>").asNondeterministic())
    ids = prompting._ids(spark, str(tmp_path))
    assert sorted(tuple(r["input_ids"][:2]) for r in ids.collect()) == [(0, 1)] * 30
    assert calls.value == 30


def _token_docs():
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["the", ",", f"w{rng.randint(0, 60)}", "é!"]) for _ in range(rng.randint(0, 40)))) for i in range(120)]
    return [*rows, (1000, None), (1001, ""), (1002, " ")]


def test_token_ids_by_chunks(spark, monkeypatch):
    rows = _token_docs()
    found = {i: re.findall(tk.TOKEN, t or "") for i, t in rows}
    counts = Counter(w for ws in found.values() for w in ws)
    ids = {w: i for i, w in enumerate(sorted(counts, key=lambda w: (-counts[w], w)))}
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(2)
    for most in (1, 300, 10**6):
        monkeypatch.setattr(tk, "CHUNK_TOKENS", most)
        made = tk.coded(docs, "doc_id")
        # a token has one row in a chunk, however often it occurs there
        assert made.words.groupBy("_of", "token").count().filter("count > 1").isEmpty()
        assert made.rows.select("_chunk").distinct().count() == (len(rows) if most == 1 else 2 if most == 10**6 else made.words.select("_of").distinct().count())
        vocab = tk.vocabulary(made)
        assert {r["token"]: (r["n"], r["id"]) for r in vocab.collect()} == {w: (counts[w], ids[w]) for w in counts}
        got = tk.token_ids(made, vocab, "doc_id").collect()
        assert len(got) == len(rows) and {r["doc_id"]: r["input_ids"] for r in got} == {i: [ids[w] for w in ws] for i, ws in found.items()}
    plain = tk.vocabulary(docs)
    assert sorted(map(tuple, plain.collect())) == sorted((w, counts[w], ids[w]) for w in counts)
    assert {r["doc_id"]: r["input_ids"] for r in tk.token_ids(docs, plain, "doc_id").collect()} == {i: [ids[w] for w in ws] for i, ws in found.items()}


def test_token_ids_of_repeated_keys_and_partial_vocabularies(spark):
    docs = spark.createDataFrame([("x", "a b c"), ("x", "b z"), ("y", "c a"), (None, "a"), ("n", None)], "k string, text string")
    vocab = spark.createDataFrame([("a", 5), ("b", 7), ("c", 9), ("c", 8), ("q", 1)], "token string, id long")
    got = sorted((r["k"] or "", r["input_ids"]) for r in tk.token_ids(docs, vocab, "k").collect())
    # position first: a b at 0, b at 1, c at 2 of x; z has no id and c has two
    assert got == [("", []), ("n", []), ("x", [5, 7, 7, 8, 9]), ("x", [5, 7, 7, 8, 9]), ("y", [8, 9, 5])]
    single = docs.filter("k = 'y' OR k IS NULL")
    assert sorted((r["k"] or "", r["input_ids"]) for r in tk.token_ids(single, vocab, "k").collect()) == [("", []), ("y", [8, 9, 5])]
    assert [r["input_ids"] for r in tk.token_ids(single, vocab.limit(0), "k").collect()] == [[], []]
    assert tk.token_ids(docs.limit(0), vocab, "k").count() == 0


def test_chunks_keep_every_document():
    rows = [["a"] * (i % 5) or None for i in range(50)]
    batches = [pa.RecordBatch.from_pydict({"k": pa.array(range(a, a + 25)), "t": pa.array(rows[a:a + 25], pa.list_(pa.string()))}) for a in (0, 25)]
    for most in (1, 7, 1000):
        chunks = list(tk._chunks(iter(batches), most))
        assert [x for c in chunks for x in c.column("t").to_pylist()] == rows
        assert all(sum(len(x or []) + 1 for x in c.column("t").to_pylist()[:-1]) < most for c in chunks)
