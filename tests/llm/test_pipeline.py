"""The pipeline's stages: order, columns, effect, and odd input; the registered queries."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from parity import compare, connect
from patchloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, score double, copies string, _k int"


def test_stages_are_the_agreed_ones():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "substring_dedup", "mix", "tokenize"]
    assert "pipeline" in __spark_entry__.queries() and set(QUERIES) <= set(__spark_entry__.queries())
    assert sorted(int(n.split("_")[0][2:]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_with_sql(spark, name):
    assert compare(spark, connect(SF), SF, name, QUERIES[name], ORACLES[name]) is None


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    good = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)]
    rows, labels = [], []
    passage = [rng.choice(good) for _ in range(60)]
    for i in range(240):
        words = [rng.choice(good) for _ in range(rng.randrange(20, 90))]
        if i % 8 == 0:
            words[3], words[9] = "idiot", "stupid"
        if i % 10 == 1:
            words += passage
        rows.append((i, " ".join(words), "en", f"s{i % 3}", 0, 0.5, "c", i))
        labels.append((i, 1, int(i % 8 == 0)))
    rows += [(1000 + i, rows[5][1], "en", "s1", 1, None, None, None) for i in range(5)]  # copies
    rows += [(2000, None, None, None, None, None, None, None), (2001, "", "", "", 0, 0.0, "", 0), (None, rows[9][1] + " more", "en", None, 0, 0.0, "", 0), (2002, "x1 " * 30000, "en", "s2", 0, 0.0, "", 0)]
    rows.append(rows[17])  # a repeated row
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, DOC).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stage_by_stage(spark, folder, tmp_path):
    columns = DOC.split(", ")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.toPandas()
        if name != "tokenize":
            assert docs.columns == before.columns and len(columns) == len(docs.columns)
    ids = {name: Counter(x["doc_id"].astype("Int64").fillna(-1)) for name, x in seen.items()}
    toxic = {i for i in range(0, 240, 8)}
    assert not toxic & set(ids["toxicity"]) and sum(ids["toxicity"].values()) == 240 + 5 + 4 + 1 - len(toxic)
    # the smallest id stays; the near copy without id goes; texts without words all stay
    assert ids["near_dedup"][5] == 1 and not any(1000 + i in ids["near_dedup"] for i in range(5)) and -1 not in ids["near_dedup"]
    assert ids["near_dedup"][17] == 1 and ids["near_dedup"][2000] == ids["near_dedup"][2001] == 1
    assert ids["substring_dedup"] == ids["near_dedup"]
    cut = seen["substring_dedup"].set_index("doc_id")
    before = seen["near_dedup"].set_index("doc_id")
    shared = [i for i in range(1, 240, 10) if i in before.index]
    assert all(len(cut.text[i].split()) == len(before.text[i].split()) - 60 and cut.n_chars[i] == len(cut.text[i]) for i in shared)
    assert cut.text[2002] == "" and all(cut.text[i] == before.text[i] for i in before.index if i < 2000 and i not in shared)
    assert set(ids["mix"].values()) <= {1, 2} and set(ids["mix"]) <= set(ids["near_dedup"])
    assert seen["tokenize"].round_trip.all() and ids["tokenize"] == ids["mix"]


def test_tokenize_holds_one_python_worker_a_task(spark):
    docs = spark.createDataFrame([(1, "one é two", "en", "a"), (2, None, "en", "a"), (3, "", None, None)], "doc_id long, text string, lang string, source string")
    out = corpus_pipeline.tokenize(spark, docs, SF)
    # two in one stage need two workers for each task, and idle workers stay
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert {r.doc_id: (r.n_tokens > 0, r.round_trip) for r in out.collect()} == {1: (True, True), 2: (False, True), 3: (False, True)}


def test_stages_on_empty_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0


def test_the_row_kept_of_equal_ids_and_texts_does_not_depend_on_order(spark):
    rows = [(1, "one two three four five six", "en", f"s{i}", 5, float(i), "c", i) for i in range(40)]
    kept = [corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(part, DOC).repartition(n), "").collect() for part, n in ((rows, 3), (rows[::-1], 7))]
    assert len(kept[0]) == 1 and kept[0] == kept[1]


def test_a_column_named_like_the_score_stays(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("__toxicity", F.lit(2.0))
    left = corpus_pipeline.reject_toxic(spark, docs, folder)
    assert left.columns == docs.columns and {r[0] for r in left.select("__toxicity").distinct().collect()} == {2.0}
