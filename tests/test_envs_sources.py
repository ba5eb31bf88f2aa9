"""Environment texts, readers and writers, imports and document encoders."""

import json

import pytest
from pyspark.sql import functions as F

from patchloom.operators import envs, retrieve
from patchloom.sources import readers, writers

YML = """name: x
channels:
  - conda-forge
dependencies:
  - types-pkg_resources
  - pip:
    - types-pkg_resources==0.1.3
    - types-pkg_resources>=1
    - types-pkg_resources~=1.2
    - types-pkg_resources!=2
    - types-pkg_resources
    - types-pkg_resources-extra
    - numpy
  - types-pkg_resources<2
"""
CLEAN = YML
for form in ("==0.1.3", ">=1", "~=1.2", "!=2"):
    CLEAN = CLEAN.replace(f"    - types-pkg_resources{form}\n", "    - types-setuptools\n")
CLEAN = CLEAN.replace("    - types-pkg_resources\n", "    - types-setuptools\n")


def one(spark, text, fn):
    return spark.createDataFrame([(text,)], "t string").select(fn(F.col("t"))).first()[0]


@pytest.mark.parametrize("text,expected", [
    (YML, CLEAN),
    (YML.replace("  - pip:\n", ""), YML.replace("  - pip:\n", "")),
    ("dependencies:\n  - pip:\n    - types-pkg_resources", "dependencies:\n  - pip:\n    - types-setuptools"),
    ("- pip:\n- types-pkg_resources", "- pip:\n- types-pkg_resources"),
])
def test_environment(spark, text, expected):
    assert one(spark, text, envs.clean_environment) == expected


def test_requirements(spark):
    text = "types-pkg_resources==1\nnumpy\ntypes-pkg_resources\nxtypes-pkg_resources\ntypes-pkg_resources<=3\n"
    assert one(spark, text, envs.clean_requirements) == "types-setuptools\nnumpy\ntypes-setuptools\nxtypes-pkg_resources\ntypes-setuptools\n"


def test_flatten(spark):
    files = spark.createDataFrame([
        ("r", "c", "req/dev.txt", "a\n-r base.txt\n# no\n-r gone.txt\nb"), ("r", "c", "req/base.txt", "x\n-e .\ny")],
        "repo string, commit string, path string, text string")
    assert envs.flatten_requirements(files.filter("path = 'req/dev.txt'"), files).first()["text"] == "x\ny\na\nb"


def test_read_instances(spark, tmp_path):
    rows = [{"instance_id": i, "repo": "a/b", "patch": None} for i in ("x-1", "x-2")]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, rows)))
    for name in ("a.json", "a.jsonl"):
        assert readers.read_instances(spark, f"{tmp_path}/{name}").count() == 2
    assert readers.read_instances(spark, f"{tmp_path}/a.json", ids=["x-2"]).first()["instance_id"] == "x-2"
    with pytest.raises(ValueError, match="x-9"):
        readers.read_instances(spark, f"{tmp_path}/a.json", ids=["x-2", "x-9"])
    spark.read.json(f"{tmp_path}/a.jsonl").write.parquet(f"{tmp_path}/set/test.parquet")
    assert readers.read_instances(spark, f"{tmp_path}/set").count() == 2
    with pytest.raises(ValueError):
        readers.read_json_rows(spark, f"{tmp_path}/a.csv", readers.INSTANCE)


def test_read_predictions(spark, tmp_path):
    rows = [{"instance_id": "a", "model_patch": "1"}, {"instance_id": "b", "model_patch": None}, {"instance_id": "a", "model_patch": "2"}]
    (tmp_path / "p.jsonl").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "p.json").write_text(json.dumps(rows))
    (tmp_path / "m.json").write_text(json.dumps({"a": rows[0], "b": rows[1]}))
    from patchloom.operators.grade import latest_predictions

    for name in ("p.jsonl", "p.json"):
        last = latest_predictions(readers.read_predictions(spark, f"{tmp_path}/{name}"))
        assert {r["instance_id"]: r["model_patch"] for r in last.collect()} == {"a": "2", "b": None}
    assert readers.read_predictions(spark, f"{tmp_path}/m.json").count() == 2
    (tmp_path / "bad.jsonl").write_text('{"model_patch": "x"}')
    with pytest.raises(ValueError, match="instance_id"):
        readers.read_predictions(spark, f"{tmp_path}/bad.jsonl")
    gold = readers.read_predictions(spark, "gold", spark.createDataFrame([("i", "p")], "instance_id string, patch string"))
    assert gold.first()["model_name_or_path"] == "gold"


def test_run_folders(spark, tmp_path):
    for name, report in (("i-1", '{"i-1": {"resolved": true}}'), ("i-2", ""), ("i-3", "{nope"), ("i-4", '{"other": {"resolved": true}}')):
        folder = tmp_path / "run7" / "org__model" / name
        folder.mkdir(parents=True)
        (folder / "report.json").write_text(report)
        (folder / "test_output.txt").write_text("PASSED a\n")
    got = {r["instance_id"]: r["resolved"] for r in readers.read_reports(spark, str(tmp_path)).collect()}
    assert got == {"i-1": True, "i-2": None, "i-3": None, "i-4": None} or got == {"i-1": True, "i-3": None, "i-4": None}
    log = readers.read_logs(spark, str(tmp_path)).filter("instance_id = 'i-1'").first()
    assert (log["run_id"], log["model"], log["log"]) == ("run7", "org/model", "PASSED a\n")


def test_repo_files(spark, tmp_path):
    for path, body in (("a/x.py", b"x = 1\n"), ("a/bad.py", b"\xff\xfe\x00"), ("tests/t.py", b""), ("README.md", b"r")):
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_bytes(body)
    got = {r["path"]: r["content"] for r in readers.read_repo_files(spark, str(tmp_path), "r", "c").collect()}
    assert got == {"a/x.py": "x = 1\n", "a/bad.py": readers.BINARY_TEXT}


def test_merge_checks_the_count(spark, tmp_path):
    writers.write_jsonl(spark.range(10), f"{tmp_path}/s")
    assert writers.merge_shards(spark, f"{tmp_path}/s", spark.range(1).schema, 10).count() == 10
    with pytest.raises(ValueError):
        writers.merge_shards(spark, f"{tmp_path}/s", spark.range(1).schema, 11)


def test_names():
    assert writers.dataset_name("a/b", "style-3", "bm25", 5, 1000, "regex") == "a__b__style-3__fs-bm25__k-5__mcc-1000-regex"
    assert writers.output_name("o/m", "d", "test", 1, 4) == "o__m__d__test__shard-1-of-4"


def test_import_edges_and_closure(spark):
    files = spark.createDataFrame([
        ("o/r", "c", "src/a.py", "import lib.core\nfrom ..x import y"), ("o/r", "c", "lib/core/m.py", "import util"),
        ("o/r", "c", "lib/core/n.py", "def ("), ("o/r", "c", "util/u.py", "import os"), ("o/r", "c", "util/data.txt", "x")],
        "repo string, commit string, path string, content string")
    edges = retrieve.import_edges(files)
    got = {(r["src"], r["dst"]) for r in edges.collect()}
    assert {("src/a.py", "lib/core/m.py"), ("src/a.py", "lib/core/n.py"), ("lib/core/m.py", "util/u.py")} <= got
    seeds = spark.createDataFrame([("o/r", "c", "src/a.py")], "repo string, commit string, seed string")
    reach = {r["node"] for r in retrieve.import_closure(edges, seeds, ["repo", "commit"]).collect()}
    assert reach == {"src/a.py", "lib/core/m.py", "lib/core/n.py", "util/u.py"}


def test_document_encoders(spark):
    source = '"mod"\nX = 1\nclass A:\n    "doc a"\n    def f(self):\n        "doc f"\n'
    files = spark.createDataFrame([("p/m.py", source), ("p/bad.py", "def (")], "path string, content string")
    docs = {r["path"]: r["contents"] for r in retrieve.with_docstrings(files).collect()}
    assert docs == {"p/m.py": "p/m.py\nmod\n\nA\ndoc a\n\nf\ndoc f", "p/bad.py": "p/bad.py\ndef ("}
    names = {r["path"]: r["contents"] for r in retrieve.with_signatures(files).collect()}
    assert names["p/m.py"] == "p/m.py\np.m\nmod\n\np.m.X\np.m.A\ndoc a\n\np.m.A.f\ndoc f\n\n"


def test_bm25_against_plain_python(spark):
    import math
    import random

    rng = random.Random(5)
    words = [f"w{i}" for i in range(12)]
    docs = [(f"c{i % 2}", f"d{i}", " ".join(rng.choices(words, k=rng.randint(0, 30)))) for i in range(40)]
    queries = [(i, f"c{i % 3}", " ".join(rng.choices(words, k=4))) for i in range(9)]
    got = {}
    out = retrieve.bm25_topk(spark.createDataFrame(queries, "query_id int, corpus string, query string"),
                             spark.createDataFrame(docs, "corpus string, docid string, contents string"), k=5)
    for r in out.collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["docid"], r["score"]))
    for qid, corpus, query in queries:
        mine = [(d, t.split()) for c, d, t in docs if c == corpus]
        scored = []
        for d, t in mine:
            score = 0.0
            for w in query.split():
                df = sum(w in x for _, x in mine)
                if w in t:
                    avg = sum(len(x) for _, x in mine) / len(mine)
                    score += math.log(1 + (len(mine) - df + 0.5) / (df + 0.5)) * t.count(w) / (t.count(w) + 0.9 * (0.6 + 0.4 * len(t) / avg))
            if any(w in t for w in query.split()):
                scored.append((d, round(score, 6)))
        best = sorted(scored, key=lambda x: (-x[1], x[0]))[:5]
        assert [(d, s) for _, d, s in sorted(got.get(qid, []))] == best
