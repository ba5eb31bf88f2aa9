"""English terms, and the bounded ranking against full scoring."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from patchloom.functions import stem
from patchloom.operators import retrieve

# word pairs published with the algorithm
PAIRS = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing
conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky
relational relat conditional condit rational ration valenci valenc hesitanci hesit digitizer digit conformabli conform radicalli radic differentli differ
vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous
formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope
goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit
replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog
effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll yes ye is is by by say sai yelling yell archaeologi archaeolog été été""".split()


def test_published_pairs(spark):
    pairs = list(zip(PAIRS[::2], PAIRS[1::2], strict=True))
    rows = spark.createDataFrame([([w for w, _ in pairs],)], "w array<string>")
    assert rows.select(stem.stems(F.col("w"))).first()[0] == [s for _, s in pairs]


def test_english_terms(spark):
    rows = spark.createDataFrame([("The runner's ponies were RUNNING, and hopping!",), ("",), (None,), ("the of and",)], "t string")
    assert [r[0] for r in rows.select(stem.english(F.col("t"))).collect()] == [["runner", "poni", "were", "run", "hop"], [], None, []]


def full(queries, docs, k, k1=0.9, b=0.4):
    out = []
    for q, corpus, text in queries:
        own = [(d, Counter(t.lower().split())) for c, d, t in docs if c == corpus]
        average = sum(sum(t.values()) for _, t in own) / max(1, len(own))
        df = Counter(w for _, t in own for w in t)
        scores = []
        for d, t in own:
            s = sum(n * math.log(1 + (len(own) - df[w] + 0.5) / (df[w] + 0.5)) * t[w] / (t[w] + k1 * (1 - b + b * sum(t.values()) / average))
                    for w, n in Counter(text.lower().split()).items() if w in t)
            if any(w in t for w in text.lower().split()):
                scores.append((-round(s, 10), d))
        out += [(q, rank, d, round(-s, 6)) for rank, (s, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    docs = [("a", f"d{i:04}", " ".join(["all"] + [words[min(299, int(rng.expovariate(0.02)))] for _ in range(rng.randrange(5, 60))])) for i in range(900)]
    docs += [("a", f"copy{i}", docs[5][2]) for i in range(30)] + [("b", "d0001", "all alone"), ("a", "none", "")]
    queries = [(i, "a", " ".join(["all"] * (i % 3) + rng.sample(words, 1 + i))) for i in range(12)]
    return docs, queries + [(50, "b", "all"), (51, "a", "all"), (52, "a", "unheard"), (53, "c", "all"), (54, "a", ""), (55, "a", docs[5][2])]


@pytest.mark.parametrize("k", [1, 7, 20, 2000])
def test_bounded_ranking_is_the_full_one(spark, corpus, k):
    docs, queries = corpus
    hits = retrieve.bm25_topk(spark.createDataFrame(queries, "query_id int, corpus string, query string"), spark.createDataFrame(docs, "corpus string, docid string, contents string"), k)
    assert sorted((r["query_id"], r["rank"], r["docid"], r["score"]) for r in hits.collect()) == full(queries, docs, k)


def test_a_word_of_all_documents_does_not_call_them(spark):
    docs = [("a", f"d{i:04}", "all " + ("rare rare" if i % 100 == 0 else f"w{i}")) for i in range(2000)]
    index = retrieve.Postings.of(
        spark.createDataFrame([(1, "a", "all rare")], "query_id int, corpus string, query string"), spark.createDataFrame(docs, "corpus string, docid string, contents string"))
    found = index.candidates(10)
    assert 10 <= found.count() <= 20
    assert index.impacts.filter("term = 'all'").count() == 2000
