"""Hard negatives, metric-tree codes and personal data against brute force."""

import hashlib
import math
import random
import re

import numpy as np
import pytest

from patchloom.llm import metric_trees, negatives, pii

VEC = "vec_id long, embedding array<float>, label int, id long, a string, band int, v array<int>, score double, row string"


def vectors(n, dim, seed, labels=4):
    """Rows with ties, copies, hot label, nulls and components that aren't finite."""
    rng = np.random.default_rng(seed)
    base = rng.normal(0, 1, (n, dim)).astype(np.float32)
    base[n // 2: n // 2 + n // 5] = base[0]  # a hot group of equal vectors
    rows = [(i, [float(x) for x in v], None if i % 17 == 3 else (1 if i % 3 else i % labels), 7, "x", 1, [1], 0.5, "r") for i, v in enumerate(base)]
    odd = [None, [1.0, None] + [0.0] * (dim - 2), [math.nan] * dim, [math.inf] * dim, [-math.inf] + [0.0] * (dim - 1), [0.0] * dim]
    rows += [(n + i, v, 1, None, None, None, None, None, None) for i, v in enumerate(odd)]
    return rows + [rows[0]] * 2


def fit(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def test_strassen_is_the_product():
    rng = np.random.default_rng(1)
    for m, k, n in ((1, 1, 1), (3, 5, 7), (64, 64, 64), (65, 33, 129), (200, 64, 90), (0, 4, 3)):
        a, b = rng.integers(-(1 << 20), 1 << 20, (m, k)), rng.integers(-(1 << 20), 1 << 20, (k, n))
        assert np.array_equal(negatives.strassen(a, b, leaf=4), a @ b)


def test_heaps_merge_like_one_sort():
    rng = random.Random(3)
    entries = [(rng.randrange(4), rng.randrange(6), i) for i in range(200)]
    parts = [negatives.Heaps(4, 5), negatives.Heaps(4, 5)]
    for i, part in enumerate(parts):
        part.push(*(np.array(c, dtype=np.int64) for c in zip(*entries[i::2], strict=True)))
    parts[0].push(parts[1].heap, parts[1].score, parts[1].id)
    expected = [(h, s, i) for h in range(4) for s, i in sorted(((s, i) for g, s, i in entries if g == h), key=lambda e: (-e[0], e[1]))[:5]]
    assert list(zip(parts[0].heap.tolist(), parts[0].score.tolist(), parts[0].id.tolist(), strict=True)) == expected


def negatives_by_force(rows, every, positives, count):
    kept = {(r[0], r[2], tuple(math.floor(256 * float(x)) for x in r[1])) for r in rows if r[0] is not None and r[2] is not None and fit(r[1])}
    out = []
    for a, label, v in kept:
        if a % every:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(v, w, strict=True)), i, l) for i, l, w in kept if i != a))
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            fits = [(i, -t) for t, i, l in scored if l != label and 30 * -s <= 100 * -t <= 90 * -s][:count]
            out += [(a, p, rank, i, -s, t) for rank, (i, t) in enumerate(fits, 1)]
    return sorted(out)


@pytest.mark.parametrize("band", [negatives.BAND, (16, 64)])
def test_hard_negatives(spark, monkeypatch, band):
    from pyspark.sql import functions as F

    monkeypatch.setattr(negatives, "BAND", band)
    rows = vectors(240, 8, 5)
    table = spark.createDataFrame(rows, VEC).repartition(5)
    found = negatives.hard_negatives(table, F.col("vec_id") % 10 == 0).collect()
    assert sorted(tuple(r) for r in found) == negatives_by_force(rows, 10, 5, 10)


def test_hard_negatives_without_rows(spark):
    from pyspark.sql import functions as F

    empty = spark.createDataFrame([], VEC)
    assert negatives.hard_negatives(empty, F.col("vec_id") % 10 == 0).collect() == []
    one = spark.createDataFrame(vectors(1, 4, 1)[:1], VEC)
    assert negatives.hard_negatives(one, F.col("vec_id") % 10 == 0).collect() == []


def codes_by_force(rows, entries, rounds, parts=4):
    kept = [(r[0], r[2], [math.floor(1024 * float(x)) for x in r[1]]) for r in rows if fit(r[1])]
    width = max(1, -(-max((len(v) for _, _, v in kept), default=0) // parts))
    kept = [(i, l, np.array(v + [0] * (width * parts - len(v)), dtype=np.int64).reshape(parts, width)) for i, l, v in kept]
    first = sorted(kept, key=lambda r: (r[0], r[2].ravel().tolist()))[:entries]
    books = [np.array([r[2][p] for r in first]) for p in range(parts)]

    def nearest(p, v):
        d = ((books[p] - v) ** 2).sum(1)
        return int(d.argmin()), int(d.min())

    for _ in range(rounds):
        for p in range(parts):
            owner = np.array([nearest(p, r[2][p])[0] for r in kept])
            points = np.array([r[2][p] for r in kept])
            books[p] = np.array([points[owner == i].sum(0) // (owner == i).sum() if (owner == i).any() else books[p][i] for i in range(len(books[p]))])
    coded = []
    for i, label, v in kept:
        best = [nearest(p, v[p]) for p in range(parts)]
        coded.append((i, "".join(f"{c:02x}" for c, _ in best), sum(d for _, d in best), label))
    sha = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
    return sorted((i, c, e, sum(x[2] for x in coded if x[3] == label), sha) for i, c, e, label in coded)


@pytest.mark.parametrize("entries,dim,leaf,chunk", [(16, 8, 4, 64), (256, 8, 128, 4096), (9, 6, 2, 50)])
def test_codes(spark, monkeypatch, entries, dim, leaf, chunk):
    monkeypatch.setattr(metric_trees, "CHUNK", chunk)
    monkeypatch.setattr(metric_trees.Tree.build.__func__, "__defaults__", (leaf,))
    rows = vectors(300, dim, 8)
    table = spark.createDataFrame(rows, VEC).repartition(3)
    found = metric_trees.compress(table, entries=entries, rounds=4).collect()
    assert sorted(tuple(r) for r in found) == codes_by_force(rows, entries, 4)


def test_balls_hold_their_points():
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.integers(-900, 900, (500, 5)), np.zeros((300, 5), dtype=np.int64)])
    tree = metric_trees.Tree.build(points, leaf=8)
    assert sorted(tree.order.tolist()) == list(range(800))
    for b in range(len(tree.begin)):
        own = points[tree.order[tree.begin[b]:tree.end[b]]]
        assert np.array_equal(own.sum(0), tree.sums[b])
        assert np.sqrt(((own - own.mean(0)) ** 2).sum(1)).max() <= tree.radius[b] + 1e-6
        if tree.left[b] >= 0:
            left, right = tree.left[b], tree.right[b]
            assert (tree.begin[left], tree.end[left], tree.end[right]) == (tree.begin[b], tree.begin[right], tree.end[b])


def test_most_points_go_to_their_entry_inside_whole_balls():
    rng = np.random.default_rng(4)
    centres = rng.integers(-50_000, 50_000, (16, 4))
    points = np.concatenate([c + rng.integers(-40, 40, (200, 4)) for c in centres])
    book, compared = metric_trees.Codebook(centres), []
    tree = metric_trees.Tree.build(points, leaf=16)
    book.owners(tree, points, lambda at, entry: compared.append(0 if isinstance(entry, int) else tree.end[at] - tree.begin[at]))
    assert sum(compared) < len(points) / 10
    assert np.array_equal(book.codes(tree, points), np.repeat(np.arange(16), 200))


def test_codes_without_rows(spark):
    assert metric_trees.compress(spark.createDataFrame([], VEC)).collect() == []
    assert metric_trees.compress(spark.createDataFrame([(1, None, 1, *[None] * 6)], VEC)).collect() == []


# --- personal data ------------------------------------------------------------------------------

DOC = "doc_id long, text string, row string, spans int"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_by_force(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            ok = {
                "email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")), "phone": lambda: 10 <= len(digits) <= 15,
                "card": lambda: 14 <= len(digits) <= 19 and sum(sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(reversed(digits))) % 10 == 0,
            }[kind]()
            if ok:
                out.append((m.start(), k, m.end(), kind))
    return [(a, b, kind) for a, _, b, kind in sorted(out)]


def test_checksums():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765433") and pii.mod97("DE89370400440532013000")


def test_base_spans_of_random_texts():
    rng = random.Random(6)
    pieces = ["4111 1111 1111 1111", "4111-1111-1111-1112", "10.0.0.1", "256.1.1.1", "1.2.3", "a.b@c.de", "x@y", "@", "_", ".", "+49 (30) 123-4567", "+1", " ", "-", "7", "é", "\n", "+", "00012.1.1.1", "(555)"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(9)))
        assert pii.base_spans(text) == base_by_force(text), text


@pytest.mark.parametrize("text,kind", [
    ("bank: GB82 WEST 1234 5698 7654 32.", "iban"), ("mail me: jo [at] example [dot] org", "masked_email"), ("my ssn 123-45-6789", "ssn"), ("call 030 1234 567", "local_phone"),
    ("no 99 4111 1111 1111 1111 card", "inner_card"),
])
def test_added_spans(text, kind):
    assert kind in [s.kind for s in pii.find_spans(text) if not s.base]


@pytest.mark.parametrize("text", ["bank: GB83 WEST 1234 5698 7654 32", "order 123-45-6789", "in 030 1234 567 seiten", "", "meet [at] noon", "plain words only"])
def test_nothing_to_add(text):
    assert pii.find_spans(text) == []


def test_context_moves_scores():
    near, far = (pii.context_score(t, t.index("10."), len(t), "ip", 0.6) for t in ("server 10.0.0.1", "version 10.0.0.1"))
    assert near == 0.9 and far == 0.3


def test_spans_of_rows(spark):
    long = "plain words " * 200_000 + "a@b.cd" + " 1" * 100_000 + "." * 100_000
    texts = [None, "", "é a@b.cd", "a@b.cd", "a@b.cd", long, "10.0.0.1 +49 30 1234567"]
    rows = [(i, t, None, 3) for i, t in enumerate(texts)] + [(None, "a@b.cd", "x", None)]
    found = pii.personal_data(spark.createDataFrame(rows, DOC), ["doc_id", "row", "spans"][:2]).collect()
    got = sorted(((r["doc_id"], [(s["start"], s["end"], s["kind"]) for s in r["spans"] if s["base"]]) for r in found), key=str)
    assert got == sorted(((i, base_by_force(t or "")) for i, t, *_ in rows), key=str)
    assert pii.personal_data(spark.createDataFrame([], DOC), ["doc_id"]).collect() == []


def test_query_of_personal_data(spark):
    from patchloom.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op13_personal_data"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = base_by_force(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in PATTERNS] == [sum(b[2] == k for b in base) for k in PATTERNS]
        listed = ",".join(f"{k}:{a}:{b}" for a, b, k in base)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert not listed or set(listed.split(",")) <= set(r["spans"].split(","))


def test_redaction(spark):
    rows = [(1, "write a@b.cd now", "x", 2), (2, None, None, None)]
    assert [tuple(r) for r in pii.redact(spark.createDataFrame(rows, DOC)).orderBy("doc_id").collect()] == [(1, "write <email> now", "x", 2), (2, None, None, None)]
