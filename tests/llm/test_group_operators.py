"""Operators that compare rows with each other: components, near-duplicates, passages, embeddings; toxicity."""

import math
import random
import re
from collections import Counter

import ahocorasick
import numpy as np
import pytest

from patchloom.llm import lattice, passages, sketches, toxicity
from patchloom.llm.components import components
from patchloom.llm.words import Words, batches

DOC = "doc_id long, text string, source string, n int, id string, words long, _t string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def prose(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def changed(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**9)}"
    return words


@pytest.fixture(scope="module")
def texts():
    """Copies, near copies around the threshold, chains, shared passages, short, empty and long texts."""
    rng = random.Random(11)
    base = [prose(rng, n) for n in (300, 60, 34, 35, 36, 5, 4, 8000)]
    out = [" ".join(b) for b in base]
    out += [" ".join(base[0])] * 4 + [" ".join(changed(rng, base[0], k)) for k in (1, 2, 3, 4, 5, 6, 7) for _ in range(6)]
    chain = base[0]
    for _ in range(12):
        chain = changed(rng, chain, 2)
        out.append("\t".join(chain))
    out += [" ".join(changed(rng, base[7], k)) for k in (3, 60, 120)] + [" ".join(base[1]).upper(), " ".join(base[1][:57]), " ".join(base[4] * 3)]
    passage = prose(rng, 46)
    out += [" ".join(prose(rng, 20) + passage + prose(rng, 25)) for _ in range(25)] + [" ".join(passage[:34]), " ".join(passage[5:41])]
    out += ["", None, None, " \t\n", "one", "one", "ONE", "one two three four", "One two three four", "é " * 90, "é " * 89]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i * 3, t, "s", 1, "x", i, None) for i, t in enumerate(texts)] + [(None, texts[0], None, None, None, None, "t"), (3, texts[1], "s", 1, "x", 1, None), (None, None, None, 0, "", 0, "")]
    return spark.createDataFrame(rows, DOC), rows


def sets_of(text, n=5):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[j:j + n]) for j in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def joined(n, links):
    at = list(range(n))
    for a, b in links * 1:
        while at[a] != a:
            a = at[a]
        while at[b] != b:
            b = at[b]
        at[max(a, b)] = min(a, b)
    out = []
    for i in range(n):
        while at[i] != i:
            i = at[i]
        out.append(i)
    return out


def test_words_are_split_and_hashed_alike():
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab \t\n\x0b\x0c\r\x1c\xa0é") for _ in range(rng.randrange(60))).encode() for _ in range(300)] + [b"", b" ", b"x"]
    found = Words(texts)
    names = {}
    for k, text in enumerate(texts):
        own = found.hashes[found.first[k]:found.first[k + 1]].tolist()
        want = [w.encode() for w in WORD.findall(text.decode())]
        assert len(own) == len(want) and all(names.setdefault(w, h) == h for w, h in zip(want, own, strict=True))
    assert len(set(names.values())) == len(names)
    runs = Counter(zip(found.runs(3).tolist(), (tuple(found.hashes[i:i + 3].tolist()) for i in range(len(found.hashes) - 2)), strict=True))
    assert len(runs) == len({h for h, _ in runs}) == len({t for _, t in runs})
    assert [f for f, _ in batches([b"a" * 9, None, b"b" * 30, b"c"], 12)] == [0, 2, 3]


def test_components(spark):
    rng = random.Random(8)
    links = [(i, i + 1) for i in range(100, 170)] + [(200, i) for i in range(201, 260)] + [(rng.randrange(300, 600), rng.randrange(300, 600)) for _ in range(200)] + [(7, 7), (5, 6), (6, 5)]
    want = joined(600, links)
    got = components(spark.createDataFrame([*links, (None, 3), (3, None)], "a long, b long"))
    nodes = {x for link in links for x in link}
    assert {r.node: r.component for r in got.collect()} == {x: want[x] for x in nodes}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates_against_all_pairs(docs, percent):
    frame, rows = docs
    sets = [sets_of(r[1]) for r in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    group = joined(len(rows), links)
    keys = {}
    for i, g in enumerate(group):
        if rows[i][0] is not None:
            keys[g] = min(keys.get(g, math.inf), rows[i][0])
    got = sketches.near_duplicates(frame, percent=percent).collect()
    want = Counter((r[0], len(s), keys.get(g), r[0] == keys.get(g)) for r, s, g in zip(rows, sets, group, strict=True))
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == want
    if percent == 80:
        left = sketches.drop_near_duplicates(frame).collect()
        best = [r for r, s in zip(rows, sets, strict=True) if not s]
        for g in set(group):
            own = [r for r, s, x in zip(rows, sets, group, strict=True) if s and x == g]
            best += [min(own, key=lambda r: (r[0] is None, r[0] or 0))] if own else []
        assert Counter((r.doc_id, len(sets_of(r.text))) for r in left) == Counter((r[0], len(sets_of(r[1]))) for r in best)
        assert left[0].asDict().keys() == rows_columns()


def rows_columns():
    return dict.fromkeys(x.split(" ")[0] for x in DOC.split(", ")).keys()


def test_near_duplicates_of_nothing(spark, docs):
    none = docs[0].limit(0)
    assert sketches.near_duplicates(none).count() == 0 and sketches.drop_near_duplicates(none).count() == 0


def without_recurring(all_words, window):
    starts = Counter(tuple(w[j:j + window]) for w in all_words for j in range(len(w) - window + 1))
    out = []
    for w in all_words:
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if starts[tuple(w[j:j + window])] > 1:
                gone[j:j + window] = [True] * window
        out.append([x for x, g in zip(w, gone, strict=True) if not g])
    return out


@pytest.mark.parametrize("slice_bytes, piece_bytes", [(passages.SLICE, passages.PIECE), (600, 500)])
def test_passages_against_all_windows(docs, slice_bytes, piece_bytes, monkeypatch):
    monkeypatch.setattr(passages, "SLICE", slice_bytes)
    monkeypatch.setattr(passages, "PIECE", piece_bytes)
    frame, rows = docs
    all_words = [WORD.findall(r[1] or "") for r in rows]
    kept = without_recurring(all_words, 35)
    got = passages.remove_passages(frame).collect()
    want = Counter((r[0], len(w), len(w) - len(k), " ".join(k)) for r, w, k in zip(rows, all_words, kept, strict=True))
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == want
    assert any(0 < len(k) < len(w) for w, k in zip(all_words, kept, strict=True))


def test_only_what_the_automaton_finds_is_compared():
    text = " ".join(f"w{i}" for i in range(200)).encode()
    held = Words([text])
    _, places, _ = passages.anchors(held, 35, 12)
    all_words = text.split()

    def compiled(chosen):
        automaton = ahocorasick.Automaton()
        for key in [" of another text ", *(f" {b' '.join(all_words[a:a + 12]).decode()} " for a in chosen)]:
            automaton.add_word(key, len(key))
        automaton.make_automaton()
        return automaton

    assert passages.windows_at_phrases(compiled(places.tolist()), held, 35, 12).tolist() == list(range(166))
    found = passages.windows_at_phrases(compiled(places.tolist()[:1]), held, 35, 12).tolist()
    assert 0 < len(found) <= 24 and found == list(range(found[0], found[-1] + 1)) and places[0] in range(found[0], found[-1] + 24)
    assert not len(passages.windows_at_phrases(compiled([]), held, 35, 12))


@pytest.mark.parametrize("size", [1, 40, 300, 10_000])
def test_pieces_hold_each_window_once(size):
    rng = random.Random(size)
    words = [b"x" * rng.choice((1, 2, 9, 400)) + str(i).encode() for i in range(500)]
    text = b"\n " + b"".join(w + rng.choice((b" ", b"\t\n", b"   ")) for w in words)
    windows = []
    for number, (p, first, piece) in enumerate(passages.pieces(text, size, 34)):
        mine = piece.split(b" ")
        assert p == number and mine == words[first:first + len(mine)]
        windows += range(first, first + len(mine) - 34)
    assert windows == list(range(466))
    assert list(passages.pieces(b"", size, 34)) == [(0, 0, b"")]


def test_periodic_and_repeated_texts(spark):
    texts = ["a b c " * 40, "a b c " * 13, "x y " * 18 + "z", "q " * 36, "q " * 35, "r " * 35, " ".join(map(str, range(70))) + " " + " ".join(map(str, range(10, 45)))]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    all_words = [t.split() for t in texts]
    want = {i: " ".join(k) for i, k in enumerate(without_recurring(all_words, 35))}
    assert {r.doc_id: r.kept for r in passages.remove_passages(frame).collect()} == want


def test_stripped_rows_keep_their_columns(spark, docs):
    frame, rows = docs
    got = passages.strip_passages(frame, length="n").collect()
    kept = without_recurring([WORD.findall(r[1] or "") for r in rows], 35)
    want = Counter()
    for r, k in zip(rows, kept, strict=True):
        text = r[1] if len(k) == len(WORD.findall(r[1] or "")) else " ".join(k)
        want[r[0], text, r[2], None if text is None else len(text), *r[4:]] += 1
    assert Counter(map(tuple, got)) == want
    assert passages.strip_passages(frame.limit(0)).count() == 0 and passages.remove_passages(frame.limit(0)).count() == 0


VECTOR = "vec_id long, embedding array<float>, label int, n_links string, id int"


def test_e8_points_are_the_nearest():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 8)) * 3
    points = lattice.decode_e8(x)
    twice = np.rint(points * 2)
    assert np.allclose(twice, points * 2) and ((twice % 2 == 0).all(1) | (twice % 2 != 0).all(1)).all() and (points.sum(1) % 2 == 0).all()
    own = ((x - points) ** 2).sum(1)
    assert all((own <= ((x - points - r) ** 2).sum(1) + 1e-9).all() for r in lattice.ROOTS) and own.max() <= 1 + 1e-9


def brute_vectors(rows, least=0.98):
    usable = [v is not None and lab is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, lab, *_ in rows]
    unit = [np.array(r[1], dtype=np.float32).astype(float) / np.linalg.norm(np.array(r[1], dtype=np.float32).astype(float)) if u else None for r, u in zip(rows, usable, strict=True)]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if usable[a] and usable[b] and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= least]
    return links


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(30, 64))
    rows = []
    for i in range(600):
        c = centres[i % 30] if i % 2 else rng.normal(size=64)
        v = c / np.linalg.norm(c) + rng.normal(size=64) * (0.012 if i % 3 else 0.02)
        rows.append((i, [float(x) for x in v.astype(np.float32)], i % 30 % 4, "x", 1))
    rows += [(1000 + i, rows[5][1], rows[5][2], None, i) for i in range(90)] + [(2000, rows[5][1], 3, "", 0), (2001, rows[5][1], None, "", 0), (None, rows[5][1], rows[5][2], "", 0)]
    rows += [(2002, [2 * x for x in rows[5][1]], rows[5][2], "", 0), (2002, rows[7][1], rows[7][2], "", 0), (2003, [0.0] * 64, 1, "", 0), (2004, None, 1, "", 0), (2005, [], 1, "", 0),
             (2006, [float("nan")] + [1.0] * 63, 1, "", 0), (2007, [float("inf")] + [1.0] * 63, 1, "", 0), (2008, [None] + [1.0] * 63, 1, "", 0), (2009, [1.0, 2.0], 1, "", 0), (2010, [2.0, 4.0], 1, "", 0)]
    links = brute_vectors(rows)
    group = joined(len(rows), links)
    n = Counter(x for link in links for x in link)
    keys = {}
    for i, g in enumerate(group):
        if rows[i][0] is not None:
            keys[g] = min(keys.get(g, math.inf), rows[i][0])
    want = Counter((r[0], n[i], keys.get(g), r[0] == keys.get(g)) for i, (r, g) in enumerate(zip(rows, group, strict=True)))
    frame = spark.createDataFrame(rows, VECTOR)
    assert Counter(tuple(r) for r in lattice.near_duplicates(frame).select("vec_id", "n_links", "component_id", "kept").collect()) == want
    assert lattice.near_duplicates(frame.limit(0)).count() == 0


def test_parts_of_a_block():
    near = np.array([[1, 0, 0, 0], [0, 1, 0, 1], [0, 0, 1, 0], [0, 1, 0, 1]], dtype=bool)
    left, right = lattice._connected(near)
    assert left.tolist() == right.tolist() == [0, 1, 2, 1]


@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(21)
    good = "the of and with that from have they would there about which their water under never".split()
    bad = "stupid idiot loser".split()
    rows, labels = [], []
    for i in range(900):
        toxic = i % 6 == 0
        words = [rng.choice(good) + rng.choice(["", "", "s", "er"]) for _ in range(40)]
        if toxic:
            for _ in range(3):
                words[rng.randrange(40)] = rng.choice(bad)
        rows.append((i, " ".join(words), "s", 1, "x", i, None))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_disguised_words_are_restored(spark, labelled):
    rows, labels = labelled
    docs = spark.createDataFrame(rows, DOC)
    scorer = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert set(scorer.weights) >= {"stupid", "idiot", "loser"}
    score = lambda t: scorer.score(t, scorer.spellings())
    for text in ("you 1d10t", "s-t-u-p-i-d", "so stuuuupid", "l o s e r", "$tup1d", "What a LOSER!", "i.d.i.o.t", "x " * 30000 + "idiot"):
        assert score(text) > 0.5, text
    for text in ("", None, "the water under", "12 34 5678", "a.b@mail.example.com", "x " * 30000, "w4t3r"):
        assert 0 <= score(text) < 0.5, text


@pytest.mark.parametrize("between", [" ", "."])
def test_insults_at_every_offset_of_a_long_run(spark, labelled, between):
    rows, labels = labelled
    scorer = toxicity.train(spark.createDataFrame(rows, DOC), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    spellings = scorer.spellings()
    before = {0: ""}  # words that come to each length; the insult's neighbours are always the same
    for n in range(2, 120):
        before[n] = next(w + before[n - len(w)] for w in ("that", "the", "of") if n - len(w) in before)
    after = "waterunderthatabouttheirwouldneverfromtherewhichwithhave"
    assert scorer.score(between.join(before[119] + after), spellings) < 0.5
    missed = [(bad, n) for bad in ("stupid", "idiot", "loser") for n in before
              if scorer.score(between.join(before[n] + "water" + bad + after), spellings) < 0.5]
    assert not missed


def test_double_letters_fragments_and_any_white_space(spark, labelled):
    rows, labels = labelled
    scorer = toxicity.train(spark.createDataFrame(rows, DOC), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    spellings = scorer.spellings()
    for text in ("stuupid", "idiiot", "looser!", "st upid", "id iot", "s tu pid", "stupi d", "l oser", "lo\tser", "(st\nupid)", "st - upid", "id 10t", "st uupid", "water/st upid",
                 "s\tt\tu\tp\ti\td", "i\nd\ni\no\nt", "l    o    s    e    r", "s\u00a0t\u00a0u\u00a0p\u00a0i\u00a0d"):
        assert scorer.score(text, spellings) > 0.5 and scorer.score(f"the water {text} under there", spellings) > 0.5, text
    for text in ("the water", "st the upid", "| " * 3000, "a - " * 3000, "i d i", "stup", "would there", "un der wat er"):
        assert scorer.score(text, spellings) < 0.5, text
    # words that only meet are not one word
    met = toxicity.Scorer(scorer.model, {"thewater": 8.0, "there": 8.0}, -4.0)
    assert met.total("of the water under", met.spellings()) == -4.0 and met.total("of the re under", met.spellings()) == 4.0


def test_scores_of_documents(spark, labelled):
    rows, labels = labelled
    extra = [(5000, None, None, None, None, None, None), (5001, "", "s", 1, "", 1, ""), (None, "stupid idiot", "", 0, "", 0, ""), (7, rows[7][1], "s", 1, "x", 7, None)]
    docs = spark.createDataFrame(rows + extra, DOC)
    marks = spark.createDataFrame([*labels, (3, 1, None), (None, 1, 1), (99999, 1, 1), (9, 1, 0)], "doc_id long, quality int, toxic int")
    got = toxicity.score_documents(docs, marks).collect()
    assert len(got) == len(rows) + len(extra)
    import zlib
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    truth = {i: t for i, _, t in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held) and len(held) > 100
    assert {r.predicted for r in got if r.doc_id in (5000, 5001)} == {0}
    assert toxicity.score_documents(docs.limit(0), marks).count() == 0
    unmarked = toxicity.score_documents(docs, marks.limit(0)).collect()
    assert {r.score for r in unmarked} == {0.5}


def test_held_out_labels_are_not_used(spark, labelled):
    rows, labels = labelled
    import zlib
    docs = spark.createDataFrame(rows, DOC)
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    one, other = (toxicity.train(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, turned))
    assert one.weights == other.weights and one.intercept == other.intercept


def test_calibration_of_separable_and_constant_sums():
    x = np.concatenate([np.zeros(900), np.full(10, 4.0), np.full(90, 9.0)])
    y = np.concatenate([np.zeros(910), np.ones(90)])
    slope, intercept = toxicity._logistic(x, y)
    chance = lambda v: 1 / (1 + math.exp(-(slope * v + intercept)))
    assert chance(0) < 0.05 and chance(4) < 0.5 < 0.9 < chance(9)
    slope, intercept = toxicity._logistic(np.zeros(100), np.arange(100) < 20)
    assert slope == 0 and abs(1 / (1 + math.exp(-intercept)) - 0.2) < 0.01
    slope, _ = toxicity._logistic(np.concatenate([np.zeros(50), np.full(50, 900.0)]), np.concatenate([np.zeros(50), np.ones(50)]))
    assert slope > 0


def test_strongest_word_decides():
    scorer = toxicity.Scorer(np.zeros((64, 64, 64)), {"bad": 8.0, "poor": 2.0}, -4.0, 1.0)
    totals = [scorer.total(t, scorer.spellings()) for t in ("", "poor", "bad", "bad poor bad")]
    assert totals[:3] == [-4.0, -2.0, 4.0] and abs(totals[3] - (4.0 + 2.0 * toxicity.SHARE)) < 1e-9
