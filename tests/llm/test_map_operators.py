"""Operators that treat rows one by one, or after a sort: tokens, shards, urls, fingerprints, archives, mixing."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from patchloom.llm import bpe, mixing, omh, reputation, sharding, warc
from patchloom.llm.queries import RULES, VOCABULARY_FILE

DOC = "doc_id long, text string, source string, size int, shard string, score string"
LONG = "a long tale of one thing " * 4000
DOCS = [
    (1, "It's 12 o'clock  now\n\n ok", "b", 0, "x", None), (2, None, "a", None, None, None), (3, "", None, 1, "y", "s"),
    (4, LONG, "a", 2, "z", "t"), (4, LONG, "a", 2, "z", "t"), (None, "no key here", "b", 3, None, None), (-7, "é" * 700 + " 👩‍👧 <|endoftext|>", "é", 4, "q", ""),
    (6, "  \t ", "b", 5, "x", None), (5, "It's 12 o'clock  now\n\n ok", "a", 0, "x", None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, DOC)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.from_file(VOCABULARY_FILE, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference(vocabulary):
    with open(VOCABULARY_FILE, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash_is_minimal(vocabulary):
    table = vocabulary.hash
    assert sorted(table.keys) == list(range(len(vocabulary.entries)))
    assert all(table.find(k) == i for i, k in enumerate(vocabulary.entries))
    assert bpe.PerfectHash([]).find(b"x") == -1 and bpe.PerfectHash([b"a"]).find(b"a") == 0


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80) | st.text("ab \n'sé1", max_size=200))
def test_ids_are_those_of_the_library(vocabulary, reference, text):
    (ids,) = vocabulary.encode([text], vocabulary.remembered())
    assert ids.tolist() == reference.encode_ordinary(text) and vocabulary.decode(ids.tolist()) == text.encode()


def test_round_trip_query_rows(docs, none, vocabulary, reference):
    rows = bpe.round_trip(docs, vocabulary).collect()
    assert len(rows) == len(DOCS)
    want = {}
    for key, text, *_ in DOCS:
        ids = reference.encode_ordinary(text or "")
        want[key, len(ids)] = (hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
    assert all(want[r.doc_id, r.n_tokens] == (r.ids_sha256, r.decoded_sha256) for r in rows)
    assert bpe.round_trip(none, vocabulary).count() == 0
    with pytest.raises(ValueError):
        bpe.encode(docs, vocabulary, "text", "Size")


def jump(key: int, n: int) -> int:
    """The published loop."""
    key, b, j = key % (1 << 64), -1, 0
    while j < n:
        b = j
        key = (key * sharding.MULTIPLIER + 1) % (1 << 64)
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_shards(spark, docs, none):
    rows = sharding.shard_rows(docs, 24).collect()
    assert sorted((r.doc_id or 0, r.size, r.text_crc32) for r in rows) == sorted(
        (k or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for k, t, *_ in DOCS)
    assert all((r.shard, r.grown_shard) == (jump(r.doc_id or 0, 24), jump(r.doc_id or 0, 25)) for r in rows)
    for shard in {r.shard for r in rows}:
        own = sorted(r.slot for r in rows if r.shard == shard)
        assert own == list(range(len(own)))
    assert sharding.shard_rows(none, 24).count() == 0
    keys = [random.Random(3).randrange(-(1 << 63), 1 << 63) for _ in range(400)] + [0, -1, (1 << 63) - 1, -(1 << 63)]
    got = spark.createDataFrame([(k,) for k in keys], "k long").select("k", sharding.jump_hash(F.col("k"), 300).alias("s")).collect()
    assert all((r.s.shard, r.s.grown) == (jump(r.k, 300), jump(r.k, 301)) for r in got)
    assert all(r.s.grown in (r.s.shard, 300) for r in got)


URLS = {
    "http://WWW.Example.com/en/x?q#f": ("www.example.com", "/en/x", "www.example.com/en/", "allow"),
    "https://blog.example.com/en/": ("blog.example.com", "/en/", "example.com/en/", "block"),
    "https://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"), "ftp://a.net/es/1": ("a.net", "/es/1", "net/es/", "block"),
    "x://h.com": ("h.com", "", None, None), "x://?a/b": ("", "", None, None), "no scheme": ("", "", None, None), None: ("", "", None, None), "": ("", "", None, None),
    "a://b://c/d": ("b:", "//c/d", None, None), "http://É.com/": ("É.com", "/", "com/", "allow"), "line\n://com/x": ("com", "/x", "com/", "allow"),
}


def test_urls_and_rules(spark):
    pages = spark.createDataFrame([(i, u, "clash", 1.0) for i, u in enumerate(URLS)] + [(None, None, None, None)], "page_id long, url string, host string, bound double")
    rows = {r.page_id: r for r in reputation.judge_urls(pages, RULES).collect()}
    for i, (host, path, rule, verdict) in enumerate(URLS.values()):
        assert (rows[i].host, rows[i].path, rows[i].rule) == (host, path, rule)
        assert rows[i].verdict == verdict or verdict is None and rows[i].verdict in ("allow", "block")
    assert len(rows) == len(URLS) + 1 and rows[None].host == ""
    assert reputation.judge_urls(pages.limit(0), RULES).count() == 0
    assert {r.verdict for r in reputation.judge_urls(pages, []).collect()} == {"allow"}


def test_reputation_shrinks_and_needs_evidence(spark):
    rows = [("bad.a.org", 1)] * 60 + [("good.b.org", 0)] * 60 + [("one.c.org", 1)] + [("mixed.a.org", None)] * 3 + [(None, None)]
    got = {r.host: r for r in reputation.host_reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert got["bad.a.org"].bound > 0.8 and got["good.b.org"].mean < 0.1
    assert got["one.c.org"].bound < got["bad.a.org"].bound and got["one.c.org"].mean < 1
    assert got["good.b.org"].mean < got["mixed.a.org"].mean < got["bad.a.org"].mean  # takes after its domain
    assert (got[""].n, got[""].n_bad) == (0, 0)


def test_registered_domains(spark):
    row = spark.createDataFrame([("a.b.co.uk",)], "h string").select(
        reputation.registered_domain(F.col("h"), ["co.uk"]).alias("d"), reputation.suffix_of(F.col("h"), ["co.uk"]).alias("s"), reputation.registered_domain(F.col("h")).alias("p")).first()
    assert tuple(row) == ("b.co.uk", "co.uk", "co.uk")


def slow_signature(text: str) -> list[tuple]:
    """Slots as tuples of k-mers, without numbers taken for hashes of tuples."""
    kmers = omh._kmers(text)
    order = [int(x) for x in omh._numbered(kmers)]
    out = []
    for b in range(omh.SLOTS):
        first = sorted(range(len(order)), key=lambda i: (order[i] - (b << omh._ARC)) % (1 << 64))[:omh.L]
        out.append(tuple(int(kmers[i]) for i in sorted(first)))
    return out


@pytest.mark.parametrize("n", [1, 4, 5, 6, 60, 3000, 9000])
def test_signature_takes_the_first_of_each_arc(n):
    rng = random.Random(n)
    text = "".join(rng.choice("abcd é") for _ in range(n))
    slots = slow_signature(text)
    same_tuple = {}
    for t, s in zip(slots, omh.signature(text).tolist(), strict=True):
        assert same_tuple.setdefault(t, s) == s
    assert len(set(same_tuple.values())) > 0.9 * len(same_tuple)


def test_occurrences_are_numbered():
    kmers = omh._kmers("aaaaaaaaaa")
    assert len(set(kmers.tolist())) == 1 and len(set(omh._numbered(kmers).tolist())) == len(kmers)


def test_order_counts():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    text = " ".join(words)
    shuffled = " ".join(rng.sample(words, len(words)))
    near = " ".join(words[:40] + ["xyz"] + words[41:])
    alike = lambda x: omh.likeness(omh.signature(text), omh.signature(x))
    assert alike(text) == 1 and alike(near) > 0.85 > 0.6 > alike(shuffled)


def test_edited_texts(spark, docs, none):
    rows = omh.edit_fingerprints(docs).collect()
    order = sorted(DOCS, key=lambda d: (d[0] is None, -(d[0] or 0)))
    assert len(rows) == len(DOCS)
    got = sorted((r.doc_id is None, -(r.doc_id or 0), r.n_chars, r.edited_sha256, r.fingerprint, r.near_edited, r.near_next) for r in rows)
    want = []
    for i, (key, text, *_) in enumerate(order):
        text, following = text or "", order[(i + 1) % len(order)][1] or ""
        n = len(text) // 3
        changed = text[:len(text) - n] + following[:n]
        a, b, c = (omh.signature(x) for x in (text, changed, following))
        want.append((key is None, -(key or 0), len(text), hashlib.sha256(changed.encode()).hexdigest(), a.astype(">u2").tobytes().hex(), omh.likeness(a, b), omh.likeness(a, c)))
    assert got == sorted(want)
    assert omh.edit_fingerprints(none).count() == 0
    (alone,) = omh.edit_fingerprints(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).collect()
    assert alone.near_next == 1 and alone.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()
    assert {r.fingerprint for r in omh.fingerprints(docs.filter("doc_id = 2 OR doc_id = 3")).collect()} == {""}


PAGE = "page_id long, url string, html string, payload string, refers_to int"


def test_archives(spark, tmp_path):
    big, tricky = "x" * 1000, "a" + warc.BORDER + "WARC-Type: response\r\nContent-Length: 5\r\n\r\nhello" + warc.END + "é" * 900
    pages = [(1, "http://h/a?b", big, "c", 1), (2, None, big, None, None), (3, "u", big, "", 2), (3, "u", big, "", 2), (4, "http://x\r\ny/", None, "", 0), (5, "", "", "", 0),
             (6, "z", "small", "", 0), (7, "z", "small", "", 0), (None, "n", big, "", 0), (8, "t", tricky, "", 0), (9, "t", tricky, "", 0), (10, "l", "y" * 3_000_000, "", 0),
             (11, "e", warc.END, "", 0), (12, "v", warc.VERSION + "\r\n", "", 0)]
    frame = spark.createDataFrame(pages, PAGE).coalesce(2)
    digests = warc.capture_digests(frame, str(tmp_path / "w"))
    assert "Join" in digests._jdf.queryExecution().optimizedPlan().toString()  # requests and metadata take part
    got = digests.collect()
    want = []
    for page, _, html, *_ in pages:
        body = (html or "").encode()
        best = max(p for p, _, h, *_ in pages if p is not None and (h or "") == (html or "")) if len(body) >= 1000 else page
        want.append((page or -1, len(body), hashlib.sha1(body).hexdigest(), "response" if best == page else "revisit", -1 if best == page else best))
    assert sorted((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or -1) for r in got) == sorted(want)
    captures = warc.assemble(warc.read_archives(spark, str(tmp_path / "w"))).collect()
    assert len(captures) == len(pages) and all(len(c.requests) == len(c.metadata) == 1 for c in captures)
    blocks = {c.response.page_id: bytes(c.response.block) for c in captures}
    assert blocks["9"] == tricky.encode() and blocks["8"] == b"" and blocks["10"] == b"y" * 3_000_000 and blocks["12"] == pages[-1][2].encode()
    assert warc.capture_digests(frame.limit(0), str(tmp_path / "none")).count() == 0


def test_assembly_of_incomplete_captures(spark):
    rows = [("response", "r", None), ("request", "q", "r"), ("metadata", "m", "q"), ("request", "lost", "gone"), ("metadata", "alone", None), ("revisit", "v", None)]
    records = spark.createDataFrame([(*r, "1", None, None, None, None, b"") for r in rows], warc._RECORD)
    got = {c.capture_id: c for c in warc.assemble(records).collect()}
    assert set(got) == {"r", "gone", "alone", "v"}
    assert [x.record_id for x in got["r"].requests] == ["q"] and [x.record_id for x in got["r"].metadata] == ["m"]
    assert got["gone"].response is None and got["v"].requests is None


@pytest.mark.parametrize("uri, told, whole", [("u", 3, True), ("other", 3, False), ("u", 4, False), ("u", None, False)])
def test_captures_that_disagree(spark, uri, told, whole):
    rows = [("response", "r", None, "1", "u", None, 3, None, b"abc"), ("request", "q", "r", "1", uri, None, None, None, b"")]
    if told:
        rows.append(("metadata", "m", "r", "1", "u", None, None, None, b"payload-length: %d\r\n" % told))
    digests = warc.digests(spark.createDataFrame(rows, warc._RECORD))
    if whole:
        assert [tuple(r) for r in digests.collect()] == [("1", 3, hashlib.sha1(b"abc").hexdigest(), "response", None)]
    else:
        with pytest.raises(Exception, match="disagree: page 1"):
            digests.collect()


def fill(sums: list[tuple], weights, total, most):
    """Targets by sharing the excess again and again."""
    target = {}
    rest, open_ = total * sum(s for _, s in sums), {k: (s, weights[i % len(weights)]) for i, (k, s) in enumerate(sums)}
    while open_:
        unit = rest / sum(w for _, w in open_.values())
        full = {k: most * s for k, (s, w) in open_.items() if unit * w > most * s}
        if not full:
            return target | {k: unit * w for k, (_, w) in open_.items()}
        target |= full
        rest -= sum(full.values())
        open_ = {k: v for k, v in open_.items() if k not in full}
    return target


def test_mix(spark, docs, none):
    rng = random.Random(4)
    rows = [(i if i % 50 else None, " ".join("w" * rng.randrange(1, 9) for _ in range(rng.randrange(0, 60))) or None, rng.choice(["z", "é", "a", "a", "a", None]), 1, "s", "t") for i in range(1500)]
    frame = spark.createDataFrame(rows, DOC)
    got = mixing.mix(frame, (3, 1, 2), 1.5, 2).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sums = {s: sum(size(t) for _, t, x, *_ in rows if x == s) for s in {r[2] for r in rows}}
    order = sorted(sums.items(), key=lambda x: (x[0] is None, x[0] or ""))
    want = {sums[k]: t for k, t in fill(order, (3, 1, 2), 1.5, 2).items()}
    assert len(got) == len(rows) and sorted(r["size"] for r in got) == sorted(size(r[1]) for r in rows)
    for total, target in want.items():
        own = [r for r in got if r.source_size == total]
        assert all(abs(r.target - target) < 1e-6 for r in own)
        assert abs(sum(r.taken for r in own) - target) <= max(r["size"] for r in own)
    assert all(r.taken in (0, r["size"], 2 * r["size"]) for r in got)
    again = mixing.mix(frame.repartition(5).orderBy("text"), (3, 1, 2), 1.5, 2).collect()
    assert sorted((r["size"], r.target, r.taken) for r in again) == sorted((r["size"], r.target, r.taken) for r in got)
    assert mixing.mix(none, (3, 1, 2), 1.5, 2).count() == 0
    assert len(mixing.mix(docs, (3, 1, 2), 1.5, 2).collect()) == len(DOCS)
    assert mixing.mix_rows(docs, (3, 1, 2), 1.5, 2).columns == docs.columns and mixing.mix_rows(none, (3,), 1.5, 2).count() == 0


def test_reduction_tree(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP_ROWS", 8)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    frame = spark.createDataFrame([(i, "w " * (1 + i % 7), "a" if i % 3 else "b") for i in range(400)], "doc_id long, text string, source string")
    got = mixing.mix(frame, (2, 1), 1.3, 2).collect()
    for target in {r.target for r in got}:
        own = [r for r in got if r.target == target]
        assert abs(sum(r.taken for r in own) - target) <= 7
    assert len(got) == 400


def test_pivot_keeps_size_and_chances():
    rng = np.random.default_rng(1)
    size, share = rng.integers(1, 50, 40).astype(float), rng.random(40)
    runs = np.array([mixing.pivot(size, share, np.random.default_rng(k)) for k in range(3000)])
    assert np.allclose(runs @ size, share @ size)
    assert ((runs > 0) & (runs < 1)).sum(1).max() <= 1
    assert np.abs(runs.mean(0) - share).max() < 0.05


def test_records_whose_border_the_reader_missed_are_all_read():
    """A border that lies across two buffers of the text reader may be missed; nothing after it is lost."""
    record = lambda i, block: f"WARC-Type: response\r\nX-Page-ID: {i}\r\nContent-Length: {len(block)}\r\n\r\n{block}"
    blocks = ["a\r\n", "", "x" + warc.BORDER + "y", "\r\n\r\n", "end"]
    records = [record(i, b) for i, b in enumerate(blocks)]
    archive = warc.VERSION + "\r\n" + warc.BORDER.join(records) + warc.END
    for cut in range(1 << len(records)):  # every choice of borders that are seen
        pieces, rest = [], records[0]
        for i, r in enumerate(records[1:]):
            if cut >> i & 1:
                pieces.append(rest)
                rest = r
            else:
                rest += warc.BORDER + r
        pieces = [x.encode() for x in [*pieces, rest + warc.END]]
        pieces[0] = (warc.VERSION + "\r\n").encode() + pieces[0]
        if cut >> len(blocks) - 1 & 1:  # also where the reader sees the border inside a payload
            pieces = [x for p in pieces for x in p.split(warc.BORDER.encode())]
        assert [(h["x-page-id"], b.decode()) for h, b in warc._glued(iter(pieces))] == [(str(i), b) for i, b in enumerate(blocks)]
    assert [b.decode() for _, b in warc._glued(iter(archive.encode().split(warc.BORDER.encode())))] == blocks
