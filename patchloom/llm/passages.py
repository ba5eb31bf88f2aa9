"""Remove passages that recur anywhere in the corpus, with repeated-phrase automata.

A window of WINDOW words recurs when its words also start somewhere else. Each window has an
anchor: the phrase of PHRASE words whose hash is least among those inside. Equal windows have
equal anchors, so

1. phrases that are anchors anywhere are counted over all documents; those met at two places
   recur. The text (or piece) with the least hash is a phrase's home, and all phrases of one home
   make a shard, as phrases that stand together in one text tend to recur together;
2. each text goes whole to the shards of which it holds a phrase, once for each;
3. a shard compiles its phrases into an Aho-Corasick automaton and streams its texts through it.
   The places that the automaton returns are the only ones looked at: the windows around them
   that have the phrase as anchor are compared by 128 bits of hashes of their words;
4. the words of the windows that occur twice are removed from their documents.

Texts beyond PIECE bytes go in pieces that overlap by WINDOW - 1 words, so that each window is in
one piece. A shard with over SLICE bytes of texts is split into slices; each compiles the shard's
phrases and tells every window that it holds once, and those it holds more often, to a sum over
the slices. Equal documents are one text that counts twice.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, functions as F

from patchloom.llm.words import Words, batches
from patchloom.session import pin

WINDOW, PHRASE = 35, 12
PIECE = 1 << 18  # bytes of a text that are looked at together
SLICE = 1 << 20  # bytes of texts from which a shard is split
_BUNDLE = 1 << 20  # bytes of texts and phrases whose shards share an automaton
_NO_END = (1 << 31) - 1
_SPACE = re.compile(rb"[\x20\t-\r]")


def pieces(text: bytes, size: int, overlap: int) -> Iterator[tuple[int, int, bytes]]:
    """(number, index of its first word, words joined by one space) of each piece of about ``size`` bytes.

    A piece starts with the last ``overlap`` words of the one before; words stay whole.
    """
    at, number, first, width = 0, 0, 0, size
    while at + width < len(text):
        edge = _SPACE.search(text, at + width)
        if not edge:
            break
        chunk = text[at:edge.start()]
        words = chunk.split()
        if len(words) < 2 * overlap:  # very long words
            width *= 2
            continue
        yield number, first, b" ".join(words)
        at += len(chunk.rsplit(None, overlap)[0])
        number, first, width = number + 1, first + len(words) - overlap, size
    yield number, first, b" ".join(text[at:].split())


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) of each run of ``width`` values."""
    out, have = values, 1
    while have * 2 <= width:
        out = pick(out[:-have], out[have:])
        have *= 2
    return pick(out[: len(values) - width + 1], out[width - have:]) if have < width else out


def anchors(words: Words, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, hash) of the anchors of all windows; of equal phrases in a window each is one."""
    counts = np.diff(words.first)
    n, span = len(words.hashes), window - phrase + 1
    none = np.zeros(0, dtype=np.int64)
    if n < window:
        return none, none, none
    runs = words.runs(phrase)
    least = _sliding(runs, span, np.minimum)
    stop = np.repeat(words.first[1:], counts)
    least[np.arange(len(least)) + window > stop[: len(least)]] = 0  # crosses into the next text
    padded = np.concatenate([np.zeros(span - 1, np.uint64), least, np.zeros(span - 1, np.uint64)])
    at = np.flatnonzero(_sliding(padded, span, np.maximum) == runs)
    text = np.repeat(np.arange(len(counts)), counts)[at]
    ok = (runs[at] != 0) & (at + phrase <= stop[at])
    return text[ok], (at - words.first[text])[ok], runs[at][ok].view(np.int64)


def _table(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _find_anchors(window: int, phrase: int, size: int):
    """(d, m, p, bytes, pos, h): anchors at word ``pos`` of piece ``p`` of a text, with the piece's bytes."""
    def table(held: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        text, place, value = anchors(Words([h[3] for h in held]), window, phrase)
        whose = [np.array([h[i] for h in held], dtype=t)[text] for i, t in ((0, np.int64), (1, np.int32), (2, np.int32))]
        sizes = np.array([len(h[3]) for h in held], dtype=np.int32)[text]
        return pa.RecordBatch.from_arrays([pa.array(a) for a in (*whose, sizes, place.astype(np.int32), value)], names=["d", "m", "p", "bytes", "pos", "h"])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            held, total = [], 0
            for d, m, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                for p, _, piece in pieces(text.as_buffer().to_pybytes(), size, window - 1):
                    held.append((d, m, p, piece))
                    total += len(piece) + 1
                    if total > 1 << 19:
                        yield table(held)
                        held, total = [], 0
            if held:
                yield table(held)
    return run


_DEALT = [("shard", pa.int64()), ("slice", pa.int32()), ("slices", pa.int32()), ("d", pa.int64()), ("m", pa.int32()), ("first", pa.int32()), ("weight", pa.int32()), ("phrases", pa.binary()), ("words", pa.binary())]
_DEALT_SQL = "shard long, slice int, slices int, d long, m int, first int, weight int, phrases binary, words binary"


def _deal(window: int, phrase: int, size: int):
    """Rows of a slice: the phrases of the shard that a piece is home of, one a line, and the piece where it goes there."""
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            out, total = [], 0
            for d, m, weight, text, routes in zip(*batch.columns, strict=True):
                name = d.as_py(), m.as_py()
                weight = weight.as_py()
                by_piece: dict[int, list[dict]] = {}
                for route in routes.as_py():
                    by_piece.setdefault(route["p"], []).append(route)
                for p, first, piece in pieces(text.as_buffer().to_pybytes(), size, window - 1):
                    for route in by_piece.get(p, ()):
                        phrases = None
                        if route["positions"]:
                            words = piece.split(b" ")
                            phrases = b"\n".join(b" ".join(words[a:a + phrase]) for a in route["positions"])
                        out.append((route["shard"], route["slice"], route["slices"], *name, first, weight, phrases, piece if route["goes"] else None))
                        total += len(piece)
                        if total > 1 << 22:
                            yield _table(out, _DEALT)
                            out, total = [], 0
            if out:
                yield _table(out, _DEALT)
    return run


def windows_at_phrases(automaton: ahocorasick.Automaton, words: Words, window: int, phrase: int) -> np.ndarray:
    """First words of the windows whose anchor is a phrase that the automaton finds in ``words``.

    The texts of ``words`` hold one space between words. The automaton's keys are phrases with a
    space before and after, its values their lengths.
    """
    line = " " + words.data.tobytes().decode("latin-1")
    starts = np.fromiter((end - length + 1 for end, length in automaton.iter(line)), dtype=np.int64)
    if not len(starts) or len(words.hashes) < window:
        return np.zeros(0, dtype=np.int64)
    at = np.searchsorted(words.start, starts)
    runs, span = words.runs(phrase), window - phrase + 1
    least = _sliding(runs, span, np.minimum)
    stop = np.repeat(words.first[1:], np.diff(words.first))[: len(least)]
    marked = np.zeros(len(least), dtype=bool)
    for back in range(span):
        a = at - back
        ok = (a >= 0) & (a < len(least))
        a, hashes = a[ok], runs[at[ok]]
        marked[a[least[a] == hashes]] = True
    return np.flatnonzero(marked & (np.arange(len(least)) + window <= stop))


class _Bundle:
    """Slices that share an automaton; a text counts for the slice it was sent to."""

    def __init__(self, window: int, phrase: int):
        self.window, self.phrase = window, phrase
        self.slices: list[tuple[int, int]] = []  # shard, number of its slices
        self.phrases: set[bytes] = set()
        self.names: list[tuple[int, int, int, int, int]] = []  # index in slices, d, m, first, weight
        self.texts: list[bytes] = []
        self.bytes = 0

    def add(self, d: int, m: int, first: int, weight: int, phrases: bytes | None, words: bytes | None) -> None:
        if phrases is not None:
            self.phrases.update(phrases.split(b"\n"))
            self.bytes += len(phrases)
        if words is not None:
            self.names.append((len(self.slices) - 1, d, m, first, weight))
            self.texts.append(words)
            self.bytes += len(words)

    def table(self) -> Iterator[pa.RecordBatch]:
        """Ranges of recurring words (a is null), and windows to be summed over the slices of a shard."""
        if not self.phrases or not self.texts:
            return
        automaton = ahocorasick.Automaton()
        for held in self.phrases:
            automaton.add_word(f" {held.decode('latin-1')} ", len(held) + 2)
        automaton.make_automaton()
        parts: list[tuple[np.ndarray, ...]] = []
        for index, part in batches(self.texts):
            words = Words(part)
            at = windows_at_phrases(automaton, words, self.window, self.phrase)
            if len(at):
                text = np.searchsorted(words.first, at, side="right") - 1
                parts.append((index + text, at - words.first[text], words.runs(self.window)[at], words.runs(self.window, 1)[at]))
        if not parts:
            return
        text, place, a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
        names = np.array(self.names, dtype=np.int64)
        which, d, m, first, weight = names[text].T
        lo = first + place
        order = np.lexsort((b, a, which))
        new = np.ones(len(order), dtype=bool)
        new[1:] = np.any([x[order][1:] != x[order][:-1] for x in (which, a, b)], axis=0)
        heads = np.flatnonzero(new)
        sums = np.add.reduceat(weight[order], heads)
        again = np.empty(len(order), dtype=bool)
        again[order] = np.repeat(sums >= 2, np.diff(np.append(heads, len(order))))
        yield self._ranges(text[again], d[again], m[again], lo[again])
        shards, slices = np.array(self.slices, dtype=np.int64).T
        one = order[heads]  # a window of each kind, for shards of several slices
        keep = slices[which[one]] > 1
        one, sums = one[keep], sums[keep]
        if len(one):
            alone = pa.array(sums < 2)
            null = pa.nulls(len(one), pa.int64())
            place_of = [pa.compute.if_else(alone, pa.array(x[one]), null).cast(k) for x, k in ((d, pa.int64()), (m, pa.int32()), (lo, pa.int32()), (lo + self.window, pa.int32()))]
            key = a[one].view(np.int64) ^ shards[which[one]]
            yield pa.RecordBatch.from_arrays([*place_of, pa.array(key), pa.array(b[one].view(np.int64)), pa.array(np.minimum(sums, 2).astype(np.int32))], names=_LOCATED)

    def _ranges(self, text: np.ndarray, d: np.ndarray, m: np.ndarray, lo: np.ndarray) -> pa.RecordBatch:
        new = np.ones(len(lo), dtype=bool)
        new[1:] = (text[1:] != text[:-1]) | (lo[1:] - lo[:-1] > self.window)
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(lo))[: len(head)] - 1
        null = pa.nulls(len(head), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(d[head]), pa.array(m[head].astype(np.int32)), pa.array(lo[head].astype(np.int32)), pa.array((lo[tail] + self.window).astype(np.int32)), null, null, null.cast(pa.int32())], names=_LOCATED)


_LOCATED = ["d", "m", "lo", "hi", "a", "b", "n"]


def _locate(window: int, phrase: int):
    """Rows come sorted by shard and slice."""
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, now = _Bundle(window, phrase), None
        for batch in stream:
            for shard, piece, slices, *name, phrases, words in zip(*batch.columns, strict=True):
                key = shard.as_py(), piece.as_py()
                if key != now:
                    if bundle.bytes >= _BUNDLE:
                        yield from bundle.table()
                        bundle = _Bundle(window, phrase)
                    bundle.slices.append((key[0], slices.as_py()))
                    now = key
                bundle.add(*(x.as_py() for x in name), phrases.as_py(), words.as_py())
        yield from bundle.table()
    return run


def recurring_spans(rows: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """(d, m, spans) of texts with recurring windows; ``rows`` is (d, m, text binary), d and m name the text.

    Spans are (lo, hi) word ranges and may overlap; that of equal documents has no end.
    """
    found = pin(rows.mapInArrow(_find_anchors(window, phrase, PIECE), "d long, m int, p int, bytes int, pos int, h long"))
    found = found.withColumn("unit", F.xxhash64("d", "m", "p"))
    again = found.groupBy("h").agg(F.min("unit").alias("shard"), F.max("unit").alias("_unit"), F.min("pos").alias("_lo"), F.max("pos").alias("_hi"))
    again = pin(again.filter("shard <> _unit OR _lo <> _hi").select("h", "shard"))
    routes = pin(found.join(again, "h").groupBy("d", "m", "p", "shard").agg(
        F.max("bytes").alias("bytes"), F.collect_set(F.when(F.col("unit") == F.col("shard"), F.col("pos"))).alias("positions")))
    large = routes.groupBy("shard").agg(F.sum("bytes").alias("_all")).filter(F.col("_all") > SLICE).select("shard", F.ceil(F.col("_all") / SLICE).cast("int").alias("slices"))
    own = F.pmod(F.xxhash64("d", "m", "p"), F.col("slices")).cast("int")
    slices = F.when(F.size("positions") > 0, F.sequence(F.lit(0), F.col("slices") - 1)).otherwise(F.array(own))
    sent = routes.join(large, "shard", "left").fillna(1, ["slices"]).withColumn("slice", F.explode(slices)).withColumn("goes", F.col("slice") == own)
    sent = sent.groupBy("d", "m").agg(F.collect_list(F.struct("p", "shard", "slice", "slices", "goes", "positions")).alias("routes"))
    texts = rows.groupBy("d", "m").agg(F.first("text").alias("text"), F.least(F.count(F.lit(1)), F.lit(2)).cast("int").alias("weight"))
    dealt = texts.join(sent, ["d", "m"]).select("d", "m", "weight", "text", "routes").mapInArrow(_deal(window, phrase, PIECE), _DEALT_SQL)
    located = pin(dealt.repartition("shard", "slice").sortWithinPartitions("shard", "slice").mapInArrow(
        _locate(window, phrase), "d long, m int, lo int, hi int, a long, b long, n int"))
    between = located.filter("a IS NOT NULL").groupBy("a", "b").agg(F.sum("n").alias("n"), F.collect_list(F.when(F.col("d").isNotNull(), F.struct("d", "m", "lo", "hi"))).alias("alone"))
    between = between.filter("n > 1").select(F.explode("alone").alias("s")).select("s.d", "s.m", "s.lo", "s.hi")
    copies = rows.groupBy("d", "m").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("d", "m", F.lit(0).alias("lo"), F.lit(_NO_END).alias("hi"))
    spans = located.filter("a IS NULL").select("d", "m", "lo", "hi").unionByName(between).unionByName(copies)
    return spans.groupBy("d", "m").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))


def _strip(rejoin: bool, window: int):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            totals, removed, kept = [], [], []
            for text, spans in zip(batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1), strict=True):
                words = (text.as_py() or b"").split()
                gone = np.zeros(len(words), dtype=bool)
                for s in spans.as_py() or ():
                    if s["hi"] != _NO_END or len(words) >= window:
                        gone[s["lo"]:s["hi"]] = True
                totals.append(len(words))
                removed.append(int(gone.sum()))
                if removed[-1]:
                    kept.append(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]))
                else:
                    kept.append(b" ".join(words) if rejoin else text.as_py())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-2], pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                names=[*batch.schema.names[:-2], "n_words", "n_removed", "kept"])
    return run


def _stripped(docs: DataFrame, text: str, window: int, phrase: int, carry: list[str], rejoin: bool) -> DataFrame:
    """(_row, a struct of the carried columns, n_words, n_removed, kept)."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    name = [F.xxhash64(body).alias("d"), F.hash(body, F.lit(7)).alias("m")]
    spans = pin(recurring_spans(docs.select(*name, body.alias("text")), window, phrase))
    packed = docs.select(F.struct(*carry).alias("_row"), *name, F.col(text).cast("binary").alias("_text"))
    joined = packed.join(spans, ["d", "m"], "left").select("_row", "_text", "spans")
    schema = joined.select("_row").withColumns({"n_words": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long"), "kept": F.lit(None).cast("string")}).schema
    return joined.mapInArrow(_strip(rejoin, window), schema)


def remove_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """(key, n_words, n_removed, kept) for each row: the kept words, joined by one space.

    A word goes when a window over it also starts anywhere else, in the same text too. Null texts
    have no words and give an empty string; repeated rows lose whatever they share, that is all
    words of texts with at least ``window`` words. Windows are judged on the input.
    """
    return _stripped(docs, text, window, phrase, [key], True).select(F.col("_row")[key].alias(key), "n_words", "n_removed", "kept")


def strip_passages(docs: DataFrame, text: str = "text", window: int = WINDOW, phrase: int = PHRASE, length: str | None = None) -> DataFrame:
    """``docs`` with the recurring words of its texts removed; texts that lose nothing stay as they are.

    ``length`` names a column that holds the text's length in code points and is brought up to
    date. All rows and other columns stay, also those of texts that lose all words.
    """
    others = [c for c in docs.columns if c != text]
    made = _stripped(docs, text, window, phrase, others, False)
    field = lambda c: F.length("kept").cast(docs.schema[c].dataType) if c == length else F.col("_row")[c]
    return made.select(*(F.col("kept").alias(c) if c == text else field(c).alias(c) for c in docs.columns))
