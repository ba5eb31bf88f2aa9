"""Toxicity scores that see through disguised spelling, by a noisy channel.

What is written ("1d10t", "s-t-u-p-i-d", "stuuupid") is taken for a noisy copy of what was meant.
A lattice holds, for each written character, the letters it may stand for, or nothing at all for
separators and repetitions; Viterbi decoding picks the path that a character trigram model finds
likeliest. The model's counts come from all texts. The restored words are scored by weights
learned from labelled documents: Bernoulli naive Bayes over words that tell the classes apart
beyond chance. Neighbouring fragments ("st upid") are read as one where the lattice of the two
or more together can spell a word with a weight, and Viterbi says that it does.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from patchloom.session import pin

SHARE = 0.1  # of the weights of all but the strongest word
TRAINING_ROWS = 20_000  # labelled documents that weights are learned from, picked by a hash
MAX_FEATURES = 5_000  # words with a weight, the surest first
CERTAINTY = 2.0  # standard errors by which a word must make toxic documents likelier than others
REMEMBERED = 40_000  # spellings a task remembers
FOLDS, HELD_OUT = 5, 0

# Letters of the character model by index; index 0 is the border of a word, the last any other letter.
_LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøùúûüýßœ"
_OTHER = len(_LETTERS) + 1
_SIZE = 64
_INDEX = {c: i for i, c in enumerate(_LETTERS, 1)}
_CODES = np.zeros(0x10000, dtype=np.int64)
for _c in range(0x10000):
    if not 0xD800 <= _c < 0xE000 and chr(_c).isalpha():
        _CODES[_c] = _INDEX.get(chr(_c).lower(), _OTHER)

# The letters that digits and signs stand for in disguised spelling.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i",
}
SEPARATORS = ".-_*~^/\\,:;'\"`´·• "
_LOG_AS_IS, _LOG_STANDS, _LOG_DROP, _LOG_REPEAT = math.log(0.95), math.log(0.3), math.log(0.6), math.log(0.2)
_LOG_DIGIT, _LOG_BORDER = math.log(1e-5), math.log(0.02)  # a sign that is no letter; a separator that does separate

_LETTER = r"[^\W\d_]"
_SIGN = "[" + re.escape("".join(STANDS_FOR)) + "]"
_SEP = "[" + re.escape(SEPARATORS.strip()) + "]"
# Words worth decoding: a letter next to a sign that may be one, letters with signs between them, a letter twice in a row.
_DISGUISED = re.compile(rf"{_LETTER}{_SIGN}|{_SIGN}{_LETTER}|{_LETTER}{_SEP}+{_LETTER}|({_LETTER})\1", re.IGNORECASE)
# Runs of single characters with any white space between them.
_SINGLE = re.compile(rf"{_LETTER}|{_SIGN}")
_SPACED = re.compile(rf"(?<!\S)(?:{_LETTER}|{_SIGN})(?:\s+(?:{_LETTER}|{_SIGN}))+(?!\S)")
_WORDS = re.compile(rf"{_LETTER}+")
_LONGEST = 64  # characters of a spelling that a task remembers; longer ones are read again each time


def _codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), dtype=np.uint16)
    return _CODES[points]


def trigram_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Counts of letter trigrams over all texts, words with two borders before them and one after.

    Tasks count by themselves; the table has 64**3 cells whatever the corpus.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_SIZE ** 3, dtype=np.int64)
        for batch in batches:
            held, size = [], 0
            values = [v.as_py() for v in batch.column(0)]
            for i, v in enumerate(values):
                if v:
                    held.append(v)
                    size += len(v)
                if size > 1 << 18 or i == len(values) - 1:
                    c = _codes("  " + "  ".join(held) + "  ")
                    total += np.bincount((c[:-2] * _SIZE + c[1:-1]) * _SIZE + c[2:], minlength=_SIZE ** 3)
                    held, size = [], 0
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "n"])

    cells = docs.select(text).mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    counts = np.zeros(_SIZE ** 3)
    for cell, n in cells.collect():  # at most 64**3 rows
        counts[cell] = n
    return counts.reshape(_SIZE, _SIZE, _SIZE)


def log_model(counts: np.ndarray) -> np.ndarray:
    """log P(c | a, b), trigrams shrunk towards bigrams and these towards single letters."""
    one = counts.sum((0, 1)) + 1.0
    one /= one.sum()
    pairs = counts.sum(0)
    two = (pairs + 20 * one) / (pairs.sum(1, keepdims=True) + 20)
    three = (counts + 20 * two) / (counts.sum(2, keepdims=True) + 20)
    return np.log(three)


def lattice(written: str) -> Iterator[tuple[tuple[str, float], ...]]:
    """For each written character the letters it may stand for, each with a log chance; "" drops it.

    A space that is kept is a border. A letter that repeats the one before it may be dropped.
    """
    before = ""
    for ch in written:
        yield _options(ch, ch == before)
        before = ch


@lru_cache(4096)
def _options(ch: str, again: bool) -> tuple[tuple[str, float], ...]:
    options: list[tuple[str, float]] = []
    if ch.isalpha():
        options.append((ch, _LOG_AS_IS))
        if again:
            options.append(("", _LOG_REPEAT))
    elif ch in STANDS_FOR:
        options += [(c, _LOG_STANDS) for c in STANDS_FOR[ch]]
        options.append((" ", _LOG_DIGIT))
        if again:
            options.append(("", _LOG_REPEAT))
        if ch in "+!|(<":
            options.append(("", _LOG_DROP))
    elif ch in SEPARATORS:
        options += [("", _LOG_DROP), (" ", _LOG_BORDER)]
    else:
        options.append((" ", _LOG_AS_IS))
    return tuple(options)


def decode(written: str, model: np.ndarray) -> str:
    """The likeliest reading of the whole of ``written`` (lower case); states are the last two letters read.

    Time grows with its length. What all paths share is settled where they meet in one state.
    """
    beam: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
    settled: list[str] = []
    for options in lattice(written):
        reached: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (score, path) in beam.items():
            for letter, chance in options:
                if not letter:
                    state, new, way = (a, b), score + chance, path
                else:
                    c = 0 if letter == " " else _INDEX.get(letter, _OTHER)
                    if c == 0 and b == 0:  # borders don't pile up
                        state, new, way = (0, 0), score + chance, path
                    else:
                        state, new, way = ((b, c) if c else (0, 0)), score + chance + model[a, b, c], (path, letter)
                if state not in reached or new > reached[state][0]:
                    reached[state] = (new, way)
        beam = reached
        if len(beam) == 1:
            (state, (score, path)), = beam.items()
            settled += _letters(path)
            beam = {state: (score, ())}
    _, path = max(((score + (model[a, b, 0] if b else 0.0), path) for (a, b), (score, path) in beam.items()), key=lambda x: x[0])
    return "".join(settled + _letters(path))


def _letters(path: tuple) -> list[str]:
    letters = []
    while path:
        path, letter = path
        letters.append(letter)
    return letters[::-1]


def restored_words(written: str, model: np.ndarray, worth: Callable[[str], bool] = bool) -> frozenset[str]:
    """Words of one spelling as it is written and, where it looks disguised and is worth it, as it was meant."""
    words = set(_WORDS.findall(written))
    if _DISGUISED.search(written) and worth(written):
        words.update(_WORDS.findall(decode(written, model)))
    return frozenset(words)


class _Spellings(dict):
    """What each spelling means, found when it is first met."""

    fragments: _Fragments | None = None

    def __init__(self, meaning: Callable[[str], frozenset]):
        self.meaning = meaning

    def __missing__(self, written: str) -> frozenset:
        made = self.meaning(written)
        if len(written) <= _LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[written] = made
        return made


def _contents(text: str | None, spellings: _Spellings) -> set:
    """Union of what the spellings of the whole text mean."""
    if not text:
        return set()
    low = text.lower()
    found: set = set()
    fragments = low.split()
    known = set(fragments)
    if spellings.fragments:
        known = spellings.fragments.hopeful(known)
    found.update(*map(spellings.__getitem__, known))
    for run in _SPACED.findall(low):
        found |= spellings[" " + " ".join(run.split())]
    if spellings.fragments:
        spellings.fragments.add_to(found, fragments, known)
    return found


def _spelling_words(model: np.ndarray, worth: Callable[[str], bool] = bool) -> Callable[[str], frozenset]:
    def words(written: str) -> frozenset:
        if written.startswith(" "):  # a run of single characters, or fragments that may be one word
            return frozenset(_WORDS.findall(decode(written[1:], model))) if worth(written) else frozenset()
        return restored_words(written, model, worth)
    return words


_NOTHING = frozenset(), frozenset()


class _Fragments:
    """Words with a weight that neighbouring fragments of a text make up; bounded by the words and what is remembered.

    Beginnings of words are followed through the lattice of each fragment, so whatever Viterbi can
    read as a word across a space is met; what is met is decoded with its fragments together.
    """

    def __init__(self, words: Iterable[str], model: np.ndarray):
        self.words = frozenset(words)
        self.beginnings = frozenset(w[:n] for w in self.words for n in range(1, len(w) + 1))
        self.fresh = _Spellings(lambda written: self._follow("", written)[1])
        self.steps: dict[tuple[str, str], tuple[frozenset, frozenset]] = {}
        known = _spelling_words(model, self.can_spell)
        self.spellings = _Spellings(lambda written: known(written) & self.words)
        self.spellings.fragments = self

    def can_spell(self, written: str) -> bool:
        """Whether any path through the lattice has a word with a weight; where none has, decoding can't find one."""
        return bool(self._follow("", written)[0])

    def _follow(self, begun: str, written: str) -> tuple[frozenset, frozenset]:
        """From ``begun``, which lies before ``written``: words that end in it, and beginnings that reach its end.

        Nothing begun: words may begin here and after each border inside.
        """
        ended, at, beginnings = set(), {begun}, self.beginnings
        plain = bool(begun) or written.isalpha()  # no word begins later
        for options in lattice(written):
            reached = set()
            for letter, _ in options:
                if not letter:
                    reached |= at
                elif letter == " ":
                    ended |= at & self.words
                    if not begun:
                        reached.add("")
                else:
                    for b in at:
                        if b + letter in beginnings:
                            reached.add(b + letter)
            at = reached
            if plain and not at:
                break
        return frozenset(ended | (at & self.words)), frozenset(at - {""})

    def _step(self, begun: str, written: str) -> tuple[frozenset, frozenset]:
        made = self.steps.get((begun, written))
        if made is None:
            made = self._follow(begun, written)
            made = made if any(made) else _NOTHING
            if len(written) <= _LONGEST:
                if len(self.steps) >= REMEMBERED // 4:
                    self.steps.clear()
                self.steps[begun, written] = made
        return made

    def hopeful(self, written: set[str]) -> set[str]:
        """Without those of letters only that begin as no word does: nothing can be read from them, or begin in them."""
        beginnings = self.beginnings
        return {w for w in written if w[0] in beginnings or not w.isalpha()}

    def add_to(self, found: set, fragments: list[str], hopeful: set[str]) -> None:
        held: dict[str, int] = {}  # beginnings and the last fragment that each can start with
        tried: set[tuple[str, int]] = set()
        for i, written in enumerate(fragments):
            fresh = self.fresh[written] if written in hopeful else ()
            if held:
                onward: dict[str, int] = {}
                for begun, start in held.items():
                    ended, reached = self._step(begun, written)
                    for word in ended:
                        # the same word from the same start only drops more when met again
                        if word not in found and (word, start) not in tried:
                            tried.add((word, start))
                            window = fragments[start:i + 1]
                            if not all(map(_SINGLE.fullmatch, window)):  # such runs are decoded whole
                                found |= self.spellings[" " + " ".join(window)]
                    for b in reached:
                        if onward.get(b, -1) < start:
                            onward[b] = start
                held = onward
            for b in fresh:
                held[b] = i


@dataclass(frozen=True)
class Scorer:
    """Character model, word weights, and what makes their sum a chance; bounded by the model's size and MAX_FEATURES."""

    model: np.ndarray
    weights: dict[str, float]
    intercept: float
    slope: float = 1.0

    def spellings(self) -> _Spellings:
        return _Fragments(self.weights, self.model).spellings

    def total(self, text: str | None, spellings: _Spellings) -> float:
        """Log odds: the strongest word decides, the others add a share of their weights."""
        found = sorted((self.weights[w] for w in _contents(text, spellings)), reverse=True)
        return self.intercept + self.slope * (sum(found[:1]) + SHARE * sum(found[1:]))

    def score(self, text: str | None, spellings: _Spellings) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.total(text, spellings)))))


def in_fold(key: Column) -> Column:
    """crc32 of the key as text modulo FOLDS; a null key is in no held-out fold."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % FOLDS, F.lit(-1))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = TRAINING_ROWS) -> Scorer:
    """Learn from all texts (character counts) and from ``rows`` labelled documents outside the held-out fold.

    A document with several labels counts as toxic when one says so; labels that are null, or
    without a document, are left out. Without toxic or without other documents every score is
    the share of toxic ones (one half where there are no labels).
    """
    model = log_model(trigram_counts(docs, text))
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & (in_fold(F.col(key)) != HELD_OUT)).groupBy(key).agg(F.max(label).alias("_label"))
    sample = known.orderBy(F.xxhash64(key), key).limit(rows)  # bounded, so it may be broadcast
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spellings = _Spellings(_spelling_words(shared.value))
        toxic: Counter[str] = Counter()
        other: Counter[str] = Counter()

        def table() -> pa.RecordBatch:
            words = list(toxic.keys() | other.keys())
            columns = [pa.array(words, pa.string()), *(pa.array([c[w] for w in words], pa.int64()) for c in (toxic, other))]
            return pa.RecordBatch.from_arrays(columns, names=["word", "toxic", "other"])

        for batch in batches:
            for value, is_toxic in zip(batch.column(0), batch.column(1), strict=True):
                own = toxic if is_toxic.as_py() else other
                own.update(_contents(value.as_py(), spellings))
                own[""] += 1  # counts documents
            if len(toxic) + len(other) > 150_000:
                yield table()
                toxic.clear()
                other.clear()
        yield table()

    # a text that many documents share counts once
    labelled = docs.select(key, F.col(text).alias("_text")).join(F.broadcast(sample), key).groupBy("_text").agg(F.max("_label").alias("_label"))
    counts = labelled.mapInArrow(count, "word string, toxic long, other long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    counts = pin(counts)
    totals = counts.filter("word = ''").first()
    t, o = (totals["toxic"], totals["other"]) if totals else (0, 0)
    if not t or not o:
        return Scorer(model, {}, math.log((t + 0.5) / (o + 0.5)))
    toxic, other = F.col("toxic") + 0.5, F.col("other") + 0.5
    without, without_other = t - F.col("toxic") + 0.5, o - F.col("other") + 0.5
    sure = counts.filter("word <> ''").select(
        "word", (toxic / (t + 1)).alias("p"), (other / (o + 1)).alias("q"), F.log(toxic * without_other / (other * without)).alias("odds"),
        F.sqrt(1 / toxic + 1 / other + 1 / without + 1 / without_other).alias("spread"),
    ).withColumn("least", F.col("odds") - CERTAINTY * F.col("spread")).filter(F.col("least") > math.log(o / t))
    best = sure.orderBy(F.desc("least"), "word").limit(MAX_FEATURES).collect()
    raw = Scorer(model, {r["word"]: r["odds"] for r in best}, 0.0, 1.0)
    sums = add_scores(labelled, raw, "_text", "_sum", Scorer.total).select(F.round("_sum", 3), F.col("_label") > 0)
    slope, intercept = _logistic(*np.array(sums.collect(), dtype=np.float64).T)  # one row for each of the sample
    return Scorer(model, raw.weights, intercept, slope)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """(slope, intercept) that make the sums into chances; the words of a class rule each other out,
    so their weights can't simply be added up. Newton steps, halved while they don't help."""
    x = np.stack([x, np.ones_like(x)], axis=1)

    def loss(beta: np.ndarray) -> float:
        z = x @ beta
        return float(np.logaddexp(0, z).sum() - y @ z + ridge * beta @ beta / 2)

    beta = np.array([0.0, math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -500, 500)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge * np.eye(2), x.T @ (y - p) - ridge * beta)
        size = 1.0
        while size > 1e-6 and loss(beta + size * step) > loss(beta):
            size /= 2
        beta = beta + size * step
        if size <= 1e-6 or np.abs(size * step).max() < 1e-9:
            break
    return max(0.0, float(beta[0])), float(beta[1])


def add_scores(docs: DataFrame, scorer: Scorer, text: str = "text", out: str = "score", measure: Callable[[Scorer, str | None, _Spellings], float] = Scorer.score) -> DataFrame:
    """Add the score of the whole text, 0 to 1. Null and empty texts get that of a text without weighted words.

    Map-only; other columns and repeated rows are kept as they are. ``out`` must be a new name.
    """
    if out.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"column {out} is there already")
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spellings = shared.value.spellings()
        for batch in batches:
            made = [measure(shared.value, v.as_py(), spellings) for v in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.float64())], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, docs.withColumn(out, F.lit(0.0)).schema)


def score_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """(key, held_out, score, predicted) for each document; only the text goes into the score."""
    scorer = train(docs, labels, key, text, label)
    return add_scores(docs.select(key, F.col(text).alias("_text")), scorer, "_text", "score").select(
        key, (in_fold(F.col(key)) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
