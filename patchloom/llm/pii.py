"""Personal data in whole texts: patterns propose spans, checks confirm them, context words weigh them.

Four base kinds (``BASE``) are found leftmost and without overlaps, each by one pattern and one check;
a match that fails its check is dropped and not tried again. Other kinds add spans that the base
patterns miss: account numbers with a valid mod-97 sum, card numbers inside longer runs of digits,
disguised addresses, and numbers that only the words around them make personal. Added spans need a
score of at least ``ACCEPT``; base spans stay whatever their score.

Every pattern reads a text once: runs of letters or digits are entered at their start only, are
taken whole and never given back, so no text costs more than its length.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

BASE = ("email", "ip", "card", "phone")
ADDED = ("masked_email", "iban", "inner_card", "local_phone", "ssn")
ACCEPT = 0.5  # least score of an added span
BEFORE, AFTER = 48, 24  # code points around a span that are searched for context words
SPAN = "array<struct<kind:string,start:int,end:int,base:boolean,score:double>>"


class Span(NamedTuple):
    start: int
    end: int
    kind: str
    base: bool
    score: float


def luhn(digits: str) -> bool:
    """Does the last digit make the weighted digit sum a multiple of ten?"""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def mod97(account: str) -> bool:
    """Is an account number (country, two check digits, the rest) 1 modulo 97, letters counting from 10?"""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


# --- base kinds ---------------------------------------------------------------------------------

_DOMAIN = r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_LOCAL = r"[A-Za-z0-9._%+-]"
_EMAIL_HERE = re.compile(rf"{_LOCAL}++@{_DOMAIN}")
_EMAIL = re.compile(rf"(?<!{_LOCAL}){_LOCAL}++@{_DOMAIN}")
_OCTETS = r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_IP_HERE = re.compile(_OCTETS)
_IP = re.compile(rf"(?<![0-9]){_OCTETS}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _each(here: re.Pattern[str], later: re.Pattern[str], text: str) -> Iterator[re.Match[str]]:
    """Leftmost matches. ``later`` enters runs at their start only; just behind a match the next may start inside one."""
    at = 0
    while m := here.match(text, at) or later.search(text, at):
        yield m
        at = m.end()


def _is_ip(match: str) -> bool:
    return all(len(p) <= 3 and int(p) <= 255 for p in (part.lstrip("0") or "0" for part in match.split(".")))


def _is_card(match: str) -> bool:
    digits = _digits(match)
    return 14 <= len(digits) <= 19 and luhn(digits)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base kinds, by start, then in the order of ``BASE``."""
    out = []
    if "@" in text:
        out += [(*m.span(), "email") for m in _each(_EMAIL_HERE, _EMAIL, text)]
    out += [(*m.span(), "ip") for m in _each(_IP_HERE, _IP, text) if _is_ip(m[0])]
    out += [(*m.span(), "card") for m in _CARD.finditer(text) if m.end() - m.start() >= 14 and _is_card(m[0])]
    if "+" in text:
        out += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], BASE.index(s[2])))


# --- added kinds --------------------------------------------------------------------------------

#: Total lengths of account numbers by country (ISO 13616).
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "CH": 21, "CR": 22, "CY": 28,
    "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23,
    "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28,
    "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15,
    "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24,
    "TR": 26, "UA": 29, "XK": 20,
}
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=[ -]?[A-Z0-9])")
_IBAN_REST = {n: re.compile(rf"(?:[ -]?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])") for n in sorted(set(IBAN_LENGTHS.values()))}
_AT = re.compile(r"[\[({<]\s?(?:at|arroba|AT|ät)\s?[\])}>]")
_NAME_BEFORE = re.compile(r"[A-Za-z0-9._%+-]{1,64}\s?$")
_MASKED_DOMAIN = re.compile(r"\s?[A-Za-z0-9-]{1,63}(?:(?:\.|\s?[\[({<]\s?(?:dot|punkt|point|punto|DOT)\s?[\])}>]\s?)[A-Za-z0-9-]{1,63}){1,8}")
_LOCAL_PHONE = re.compile(r"(?<![\w+.,/-])\(?[0-9]{2,5}\)?(?:[ ./-]?[0-9]{2,5}){1,4}(?![\w,/-])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_GROUP = re.compile(r"[0-9]+")
_ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|3[068]|6")  # first digits that card issuers use
_GROUPINGS = {(4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 4, 4, 3)}

#: Words near a span that make its kind likelier, and words that make it less likely.
CONTEXT = {
    "email": ("mail", "e-mail", "email", "contact", "kontakt", "write", "correo", "courriel", "address", "adresse"),
    "ip": ("ip", "address", "adresse", "host", "server", "login", "client", "serveur", "servidor"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "karte", "kreditkarte", "carte", "tarjeta", "payment", "zahlung"),
    "phone": ("phone", "tel", "telefon", "téléphone", "teléfono", "call", "mobile", "cell", "fax", "handy", "anruf", "appelez", "llame", "portable", "móvil"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta", "bic", "swift"),
    "ssn": ("ssn", "social", "security"),
}
AGAINST = {
    "ip": ("version", "release", "v", "section", "build", "kapitel", "chapitre"),
    "card": ("isbn", "order", "invoice", "tracking", "serial", "id", "hash", "token", "rechnung", "commande", "pedido"),
    "phone": ("isbn", "order", "invoice", "version", "page", "id", "seite", "section"),
    "iban": ("serial", "token", "hash"),
    "ssn": ("isbn", "order", "invoice", "part"),
}
_CLASS = {"masked_email": "email", "inner_card": "card", "local_phone": "phone"}
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
#: Score of a confirmed span before its context is read; a word for or against it counts ``STEP``.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.6, "phone": 0.7, "masked_email": 0.6, "iban": 0.9, "inner_card": 0.4, "local_phone": 0.3, "ssn": 0.3}
STEP = 0.3


def context_score(text: str, start: int, end: int, kind: str, prior: float) -> float:
    """``prior``, moved up and down once each by words around the span, from 0 to 1."""
    kind = _CLASS.get(kind, kind)
    lo = max(0, start - BEFORE)
    around = set(_WORD.findall(text[lo:start].lower())) | set(_WORD.findall(text[end:end + AFTER].lower()))
    score = prior + STEP * any(w in around for w in CONTEXT[kind]) - STEP * any(w in around for w in AGAINST.get(kind, ()))
    return round(min(1.0, max(0.0, score)), 6)


def _masked_emails(text: str) -> Iterator[tuple[int, int, float]]:
    for m in _AT.finditer(text):
        lo = max(0, m.start() - 66)
        name, domain = _NAME_BEFORE.search(text[lo:m.start()]), _MASKED_DOMAIN.match(text, m.end())
        if name and domain:
            yield lo + name.start(), domain.end(), PRIOR["masked_email"]


def _accounts(text: str) -> Iterator[tuple[int, int, float]]:
    for m in _IBAN.finditer(text):
        rest = _IBAN_REST.get(IBAN_LENGTHS.get(m[0][:2], 0))
        tail = rest and rest.match(text, m.end())
        if tail and mod97(re.sub("[ -]", "", text[m.start():tail.end()])):
            yield m.start(), tail.end(), PRIOR["iban"]


def _inner_cards(text: str) -> Iterator[tuple[int, int, float]]:
    """Card numbers made of whole groups of a run of digits that is no card number itself."""
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 14 or _is_card(m[0]):
            continue
        groups = [(g.start(), g.end()) for g in _GROUP.finditer(text, *m.span())]
        after = 0
        for i, (lo, _) in enumerate(groups):
            if lo < after or not _ISSUERS.match(text, lo):
                continue
            sizes: list[int] = []
            for a, b in groups[i:]:
                sizes.append(b - a)
                if sum(sizes) > 19:
                    break
                usual = tuple(sizes) in _GROUPINGS
                if (usual or len(sizes) == 1) and len(groups) > len(sizes) and _is_card(text[lo:b]):
                    yield lo, b, PRIOR["inner_card"] + (0.2 if usual else 0.0)
                    after = b
                    break


def _local_phones(text: str) -> Iterator[tuple[int, int, float]]:
    for m in _LOCAL_PHONE.finditer(text):
        if 7 <= len(_digits(m[0])) <= 15:
            yield *m.span(), PRIOR["local_phone"]


def _social_numbers(text: str) -> Iterator[tuple[int, int, float]]:
    for m in _SSN.finditer(text):
        yield *m.span(), PRIOR["ssn"]


_FINDERS: dict[str, Callable[[str], Iterator[tuple[int, int, float]]]] = dict(
    zip(ADDED, (_masked_emails, _accounts, _inner_cards, _local_phones, _social_numbers), strict=True))


def find_spans(text: str) -> list[Span]:
    """All spans of a text, by start, then kind as listed in ``BASE`` and ``ADDED``.

    Added spans that overlap a base span, or an added one with a higher score, are left out.
    """
    base = base_spans(text)
    spans = [Span(a, b, kind, True, context_score(text, a, b, kind, PRIOR[kind])) for a, b, kind in base]
    more = []
    for kind, finder in _FINDERS.items():
        for a, b, prior in finder(text):
            score = context_score(text, a, b, kind, prior)
            if score >= ACCEPT:
                more.append(Span(a, b, kind, False, score))
    kept = _apart([(s.start, s.end) for s in spans], more)
    order = {k: i for i, k in enumerate((*BASE, *ADDED))}
    return sorted(spans + kept, key=lambda s: (s.start, order[s.kind]))


def _apart(taken: list[tuple[int, int]], more: list[Span]) -> list[Span]:
    """Those of ``more`` that overlap nothing taken and no better span: in each cluster the best, then what is left."""
    solid: list[list[int]] = []
    for a, b in sorted(taken):
        if solid and a < solid[-1][1]:
            solid[-1][1] = max(solid[-1][1], b)
        else:
            solid.append([a, b])
    free, at = [], 0
    for s in sorted(more):
        while at < len(solid) and solid[at][1] <= s.start:
            at += 1
        if at == len(solid) or solid[at][0] >= s.end:
            free.append(s)
    out: list[Span] = []
    cluster: list[Span] = []
    reach = -1
    for s in [*free, None]:
        if s is None or s.start >= reach:
            for c in sorted(cluster, key=lambda c: (-c.score, c.start, c.end)):
                if all(c.end <= o.start or c.start >= o.end for o in cluster if o in out):
                    out.append(c)
            cluster, reach = [], -1
        if s is not None:
            cluster.append(s)
            reach = max(reach, s.end)
    return out


# --- rows ---------------------------------------------------------------------------------------


def _spans_of_batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("score", pa.float64())]))
    for batch in stream:
        found = []
        for value in batch.column(batch.num_columns - 1):
            text = (value.as_py() or b"").decode("utf-8", "replace")
            found.append([{"kind": s.kind, "start": s.start, "end": s.end, "base": s.base, "score": s.score} for s in find_spans(text)])
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, kind)], names=[*batch.schema.names[:-1], "spans"])


def personal_data(docs: DataFrame, carry: list[str], text: str = "text") -> DataFrame:
    """``carry`` of each row and its ``spans``: kind, start and end in code points, base or added, score.

    Null and empty texts have no spans, repeated rows each have theirs. Bytes that are no UTF-8 count
    as one replacement character each run. An empty table gives an empty table.
    """
    rows = docs.select(F.struct(*carry).alias("row"), F.col(text).cast("binary").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    found = rows.mapInArrow(_spans_of_batches, f"row {kind}, spans {SPAN}")
    return found.select(*(F.col("row")[c].alias(c) for c in carry), "spans")


def listed(spans: Column) -> Column:
    """``kind:start:end`` of all spans, joined by commas."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with each span replaced by its kind in angle brackets; of overlapping spans the first. Null texts stay null."""
    others = [c for c in docs.columns if c != text]
    rows = docs.select(F.struct(*others).alias("row"), F.col(text).cast("binary").alias("text"))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            out = []
            for value in batch.column(1):
                body = value.as_py()
                if body is None:
                    out.append(None)
                    continue
                body, pieces, at = body.decode("utf-8", "replace"), [], 0
                for s in find_spans(body):
                    if s.start >= at:
                        pieces += [body[at:s.start], f"<{s.kind}>"]
                        at = s.end
                out.append("".join([*pieces, body[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["row", "text"])

    kind = rows.schema["row"].dataType.simpleString()
    clean = rows.mapInArrow(run, f"row {kind}, text string")
    return clean.select(*(F.col("text").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns))
