"""Column helpers with Python's text rules.

Spark's ``trim`` only removes spaces, ``\\w`` is ASCII and ``.`` stops at several
line ends. The helpers below give the rules Python code expects.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The characters str.isspace() accepts.
PY_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same characters as pattern classes, for patterns made by rx().
SPACE = r"[\s\x1c-\x1f]"
NOT_SPACE = r"[^\s\x1c-\x1f]"


def rx(pattern: str, flags: str = "") -> str:
    """A Java pattern whose classes are Unicode and whose ``.`` and ``$`` only know ``\\n``."""
    return f"(?Ud{flags}){pattern}"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(PY_SPACE))


def lstrip(c: Column, chars: str = PY_SPACE) -> Column:
    return F.ltrim(c, F.lit(chars))


def rstrip(c: Column, chars: str = PY_SPACE) -> Column:
    return F.rtrim(c, F.lit(chars))


def words(c: Column) -> Column:
    """``str.split()``: no empty words, any white space separates."""
    return F.filter(F.split(c, rx(SPACE + "+")), lambda w: w != "")


def word(c: Column, i: int) -> Column:
    """The i-th word (0-based) or null; reads no further than that word."""
    p = rx(rf"^{SPACE}*(?:{NOT_SPACE}+{SPACE}+){{{i}}}({NOT_SPACE}+)")
    return F.nullif(F.regexp_extract(c, p, 1), F.lit(""))


def word_count(c: Column) -> Column:
    return F.size(words(c))


def group(c: Column, pattern: str, i: int, flags: str = "") -> Column:
    """Group ``i`` of the first match, null when the pattern does not match."""
    p = rx(pattern, flags)
    return F.when(c.rlike(p), F.regexp_extract(c, p, i))


def find_all(c: Column, pattern: str, i: int = 0, flags: str = "") -> Column:
    return F.regexp_extract_all(c, F.lit(rx(pattern, flags)), F.lit(i))


def contains_any(c: Column, needles) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | c.contains(n)
    return out


def starts_with_any(c: Column, needles) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | c.startswith(n)
    return out


def ends_with_any(c: Column, needles) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | c.endswith(n)
    return out


def lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def ordered_concat(order, value: Column, sep: str) -> Column:
    """Aggregate: join ``value`` in the order of the ``order`` columns."""
    keys = [F.col(o) if isinstance(o, str) else o for o in (order if isinstance(order, (list, tuple)) else [order])]
    named = [k.alias(f"o{i}") for i, k in enumerate(keys)]
    return F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct(*named, value.alias("v")))), lambda s: s["v"]), sep
    )


def after_first(c: Column, sep: str) -> Column:
    """``s.split(sep, 1)[-1]``: the text after the first ``sep``, or all of it."""
    at = F.instr(c, sep)
    return F.when(at > 0, F.substr(c, at + len(sep))).otherwise(c)
