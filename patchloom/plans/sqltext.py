"""Fragments for the checking SQL."""

from patchloom.functions.text import PY_SPACE

# white space as SQL text: control characters as chr(), the rest literally
WS = "(" + " || ".join(f"chr({ord(c)})" for c in PY_SPACE) + ")"


def strip(e: str) -> str:
    return f"trim({e}, {WS})"


def words(e: str) -> str:
    """str.split() as a list."""
    return f"list_filter(regexp_split_to_array({e}, '[\\s\\x0b\\x1c-\\x1f\\x85\\p{{Z}}]+'), lambda x: x <> '')".replace("{{", "{").replace("}}", "}")


def lines_cte(source: str, keys: str, text: str = "log", name: str = "lines") -> str:
    """CTE with (keys, line_no, line), line_no from 0."""
    return (
        f"{name} AS (SELECT {keys}, u.nr - 1 AS line_no, u.line AS line FROM "
        f"(SELECT {keys}, string_split({text}, chr(10)) AS ls FROM {source}) s, unnest(s.ls) WITH ORDINALITY AS u(line, nr))"
    )
