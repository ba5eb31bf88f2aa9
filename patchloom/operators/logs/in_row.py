"""Log formats whose lines depend on earlier ones, read inside the log's row.

Each function gives the hits of a log as one array. Lines that matter are kept, and those that
set the state open a block; a block is the state line and what follows up to the next one. State
is carried over blocks, of which a log has few, and never over all lines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from patchloom.functions import text as tx
from patchloom.operators.logs.base import ERROR, FAILED, Hit, PASSED, SKIPPED, ansi_strip, fired
from patchloom.operators.logs.line_rules import chart_js_failures

# Patterns of testdox, Maven and Gradle output.
TESTDOX_SUITE = r"^(\w.+) \(.+\)$"
TESTDOX_TEST = r"^\s*([✔✘↩])\s*(.*)$"
TESTDOX_STATUS = {"✔": PASSED, "✘": FAILED, "↩": SKIPPED}
MAVEN_TEST = r"^.*-Dtest=(\S+).*$"
MAVEN_RESULT = r"^.*BUILD (SUCCESS|FAILURE)$"
GRADLE_FULL = r"^([^>].+)\s+(PASSED|FAILED)$"
GRADLE_NAME = r"^([^>]\S*\s+>\s+\S+)$"
GRADLE_STATUS = r"^(PASSED|FAILED)$"

# Phrases of Django's test runner.
DJANGO_VERSION_TEST = "--version is equivalent to version"
DJANGO_OK_SUFFIXES = (" ... ok", " ... OK", " ...  OK")
DJANGO_MIGRATION_PREFIX = "Applying sites.0002_alter_domain_unique...test_no_migrations"
DJANGO_MULTILINE = (
    r"^(.*?)\s\.\.\.\sTesting\ against\ Django\ installed\ in\ ((?s:.*?))\ silenced\)\.\nok$",
    r"^(.*?)\s\.\.\.\sInternal\ Server\ Error:\ \/(.*)\/\nok$",
    r"^(.*?)\s\.\.\.\sSystem check identified no issues \(0 silenced\)\nok$",
)

# Markers of browser runs, jest runs and XML reports.
KARMA_START, KARMA_END = "Starting browser", "SUMMARY:"
KARMA_MARKS = {"✔": PASSED, "✖": FAILED}
JEST_COMMAND = " ./node_modules/.bin/jest "
JEST_STOPS = ("Test Suites", "  ● ")
JEST_MARKS = {"✓": PASSED, "✕": FAILED}
JEST_TIME = r"\(\d+ms\)"
NUMBERED_FAILURE = r"^\s*\d+\)([^:]*):"
DOCTEST_OPEN, DOCTEST_CLOSE = "<doctest", "</doctest>"
BROKEN_REPORT = "(broken report)"

_BORDER = "\uffff"  # no character of a text; it is taken out of logs that hold it all the same
_HIT = "array<struct<rank:int,line_no:bigint,pos:int,test:string,status:string>>"
_NAMES = "array<string>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def hit(test: Column, status: Column, line_no: Column, rank: int = 0, pos: Column | None = None) -> Column:
    return F.struct(F.lit(rank).alias("rank"), line_no.cast("long").alias("line_no"), (F.lit(0) if pos is None else pos).cast("int").alias("pos"),
                    test.alias("test"), status.alias("status"))


def _hits(rows: Column) -> Column:
    return F.coalesce(F.filter(rows, lambda h: h["test"].isNotNull() & h["status"].isNotNull()), F.array().cast(_HIT)).cast(_HIT)


def _status(mark: Column, words: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for word, value in words.items():
        out = F.when(mark == word, F.lit(value)).otherwise(out)
    return out


def blocks(lines: Column, opens: Callable[[Column], Column], keep: Callable[[Column], Column]) -> Column:
    """Blocks of lines (arrays): the first has no opening line, every other starts with its own.

    One pass marks the opening lines and joins what is kept; one split makes the blocks.
    """
    def marked(line: Column) -> Column:
        return let(F.replace(line, F.lit(_BORDER), F.lit("")), lambda x: F.when(opens(x), F.concat(F.lit(_BORDER), x)).when(keep(x), x))

    joined = F.array_join(F.transform(lines, marked), "\n")
    return F.transform(F.split(joined, _BORDER), lambda b: F.split(F.when(b.endswith("\n"), F.substr(b, F.lit(1), F.length(b) - 1)).otherwise(b), "\n"))


def _per_block(all_blocks: Column, use: Callable[[Column, Column], Column]) -> Column:
    return F.flatten(F.transform(all_blocks, use))


def _place(block: Column, line: Column) -> Column:
    return block.cast("long") * F.lit(1 << 31) + line.cast("long")


def phpunit(log: Column) -> Column:
    """A test belongs to the last suite line before it; without one, to the suite "None"."""
    suite, test = tx.rx(TESTDOX_SUITE), tx.rx(TESTDOX_TEST)

    def tests(block: Column, b: Column) -> Column:
        name = F.when(b == 0, F.lit("None")).otherwise(F.regexp_extract(F.get(block, F.lit(0)), suite, 1))
        return F.transform(block, lambda line, i: F.when(
            line.rlike(test) & ~line.rlike(suite),
            hit(F.concat(name, F.lit(" > "), F.regexp_extract(line, test, 2)), _status(F.regexp_extract(line, test, 1), TESTDOX_STATUS), _place(b, i))))

    return _hits(_per_block(blocks(tx.lines(log), lambda x: x.rlike(suite), lambda x: x.rlike(test)), tests))


def gradle(log: Column) -> Column:
    """``name STATUS`` on one line, or a name line followed by a bare status."""
    full, name, bare = (tx.rx(p) for p in (GRADLE_FULL, GRADLE_NAME, GRADLE_STATUS))

    def event(line: Column) -> Column:
        return let(tx.strip(line), lambda t: F.struct(t.alias("t"), F.when(t.rlike(full), "full").when(t.rlike(name), "name").when(t.rlike(bare), "status").alias("kind")))

    def result(events: Column) -> Column:
        def one(e: Column, i: Column) -> Column:
            before = F.get(events, i - 1)
            return F.when(e["kind"] == "full", hit(F.regexp_extract(e["t"], full, 1), F.regexp_extract(e["t"], full, 2), i)).when(
                (e["kind"] == "status") & (before["kind"] == "name"), hit(before["t"], e["t"], i))
        return F.transform(events, one)

    return _hits(let(F.filter(F.transform(tx.lines(log), event), lambda e: e["kind"].isNotNull()), result))


def maven(log: Column) -> Column:
    """Test commands and build results are paired first in, first out.

    A result that finds no waiting test is spare; spare results go to the tests that are left.
    """
    test_p, result_p = tx.rx(MAVEN_TEST), tx.rx(MAVEN_RESULT)

    def event(line: Column) -> Column:
        return let(tx.strip(line), lambda t: F.struct(tx.group(t, MAVEN_TEST, 1).alias("test"), tx.group(t, MAVEN_RESULT, 1).alias("result")))

    events = F.filter(F.transform(F.filter(tx.lines(log), lambda x: tx.strip(x).rlike(test_p) | tx.strip(x).rlike(result_p)), event), lambda e: e["test"].isNotNull() | e["result"].isNotNull())
    start = F.struct(F.lit(0).alias("seen"), F.lit(0).alias("used"), F.array().cast(_NAMES).alias("paired"), F.array().cast(_NAMES).alias("spare"))

    def step(s: Column, e: Column) -> Column:
        seen = s["seen"] + F.when(e["test"].isNotNull(), 1).otherwise(0)
        has, waits = e["result"].isNotNull(), s["used"] < seen
        return F.struct(
            seen.alias("seen"), (s["used"] + F.when(has & waits, 1).otherwise(0)).alias("used"),
            F.when(has & waits, F.concat(s["paired"], F.array(e["result"]))).otherwise(s["paired"]).alias("paired"),
            F.when(has & ~waits, F.concat(s["spare"], F.array(e["result"]))).otherwise(s["spare"]).alias("spare"))

    def status(result: Column) -> Column:
        return F.when(result == "SUCCESS", PASSED).otherwise(FAILED)

    def paired(events: Column) -> Column:
        tests = F.transform(F.filter(events, lambda e: e["test"].isNotNull()), lambda e: e["test"])
        return let(F.struct(tests.alias("tests"), F.aggregate(events, start, step).alias("s")), lambda x: F.concat(
            F.transform(x["s"]["paired"], lambda r, i: hit(F.get(x["tests"], i), status(r), i)),
            F.transform(x["s"]["spare"], lambda r, i: hit(F.get(x["tests"], x["s"]["used"] + i), status(r), i, rank=1))))

    return _hits(let(events, paired))


def _django_hits(t: Column, u: Column, prev: Column) -> list[Hit]:
    ok = tx.ends_with_any(t, DJANGO_OK_SUFFIXES)
    suffix_len = F.when(t.endswith(DJANGO_OK_SUFFIXES[2]), len(DJANGO_OK_SUFFIXES[2])).otherwise(len(DJANGO_OK_SUFFIXES[0]))

    def before(sep: str) -> Column:
        return F.substring_index(u, sep, 1)

    return [
        Hit(t.contains(DJANGO_VERSION_TEST), F.lit(DJANGO_VERSION_TEST), F.lit(PASSED)),
        Hit(ok, F.substr(u, F.lit(1), F.length(u) - suffix_len), F.lit(PASSED)),
        Hit(u.contains(" ... skipped"), before(" ... skipped"), F.lit(SKIPPED)),
        Hit(u.endswith(" ... FAIL"), before(" ... FAIL"), F.lit(FAILED)),
        Hit(u.startswith("FAIL:"), tx.word(u, 1), F.lit(FAILED)),
        Hit(u.endswith(" ... ERROR"), before(" ... ERROR"), F.lit(ERROR)),
        Hit(u.startswith("ERROR:"), tx.word(u, 1), F.lit(ERROR)),
        Hit(u.startswith("ok") & prev.isNotNull(), prev, F.lit(PASSED)),
    ]


def django(log: Column) -> Column:
    """Results on the test's own line, a bare ``ok`` for the last line with dots, and three messages over lines."""
    def relevant(t: Column) -> Column:
        return (t.contains(DJANGO_VERSION_TEST) | t.contains(" ...  OK") | tx.ends_with_any(t, (" ... ok", " ... OK", " ... FAIL", " ... ERROR"))
                | tx.starts_with_any(t, ("FAIL:", "ERROR:", "ok")))

    def results(block: Column, b: Column) -> Column:
        prev = F.when(b > 0, F.substring_index(F.get(block, F.lit(0)), " ... ", 1))

        def one(t: Column, i: Column) -> Column:
            # one migration message glues its test name to the text before it
            glued = tx.ends_with_any(t, DJANGO_OK_SUFFIXES) & t.startswith(DJANGO_MIGRATION_PREFIX)
            return let(F.when(glued, tx.strip(tx.after_first(t, "..."))).otherwise(t), lambda u: fired(_django_hits(t, u, prev), _place(b, i)))

        return F.flatten(F.transform(block, one))

    stripped = F.transform(tx.lines(log), tx.strip)
    by_line = _per_block(blocks(stripped, lambda t: t.contains(" ... "), relevant), results)
    over_lines = F.concat(*[tx.find_all(log, p, 1, flags="m") for p in DJANGO_MULTILINE])
    return _hits(F.concat(by_line, F.transform(over_lines, lambda t, i: hit(t, F.lit(PASSED), F.lit(0), rank=1, pos=i))))


def chart_js(log: Column) -> Column:
    return _hits(F.transform(chart_js_failures(log), lambda t, i: hit(t, F.lit(FAILED), i)))


def _over_blocks(all_blocks: Column, start: Column, step: Callable[[Column, Column], Column], use: Callable[[Column, Column, Column], Column]) -> Column:
    """``use(block, state, number)`` of each block; ``step(state, opening line)`` carries the state from block to block."""
    def walk(found: Column) -> Column:
        def move(s: Column, block: Column) -> Column:
            return let(F.when(s["n"] == 0, s["at"]).otherwise(step(s["at"], F.get(block, F.lit(0)))),
                       lambda at: F.struct((s["n"] + 1).alias("n"), at.alias("at"), F.concat(s["all"], F.array(at)).alias("all")))

        first = F.struct(F.lit(0).alias("n"), start.alias("at"), F.slice(F.array(start), 1, 0).alias("all"))
        states = F.aggregate(found, first, move, lambda s: s["all"])
        return F.flatten(F.transform(F.arrays_zip(found.alias("block"), states.alias("state")), lambda z, b: use(z["block"], z["state"], b)))

    return let(all_blocks, walk)


def karma(log: Column) -> Column:
    """Suites by indentation, between the browser's start and the summary.

    A suite line that is further in than the last one adds its name, one that is less far in
    takes the last name away, and one at the same depth changes nothing.
    """
    lines = tx.lines(log)
    begin = F.coalesce(F.array_position(F.transform(lines, lambda x: x.contains(KARMA_START)), F.lit(True)), F.lit(0))
    summary = lambda rows: F.array_position(F.transform(rows, lambda x: x.startswith(KARMA_END)), F.lit(True))

    def inside(rows: Column) -> Column:
        after = F.slice(rows, (begin + 1).cast("int"), F.size(rows))
        early = (summary(rows) > 0) & (summary(rows) < begin)
        end = summary(after)
        return F.when((begin == 0) | early, F.array().cast(_NAMES)).when(end > 0, F.slice(after, F.lit(1), (end - 1).cast("int"))).otherwise(after)

    test, suite = tx.rx(r"^\s*[✔✖]\s(.*)$"), tx.rx(r"^(\s+)\s(.*)$")
    lead = lambda x: F.length(F.regexp_extract(x, suite, 1))
    is_test = lambda x: x.rlike(test) & ~x.contains(KARMA_START)
    opens = lambda x: x.rlike(suite) & ~x.rlike(test) & ~x.contains(KARMA_START)
    start = F.struct(F.lit(-1).alias("depth"), F.array().cast(_NAMES).alias("path"))

    def step(s: Column, line: Column) -> Column:
        deeper, same = lead(line) > s["depth"], lead(line) == s["depth"]
        path = F.when(same, s["path"]).when(deeper, F.concat(s["path"], F.array(F.regexp_extract(line, suite, 2)))).otherwise(
            F.slice(s["path"], F.lit(1), F.greatest(F.size(s["path"]) - 1, F.lit(0))))
        return F.struct(lead(line).alias("depth"), path.alias("path"))

    def use(block: Column, state: Column, b: Column) -> Column:
        return F.transform(block, lambda x, i: F.when(is_test(x), hit(
            F.array_join(F.concat(state["path"], F.array(F.regexp_extract(x, test, 1))), " > "),
            _status(F.regexp_extract(x, tx.rx(r"^\s*([✔✖])\s"), 1), KARMA_MARKS), _place(b, i))))

    return _hits(_over_blocks(blocks(let(lines, inside), opens, is_test), start, step, use))


def _indent(line: Column) -> Column:
    return F.length(line) - F.length(tx.lstrip(line))


def calypso(log: Column) -> Column:
    """Sections that start at a jest command and end at its summary; the suites of one carry on in the next."""
    sections = F.split(log, tx.rx(JEST_COMMAND.replace(".", "[.]")))

    def active(section: Column) -> Column:
        def upto(lines: Column) -> Column:
            stop = F.array_position(F.transform(lines, lambda x: tx.starts_with_any(x, JEST_STOPS)), F.lit(True))
            return F.when(stop > 0, F.slice(lines, F.lit(1), (stop - 1).cast("int"))).otherwise(lines)
        return let(tx.lines(section), upto)

    lines = F.flatten(F.transform(F.slice(sections, F.lit(2), F.size(sections)), active))
    marked = lambda x: F.substr(tx.strip(x), F.lit(1), F.lit(1)).isin(*JEST_MARKS)
    start = F.array().cast("array<struct<indent:int,name:string>>")

    def step(stack: Column, line: Column) -> Column:
        outer = F.filter(stack, lambda s: s["indent"] < _indent(line))  # indents rise from the bottom to the top
        return F.concat(outer, F.array(F.struct(_indent(line).alias("indent"), tx.strip(line).alias("name"))))

    def name_of(line: Column) -> Column:
        timed, plain = (tx.group(line, rf"^\s+[✓✕]\s(.*){tail}", 1) for tail in (JEST_TIME + "$", ""))
        return F.when(line.rlike(tx.rx(JEST_TIME)), timed).otherwise(plain)

    def use(block: Column, stack: Column, b: Column) -> Column:
        suites = F.array_join(F.transform(stack, lambda s: s["name"]), " - ")
        return F.transform(block, lambda x, i: F.when(marked(x), hit(
            tx.strip(F.concat(suites, F.lit(" - "), name_of(x))), _status(F.substr(tx.strip(x), F.lit(1), F.lit(1)), JEST_MARKS), _place(b, i))))

    found = blocks(lines, lambda x: ~marked(x) & (_indent(x) > 0), marked)
    return _hits(_over_blocks(found, start, step, use))


def _without_dumps(log: Column) -> Column:
    """The log without printed objects and lists: from a line that ends in an opening bracket to a line that is its end."""
    bare = lambda x: tx.rstrip(x)
    opens = lambda x: bare(x).endswith("{") | bare(x).endswith("[") | bare(x).isin("}", "]")
    one_line = lambda x: (bare(x).startswith("{") & bare(x).endswith("}")) | (bare(x).startswith("[") & bare(x).endswith("]"))
    start = F.struct(F.lit(False).alias("object"), F.lit(False).alias("list"), F.lit(False).alias("shows"))

    def step(s: Column, line: Column) -> Column:
        x = bare(line)
        in_object = x.endswith("{") | (s["object"] & (x != "}"))
        in_list = (~x.endswith("{") & x.endswith("[")) | (s["list"] & ~((x == "]")))
        # a closing line with nothing to close is a line like others
        shows = ~s["object"] & ~s["list"] & x.isin("}", "]")
        return F.struct(in_object.alias("object"), in_list.alias("list"), shows.alias("shows"))

    def use(block: Column, s: Column, b: Column) -> Column:
        rest = F.when((b == 0) | s["shows"], block).otherwise(F.slice(block, F.lit(2), F.size(block)))
        return F.when(s["object"] | s["list"], F.array().cast(_NAMES)).otherwise(rest)

    return F.array_join(_over_blocks(blocks(tx.lines(log), opens, lambda x: ~one_line(x)), start, step, use), "\n")


def _without_elements(log: Column) -> Column:
    """The log without XML elements: innermost ones first, as often as elements are nested, then what overlaps."""
    inner, loose = r"<(\w+)>[^<]*</\1>", r"<(\w+)>[\s\S]*?</\1>"
    stray = F.regexp_replace(log, r"<(?!/?\w+>)", _BORDER)  # a bare sign opens nothing
    times = F.sequence(F.lit(0), F.size(F.split(log, "</")))
    start = F.struct(stray.alias("text"), F.lit(False).alias("done"))

    def step(s: Column, _: Column) -> Column:
        return F.when(s["done"], s).otherwise(let(F.regexp_replace(s["text"], inner, ""), lambda t: F.struct(t.alias("text"), (t == s["text"]).alias("done"))))

    left = F.when(log.contains("</"), F.regexp_replace(F.aggregate(times, start, step, lambda s: s["text"]), loose, "")).otherwise(log)
    return F.replace(left, F.lit(_BORDER), F.lit("<"))


def p5js(log: Column) -> Column:
    """Numbered failures; a title is several lines, each further in than the one before."""
    titles = tx.find_all(_without_elements(_without_dumps(ansi_strip(log))), NUMBERED_FAILURE, 1, flags="m")

    def one(title: Column, i: Column) -> Column:
        def named(parts: Column) -> Column:
            deeper = F.forall(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: _indent(F.get(parts, k)) > F.when(k > 0, _indent(F.get(parts, k - 1))).otherwise(0))
            return F.when(deeper, hit(F.array_join(F.transform(parts, tx.strip), ":"), F.lit(FAILED), i))
        return let(F.split(title, "\n"), named)

    return _hits(F.transform(titles, one))


def _attribute(tag: Column, name: str) -> Column:
    """Value of an attribute with its entities read; null if it isn't there."""
    raw = F.coalesce(tx.group(tag, rf'\b{name}\s*=\s*"([^"]*)"', 1), tx.group(tag, rf"\b{name}\s*=\s*'([^']*)'", 1))
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        raw = F.replace(raw, F.lit(entity), F.lit(char))
    return raw


def doctest(log: Column) -> Column:
    """Sub-cases of the XML report; one passes when all expressions in it do.

    A report that isn't well formed gives one hit of its own, an error.
    """
    start_at = F.instr(log, DOCTEST_OPEN)
    rest = F.substr(log, start_at)
    end_at = F.instr(rest, DOCTEST_CLOSE)
    report = F.regexp_replace(F.substr(rest, F.lit(1), end_at + len(DOCTEST_CLOSE) - 1), r"<!--[\s\S]*?-->|<!\[CDATA\[[\s\S]*?\]\]>|<\?[^>]*>", "")
    tags = tx.find_all(report, r"<[^>]*>")
    open_sub = "array<struct<nr:int,name:string,depth:int,good:boolean>>"
    start = F.struct(F.lit(0).alias("n"), F.lit(False).alias("bad"), F.array().cast(_NAMES).alias("stack"), F.array().cast(_NAMES).alias("cases"),
                     F.array().cast(open_sub).alias("subs"), F.array().cast(_HIT).alias("out"))

    def step(s: Column, tag: Column) -> Column:
        name = F.regexp_extract(tag, r"^</?([\w:.-]+)", 1)
        closes, single = tag.startswith("</"), tag.endswith("/>")
        opens = ~closes & ~single
        depth = F.size(s["stack"])
        top = F.get(s["stack"], depth - 1)
        wrong = s["bad"] | (name == "") | (closes & F.coalesce(top != name, F.lit(True)))
        fails = ~closes & (name == "Expression") & ~F.coalesce(_attribute(tag, "success") == "true", F.lit(False))
        subs = F.when(fails, F.transform(s["subs"], lambda x: F.struct(x["nr"].alias("nr"), x["name"].alias("name"), x["depth"].alias("depth"), F.lit(False).alias("good")))).otherwise(s["subs"])
        in_case = F.size(s["cases"]) > 0
        full = F.concat(F.coalesce(F.get(s["cases"], F.size(s["cases"]) - 1), F.lit("None")), F.lit(" > "), F.coalesce(_attribute(tag, "name"), F.lit("None")))
        fresh = F.struct(s["n"].alias("nr"), full.alias("name"), depth.alias("depth"), F.lit(True).alias("good"))
        last = F.get(subs, F.size(subs) - 1)
        ends_sub = closes & (name == "SubCase") & in_case & (F.size(subs) > 0)
        is_sub = (name == "SubCase") & in_case
        drop_last = lambda a: F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))
        return F.struct(
            (s["n"] + 1).alias("n"), wrong.alias("bad"),
            F.when(opens, F.concat(s["stack"], F.array(name))).when(closes, drop_last(s["stack"])).otherwise(s["stack"]).alias("stack"),
            F.when(opens & (name == "TestCase"), F.concat(s["cases"], F.array(F.coalesce(_attribute(tag, "name"), F.lit("None"))))).when(
                closes & (name == "TestCase"), drop_last(s["cases"])).otherwise(s["cases"]).alias("cases"),
            F.when(opens & is_sub, F.concat(subs, F.array(fresh))).when(ends_sub, drop_last(subs)).otherwise(subs).cast(open_sub).alias("subs"),
            F.when(ends_sub, F.concat(s["out"], F.array(hit(last["name"], F.when(last["good"], PASSED).otherwise(FAILED), last["nr"])))).when(
                single & is_sub, F.concat(s["out"], F.array(hit(full, F.lit(PASSED), s["n"])))).otherwise(s["out"]).cast(_HIT).alias("out"))

    broken = F.array(hit(F.lit(BROKEN_REPORT), F.lit(ERROR), F.lit(0))).cast(_HIT)
    done = F.aggregate(tags, start, step, lambda s: F.when(s["bad"] | (F.size(s["stack"]) > 0) | (s["n"] == 0), broken).otherwise(s["out"]))
    return F.when(F.coalesce(start_at, F.lit(0)) == 0, F.array().cast(_HIT)).when(end_at == 0, broken).otherwise(_hits(done))


WHOLE_LOG: dict[str, Callable[[Column], Column]] = {
    "phpunit": phpunit, "gradle": gradle, "maven": maven, "django": django, "chart_js": chart_js,
    "karma": karma, "calypso": calypso, "p5js": p5js, "doctest": doctest,
}
