"""Line wrap as a fold over words, with the rules of Python's ``textwrap``: greedy lines, breaks at white space and after hyphens, long words cut. All JVM-side.

A letter beyond the basic plane counts as no letter where it stands before a hyphen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewright.functions.jsontext import let

#: Ends of lines, and the pieces of a line between which it may break; fixed values.
LINE_END = r"\r\n|[\n\r\x0b\f\x1c-\x1e\x85\u2028\u2029]"
_WS, _WP, _LT = r"[\t\n\x0b\f\r ]", r"[\w!\"'&.,?]", r"[^\d\W]"
PIECE = rf"(?U){_WS}+|(?<={_WP})-{{2,}}(?=\w)|[^\t\n\x0b\f\r ]+?(?:-(?:(?<={_LT}{{2}}-)|(?<={_LT}-{_WP}-))(?={_LT}-?{_LT})|(?={_WS}|\z)|(?<={_WP})(?=-{{2,}}\w))"


def split_lines(text: Column) -> Column:
    """The lines of a text; an end of line at its end begins no other."""
    body = F.regexp_replace(text, rf"(?:{LINE_END})\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(body, LINE_END, -1))


def wrapped_line(line: Column, width: int) -> Column:
    """One line as an array of lines of ``width`` characters at most."""
    tabs = F.aggregate(F.split(line, "\t", -1), F.lit(None).cast("string"), lambda a, p: F.when(a.isNull(), p).otherwise(F.concat(a, F.repeat(F.lit(" "), (8 - F.length(a) % 8).cast("int")), p)))
    plain = F.translate(tabs, "\x0b\f", "  ")
    begin = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("cur"))
    state = lambda lines, cur: F.struct(lines.alias("lines"), cur.alias("cur"))
    flushed = lambda a, cur: F.when(F.rtrim(cur) == "", a["lines"]).otherwise(F.concat(a["lines"], F.array(F.rtrim(cur))))

    def cut(a: Column, rest: Column) -> Column:
        """Where a word too long for a line is cut: where the line is full, or after the last hyphen before."""
        room = F.lit(width) - F.length(a["cur"])
        back = F.instr(F.reverse(F.left(rest, room)), "-")
        hyphen = F.when(back > 0, room - back).otherwise(-1)  # its place, from 0
        return F.when((hyphen > 0) & (F.replace(F.left(rest, hyphen), F.lit("-"), F.lit("")) != ""), hyphen + 1).otherwise(room)

    def long(a: Column, piece: Column) -> Column:
        first = F.struct(a["lines"].alias("lines"), a["cur"].alias("cur"), piece.alias("rest"))

        def once(b: Column, _: Column) -> Column:
            n = cut(b, b["rest"])
            full = F.when((n == 0) & (b["cur"] != ""), F.concat(b["lines"], F.array(b["cur"]))).otherwise(flushed(b, F.concat(b["cur"], F.left(b["rest"], n))))
            more = F.struct(full.alias("lines"), F.lit("").alias("cur"), F.substr(b["rest"], n + 1).alias("rest"))
            fits = F.length(b["cur"]) + F.length(b["rest"]) <= width
            return F.when(b["rest"] == "", b).when(fits, F.struct(b["lines"].alias("lines"), F.concat(b["cur"], b["rest"]).alias("cur"), F.lit("").alias("rest"))).otherwise(more)

        return F.aggregate(F.sequence(F.lit(0), F.length(piece)), first, once, lambda b: state(b["lines"], b["cur"]))

    def step(a: Column, piece: Column) -> Column:
        blank = F.trim(piece) == ""
        fits = F.length(a["cur"]) + F.length(piece) <= width
        next_line = state(flushed(a, a["cur"]), F.when(blank, F.lit("")).otherwise(piece))
        lead = state(a["lines"], F.repeat(F.lit(" "), ((F.length(piece) - 1) % width + 1).cast("int")))  # white space that begins a text and is wider than a line
        none_yet = (a["cur"] == "") & (F.size(a["lines"]) == 0)
        return F.when(blank & (a["cur"] == "") & (F.size(a["lines"]) > 0), a).when(blank & none_yet & (F.length(piece) > width), lead).when(fits, state(a["lines"], F.concat(a["cur"], piece))).when(blank | (F.length(piece) <= width), next_line).otherwise(long(a, piece))

    pieces = F.regexp_extract_all(plain, F.lit(PIECE), F.lit(0))
    return F.aggregate(pieces, begin, step, lambda a: flushed(a, a["cur"]))


def wrapped(text: Column, width: int = 110, indent: str = "    ") -> Column:
    """Each line of a text wrapped, lines after the first behind ``indent``."""
    each = F.transform(split_lines(F.coalesce(text, F.lit(""))), lambda x: F.when(F.length(x) <= width, F.array(x)).otherwise(let(x, lambda y: wrapped_line(y, width))))
    return F.array_join(F.flatten(each), "\n" + indent)
