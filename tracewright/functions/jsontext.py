"""Edits of JSON texts that keep every byte they do not replace. All JVM-side.

A text is cut into tokens once, strings, brackets, commas, colons and what stands between; one pass over them finds the
extent of a member's value at the top level. Keys are compared as they are written; of a repeated key the last counts, as for
JSON readers. What is no object stays as it is; null stays null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r'(?s)"(?:[^"\\]++|\\.)*+"|[{}\[\],:]|[^"{}\[\],:]++'


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def quoted(text: Column) -> Column:
    """``text`` as a JSON string."""
    j = F.to_json(F.struct(text.alias("t")))
    return F.substr(j, F.lit(6), F.length(j) - 6)


def _extent(tokens: Column, key: str) -> Column:
    """struct<start, end> of the value's tokens, from 0, the end exclusive; -1 without the key. ``members``: whether there is any."""
    i = lambda n: F.lit(n).cast("int")
    begin = F.struct(i(0).alias("at"), i(0).alias("depth"), F.lit("").alias("before"), i(0).alias("mode"), i(-1).alias("start"), i(-1).alias("end"), F.lit(False).alias("members"))

    def step(s: Column, t: Column) -> Column:
        blank = ~t.rlike(r"[^ \t\n\r]")
        down = s["depth"] - F.when(t.isin("}", "]"), 1).otherwise(0)
        top = s["depth"] == 1
        is_key = top & (t == F.lit(f'"{key}"')) & s["before"].isin("{", ",")
        opens = (s["mode"] == 1) & (t == ":")
        closes = (s["mode"] == 2) & ((top & (t == ",")) | (down == 0))
        return F.struct(
            (s["at"] + 1).alias("at"), (down + F.when(t.isin("{", "["), 1).otherwise(0)).alias("depth"), F.when(blank, s["before"]).otherwise(t).alias("before"),
            F.when(is_key, 1).when(opens, 2).when(closes, 0).otherwise(s["mode"]).alias("mode"), F.when(opens, s["at"] + 1).otherwise(s["start"]).alias("start"), F.when(closes, s["at"]).otherwise(s["end"]).alias("end"),
            (s["members"] | (top & ~blank & ~t.isin("{", "}"))).alias("members"),
        )

    return F.aggregate(tokens, begin, step)


def with_member(text: Column, key: str, value: Column) -> Column:
    """The object ``text`` with ``key`` set to the JSON text ``value``, in its place if it has the key, else at the end."""
    joined = lambda tokens: F.array_join(tokens, "")

    def edit(p: Column) -> Column:
        tokens, n = p["t"], F.size(p["t"])
        there = F.concat(joined(F.slice(tokens, 1, p["e"]["start"])), p["v"], joined(F.slice(tokens, p["e"]["end"] + 1, n)))
        body = F.regexp_replace(joined(tokens), r"\}\s*$", "")
        new = F.concat(body, F.when(p["e"]["members"], ",").otherwise(""), F.lit(f'"{key}":'), p["v"], F.lit("}"))
        return F.when(p["e"]["end"] >= 0, there).otherwise(new)

    tokens = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    found = let(F.struct(tokens.alias("t"), value.alias("v")), lambda p: let(F.struct(p["t"].alias("t"), p["v"].alias("v"), _extent(p["t"], key).alias("e")), edit))
    return F.when(F.startswith(F.ltrim(text), F.lit("{")), found).otherwise(text)


def member(text: Column, key: str) -> Column:
    """The JSON text of a member of an object, byte for byte; null without it."""
    tokens = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    cut = lambda p: F.when(p["e"]["end"] >= 0, F.regexp_replace(F.array_join(F.slice(p["t"], p["e"]["start"] + 1, p["e"]["end"] - p["e"]["start"]), ""), r"^\s+|\s+$", ""))
    found = let(tokens, lambda t: let(F.struct(t.alias("t"), _extent(t, key).alias("e")), cut))
    return F.when(F.startswith(F.ltrim(text), F.lit("{")), found)
