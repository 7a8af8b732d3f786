"""Secret scans (native): patterns, and sliding-window Shannon entropy over candidate strings.

Base kinds are patterns: ``assign`` (a named value), ``access`` (access key ids), ``hex`` (long hex runs). The
``entropy`` kind looks at candidates, runs of 24 or more of ``[A-Za-z0-9+/=_-]`` with letters
and digits. A window of 20 characters slides over the candidate; the sum of n * log2(n) over
its character counts is updated by the counts of what enters and what leaves, which are kept
from step to step, so a step neither recounts nor reads the window. Per character class (hex, alphanumeric, base64) a threshold, in bits, is met
or not; the span is the whole candidate. Base spans and placeholder words are cut out of a candidate;
each piece of 24 or more that is left, without separators at its ends, is then judged on its own.
Pieces that are UUIDs or digests named as such are suppressed.

Positions are code points. ``split`` by the pattern and the matches themselves give the gaps
and the lengths, whose running sums are the starts: one array pass, no shuffle, no Python.
Only rows whose text holds a pattern at all take that path.

Defined results
  null or empty text: no spans, empty strings hashed. Repeated rows: judged alike.
  very long texts and candidates: scanned whole. Empty table: empty result.
  Extra columns pass through ``scan``; a column named ``spans_found`` is replaced.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.common import let, load

#: Patterns of the base kinds, in the order in which ties are listed; fixed values.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
CANDIDATE = r"[A-Za-z0-9+/=_-]{24,}"
KINDS = ["assign", "access", "hex", "entropy"]

WINDOW = 20
#: Bits per character that a window must reach, by class.
THRESHOLDS = {"hex": 3.0, "alnum": 3.7, "base64": 3.9}
#: Pieces that are no secrets (repetitions stay below the thresholds), and words that are cut out of candidates.
UUID = r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
NAMED = r"(?<![^/_-])(example|sample|placeholder|dummy|test)(?![^/_-])"
#: What stands before a candidate that is a public digest.
DIGEST_BEFORE = r"(?i)(sha-?(1|224|256|384|512)|md5|integrity|commit|revision)[\"'=: -]{1,4}$"

SPAN = "array<struct<start:bigint,kind:int,end:bigint,hit:string>>"


def located(text: Column, pattern: str, kind: int) -> Column:
    """All leftmost, non-overlapping matches as (start, kind, end, hit), in code points."""
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    begin = lambda at, kind_of: F.struct(at.alias("at"), F.array().cast(kind_of).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["g"])
        end = start + F.length(x["h"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["h"].alias("hit")))).alias("out"))

    bound = let(F.struct(hits.alias("h"), gaps.alias("g")), lambda p: F.transform(p["h"], lambda h, i: F.struct(h.alias("h"), F.get(p["g"], i).alias("g"))))
    # starts are running sums, taken in blocks so that many matches cost no quadratic copying
    block = 256
    blocks = let(bound, lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / block).cast("int")), lambda b: F.slice(p, b * block + 1, F.lit(block))))
    width = lambda p: F.aggregate(p, F.lit(0).cast("bigint"), lambda n, x: n + F.length(x["g"]) + F.length(x["h"]))
    from_ = F.aggregate(
        blocks,
        begin(F.lit(0).cast("bigint"), "array<struct<at:bigint,p:array<struct<h:string,g:string>>>>"),
        lambda acc, p: F.struct((acc["at"] + width(p)).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("at"), p.alias("p")))).alias("out")),
        lambda acc: acc["out"],
    )
    found = F.flatten(F.transform(from_, lambda b: F.aggregate(b["p"], begin(b["at"], SPAN), step, lambda acc: acc["out"])))
    return F.when(F.regexp_instr(text, F.lit(pattern)) > 0, found).otherwise(F.array().cast(SPAN))


#: Characters of candidates; each has a byte of its own in the counts of a window, any other shares the first one.
ALPHABET = string.ascii_letters + string.digits + "+/=_-"
COUNTERS = len(ALPHABET) // 8 + 1


def window_peak(c: Column, window: int = WINDOW) -> Column:
    """The largest entropy, in bits per character, of any window of ``c`` (shorter: of all of it).

    The counts of the window are bytes packed into a few long integers; a step adds one for the character
    that enters, takes one for the character that leaves, and reads no other. ``window`` is 127 at most.
    """
    nlogn = lambda n: F.when(n <= 1, F.lit(0.0)).otherwise(n * F.log2(n.cast("double")))
    shift = lambda name, x, by: F.call_function(name, x, by)

    def place(ch: Column) -> Column:
        code = F.instr(F.lit(ALPHABET), ch)
        return F.struct(F.shiftright(code, 3).alias("at"), F.shiftleft(code.bitwiseAND(7), 3).alias("bits"))

    def over(places: Column) -> Column:
        zero = F.struct(F.lit(0.0).alias("s"), F.lit(math.inf).alias("least"), F.array_repeat(F.lit(0).cast("bigint"), COUNTERS).alias("counts"))
        n = F.size(places)

        def step(acc: Column, i: Column) -> Column:
            enters, leaves = F.get(places, i), F.get(places, i - window)  # nothing leaves the first window
            count = lambda x: shift("shiftright", F.get(acc["counts"], x["at"]), x["bits"]).bitwiseAND(127)
            unit = lambda x, j: F.when(x["at"] == j, shift("shiftleft", F.lit(1).cast("bigint"), x["bits"])).otherwise(F.lit(0).cast("bigint"))
            n_in, n_out = count(enters), count(leaves)
            grown = acc["s"] + nlogn(n_in + 1) - nlogn(n_in)
            same = F.coalesce(enters == leaves, F.lit(False))
            s = F.when(same, acc["s"]).when(i < window, grown).otherwise(grown + nlogn(n_out - 1) - nlogn(n_out))
            counts = F.when(same, acc["counts"]).otherwise(F.transform(acc["counts"], lambda w, j: w + unit(enters, j) - unit(leaves, j)))
            full = i >= F.least(n, F.lit(window)) - 1
            return F.struct(s.alias("s"), F.when(full, F.least(acc["least"], s)).otherwise(acc["least"]).alias("least"), counts.alias("counts"))

        width = F.least(n, F.lit(window)).cast("double")
        return F.aggregate(F.sequence(F.lit(0), n - 1), zero, step, lambda acc: F.log2(width) - acc["least"] / width)

    return let(F.transform(F.filter(F.split(c, ""), lambda x: x != ""), place), over)


def threshold(c: Column) -> Column:
    return F.when(c.rlike(r"^[0-9a-fA-F-]+$"), THRESHOLDS["hex"]).when(c.rlike(r"^[A-Za-z0-9]+$"), THRESHOLDS["alnum"]).otherwise(THRESHOLDS["base64"])


def base_spans(t: Column) -> Column:
    none = F.array().cast(SPAN)
    value_length = lambda s: F.length(F.regexp_extract(s["hit"], ASSIGN, 2))
    assign = F.when(t.rlike(ASSIGN), F.filter(located(t, ASSIGN, 0), lambda s: value_length(s) >= 8)).otherwise(none)
    access = F.when(F.contains(t, F.lit("AKIA")), F.filter(located(t, ACCESS, 1), lambda s: F.length(s["hit"]) >= 16)).otherwise(none)
    hexes = F.when(t.rlike(HEX), located(t, HEX, 2)).otherwise(none)
    return F.array_sort(F.concat(assign, access, hexes))


def pieces(s: Column, base: Column) -> Column:
    """The candidate, or what base spans and placeholder words leave of it, as spans of the candidate's least length."""
    hole = lambda start, end: F.struct(start.alias("start"), end.alias("end"))
    spans = F.transform(F.filter(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])), lambda b: hole(b["start"], b["end"]))
    words = F.when(s["hit"].rlike(NAMED), F.transform(located(s["hit"], NAMED, 3), lambda w: hole(s["start"] + w["start"], s["start"] + w["end"]))).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>"))
    begin = F.struct(s["start"].alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("out"))

    def step(acc: Column, h: Column) -> Column:
        gap = F.when(h["start"] > acc["at"], F.array(hole(acc["at"], h["start"]))).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>"))
        return F.struct(F.greatest(acc["at"], h["end"]).alias("at"), F.concat(acc["out"], gap).alias("out"))

    def trimmed(g: Column) -> Column:
        raw = F.substr(s["hit"], (g["start"] - s["start"] + 1).cast("int"), (g["end"] - g["start"]).cast("int"))
        start = g["start"] + F.length(F.regexp_extract(raw, "^[/=_-]*", 0))
        hit = F.regexp_replace(raw, "^[/=_-]+|[/_-]+$", "")
        return F.struct(start.alias("start"), F.lit(3).alias("kind"), (start + F.length(hit)).alias("end"), hit.alias("hit"))

    def cut(holes: Column) -> Column:
        gaps = F.aggregate(holes, begin, step, lambda acc: F.concat(acc["out"], F.when(acc["at"] < s["end"], F.array(hole(acc["at"], s["end"]))).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>"))))
        return F.when(F.size(holes) == 0, F.array(s)).otherwise(F.filter(F.transform(gaps, trimmed), lambda x: F.length(x["hit"]) >= 24))

    return let(F.array_sort(F.concat(spans, words)), cut)


def entropy_spans(t: Column, base: Column) -> Column:
    """High-entropy pieces of candidates that are not allowed."""

    def secret(s: Column) -> Column:
        c = s["hit"]
        mixed = c.rlike(r"[0-9]") & c.rlike(r"[A-Za-z]")
        before = F.substring(t, F.greatest(s["start"] - 15, F.lit(1)).cast("int"), F.least(s["start"], F.lit(16)).cast("int"))
        return F.when(mixed, ~c.rlike(UUID) & ~before.rlike(DIGEST_BEFORE) & (window_peak(c) >= threshold(c))).otherwise(F.lit(False))

    return F.when(t.rlike(CANDIDATE), F.filter(F.flatten(F.transform(located(t, CANDIDATE, 3), lambda s: pieces(s, base))), secret)).otherwise(F.array().cast(SPAN))


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``spans_found``: all spans (start, kind, end, hit) by start, then kind."""
    t = F.coalesce(F.col(text), F.lit(""))
    both = let(base_spans(t), lambda b: F.array_sort(F.concat(b, entropy_spans(t, b))))
    return df.withColumn("spans_found", both)


def listed(spans: Column, most: int = len(KINDS)) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.filter(spans, lambda s: s["kind"] < most), lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(df: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``df`` (scanned) with every span, or union of overlapping spans, of ``text`` replaced by ``mark``."""
    t = F.col(text)
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substr(t, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        return F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), F.concat(acc["out"], gap, F.lit(mark)).alias("out"))).otherwise(
            F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))
        )

    cut = F.aggregate("spans_found", zero, step, lambda acc: F.concat(acc["out"], F.substr(t, (acc["at"] + 1).cast("int"))))
    return df.withColumn(text, F.when(F.size("spans_found") > 0, cut).otherwise(t))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(load(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "spans_found")
    n = lambda k: F.size(F.filter("spans_found", lambda s: s["kind"] == k)).cast("bigint")
    return found.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(listed(F.col("spans_found"), 3).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans_found")).alias("spans")
    )


def _sql_spans(pattern: str, kind: int, keep: str) -> str:
    return f"""
k{kind} as (select doc_id, t, regexp_extract_all(t, $p${pattern}$p$) as h, regexp_split_to_array(t, $p${pattern}$p$) as g from d where regexp_matches(t, $p${pattern}$p$)),
l{kind} as (select doc_id, t, unnest(h) as hit, unnest(g[1:len(h)]) as gap, generate_subscripts(h, 1) as i from k{kind}),
m{kind} as (select doc_id, t, hit, (sum(length(gap) + length(hit)) over (partition by doc_id order by i))::bigint as e from l{kind}),
s{kind} as (select doc_id, t, e - length(hit) as s, {kind} as k, e, hit from m{kind} where {keep})"""


ORACLE = f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
{_sql_spans(ASSIGN, 0, f"length(regexp_extract(hit, $p${ASSIGN}$p$, 2)) >= 8")},
{_sql_spans(ACCESS, 1, "length(hit) >= 16")},
{_sql_spans(HEX, 2, "true")},
{_sql_spans(CANDIDATE, 3, "true")},
b as (select doc_id, s, k, e from s0 union all select doc_id, s, k, e from s1 union all select doc_id, s, k, e from s2),
tok as (select doc_id, s, unnest(regexp_split_to_array(hit, '[/_-]')) as w, generate_subscripts(regexp_split_to_array(hit, '[/_-]'), 1) as i from s3),
tp as (select doc_id, s, w, s + (sum(length(w) + 1) over (partition by doc_id, s order by i))::bigint - 1 as he from tok),
ho as (select doc_id, s, he - length(w) as hs, he from tp where w in ('example', 'sample', 'placeholder', 'dummy', 'test')
  union all select s3.doc_id, s3.s, b.s, b.e from s3 join b on b.doc_id = s3.doc_id and b.s < s3.e and s3.s < b.e),
ch as (select doc_id, t, s, hit, unnest(range(s, e)) as p from s3 where exists (select 1 from ho where ho.doc_id = s3.doc_id and ho.s = s3.s)),
lf as (select *, p - row_number() over (partition by doc_id, s order by p) as g from ch where not exists (select 1 from ho where ho.doc_id = ch.doc_id and ho.s = ch.s and ch.p >= hs and ch.p < he)),
il as (select doc_id, t, min(p) as a, substr(any_value(hit), min(p) - s + 1, count(*)) as raw from lf group by doc_id, t, s, g),
pc as (select doc_id, t, a + length(regexp_extract(raw, '^[/=_-]*')) as s, regexp_replace(raw, '^[/=_-]+|[/_-]+$', '', 'g') as hit from il),
al as (select doc_id, t, s, s + length(hit) as e, hit from pc where length(hit) >= 24
  union all select doc_id, t, s, e, hit from s3 where not exists (select 1 from ho where ho.doc_id = s3.doc_id and ho.s = s3.s)),
c as (select doc_id, s, 3 as k, e, hit from al where regexp_matches(hit, '[0-9]') and regexp_matches(hit, '[A-Za-z]') and not regexp_matches(hit, $p${UUID}$p$) and not regexp_matches(substr(t, greatest(s - 15, 1), least(s, 16)), $p${DIGEST_BEFORE}$p$)),
w as (select doc_id, s, k, e, hit, unnest(range(1, greatest(length(hit) - {WINDOW - 1}, 1) + 1)) as i from c),
p as (select doc_id, s, k, e, hit, max(list_aggregate(string_split(substr(hit, i, {WINDOW}), ''), 'entropy')) as peak from w group by all),
a as (select * from b union all select doc_id, s, k, e from p where peak >= case when regexp_matches(hit, '^[0-9a-fA-F-]+$') then {THRESHOLDS["hex"]} when regexp_matches(hit, '^[A-Za-z0-9]+$') then {THRESHOLDS["alnum"]} else {THRESHOLDS["base64"]} end),
n as (select doc_id, k, s, (['assign', 'access', 'hex', 'entropy'])[k + 1] || ':' || s || ':' || e as x from a),
o as (select doc_id, count(*) filter (k = 0) as n_assign, count(*) filter (k = 1) as n_access, count(*) filter (k = 2) as n_hex,
      coalesce(string_agg(x, ',' order by s, k) filter (k < 3), '') as base, string_agg(x, ',' order by s, k) as spans from n group by doc_id)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join o using (doc_id)
"""
