"""Periodic run detection: stretches of words that repeat with a period, four times or more.

A run with smallest period q is as long as ``least`` words and ``times`` periods at least, and no neighbouring word
extends it. For every power of two B, a run with B <= q < 2B holds a block of B words at a multiple of B, in whole,
that stands again q words further on. So the aligned blocks of a text, as sequences of integers, are the keys of an Aho-Corasick
automaton that is run over the text; an occurrence B to 2B - 1 words after its block seeds an extension, word by
word in both directions, to the longest stretch with that distance as period. A stretch whose period is a multiple of a
smaller one is the smaller one's run.

Memory and time. Blocks are left out that cannot lie in such a run: those with a word that is not repeated within 2B
words, and those inside a run already found with a smaller period (a second period would make that period smaller); for the same
reason an occurrence inside such a run seeds nothing. The others go to an automaton for each stretch of text of ``CHUNK`` words or four blocks, so an automaton's nodes are a bounded
number of words or the length of the text itself, and its first level stays narrow. The work is n log n at most in a
text of n words, and near n in usual texts. Words come as arrays and are numbered once a batch; no row leaves its
task, there is no shuffle.

Defined results
  null words: no runs, empty collapsed text. Null elements: equal to one another, empty in the collapsed text.
  very long texts: whole. Repeated rows: judged alike. Ties: all runs are listed, by start, then period.
  Empty table: empty result. Extra columns pass through; columns named ``runs`` or ``collapsed``, in any case, are replaced.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm.common import kept_columns, let, load, map_arrow, quoted, small_batches

WORD = r"[^\x20\x09-\x0D]+"
#: Words of text that share an automaton, where blocks are small.
CHUNK = 2048
RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])


def words_of(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def equal_ahead(a: np.ndarray, b: np.ndarray) -> int:
    """How many words two sequences share from their begin; what is compared doubles, so little is read beyond the first difference."""
    at, step, n = 0, 64, min(len(a), len(b))
    while at < n:
        differ = a[at : min(at + step, n)] != b[at : min(at + step, n)]
        k = int(differ.argmax())
        if differ[k]:
            return at + k
        at, step = at + len(differ), step * 2
    return n


def primitive(w: np.ndarray, start: int, period: int) -> bool:
    """Whether a stretch of four periods or more has no smaller period, which would divide this one."""
    rest, p = period, 2
    while rest > 1:
        if p * p > rest:
            p = rest
        if rest % p == 0:
            shift = period // p
            if np.array_equal(w[start : start + period], w[start + shift : start + shift + period]):
                return False
            while rest % p == 0:
                rest //= p
        p += 1
    return True


def distance_to_next(w: np.ndarray) -> np.ndarray:
    """For every word how far on it stands again; the text's length where it does not."""
    order = np.argsort(w, kind="stable")
    same = w[order[1:]] == w[order[:-1]]
    after = np.full(len(w), len(w))
    after[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return after


def seeds(w: np.ndarray, starts: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """(start, distance) of aligned blocks that stand again ``size`` to twice ``size`` words on, by place."""
    chunk = max(CHUNK, 4 * size)
    for part in np.split(starts, np.flatnonzero(np.diff(starts // chunk)) + 1):
        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        at: dict[tuple[int, ...], list[int]] = {}
        for s in part.tolist():
            at.setdefault(tuple(w[s : s + size].tolist()), []).append(s)
        for key, places in at.items():
            automaton.add_word(key, places)
        automaton.make_automaton()
        lo, hi = int(part[0]) + size, int(part[-1]) + 3 * size
        for end, places in automaton.iter(tuple(w[lo:hi].tolist())):
            here = lo + end - size + 1
            for k in range(bisect_left(places, here - 2 * size + 1), len(places)):
                if here - places[k] < size:
                    break
                yield places[k], here - places[k]


def ends_around(places: np.ndarray, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """For every place the furthest end of a run that holds it; 0 or a smaller place if there is none."""
    if not runs:
        return np.zeros(len(places), np.int64)
    begin, length, _ = np.array(sorted(runs)).T
    furthest = np.concatenate([[0], np.maximum.accumulate(begin + length)])
    return furthest[np.searchsorted(begin, places, side="right")]


def find(w: np.ndarray, least: int = 6, times: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of whole numbers (32 bits, unsigned), by start, then period."""
    n, runs = len(w), []
    if n < least:
        return runs
    after = distance_to_next(w)
    size = 1
    while times * size <= n:
        count = n // size
        fits = after[: count * size].reshape(count, size).max(axis=1) < 2 * size
        starts = np.flatnonzero(fits) * size
        inside = ends_around(starts, runs)
        open_ = inside < np.minimum(starts + 3 * size, n)
        starts, inside = starts[open_], dict(zip(starts[open_].tolist(), inside[open_].tolist(), strict=True))
        reach: dict[int, int] = {}  # by distance: up to where places are known to equal those so far on, or not
        for s, d in seeds(w, starts, size) if len(starts) else ():
            if s < reach.get(d, 0) or s + size + d <= inside[s]:
                continue
            stop = s + size + equal_ahead(w[s + size : n - d], w[s + size + d :])
            start = s - equal_ahead(w[:s][::-1], w[d : s + d][::-1])
            reach[d] = stop
            length = stop + d - start
            if length >= max(least, times * d) and primitive(w, start, d):
                runs.append((start, length, d))
        size *= 2
    return sorted(runs, key=lambda r: (r[0], r[2]))


def repeats(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """True for words that some run holds after its first period."""
    step = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    return np.cumsum(step[:-1]) > 0


def periodic_runs(df: DataFrame, words: str = "words", least: int = 6, times: int = 4) -> DataFrame:
    """``df`` with ``runs``, an array of (start, length, period) by start, then period, and ``collapsed``, the words without what
    runs repeat, joined by one space, in place of the array ``words``."""
    if times < 4:
        raise ValueError("blocks of half a period or more need four periods")
    small_batches(df.sparkSession)
    keep = kept_columns(df, [words, "runs", "collapsed"])
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *others, lists = batch.columns
            at = lists.offsets.to_numpy()
            flat = lists.values.slice(int(at[0]), int(at[-1] - at[0]))
            at = at - at[0]
            codes = flat.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
            found = [find(codes[a:b], least, times) for a, b in zip(at[:-1], at[1:], strict=True)]
            stays = np.ones(len(flat), bool)
            for a, b, r in zip(at[:-1], at[1:], found, strict=True):
                if r:
                    stays[a:b] = ~repeats(int(b - a), r)
            left = np.concatenate([[0], np.cumsum(stays)])[at]
            texts = pc.fill_null(flat.filter(pa.array(stays)), "")
            collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(left, pa.int32()), texts), " ")
            columns = list(zip(*[x for r in found for x in r], strict=True)) or [[], [], []]
            structs = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["start", "length", "period"])
            bounds = np.concatenate([[0], np.cumsum([len(r) for r in found], dtype=np.int64)])
            arrays = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), structs)
            yield pa.RecordBatch.from_arrays([*others, arrays, collapsed], names=[f"c{i}" for i in range(len(schema))])

    return map_arrow(df.select(*map(quoted, [*keep, words])), run, schema)


def planted(key: Column, words: Column) -> Column:
    """The contract's words: in one text of ten, by the key's checksum, all words from some place on repeat with some period."""

    def change(v: Column) -> Column:
        w, g, n = v["w"], F.floor(v["h"] / 10), F.size(v["w"])
        bound = lambda x: F.transform(F.sequence(F.lit(0), x["n"] - 1), lambda i: F.get(x["w"], F.when(i >= x["a"], x["a"] + F.pmod(i - x["a"], x["p"])).otherwise(i)))
        a = F.pmod(g, n).cast("int")
        p = (F.floor((n - a) / (g % 8 + 3)) + 1).cast("int")
        return F.when((v["h"] % 10 == 0) & (n > 0), let(F.struct(w.alias("w"), n.alias("n"), a.alias("a"), p.alias("p")), bound)).otherwise(w)

    return let(F.struct(words.alias("w"), F.crc32(key.cast("string").cast("binary")).alias("h")), change)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", planted(F.col("doc_id"), words_of(F.col("text"))).alias("words"))
    made = periodic_runs(docs)
    none = F.lit(None).cast(RUN)
    ratio = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    best = F.aggregate("runs", none, lambda acc, r: F.when(acc.isNull() | ratio(r, acc), r).otherwise(acc))
    lines = F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]))
    listed = F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "")
    made = made.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("b"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    return made.select("doc_id", "n_runs", "b.start", "b.length", "b.period", F.expr("b.length * 1000 div b.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


#: Periods of any length are beyond a join of bounded size; the tests compare with brute force.
ORACLE = None
