"""Benchmark decontamination by a generalised suffix automaton of the normalised test items.

The automaton holds every run of words of every item. A text's words stream through it, and the
longest matching length that ends at each word is tracked: where it reaches 13, a 13-word
window of some item ends; an item of fewer words is one window, marked on its state. Words
inside occurring windows are hit. Stretches without any 3 words in a row of the test items
cannot hold a window and are passed over without walking (shorter windows shorten that probe).

The test items are the query set: they are streamed to the driver in blocks of at most
``block_words`` words, and one automaton is built per block and worker. With more than one block
the documents pass through the blocks in turn inside one job; hits add up per document.
Documents are never shuffled.

Defined results
  null, empty or wordless text: no words, not contaminated. Wordless or null items: no window.
  items with a null id are ignored; items that share an id count once.
  no items: nothing is hit. Repeated rows: judged alike. Very long texts: streamed whole.
  Extra columns pass through ``mark``; columns named like its outputs are replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm.common import held, kept_columns, load, map_arrow, quoted, small_batches

WINDOW = 13
BLOCK_WORDS = 1_000_000
#: ASCII that is no letter or digit separates words; A-Z are lower-cased.
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_NORMAL).split()


class Automaton:
    """Suffix automaton of several word sequences."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW) -> None:
        self.window = window
        self.ids = [i for i, w in items if w]
        self.word: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        seqs = [[self.word.setdefault(x, len(self.word)) for x in w] for _, w in items if w]
        ends: dict[int, set[int]] = {}  # items whose prefix ends in a state
        for n, seq in enumerate(seqs):
            last = 0
            for x in seq:
                last = self.extend(last, x)
                ends.setdefault(last, set()).add(n)
        # which items hold the windows of a state: ends of all states below it in the tree of suffix links
        self.holds: dict[int, frozenset[int]] = {}
        below = {s: set(v) for s, v in ends.items()}
        for s in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            up = self.link[s]
            if self.length[s] >= window and self.length[up] < window:
                self.holds[s] = frozenset(below.get(s, ()))
            elif self.length[up] >= window and s in below:
                below.setdefault(up, set()).update(below[s])
        # whole items of fewer words: the state that holds exactly them
        self.whole: dict[int, list[int]] = {}
        for n, seq in enumerate(seqs):
            if len(seq) < window:
                s = 0
                for x in seq:
                    s = self.next[s][x]
                while self.length[self.link[s]] >= len(seq):
                    s = self.link[s]
                self.whole.setdefault(s, []).append(n)
        self.size = [len(q) for q in seqs]
        self.marked = [-1] * len(self.link)  # nearest state, itself included, with whole items
        for s in sorted(range(1, len(self.link)), key=lambda s: self.length[s]):
            self.marked[s] = s if s in self.whole else self.marked[self.link[s]]
        self.probe = min([window, *self.size], default=window)
        self.gram = min(3, self.probe)
        grams = [self.mixed(np.array(q, np.int64)) for q in seqs]
        self.grams = np.unique(np.concatenate(grams)) if grams else np.empty(0, np.uint64)

    def extend(self, last: int, x: int) -> int:
        known = self.next[last].get(x)
        if known is not None and self.length[known] == self.length[last] + 1:
            return known
        if known is not None:
            return self.split(last, x, known)
        cur = len(self.link)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        p = last
        while p >= 0 and x not in self.next[p]:
            self.next[p][x] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][x]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self.split(p, x, q)
        return cur

    def split(self, p: int, x: int, q: int) -> int:
        clone = len(self.link)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(x) == q:
            self.next[p][x] = clone
            p = self.link[p]
        return clone

    def mixed(self, ids: np.ndarray) -> np.ndarray:
        """One number per run of ``gram`` words; runs with a word of no item get 0."""
        k = self.gram
        if len(ids) < k:
            return np.empty(0, np.uint64)
        n = len(ids) - k + 1
        out = np.zeros(n, np.uint64)
        fine = np.ones(n, bool)
        for j in range(k):
            part = ids[j : j + n]
            out = out * np.uint64(0x9E3779B97F4A7C15) + part.astype(np.uint64) + np.uint64(1)
            fine &= part >= 0
        out ^= out >> np.uint64(29)
        return np.where(fine, out, np.uint64(0))

    def stretches(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Word ranges outside which no window can lie."""
        g = self.mixed(ids)
        if not len(g) or not len(self.grams):
            return []
        at = np.searchsorted(self.grams, g)
        at[at == len(self.grams)] = 0
        hit = (self.grams[at] == g) & (g != 0)
        if not hit.any():
            return []
        edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
        return [(a, b + self.gram - 1) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True) if b - a >= self.probe - self.gram + 1]

    def match(self, doc: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit word ranges (merged, end exclusive) and the items whose windows occur."""
        get = self.word.get
        ids = np.array([get(w, -1) for w in doc], np.int64)
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        nxt, link, length, window = self.next, self.link, self.length, self.window
        for a, b in self.stretches(ids):
            s = n = 0
            for i, x in enumerate(ids[a:b].tolist(), a):
                while s and x not in nxt[s]:
                    s = link[s]
                    n = length[s]
                s = nxt[s].get(x, 0)
                n = n + 1 if s else 0
                if n >= window:
                    while length[link[s]] >= window:  # the state of the window itself
                        s = link[s]
                    n = min(n, length[s])
                    found |= self.holds[s]
                    spans.append((i - window + 1, i + 1))
                m = self.marked[s]
                while m > 0:
                    fits = [k for k in self.whole[m] if self.size[k] <= n]
                    if fits:
                        found.update(fits)
                        spans.append((i - max(self.size[k] for k in fits) + 1, i + 1))
                    m = self.marked[link[m]]
        return merged(spans), found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def item_blocks(benchmark: DataFrame, item: str, text: str, block_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The query set, in blocks; one block at a time is on the driver."""
    block: list[tuple[str, list[bytes]]] = []
    n = 0
    for row in benchmark.where(F.col(item).isNotNull()).select(F.col(item).cast("string"), text).toLocalIterator():
        w = words(row[1])
        if w:
            block.append((row[0], w))
            n += len(w)
        if n >= block_words:
            yield block
            block, n = [], 0
    if block:
        yield block


#: Blocks of items at most: each is held by every executor and costs a pass over the words.
MOST_BLOCKS = 64
HITS = "array<struct<a:int,b:int>>"


def mark(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with n_words, hits (word ranges) and items (sorted ids of items with occurring windows)."""
    spark = docs.sparkSession
    small_batches(spark)
    kept = kept_columns(docs, ["n_words", "hits", "items"])
    out = docs.select(*map(quoted, kept), F.lit(0).cast("bigint").alias("n_words"), F.array().cast(HITS).alias("hits"), F.array().cast("array<string>").alias("items"))
    schema = out.schema
    blocks = 0
    for block in item_blocks(benchmark, item, item_text, block_words):
        if blocks == MOST_BLOCKS:
            raise ValueError(f"more than {MOST_BLOCKS} blocks of {block_words} words of test items")
        sent = spark.sparkContext.broadcast(block)  # block_words words at most, and one item
        out = map_arrow(out, _marker(sent, kept, text, window), schema)
        blocks += 1
    return out if blocks else map_arrow(out, _marker(None, kept, text, window), schema)


def worker_automaton(name: str, block: list[tuple[str, list[bytes]]], window: int) -> Automaton:
    """This Python worker's automaton of a block: it lives from task to task."""
    return held("automaton", name, lambda: Automaton(block, window), most=2)


def _marker(sent, kept: list[str], text: str, window: int):
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = worker_automaton(name, sent.value if sent is not None else [], window)
        for batch in batches:
            n_words, hits, items = [], [], []
            for t, h, i in zip(batch.column(kept.index(text)).to_pylist(), batch.column(len(kept) + 1).to_pylist(), batch.column(len(kept) + 2).to_pylist(), strict=True):
                w = words(t)
                spans, found = automaton.match(w)
                n_words.append(len(w))
                hits.append([{"a": a, "b": b} for a, b in (merged([(x["a"], x["b"]) for x in h] + spans) if h else spans)])
                items.append(sorted({*i, *(automaton.ids[k] for k in found)}))
            made = [pa.array(n_words, pa.int64()), pa.array(hits, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(kept))] + made, names=[*kept, "n_words", "hits", "items"])

    return run


def n_hit() -> Column:
    return F.aggregate("hits", F.lit(0).cast("bigint"), lambda n, h: n + h["b"] - h["a"])


def contaminated(share: int = 20) -> Column:
    hit = n_hit()
    return (hit > 0) & (share * hit >= F.col("n_words"))


def strip(marked: DataFrame, text: str = "text", longest: int = WINDOW) -> DataFrame:
    """``marked`` with the spans of ``longest`` words or more cut out of ``text``."""
    at, hits_at = marked.columns.index(text), marked.columns.index("hits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [without(t, [(h["a"], h["b"]) for h in hits if h["b"] - h["a"] >= longest]) for t, hits in zip(batch.column(at).to_pylist(), batch.column(hits_at).to_pylist(), strict=True)]
            yield batch.set_column(at, "text", pa.array(cut, pa.string()))

    return map_arrow(marked, run, marked.schema)


def without(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """``text`` without the words of ``spans`` and what stands between them."""
    if text is None or not spans:
        return text
    raw = text.encode("utf-8", "replace")
    inside = np.frombuffer(raw.translate(_NORMAL), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
    starts, ends = edge[::2], edge[1::2]
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : starts[a]])
        at = int(ends[b - 1])
    out.append(raw[at:])
    return b"".join(out).decode("utf-8", "replace")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = mark(load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "benchmark"))
    return marked.select(
        "doc_id",
        "n_words",
        n_hit().alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


ORACLE = r"""
with n as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents),
b as (select item_id::varchar as item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from benchmark),
v as (select distinct item_id, least(len(w), 13) as k, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') as g
      from (select item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) as i from b where len(w) > 0)),
sizes as (select distinct k from v),
p as (select doc_id, unnest(w) as x, generate_subscripts(w, 1) as i from n),
q as (select doc_id, i, x, lead(x, 1) over o as x1, lead(x, 2) over o as x2, lead(x, 3) over o as x3, lead(x, 4) over o as x4, lead(x, 5) over o as x5, lead(x, 6) over o as x6, lead(x, 7) over o as x7,
      lead(x, 8) over o as x8, lead(x, 9) over o as x9, lead(x, 10) over o as x10, lead(x, 11) over o as x11, lead(x, 12) over o as x12 from p window o as (partition by doc_id order by i)),
r as (select doc_id, i, k, array_to_string(([x, x1, x2, x3, x4, x5, x6, x7, x8, x9, x10, x11, x12])[1:k], ' ') as g from q, sizes where ([x, x1, x2, x3, x4, x5, x6, x7, x8, x9, x10, x11, x12])[k] is not null),
h as (select r.doc_id, r.i, v.k, v.item_id from r join v on r.g = v.g and r.k = v.k),
hw as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(i, i + k)) as j from h) group by doc_id),
hi as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id, ',' order by item_id) as ids from h group by doc_id)
select n.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from n left join hw using (doc_id) left join hi using (doc_id)
"""
