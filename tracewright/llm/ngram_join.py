"""N-gram Jaccard self-join: rare-first prefixes with length, positional and suffix filters, and its components.

1. Word n-grams are 64-bit numbers; a text is the sorted set of them. Texts with the same set
   form a class; one document stands for it, so exact copies are never compared.
2. A bounded table of the most frequent n-grams (counted over all documents) puts the others first:
   two sets that reach the threshold share one of the first n - ceil(t n) + 1 n-grams of each,
   in any fixed order, and rare ones make few candidates. The table's bound only moves cost.
3. Prefix n-grams meet in one shuffle, sorted. A streaming pass holds one row per n-gram: its
   hub, the smallest document, with which each other document makes a candidate if the
   length and positional filters allow. N-grams of the table are dealt over lanes by
   document, each with a hub of its own, and the hubs meet in turn: no n-gram fills a task.
4. Candidates pass the suffix filter on sketches (counts between fixed pivots bound the overlap).
   The rest is verified once: the sets concerned are made again from the text and intersected.
5. Links give components. Documents of n-grams that still lie in different components meet in
   tiles of bounded size, where all pairs across components are compared by their sketches; the
   documents with a partner come again with their sets, are verified in the tile, and only links
   that join components become rows. No pair across components is missed: the result is exact, with no cap.

Which documents a step needs is told by a bitmap over hashed ids, so texts are
shuffled only where they are needed; ids that share a bit only add work. N-grams outside the table are rarer
than all in it; a run of any length streams by.

Defined results
  null, empty or wordless text: the empty set, linked with nothing, component: itself.
  fewer words than n: the whole sequence is the one n-gram.
  rows that repeat a doc_id are one document with each row's links. null doc_id: null component, no links.
  doc_id: a whole number; ids of other types are numbered first, by the caller.
  empty table: empty result. Very long texts: whole. Extra columns pass by unread.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.llm.common import Stored, fresh, give_back, load, quoted, small_batches
from tracewright.llm.components import components

#: N-grams in the table of frequent ones, and counts per lane of such an n-gram.
FREQUENT, PER_LANE = 1 << 20, 2048
#: Documents of one n-gram in a block; two blocks make a tile.
BLOCK = 1024
#: Parts that the exact copies of one text are dealt over.
COPY_LANES = 64
#: Most bits of a bitmap over ids (64 MB): beyond that many ids it would tell nothing and is left out.
BITS = 1 << 29


class WordNumbers(dict):
    def __missing__(self, word: bytes) -> int:
        n = xxhash.xxh3_64_intdigest(word)
        if len(self) >= 200_000:
            self.clear()
        self[word] = n
        return n


_numbers = WordNumbers()


def _constants(n: int) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(f"place {j}") | 1 for j in range(n)], np.uint64)


def shingles(text: str | None, n: int) -> np.ndarray:
    """The sorted set of a text's word n-grams; A-Z lower-cased, words split at ASCII white space."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_numbers.__getitem__, words), np.uint64, len(words))
    k = min(n, len(w))
    c = _constants_of[n] if n in _constants_of else _constants_of.setdefault(n, _constants(n))
    m = len(w) - k + 1
    h = np.full(m, k, np.uint64)
    for j in range(k):
        h += w[j : j + m] * c[j]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return np.unique(h)


_constants_of: dict[int, np.ndarray] = {}


def frequent(docs: DataFrame, n: int, stored: Stored, most: int = FREQUENT, chunk: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent n-grams (sorted) and their counts, over all documents: ``most`` of them at most.

    Tasks count ``chunk`` n-grams at a time and report those met three times or more. Counts fall into levels of
    an eighth of a doubling; the table takes the highest levels that fit, so that nothing is sorted in one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def counted() -> pa.RecordBatch:
            grams, counts = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, np.uint64), np.empty(0, np.int64))
            often = counts >= 3
            return pa.RecordBatch.from_arrays([pa.array(grams[often].view(np.int64)), pa.array(counts[often].astype(np.int64))], names=["gram", "n"])

        for batch in batches:
            for t in batch.column("text").to_pylist():
                s = shingles(t, n)
                held.append(s)
                size += len(s)
                if size >= chunk:
                    yield counted()
                    held, size = [], 0
        yield counted()

    level = F.floor(8 * F.log2("n")).cast("int")
    table = stored.keep(docs.select("text").mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")))
    floor, room = 1 << 30, most
    for at, grams in sorted(table.groupBy(level.alias("at")).count().collect(), reverse=True):  # 512 levels at most
        room -= grams
        if room < 0:
            break
        floor = at
    top = table.where(level >= floor).toArrow()  # ``most`` rows at most
    grams, counts = top.column("gram").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(grams)
    return grams[order], counts[order]


def prefix(grams: np.ndarray, often: np.ndarray, counts: np.ndarray, num: int, den: int) -> np.ndarray:
    """The first n - ceil(t n) + 1 n-grams of a set, rare ones first."""
    m = len(grams) - -(-num * len(grams) // den) + 1
    if not len(often):
        return grams[:m]
    at = np.searchsorted(often, grams)
    at[at == len(often)] = 0
    common = often[at] == grams
    rare = grams[~common]
    if len(rare) >= m:
        return rare[:m]
    order = np.lexsort((grams[common], counts[at[common]]))
    return np.concatenate((rare, grams[common][order]))[:m]


def sketch_bits(n: int) -> int:
    return max(0, (n // 2).bit_length() - 1)


def sketch(grams: np.ndarray) -> bytes:
    """How many n-grams lie between equally spaced pivots, two to four on average.

    Half a byte each where that is enough, else a byte; empty where a byte is too small.
    """
    bits = sketch_bits(len(grams))
    if not bits or bits > 32:
        return b""
    counts = np.bincount((grams >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    most, counts = counts.max(), counts.astype(np.uint8)
    return (counts[::2] << 4 | counts[1::2]).tobytes() if most < 16 else counts.tobytes() if most < 256 else b""


def sketch_counts(raw: bytes, n: int) -> np.ndarray:
    """The counts of a sketch of ``n`` n-grams."""
    x = np.frombuffer(raw, np.uint8)
    return np.stack((x >> 4, x & 15), axis=1).ravel() if 2 * len(x) == 1 << sketch_bits(n) else x


def sketches_reach(a: bytes, b: bytes, na: int, nb: int, num: int, den: int) -> bool:
    """The suffix filter: what lies between two pivots in both sets is the smaller count at most."""
    if den * min(na, nb) < num * max(na, nb):
        return False
    if not a or not b:
        return True
    x, y = sketch_counts(a, na).astype(np.int64), sketch_counts(b, nb).astype(np.int64)
    while len(x) > len(y):
        x = x[::2] + x[1::2]
    while len(y) > len(x):
        y = y[::2] + y[1::2]
    return (num + den) * int(np.minimum(x, y).sum()) >= num * (na + nb)


def summaries(docs: DataFrame, n: int, num: int, den: int, often: np.ndarray, counts: np.ndarray) -> DataFrame:
    """Per row: doc_id, size of the set, its signature, prefix and sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, sig, pre, sk = [], [], [], []
            for t in batch.column("text").to_pylist():
                s = shingles(t, n)
                size.append(len(s))
                sig.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                pre.append(prefix(s, often, counts, num, den).tobytes() if len(s) else b"")
                sk.append(sketch(s))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int32()), pa.array(sig, pa.binary()), pa.array(pre, pa.binary()), pa.array(sk, pa.binary())], names=["doc_id", "n", "sig", "prefix", "sketch"])
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n int, sig binary, prefix binary, sketch binary")


def postings(classes: DataFrame, often: np.ndarray, counts: np.ndarray) -> DataFrame:
    """A row per class and prefix n-gram; lane -1 unless the n-gram is dealt over several."""
    lanes_of = 1 + counts // PER_LANE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [np.frombuffer(p, np.uint64) for p in batch.column("prefix").to_pylist()]
            if not grams:
                continue
            lengths = np.array([len(g) for g in grams])
            gram = np.concatenate(grams)
            doc = np.repeat(batch.column("doc_id").to_numpy(), lengths)
            size = np.repeat(batch.column("n").to_numpy(), lengths)
            pos = np.concatenate([np.arange(k, dtype=np.int32) for k in lengths])
            lane = np.full(len(gram), -1, np.int32)
            if len(often) and len(gram):
                at = np.searchsorted(often, gram)
                at[at == len(often)] = 0
                lanes = np.where(often[at] == gram, lanes_of[at], 1)
                mixed = (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                lane = np.where(lanes > 1, (mixed % lanes.astype(np.uint64)).astype(np.int32), -1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(lane), pa.array(doc), pa.array(size), pa.array(pos)], names=["gram", "lane", "doc", "n", "pos"])

    return classes.select("doc_id", "n", "prefix").mapInArrow(run, "gram bigint, lane int, doc bigint, n int, pos int")


SHARED = "gram bigint, lane int, doc bigint, n int, pos int, hub bigint, close boolean, done boolean"


def may_reach(na, nb, pa_, pb, num: int, den: int):
    """Length and positional filters, for arrays or columns alike; min and max come from the caller's ``least``/``greatest``."""
    least = np.minimum if isinstance(na, np.ndarray) else F.least
    greatest = np.maximum if isinstance(na, np.ndarray) else F.greatest
    length = den * least(na, nb) >= num * greatest(na, nb)
    most = 1 + least(pa_, pb) + least(na - pa_ - 1, nb - pb - 1)
    return length & ((num + den) * most >= num * (na + nb))


def shared(posts: DataFrame, num: int, den: int) -> DataFrame:
    """Postings of n-grams with two classes or more, with the hub of their run.

    close: the filters allow the two; done: a run of two, of which nothing but a close pair is needed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # gram, lane, doc, n, pos of the open run's hub; whether it went out
        out = False
        for batch in batches:
            gram, lane, doc, size, pos = (batch.column(i).to_numpy() for i in range(5))
            size, pos = size.astype(np.int64), pos.astype(np.int64)
            if not len(gram):
                continue
            if held is not None and not out and gram[0] == held[0] and lane[0] == held[1]:
                yield _rows([held[0]], [held[1]], [held[2]], [held[3]], [held[4]], [held[2]], [False], [False])
                out = True
            new = np.concatenate(([True], (gram[1:] != gram[:-1]) | (lane[1:] != lane[:-1])))
            starts = np.flatnonzero(new)
            which = np.cumsum(new) - 1
            run_size = np.diff(np.concatenate((starts, [len(gram)])))
            hub, hub_n, hub_pos = doc[starts], size[starts], pos[starts]
            goes = (run_size > 1) | (lane[starts] >= 0)
            follows = held is not None and gram[0] == held[0] and lane[0] == held[1]
            if follows:
                hub, hub_n, hub_pos = hub.copy(), hub_n.copy(), hub_pos.copy()
                hub[0], hub_n[0], hub_pos[0] = held[2], held[3], held[4]
                goes[0] = True
            last = len(starts) - 1
            two = (run_size == 2) & (lane[starts] < 0)  # the last run of a batch may go on, the first may have begun before
            two[last] = False
            if follows:
                two[0] = False
            if last or not follows:
                held = (gram[-1], lane[-1], hub[last], hub_n[last], hub_pos[last])
            out = bool(goes[last])
            m = goes[which]
            if m.any():
                w = which[m]
                close = (doc[m] != hub[w]) & may_reach(size[m], hub_n[w], pos[m], hub_pos[w], num, den)
                k = close | ~two[w]
                yield _rows(gram[m][k], lane[m][k], doc[m][k], size[m][k], pos[m][k], hub[w][k], close[k], two[w][k])

    return posts.repartition("gram", "lane").sortWithinPartitions("gram", "lane", "doc").mapInArrow(run, SHARED)


def _rows(gram, lane, doc, size, pos, hub, close, done) -> pa.RecordBatch:
    arrays = [pa.array(gram, pa.int64()), pa.array(lane, pa.int32()), pa.array(doc, pa.int64()), pa.array(np.asarray(size, np.int32)), pa.array(np.asarray(pos, np.int32)), pa.array(hub, pa.int64()), pa.array(np.asarray(close, bool)), pa.array(np.asarray(done, bool))]
    return pa.RecordBatch.from_arrays(arrays, names=["gram", "lane", "doc", "n", "pos", "hub", "close", "done"])


def among(ids: DataFrame, most: int = BITS):
    """A column function that is true for the ids of ``ids`` (one bigint column, stored) and for few others; for all where they are more than ``most``."""
    n = ids.count()
    if n > most:
        return lambda c: c.isNotNull()
    bits = min(most, max(1 << 18, 1 << (8 * n).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    at = place(F.col(ids.columns[0])) + 1  # the bitmap functions count from 1
    blocks = ids.groupBy(F.bitmap_bucket_number(at).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("m")).collect()  # bits / 8 bytes at most
    bitmap = np.zeros(bits // 8 + 4096, np.uint8)
    for b, m in blocks:
        bitmap[(b - 1) * 4096 : (b - 1) * 4096 + len(m)] = np.frombuffer(m, np.uint8)
    sent = ids.sparkSession.sparkContext.broadcast(bitmap)

    @F.pandas_udf("boolean")
    def has(h: pd.Series) -> pd.Series:
        x = h.to_numpy()
        return pd.Series((sent.value[x >> 3] >> (x & 7).astype(np.uint8)) & 1 == 1)

    return lambda c: has(F.coalesce(place(c), F.lit(0))) & c.isNotNull()


def intersects(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """Whether the Jaccard similarity of two sorted sets is num / den or more."""
    need = -(-num * (len(a) + len(b)) // (num + den))
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) >= need


def with_both(pairs: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """``pairs`` (a, b) with the columns of ``table`` (id, ...) for either side, as a_... and b_...."""
    for side in "ab":
        pairs = pairs.join(table.select(F.col("id").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in columns]), side)
    return pairs


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))


def sets_of(docs: DataFrame, wanted, n: int) -> DataFrame:
    """(id, s): the set of each row whose id is ``wanted``, made from the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, n).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.binary())], names=["id", "s"])
        give_back()

    return docs.where(wanted(F.col("doc_id"))).select("doc_id", "text").mapInArrow(run, "id bigint, s binary")


def verify(pairs: DataFrame, sums: DataFrame, docs: DataFrame, n: int, num: int, den: int, stored: Stored) -> DataFrame:
    """Of the distinct ``pairs`` (a, b) those whose sets reach the threshold, as (u, v)."""

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [sketches_reach(*x, num, den) for x in zip(*(batch.column(c).to_pylist() for c in ("a_sketch", "b_sketch", "a_n", "b_n")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(near, pa.bool_()))

    sketched = sums.where(among(ends(pairs))(F.col("doc_id"))).select(F.col("doc_id").alias("id"), "n", "sketch")
    near = stored.keep(with_both(pairs, sketched, ["n", "sketch"]).mapInArrow(prune, "a bigint, b bigint").distinct())
    wanted = among(ends(near))

    sets = stored.keep(sets_of(docs, wanted, n))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a_s").to_pylist(), batch.column("b_s").to_pylist()
            good = [intersects(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), num, den) for x, y in zip(a, b, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["u", "v"]).filter(pa.array(good, pa.bool_()))

    return stored.keep(with_both(near, sets, ["s"]).mapInArrow(check, "u bigint, v bigint"))


def tile_pairs(same: bool, docs: list[tuple], num: int, den: int) -> Iterator[tuple[int, int]]:
    """Places (i, j) in ``docs`` of one tile, pairs whose sketches may reach the threshold and whose smallest common n-gram this is.

    ``docs``, by size: (doc, size, component, its smaller n-grams, sketch, whether in the first block). Sketches are
    compared a row against all at once; nothing is kept of a pair.
    """
    n = np.array([d[1] for d in docs], np.int64)
    comp = np.array([d[2] for d in docs], np.int64)
    first = np.array([d[5] for d in docs], bool)
    counts = [sketch_counts(d[4], d[1]) for d in docs]
    smaller = [frozenset(d[3]) for d in docs]
    width = np.array([len(x) for x in counts], np.int64)
    folded: dict[int, np.ndarray] = {}
    for i in range(len(docs) - 1):
        end = int(np.searchsorted(n, den * n[i] // num, "right"))
        j = np.arange(i + 1, end)
        j = j[(comp[j] != comp[i]) & (same | (first[j] != first[i]))]
        if not len(j):
            continue
        w = int(width[i])
        known = j[(width[j] == w) | (width[j] == 2 * w)] if w else j[:0]
        if len(known):
            if w not in folded:
                folded[w] = m = np.zeros((len(docs), w), np.uint16)
                for k in np.flatnonzero((width == w) | (width == 2 * w)):
                    x = counts[k].astype(np.uint16)
                    m[k] = x if len(x) == w else x[::2] + x[1::2]
            m = folded[w]
            most = np.minimum(m[known], m[i]).sum(axis=1, dtype=np.int64)
            known = known[(num + den) * most >= num * (n[known] + n[i])]
            j = np.concatenate((known, j[(width[j] != w) & (width[j] != 2 * w)]))
        for k in j.tolist():
            if smaller[i].isdisjoint(smaller[k]):
                yield i, k


def tile_hopeful(same: bool, docs: list[tuple], num: int, den: int) -> list[int]:
    """Places in ``docs`` (by size) that have a partner by their sketches."""
    hopeful: set[int] = set()
    for pair in tile_pairs(same, docs, num, den):
        hopeful.update(pair)
    return sorted(hopeful)


def tile_links(same: bool, docs: list[tuple], sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Verified links of a tile that join components which no earlier link of the tile joins: fewer than it has documents."""
    up = {d[2]: d[2] for d in docs}

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    links = []
    for i, j in tile_pairs(same, docs, num, den):
        x, y = root(docs[i][2]), root(docs[j][2])
        if x != y and intersects(sets[i], sets[j], num, den):
            up[max(x, y)] = min(x, y)
            links.append((docs[i][0], docs[j][0]))
    return links


def across(s: DataFrame, labels: DataFrame, sums: DataFrame, docs: DataFrame, size: int, num: int, den: int, stored: Stored, block: int = BLOCK) -> DataFrame:
    """Links (u, v) between different components, enough of them to join all that links join.

    Lengths fall into bands; an n-gram's band counts only if it and its neighbours hold two components.
    Documents of an n-gram meet in tiles of two blocks at most, dealt by the document. A first pass
    compares sketches inside a tile and names the documents that have a partner there; for these the sets of
    ``size``-grams are made again, and a second pass verifies inside the tile. No pair becomes a row: a tile gives
    a row per hopeful document, then fewer links than documents.
    """
    width = max(math.log(den / num) * 1.0001, 1e-6)  # lengths that may link lie in the same or in neighbouring bands
    rows = s.where("not done").join(labels.select(F.col("node").alias("doc"), "component"), "doc", "left").select("gram", "lane", "doc", "n", F.coalesce("component", "doc").alias("c"))
    rows = rows.repartition("gram", "lane").withColumn("band", F.floor(F.log("n") / width).cast("int"))  # read twice, dealt once; lanes bound what a key has
    listed = F.collect_list(F.struct("band", "lo", "hi", "m", "x", "y")).alias("at")
    bands = rows.groupBy("gram", "lane", "band").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("doc")).alias("x"), F.bit_xor(F.xxhash64("doc", F.lit(1))).alias("y"))
    by_lane = bands.groupBy("gram", "lane").agg(F.max("lane").alias("dealt"), listed)
    parts = by_lane.where("dealt >= 0").select("gram", "lane", F.inline("at")).groupBy("gram", "band").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("m").alias("m"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.collect_set("lane").alias("lanes"))
    dealt = parts.groupBy("gram").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("m").alias("m"), F.array_distinct(F.flatten(F.collect_list("lanes"))).alias("lanes"), listed)
    total = F.aggregate(F.col("at.m"), F.lit(0).cast("bigint"), lambda a, b: a + b)
    single = by_lane.where("dealt < 0").select("gram", F.array_min("at.lo").alias("lo"), F.array_max("at.hi").alias("hi"), total.alias("m"), F.array("lane").alias("lanes"), "at")
    grams = single.unionByName(dealt)
    around = lambda b, f, what: f(F.transform(F.filter("at", lambda o: F.abs(o["band"] - b["band"]) <= 1), lambda o: o[what]))
    mixed = grams.where("lo < hi and m > 2")  # of two, the hub has met the other
    mixed = mixed.select("gram", "lanes", F.filter("at", lambda b: around(b, F.array_min, "lo") < around(b, F.array_max, "hi")).alias("at")).where(F.size("at") > 0)
    over = lambda what, f: F.aggregate(F.col("at")[what], F.lit(0).cast("bigint"), f)
    mixed = mixed.select("gram", "lanes", F.col("at.band").alias("bands"), over("m", lambda a, b: a + b).alias("m"), over("x", lambda a, b: a.bitwiseXOR(b)).alias("x"), over("y", lambda a, b: a.bitwiseXOR(b)).alias("y"))
    mixed = mixed.groupBy("m", "x", "y").agg(F.min(F.struct("gram", "bands", "lanes")).alias("g")).select("g.gram", F.explode("g.lanes").alias("lane"), "g.bands", "m")  # of n-grams with the same documents, one
    live = stored.keep(rows.join(mixed, ["gram", "lane"]).where(F.array_contains("bands", F.col("band"))).groupBy("doc").agg(F.first("n").alias("n"), F.first("c").alias("c"), F.collect_set(F.struct("gram", "m")).alias("at")))
    sketches = sums.where(among(live.select("doc"))(F.col("doc_id"))).groupBy(F.col("doc_id").alias("doc")).agg(F.max("sketch").alias("sketch"), F.count(F.lit(1)).alias("copies"))
    met = live.join(sketches, "doc").select("doc", "n", "c", F.when(F.col("copies") == 1, F.col("sketch")).otherwise(F.lit(b"")).alias("sketch"), F.transform("at", lambda x: x["gram"]).alias("all"), F.explode("at").alias("g"))
    blocks = F.ceil(F.col("g.m") / block).cast("int")
    own = F.pmod(F.xxhash64("doc"), blocks).cast("int")
    tiles = met.select("doc", "n", "c", "sketch", F.filter("all", lambda x: x < F.col("g.gram")).alias("grams"), F.col("g.gram").alias("gram"), own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    tiles = tiles.select(F.col("gram"), F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "doc", "n", "c", "grams", "sketch")

    def in_tiles(batches: Iterator[pa.RecordBatch], done) -> Iterator[pa.RecordBatch]:
        """``done(key, rows)`` of every tile of rows in tile order; a row's last column is its sketch or set."""
        key, held = None, []
        for batch in batches:
            for gram, lo, hi, *row in zip(*(batch.column(i).to_pylist() for i in range(9)), strict=True):
                if key != (gram, lo, hi):
                    if len(held) > 1:
                        yield done(key, held)
                    key, held = (gram, lo, hi), []
                held.append(row)
        if len(held) > 1:
            yield done(key, held)
        held.clear()
        give_back()

    def entries(key: tuple, held: list, sketches: list[bytes]) -> list[tuple]:
        return [(doc, n, c, grams, sk, own_ == key[1]) for (own_, doc, n, c, grams, _), sk in zip(held, sketches, strict=True)]

    def hopeful(key: tuple, held: list) -> pa.RecordBatch:
        held.sort(key=lambda r: r[2])
        some = [held[i] for i in tile_hopeful(key[1] == key[2], entries(key, held, [r[5] for r in held]), num, den)]
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
        own_columns = [pa.array([r[i] for r in some], kind) for i, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([*(pa.array([k] * len(some), kind) for k, kind in zip(key, [pa.int64(), pa.int32(), pa.int32()], strict=True)), *own_columns], names=["gram", "lo", "hi", "own", "doc", "n", "c", "grams"])

    def links(key: tuple, held: list) -> pa.RecordBatch:
        held.sort(key=lambda r: r[2])
        sets = [np.frombuffer(r[5], np.uint64) for r in held]
        found = tile_links(key[1] == key[2], entries(key, held, [sketch(x) for x in sets]), sets, num, den)
        return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], names=["u", "v"])

    by_tile = lambda df: df.repartition("gram", "lo", "hi").sortWithinPartitions("gram", "lo", "hi")
    named = stored.keep(by_tile(tiles).mapInArrow(lambda batches: in_tiles(batches, hopeful), "gram bigint, lo int, hi int, own int, doc bigint, n int, c bigint, grams array<bigint>"))
    if named.isEmpty():
        return named.select(F.col("doc").alias("u"), F.col("doc").alias("v"))
    sets = sets_of(docs, among(named.select("doc")), size).withColumnsRenamed({"id": "doc", "s": "set"})
    full = named.join(sets, "doc").select("gram", "lo", "hi", "own", "doc", F.floor(F.octet_length("set") / 8).cast("int").alias("n"), "c", "grams", "set")
    return by_tile(full).mapInArrow(lambda batches: in_tiles(batches, links), "u bigint, v bigint")


def cluster(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100, doc: str = "doc_id", text: str = "text", stored: Stored | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles and component_id; links are Jaccard >= num / den."""
    spark = docs.sparkSession
    small_batches(spark)
    stored = stored or Stored(spark)
    docs = docs.select(F.col(doc).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    often, counts = frequent(docs, n, stored)
    sums = stored.keep(summaries(docs, n, num, den, often, counts))
    full = sums.where("n > 0 and doc_id is not null").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(COPY_LANES)).cast("int"))
    classes = stored.keep(full.groupBy("sig", "part").agg(F.min(F.struct("doc_id", "n", "prefix")).alias("m"), F.count(F.lit(1)).alias("rows")).groupBy("sig").agg(F.min("m").alias("m"), F.sum("rows").alias("rows"), F.collect_list("part").alias("parts")))
    s = stored.keep(shared(postings(classes.select("m.doc_id", "m.n", "m.prefix"), often, counts), num, den))
    hubs = s.where("lane >= 0 and doc = hub").select("gram", "doc").distinct()
    met = hubs.join(hubs.groupBy("gram").agg(F.min("doc").alias("first")), "gram").where("doc != first").select(F.col("first").alias("a"), F.col("doc").alias("b"))
    tried = stored.keep(s.where("close").select(F.col("hub").alias("a"), F.col("doc").alias("b")).unionByName(met).distinct())
    several = full.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    again = full.select("doc_id", "sig").join(several, "doc_id").join(classes.select("sig", F.col("m.doc_id").alias("first")), "sig").where("doc_id != first").select(F.col("doc_id").alias("u"), F.col("first").alias("v"))
    edges = verify(tried, sums, docs, n, num, den, stored).unionByName(again)
    labels = stored.keep(components(edges, stored))
    found = stored.keep(across(s, labels, sums, docs, n, num, den, stored))
    if not found.isEmpty():
        labels = stored.keep(joined(labels, found, stored))
    ids = labels.select(F.col("node").alias("first"), "component")
    placed = classes.select("sig", "parts", "rows", F.col("m.doc_id").alias("first")).join(ids, "first", "left").where("rows > 1 or component is not null")
    placed = placed.select("sig", F.explode("parts").alias("part"), F.coalesce("component", "first").alias("component"))  # as many rows as the copies have, no key of more than its part
    rows = sums.select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), F.when(F.col("n") > 0, F.col("sig")).alias("sig"), F.pmod(F.xxhash64("doc_id"), F.lit(COPY_LANES)).cast("int").alias("part"))
    out = rows.join(placed, ["sig", "part"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def joined(labels: DataFrame, links: DataFrame, stored: Stored) -> DataFrame:
    """``labels`` (node, component) after more ``links`` (u, v): only the components that they touch are taken again."""
    of = labels.withColumnsRenamed({"node": "end"})
    for end in "uv":
        links = links.join(of.withColumnsRenamed({"end": end, "component": f"{end}_c"}), end, "left")
    more = stored.keep(components(links.select(F.coalesce("u_c", "u").alias("u"), F.coalesce("v_c", "v").alias("v")), stored))
    alone = more.select("node", F.col("node").alias("component")).join(labels, "node", "left_anti")
    moved = more.select(F.col("node").alias("component"), F.col("component").alias("to"))
    return labels.unionByName(alone).join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component"))


def keep_one(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one row of each group of near copies: that of the smallest doc_id; of rows that repeat it the one whose text sorts first.

    Columns of any name pass through unchanged. Rows without a doc_id all stay.
    """
    stored = Stored(docs.sparkSession)
    goes, rows, place = fresh(docs.columns, "goes", "rows", "place")
    groups = stored.keep(cluster(docs, n, num, den, stored=stored))
    found = groups.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("doc_id") != F.col("component_id")).cast("int")).alias(goes), F.count(F.lit(1)).alias(rows)).where(f"{goes} = 1 or {rows} > 1")
    found = stored.keep(found)
    suspect = among(found.select("doc_id"))(F.col("doc_id"))
    held = docs.where(suspect).join(found, "doc_id", "left").where(f"{goes} is null or {goes} = 0")
    once = held.withColumn(place, F.row_number().over(W.partitionBy("doc_id").orderBy("text"))).where(f"{place} = 1 or {rows} is null")
    return docs.where(~suspect).unionByName(once.select(*map(quoted, docs.columns)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(load(spark, sf_dir, "documents"))


#: Components need a walk to a fixed point over links; the test compares with brute force.
ORACLE = None
