"""BPE encoding and decoding by a pair occurrence index.

The words (pre-tokens) that a worker has not met yet are laid out once each as one array of symbols. An index maps each
pair, by its rank, to all its positions in all these words. The active ranks are applied in ascending order, each
at all its positions, left to right; a merge updates the lists of the two pairs beside it, and no other. A worker keeps the
ids of words it has met in a table of bounded size that is emptied when full; words are then encoded again, with the same ids.

Byte-level vocabularies in the ``tokenizers`` JSON form are read; a file with settings that this module does not
follow is refused. The vocabulary file is read once on the driver and travels with the task. Words are split
by the file's byte-level pattern. Letters newer than Python's Unicode tables may be classed differently by the two
regex engines, so a text with such a character is split by the library's own byte-level pre-tokenizer.

Defined results
  null text: encoded as the empty text (no ids). Special tokens in a text get their own ids.
  empty table: empty result. Repeated rows are encoded alike. Very long texts: whole, a part at a time; very long words: n log n.
  Extra columns pass through; columns named like an output, in any case, are replaced.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from itertools import islice
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm.common import give_back, held, kept_columns, load, map_arrow, quoted, small_batches

#: The byte-level pattern for words; a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same with its alternatives in another order (no two of those moved can begin alike), and for ASCII texts by the standard library.
LETTERS_FIRST = r" ?\p{L}+|'s|'t|'re|'ve|'m|'ll|'d| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ASCII_ONLY = r" ?[A-Za-z]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
#: Words, and letters of words, that a worker keeps before it empties its table.
TABLE_WORDS, TABLE_CHARS = 250_000, 6_000_000
#: Characters of texts, and words of one text, that are held at once.
GROUP_CHARS, GROUP_WORDS = 1 << 19, 1 << 17
#: Positions of a rank beyond which they are merged as arrays.
MANY = 128
#: What stands after each word.
END = 1 << 19
#: The rank of a pair that has none.
NO_RANK = np.int32(1 << 30)


def byte_letters() -> dict[int, str]:
    """Byte to printable letter of byte-level vocabularies: printable Latin-1 stays, the rest follows from 256 on."""
    stay = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in stay}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(stay))
    return out


def check_settings(j: dict) -> None:
    """Refuses a file that asks for more than byte-level BPE as this module does it."""
    model, pre = j["model"], j.get("pre_tokenizer") or {}
    plain = {"dropout": (None, 0, 0.0), "unk_token": (None,), "continuing_subword_prefix": (None, ""), "end_of_word_suffix": (None, ""), "byte_fallback": (None, False), "ignore_merges": (None, False)}
    wrong = [k for k, fit in plain.items() if model.get(k) not in fit]
    wrong += ["model"] if model.get("type", "BPE") != "BPE" else []
    wrong += ["normalizer"] if j.get("normalizer") else []
    wrong += ["pre_tokenizer"] if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or pre.get("use_regex") is False else []
    wrong += ["decoder"] if (j.get("decoder") or {}).get("type") != "ByteLevel" else []
    wrong += ["added_tokens"] if any(t.get(k) for t in j.get("added_tokens") or [] for k in ("single_word", "lstrip", "rstrip")) else []
    if wrong:
        raise ValueError(f"vocabulary settings not supported: {', '.join(wrong)}")


class Vocabulary:
    """What a vocabulary file says: ids of bytes, ranks of pairs, merges by rank, bytes of ids, special tokens."""

    def __init__(self, text: str) -> None:
        j = json.loads(text)
        check_settings(j)
        letters = byte_letters()
        back = {c: b for b, c in letters.items()}
        vocab = j["model"]["vocab"]
        self.byte_id = [vocab[letters[b]] for b in range(256)]
        self.rank: dict[int, int] = {}  # of the pair (a, b), as a << 20 | b
        self.merge: list[tuple[int, int, int]] = []  # by rank: a, b and what they become
        for m in j["model"]["merges"]:
            a, b = m.split(" ") if isinstance(m, str) else m
            self.rank.setdefault(vocab[a] << 20 | vocab[b], len(self.merge))
            self.merge.append((vocab[a], vocab[b], vocab[a + b]))
        bytes_of = {i: bytes(back[c] for c in w) if all(c in back for c in w) else w.encode() for w, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in j.get("added_tokens") or []}
        bytes_of |= {i: w.encode() for w, i in self.special.items()}
        if max(bytes_of) >= 1 << 19:
            raise ValueError("ids of 2^19 and more are not supported")
        of = [bytes_of.get(i, b"") for i in range(max(bytes_of) + 1)]
        self.size = np.fromiter(map(len, of), np.int64, len(of))  # of an id, in bytes
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(of), np.uint8)
        self.names = [str(i) for i in range(len(of))]


class PairIndex:
    """Encodes many words at once: each pair, by its rank, has all its positions in all words."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.byte_id = np.array(vocabulary.byte_id, np.int32)
        merges = np.array([m[:2] for m in vocabulary.merge], np.int64).reshape(-1, 2)
        self.keys = np.append(merges[:, 0] << 20 | merges[:, 1], -1)  # by rank; the last stands for none
        self.slots = np.full(1 << 20, -1, np.int32)
        todo, step = np.unique(self.keys[:-1], return_index=True)[1], 0  # of a pair given twice the first rank counts
        while len(todo):
            at = self._slot(self.keys[todo], step)
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]
            todo, step = todo[self.slots[at] != todo], step + 1

    @staticmethod
    def _slot(keys: np.ndarray, step: int) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).view(np.int64) + step) & 0xFFFFF

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.int64) << 20 | b
        got = self.slots[self._slot(keys, 0)]
        fits = self.keys[got] == keys
        out = np.where(fits, got, NO_RANK)
        more, step = np.flatnonzero(~fits & (got >= 0)), 1
        while len(more):
            got = self.slots[self._slot(keys[more], step)]
            fits = self.keys[got] == keys[more]
            out[more[fits]] = got[fits]
            more, step = more[~fits & (got >= 0)], step + 1
        return out

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after the other, and how many each has; no word is empty.

        The index is filled at once, positions sorted by rank; ranks are taken in ascending order, and each merge adds the
        two pairs beside it to the lists of their ranks. Long lists are merged as arrays, short ones position by position.
        """
        if not words:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1  # a mark stands after each word, and is in no pair
        ends = np.cumsum(size)
        n = int(ends[-1])
        inside = np.ones(n, bool)
        inside[ends - 1] = False
        symbols = np.full(n, END, np.int32)
        symbols[inside] = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        # arrays of numbers and views on the same memory: single positions are read through the one, many through the other
        sym, nxt, prv = (array("i", x.tobytes()) for x in (symbols, np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)))
        syms, nexts, prevs = (np.frombuffer(x, np.int32) for x in (sym, nxt, prv))
        rank = self.ranks(syms[:-1], syms[1:])
        places = np.flatnonzero(rank < NO_RANK)
        places = places[np.argsort(rank[places], kind="stable")]
        active, first = np.unique(rank[places], return_index=True)
        where = dict(zip(active.tolist(), zip(first.tolist(), np.append(first[1:], len(places)).tolist(), strict=True), strict=True))  # the index: spans of ``places``,
        added: dict[int, list[int]] = {}  # and the positions that merges have added
        queue = active.tolist()  # ascending, so a heap
        push, pop, find, merge = heapq.heappush, heapq.heappop, self.v.rank.get, self.v.merge

        def add(r: int, at: list[int]) -> None:
            if r in added:
                added[r] += at
            else:
                added[r] = at
                if r not in where:
                    push(queue, r)

        while queue:
            r = pop(queue)
            lo, hi = where.pop(r, (0, 0))
            more = added.pop(r, None)
            a, b, new = merge[r]
            if hi - lo + len(more or ()) > MANY and a != b:
                at = np.unique(np.concatenate((places[lo:hi], np.array(more, np.int64)))) if more else places[lo:hi]
                to = nexts[at]
                fits = (syms[at] == a) & (syms[to] == b)  # else an earlier merge took one of the two
                at, to = at[fits], to[fits]
                after = nexts[to]
                syms[at], syms[to], nexts[at], prevs[after] = new, -1, after, at
                before = prevs[at]
                left = at[before >= 0]
                before = before[before >= 0]
                beside = np.concatenate((self.ranks(np.full(len(at), new), syms[after]), self.ranks(syms[before], np.full(len(left), new))))
                which = np.concatenate((at, before))[beside < NO_RANK]
                beside = beside[beside < NO_RANK]
                order = np.argsort(beside, kind="stable")
                kinds, starts = np.unique(beside[order], return_index=True)
                which = which[order].tolist()
                starts = [*starts.tolist(), len(which)]
                for i, q in enumerate(kinds.tolist()):
                    add(q, which[starts[i] : starts[i + 1]])
                continue
            at = places[lo:hi].tolist()
            if more:
                at = sorted(at + more)
            for i in at:
                j = nxt[i]
                if sym[i] != a or sym[j] != b:
                    continue
                sym[i], sym[j] = new, -1
                nxt[i] = k = nxt[j]
                prv[k] = i
                q = find(new << 20 | sym[k])
                if q is not None:
                    add(q, [i])
                h = prv[i]
                if h >= 0:
                    q = find(sym[h] << 20 | new)
                    if q is not None:
                        add(q, [h])
        live = (syms >= 0) & (syms != END)
        return syms[live], np.add.reduceat(live.astype(np.int64), ends - size)


class WordNumbers(dict):
    """Words to numbers in the order of their first meeting; ``new`` lists those met since it was last emptied."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


def gather(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The slices ``values[start : start + size]``, one after the other."""
    ends = np.cumsum(size)
    return values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)]


def unassigned_class() -> str:
    """A regex class of the characters that Python's tables have no category for."""
    spans, start = [], None
    for c in range(0x110000):
        if unicodedata.category(chr(c)) == "Cn":
            start = c if start is None else start
        elif start is not None:
            spans.append((start, c - 1))
            start = None
    if start is not None:
        spans.append((start, 0x10FFFF))
    return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans) + "]"


class Encoder:
    """Texts to ids and back, with the table of words met."""

    def __init__(self, vocabulary: Vocabulary, share: float = 1.0) -> None:
        import regex

        self.share = share
        self.v, self.index = vocabulary, PairIndex(vocabulary)
        self.pattern, self.ascii = regex.compile(LETTERS_FIRST), re.compile(ASCII_ONLY)
        self.newer = regex.compile(unassigned_class()).search
        self.first_newer = next(chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) == "Cn")
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True))) + ")").split if vocabulary.special else None
        self.plain = None
        self.forget()

    def forget(self) -> None:
        self.table, self.chars, self.unsure = WordNumbers(), 0, set()
        self.ids, self.size, self.start = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def pieces(self, text: str) -> Iterator[tuple[bool, str]]:
        for i, p in enumerate(self.cut(text) if self.cut else [text]):
            if p:
                yield i % 2 == 1, p

    def words(self, text: str, plain: bool = False) -> Iterator[list[str]]:
        """Words, and special tokens as they are, ``GROUP_WORDS`` at most of a long text at a time."""
        for special, p in self.pieces(text):
            if special:
                yield [p]
            elif plain:
                if self.plain is None:
                    from tokenizers.pre_tokenizers import ByteLevel

                    self.plain = ByteLevel(add_prefix_space=False, use_regex=True)
                yield [p[a:b] for _, (a, b) in self.plain.pre_tokenize_str(p)]
            elif len(p) <= GROUP_CHARS:
                yield (self.ascii if p.isascii() else self.pattern).findall(p)
            else:
                found = map(itemgetter(0), (self.ascii if p.isascii() else self.pattern).finditer(p))
                while some := list(islice(found, GROUP_WORDS)):
                    yield some

    def full(self) -> bool:
        return self.chars > TABLE_CHARS * self.share or len(self.table) > TABLE_WORDS * self.share

    def learn(self) -> None:
        """Encodes the words that the table has numbered but holds no ids of."""
        new, self.table.new = self.table.new, []
        if not new:
            return
        special = self.v.special
        apart = [i for i, w in enumerate(new) if w in special] if special else []
        ids, size = self.index.encode([w.encode("utf-8", "replace") for w in new if w not in special] if apart else [w.encode("utf-8", "replace") for w in new])
        if apart:
            at = np.array(apart)
            before = np.concatenate([[0], np.cumsum(size)])[at - np.arange(len(at))]  # ids of the words before each special one
            ids, size = np.insert(ids, before, [special[new[i]] for i in apart]), np.insert(size, at - np.arange(len(at)), 1)
        base = len(self.size)
        self.start = np.concatenate((self.start, len(self.ids) + np.cumsum(size) - size))
        self.ids, self.size = np.concatenate((self.ids, ids)), np.concatenate((self.size, size))
        self.chars += sum(map(len, new))
        for i, w in enumerate(new):
            if not w.isascii() and max(w) >= self.first_newer and self.newer(w):
                self.unsure.add(base + i)

    def _ids(self, numbers: np.ndarray) -> np.ndarray:
        return gather(self.ids, self.start[numbers], self.size[numbers])

    def encode_long(self, text: str) -> np.ndarray:
        """The ids of a long text, part by part; the table is emptied on the way if need be."""
        for plain in (False, True):
            out = []
            for words in self.words(text, plain):
                for a in range(0, len(words), GROUP_WORDS):
                    if self.full():
                        self.forget()
                    part = words[a : a + GROUP_WORDS]
                    numbers = np.fromiter(map(self.table.__getitem__, part), np.int64, len(part))
                    self.learn()
                    if not plain and self.unsure and np.isin(numbers, list(self.unsure)).any():
                        out = None
                        break
                    out.append(self._ids(numbers))
                if out is None:
                    break
            if out is not None:
                break
        return np.concatenate(out) if out else np.empty(0, np.int32)

    def encode_all(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Per text its ids."""
        if self.full():
            self.forget()
        find = self.table.__getitem__
        if len(texts) == 1 and len(texts[0] or "") > GROUP_CHARS:
            yield self.encode_long(texts[0])
            return
        numbers = []
        for t in texts:
            words = [w for part in self.words(t or "") for w in part]
            numbers.append(np.fromiter(map(find, words), np.int64, len(words)))
        self.learn()
        if self.unsure:
            unsure = list(self.unsure)
            for i, t in enumerate(texts):
                if np.isin(numbers[i], unsure).any():
                    words = [w for part in self.words(t or "", plain=True) for w in part]
                    numbers[i] = np.fromiter(map(find, words), np.int64, len(words))
            self.learn()
        ids = self._ids(np.concatenate(numbers)) if numbers else np.empty(0, np.int32)
        at = 0
        for n in numbers:
            size = int(self.size[n].sum())
            yield ids[at : at + size]
            at += size

    def decode(self, ids: np.ndarray) -> str:
        """What ``ids`` stand for."""
        parts = [gather(self.v.bytes, self.v.start[x], self.v.size[x]).tobytes() for a in range(0, len(ids), GROUP_WORDS) for x in [ids[a : a + GROUP_WORDS]]]
        return b"".join(parts).decode("utf-8", "replace")

    def digest(self, ids: np.ndarray) -> str:
        """SHA-256 of the decimal ids joined by commas."""
        out = hashlib.sha256()
        name = self.v.names.__getitem__
        for a in range(0, len(ids), GROUP_WORDS):
            out.update(((("," if a else "") + ",".join(map(name, ids[a : a + GROUP_WORDS].tolist()))).encode()))
        return out.hexdigest()


def groups(texts: list[str | None], share: float = 1.0) -> Iterator[list[str | None]]:
    """``texts`` in order, in groups of about ``GROUP_CHARS`` characters; a longer text is a group of its own."""
    group: list[str | None] = []
    size = 0
    for t in texts:
        if group and size + len(t or "") > GROUP_CHARS * share:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t or "")
    if group:
        yield group


def worker_encoder(source: str, share: float) -> Encoder:
    """This Python worker's encoder: it lives from task to task."""
    return held("encoder", f"{share}/{hashlib.sha256(source.encode()).hexdigest()}", lambda: Encoder(Vocabulary(source), share))


def encode(df: DataFrame, vocabulary_path: str, text: str = "text", digest: bool = False, share: float = 1.0) -> DataFrame:
    """``df`` with ``n_tokens`` and ``ids`` (array of int) and, for ``text``, what the ids decode to; with ``digest`` hashes of both instead.

    ``share``: of the words that a worker's table holds, and of the texts that go together; less of it takes less memory and more time, the ids are the same.
    """
    small_batches(df.sparkSession)
    with open(vocabulary_path, encoding="utf-8") as f:
        source = f.read()
    packed = df.sparkSession.sparkContext.broadcast(source)  # a vocabulary file: some MB at any size of the data
    made = ["n_tokens", "ids_sha256", "decoded_sha256"] if digest else ["n_tokens", "ids", text]
    kept = kept_columns(df, [*made, text])
    fields = [df.schema[c] for c in kept]
    fields += [T.StructField("n_tokens", T.LongType())]
    fields += [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())] if digest else [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField(text, T.StringType())]
    schema = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            if encoder is None:
                encoder = worker_encoder(packed.value, share)
            counts, first, second = [], [], []
            for ids in (x for group in groups(batch.column(batch.num_columns - 1).to_pylist(), share) for x in encoder.encode_all(group)):
                decoded = encoder.decode(ids)
                counts.append(len(ids))
                first.append(encoder.digest(ids) if digest else ids)
                second.append(hashlib.sha256(decoded.encode()).hexdigest() if digest else decoded)
            kinds = [pa.string(), pa.string()] if digest else [pa.list_(pa.int32()), pa.string()]
            arrays = [batch.column(i) for i in range(len(kept))] + [pa.array(counts, pa.int64()), pa.array(first, kinds[0]), pa.array(second, kinds[1])]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *made])
            del batch, counts, first, second, arrays
            give_back()

    return map_arrow(df.select(*map(quoted, kept), F.col(text)), run, schema)


def vocabulary_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(load(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary_file(), digest=True)


ORACLE = None
