"""Token-ID / binary output: training-order materialisation by a keyed Feistel permutation.

Every partition's token ids, an end mark after each document, are one stream that is cut into sequences of
``seq_len`` tokens; only a partition's last sequence is padded. A cheap pass over text lengths reserves numbers
for each partition's sequences (a token is a byte at least); a keyed Feistel network over the next even
power of two permutes the reserved numbers, walking its cycle until it is back below their count. Sequences in
the order of their permuted numbers are the training order: a sequence's global slot is its rank there, without gaps.

Plan: texts are encoded once, on their way into one shuffle that deals ranges of permuted numbers. A task
holds the ranges of one shard or of several neighbours and writes each as a file of fixed-stride records in the shared folder; the manifest
tells each shard's first slot, so a reader resumes by seeking. Ranges are equal by construction, whatever the
skew of the documents. Tokens travel in the width of the file and are padded to the stride after the shuffle.
A task that finds more sequences than were reserved for it fails rather than write another order.

Defined results
  null text: the empty document, its end mark alone. Empty table: no sequences.
  repeated rows: each gets its own tokens. Very long documents: many sequences, cut and sent as they fill.
  doc_id: a whole number; null ids stay null in the lists. Extra columns are not carried into records.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.llm.common import Stored, give_back, load, shared_dir, small_batches

#: Tokens of a sequence, numbers that a shard reserves, shards of a task at most in number, key of the permutation.
SEQ_LEN, PER_SHARD, MOST_TASKS, KEY = 1024, 32768, 16384, 20250131
#: The words of the byte-level vocabularies; a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _round(x: np.ndarray, key: int, r: int) -> np.ndarray:
    k = np.uint64(int.from_bytes(hashlib.blake2b(f"{key}/{r}".encode(), digest_size=8).digest(), "little"))
    x = (x + k) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def permute(index: np.ndarray, n: int, key: int, rounds: int = 6, inverse: bool = False) -> np.ndarray:
    """The slots of ``index`` (below n), or with ``inverse`` the indexes of slots."""
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> shift, x & mask
        for r in reversed(range(rounds)) if inverse else range(rounds):
            if inverse:
                left, right = right ^ (_round(left, key, r) & mask), left
            else:
                left, right = right, left ^ (_round(right, key, r) & mask)
        out[todo] = (left << shift) | right
        todo = todo[out[todo] >= n]  # outside the slots: walk on
    return out.astype(np.int64)


SEQUENCE = "shard int, place bigint, doc_ids array<bigint>, first_token bigint, n_tokens int, body binary"


class Cutter:
    """Cuts a stream of documents' tokens into sequences; holds less than one sequence between calls."""

    def __init__(self, seq_len: int, width: int) -> None:
        self.step, self.width = seq_len * width, width
        self.rest = b""
        self.docs: list[tuple[int | None, int]] = []  # the documents in ``rest`` and where they start, in bytes

    def add(self, docs: list[int | None], tokens: list[bytes]) -> Iterator[tuple[list[int | None], int, bytes]]:
        """Per full sequence its documents, the place of its first token in the first of them, and its bytes."""
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        starts = [a for _, a in self.docs] + (len(self.rest) + np.cumsum(lengths) - lengths).tolist()
        ids = [d for d, _ in self.docs] + docs
        data = b"".join([self.rest, *tokens])
        full = len(data) // self.step
        for a in range(0, full * self.step, self.step):
            i, j = bisect.bisect_right(starts, a) - 1, bisect.bisect_left(starts, a + self.step)
            yield ids[i:j], (a - starts[i]) // self.width, data[a : a + self.step]
        end = full * self.step
        self.rest = data[end:]
        i = bisect.bisect_right(starts, end) - 1 if self.rest else len(ids)
        self.docs = [(d, a - end) for d, a in zip(ids[i:], starts[i:], strict=True)]

    def last(self) -> Iterator[tuple[list[int | None], int, bytes]]:
        if self.rest:
            yield [d for d, _ in self.docs], -self.docs[0][1] // self.width, self.rest


def sequences(df: DataFrame, encoder: Callable[[], Callable[[str], np.ndarray]], end: int, width: int = 2, text: str = "text", doc: str = "doc_id", seq_len: int = SEQ_LEN, per_shard: int = PER_SHARD, key: int = KEY, scan: bool = False) -> DataFrame:
    """All sequences, those of neighbouring shards in one partition, in training order.

    ``encoder`` makes a worker's function from text to ids. Both passes must see the same partitions: set ``scan``
    where ``df`` reads files and no more; else its two columns are written to the shared folder first.
    """
    small_batches(df.sparkSession)
    rows = df.select(F.col(doc).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    rows = rows if scan else Stored(df.sparkSession).keep(rows)
    most = F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)
    sizes = dict(rows.select(F.spark_partition_id().alias("p"), "text").groupBy("p").agg(F.ceil(most / seq_len).alias("n")).collect())  # a row per partition
    total, first = 0, {}
    for p in sorted(sizes):
        first[p] = total
        total += sizes[p]
    mark = np.array([end], f"<u{width}").tobytes()

    def rows_of(made: list[tuple], at: int) -> pa.RecordBatch:
        place = permute(np.arange(at, at + len(made)), total, key)
        arrays = [pa.array((place // per_shard).astype(np.int32)), pa.array(place), pa.array([m[0] for m in made], pa.list_(pa.int64())), pa.array([m[1] for m in made], pa.int64()), pa.array([len(m[2]) // width for m in made], pa.int32()), pa.array([m[2] for m in made], pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, names=["shard", "place", "doc_ids", "first_token", "n_tokens", "body"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = TaskContext.get().partitionId()
        at, stop = first.get(p, 0), first.get(p, 0) + sizes.get(p, 0)
        encode, cutter = None, Cutter(seq_len, width)

        def checked(made: list[tuple]) -> pa.RecordBatch:
            nonlocal at
            if at + len(made) > stop:
                raise RuntimeError(f"partition {p} changed between the passes")
            out = rows_of(made, at)
            at += len(made)
            return out

        for batch in batches:
            encode = encode or encoder()
            tokens = [encode(t or "").astype(f"<u{width}").tobytes() + mark for t in batch.column("text").to_pylist()]
            yield checked(list(cutter.add(batch.column("doc_id").to_pylist(), tokens)))
        yield checked(list(cutter.last()))
        give_back()

    shards = max(1, -(-total // per_shard))
    each = -(-shards // MOST_TASKS)
    dealt = rows.mapInArrow(run, SEQUENCE).repartitionById(-(-shards // each), F.floor(F.col("shard") / each).cast("int"))
    return dealt.sortWithinPartitions("place")


def write_shards(seqs: DataFrame, folder: str, width: int = 2, seq_len: int = SEQ_LEN, pad: int = 0) -> DataFrame:
    """Writes shard files of fixed-stride records into ``folder``, one that all executors share; a row per record.

    A file appears under its name only when whole, and its rows only after it, so tasks may be run
    again; the same shard always has the same bytes.
    """
    padding = np.full(seq_len, pad, f"<u{width}").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        shard, out, name, digest, each, rows = None, None, "", None, [], []

        def close() -> pa.RecordBatch:
            out.close()
            store.move(name, f"{root}/shard-{shard:06d}.bin")
            table = pa.Table.from_batches(rows).combine_chunks()
            n = len(each)
            columns = [table.column(c).combine_chunks() for c in ("doc_ids", "first_token", "n_tokens")]
            return pa.RecordBatch.from_arrays([pa.array([shard] * n, pa.int32()), pa.array(range(n), pa.int64()), *columns, pa.array(each), pa.array([digest.hexdigest()] * n)], names=["shard", "number", "doc_ids", "first_token", "n_tokens", "record_sha256", "shard_sha256"])

        for batch in batches:
            shards = batch.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(shards[1:] != shards[:-1]) + 1).tolist(), len(shards)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if out is not None and shards[a] != shard:
                    yield close()
                    out = None
                if out is None:
                    shard, digest, each, rows = int(shards[a]), hashlib.sha256(), [], []
                    store.create_dir(root, recursive=True)
                    name = f"{root}/.shard-{shard:06d}.{TaskContext.get().taskAttemptId()}"
                    out = store.open_output_stream(name)
                part = batch.slice(a, b - a)
                for body in part.column("body").to_pylist():
                    record = body + padding[len(body) :]
                    out.write(record)
                    digest.update(record)
                    each.append(hashlib.sha256(record).hexdigest())
                rows.append(part.select(["doc_ids", "first_token", "n_tokens"]))
        if out is not None:
            yield close()

    return seqs.mapInArrow(run, "shard int, number bigint, doc_ids array<bigint>, first_token bigint, n_tokens int, record_sha256 string, shard_sha256 string")


def manifest(written: DataFrame, block: int = 1024) -> DataFrame:
    """Per shard its first slot, number of records and digest. Sums go over blocks of shards first: one row per block reaches the driver."""
    shards = written.groupBy("shard").agg(F.count(F.lit(1)).alias("n_records"), F.min("shard_sha256").alias("shard_sha256")).withColumn("block", F.floor(F.col("shard") / block))
    at, firsts = 0, []
    for b, n in sorted(shards.groupBy("block").agg(F.sum("n_records")).collect()):
        firsts.append((b, at))
        at += n
    starts = written.sparkSession.createDataFrame(firsts, "block bigint, at bigint")
    before = F.sum("n_records").over(W.partitionBy("block").orderBy("shard")) - F.col("n_records")
    return shards.join(F.broadcast(starts), "block").select("shard", (F.col("at") + before).alias("first_slot"), "n_records", "shard_sha256")


def read_from(folder: str, slot: int, seq_len: int = SEQ_LEN, width: int = 2) -> Iterator[np.ndarray]:
    """The records from ``slot`` on, in training order."""
    stride = seq_len * width
    store, root = fs.FileSystem.from_uri(folder)
    table = pq.read_table(f"{root}/manifest", filesystem=store, columns=["shard", "first_slot", "n_records"]).sort_by("first_slot")
    for shard, first, n in zip(*(table.column(c).to_pylist() for c in table.column_names), strict=True):
        if first + n <= slot:
            continue
        with store.open_input_file(f"{root}/shard-{shard:06d}.bin") as f:
            f.seek(max(0, slot - first) * stride)
            while raw := f.read(stride):
                yield np.frombuffer(raw, f"<u{width}")


_workers: dict[str, object] = {}


def worker_encoder(source: bytes) -> Callable[[str], np.ndarray]:
    """This Python worker's encoder of ordinary text by ranks (lines of base64 and rank): it lives from task to task."""
    key = hashlib.sha256(source).hexdigest()
    if key not in _workers:
        import tiktoken

        _workers.clear()
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, source.splitlines())}
        encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        _workers[key] = lambda text: np.array(encode(text), np.uint32)
    return _workers[key]


def vocabulary_marks(source: bytes) -> tuple[int, int, int]:
    """Bytes an id takes, end mark and padding: the two ids after the vocabulary's last."""
    n = 1 + max(int(line.split()[1]) for line in source.splitlines())
    return (2 if n + 1 < 1 << 16 else 4), n, n + 1


def materialise(df: DataFrame, vocabulary_path: str, folder: str, text: str = "text", doc: str = "doc_id", seq_len: int = SEQ_LEN, per_shard: int = PER_SHARD, key: int = KEY, scan: bool = False) -> DataFrame:
    """Texts to shard files and their manifest in ``folder``; a row per slot with its digest and its shard's."""
    with open(vocabulary_path, "rb") as f:
        source = f.read()
    width, end, pad = vocabulary_marks(source)
    packed = df.sparkSession.sparkContext.broadcast(source)  # a vocabulary file: some MB at any size of the data
    seqs = sequences(df, lambda: worker_encoder(packed.value), end, width, text, doc, seq_len, per_shard, key, scan)
    written = Stored(df.sparkSession).keep(write_shards(seqs, folder, width, seq_len, pad))
    manifest(written).write.parquet(f"{folder}/manifest")
    firsts = df.sparkSession.read.schema("shard int, first_slot bigint, n_records bigint, shard_sha256 string").parquet(f"{folder}/manifest")
    out = written.join(firsts.select("shard", "first_slot"), "shard")
    return out.select((F.col("first_slot") + F.col("number")).alias("slot"), "shard", (F.col("number") * seq_len * width).alias("offset"), "doc_ids", "first_token", "n_tokens", "record_sha256", "shard_sha256")


def vocabulary_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/tracewright-shards-{uuid.uuid4().hex}"
    return materialise(load(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary_file(), folder, scan=True)


#: Files and digests are beyond SQL; the test reads the shards back and compares with the library.
ORACLE = None
