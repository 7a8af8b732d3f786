"""Fill-in-middle transformation: texts are cut in three and written with the middle last, and put together again.

A text is decoded to an array of its code points (UTF-32, numpy). Every code point has a class that depends on the
unit to cut by; where neighbouring classes differ lies a boundary (``flatnonzero``). A hash of the seed and the row's
key chooses two boundaries by rank, whether the text is transformed at all, and in which order its pieces come; so a
text's form depends on nothing but its row. The array is sliced there and the pieces are encoded again.

Units: ``char``, every code point; ``word``, words and the white space between them; ``line``, lines with their ends.

Forms: ``psm`` is prefix, suffix, middle; ``spm`` is suffix, prefix, middle, each after its sentinel; ``plain`` is the
text as it is. A text that holds a sentinel is plain, so the sentinels of an output mark its pieces without doubt;
``restore`` splits there. One pass over the rows, no shuffle; a task holds one batch.

Defined results
  null or empty text: plain, with empty output. Null key: hashed as the empty string.
  invalid UTF-8: replaced as Spark's ``make_valid_utf8`` does. Very long texts: whole, four bytes a code point.
  Repeated rows and equal keys: transformed alike; there are no ties. Empty table: empty result.
  Extra columns pass through; columns named like an output, in any case, are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm.common import kept_columns, load, map_arrow, quoted, small_batches

SPACES = np.array([9, 10, 11, 12, 13, 32], np.uint32)
OUTPUTS = [("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType()), ("output", T.StringType())]


class Sentinels(NamedTuple):
    """What stands before each piece."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"


def check_sentinels(marks: Sentinels) -> None:
    """No sentinel may begin inside another, or a piece beside one could seem to hold one."""
    for i, a in enumerate(marks):
        for j, b in enumerate(marks):
            overlap = any(a[k:] == b[: len(a) - k] for k in range(1, len(a))) or (i != j and a in b)
            if not a or overlap:
                raise ValueError(f"sentinels overlap: {a!r}, {b!r}")


def classes(points: np.ndarray, unit: str) -> np.ndarray:
    """A class for every code point; a unit ends where the next code point's class is another."""
    if unit == "char":
        return np.arange(len(points))
    if unit == "word":
        return np.isin(points, SPACES)
    if unit == "line":
        return np.cumsum(points == 10) - (points == 10)
    raise ValueError(f"unknown unit {unit!r}")


def cuts(points: np.ndarray, unit: str) -> np.ndarray:
    """Where a text can be cut: its begin, every boundary, its end."""
    kind = classes(points, unit)
    inner = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    return np.concatenate([[0], inner, [len(points)]]) if len(points) else np.zeros(1, np.int64)


def transform_text(text: str, key: str, unit: str, rate: int, spm: int, seed: int, marks: Sentinels) -> tuple[int, str, int | None, int | None, str]:
    """n, form, code points of prefix and middle, output."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    if not text or any(m in text for m in marks) or h3 % 100 >= rate:
        return len(points), "plain", None, None, text
    at = cuts(points, unit)
    ranks = np.sort([h1 % len(at), h2 % len(at)])
    first, second = at[ranks]
    prefix, middle, suffix = (x.tobytes().decode("utf-32-le") for x in (points[:first], points[first:second], points[second:]))
    if h4 % 100 < spm:
        form, out = "spm", marks.suffix + suffix + marks.prefix + prefix + marks.middle + middle
    else:
        form, out = "psm", marks.prefix + prefix + marks.suffix + suffix + marks.middle + middle
    return len(points), form, int(first), int(second - first), out


def fill_in_middle(df: DataFrame, key: str = "doc_id", text: str = "text", unit: str = "char", rate: int = 90, spm: int = 20, seed: int = 1, marks: Sentinels = Sentinels()) -> DataFrame:
    """``df`` with n (code points), form, prefix_chars, middle_chars (null if plain) and output.

    ``rate`` of a hundred texts are transformed, ``spm`` of a hundred of those have their suffix first.
    """
    check_sentinels(marks)
    classes(np.zeros(0, np.uint32), unit)
    small_batches(df.sparkSession)
    keep = kept_columns(df, [name for name, _ in OUTPUTS])
    rows = df.select(*map(quoted, keep), F.coalesce(quoted(key).cast("string"), F.lit("")), F.make_valid_utf8(F.coalesce(quoted(text), F.lit(""))))
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(name, kind) for name, kind in OUTPUTS])
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *others, keys, texts = batch.columns
            made = [transform_text(t, k, unit, rate, spm, seed, marks) for k, t in zip(keys.to_pylist(), texts.to_pylist(), strict=True)]
            columns = zip(*made, strict=True) if made else [[] for _ in kinds]
            out = [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*others, *out], names=[f"c{i}" for i in range(len(schema))])

    return map_arrow(rows, run, schema)


def restore(form: Column, output: Column, marks: Sentinels = Sentinels()) -> Column:
    """The text that ``output`` was made of."""
    part = lambda whole, mark, n: F.split_part(whole, F.lit(mark), F.lit(n))
    middle, rest = part(output, marks.middle, 2), part(output, marks.middle, 1)
    psm = F.concat(part(part(rest, marks.suffix, 1), marks.prefix, 2), middle, part(rest, marks.suffix, 2))
    spm = F.concat(part(rest, marks.prefix, 2), middle, part(part(rest, marks.prefix, 1), marks.suffix, 2))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(load(spark, sf_dir, "documents").select("doc_id", "text"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restore(F.col("form"), F.col("output"))).alias("restored_sha256"))


ORACLE = """
with d as (select doc_id, coalesce(text, '') as t, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents),
x as (select doc_id, t, length(t) as n, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from d),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
  case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from x),
p as (select *, substr(t, 1, a) as pre, substr(t, a + 1, b - a) as mid, substr(t, b + 1) as suf from c)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
  sha256(t) as restored_sha256
from p
"""
