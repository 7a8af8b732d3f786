"""Quality rules (native): a rule bitmask ledger.

``ledger`` measures each text once and evaluates every rule once: ``fail_bits`` has bit i set
where rule i fails. Policies are versioned masks over those bits, so changing a policy,
or asking what one rule alone rejects, reads the ledger and never the texts again
(``ablation`` folds the ledger to one row per distinct mask before anything else).

All measurements are array and string functions within a row: no shuffle, and no row's cost depends on
another's. Repeated 3-word windows are found from sorted 64-bit window hashes of the one
text (two different windows of one text of a million words share a hash with a chance of 3e-8).

Defined results
  null or empty text: all measurements 0; rule ``few_words`` fails.
  a text with fewer than three words has no window. Lines without a word are no lines.
  repeated rows are judged alike; an empty table gives an empty ledger. Very long texts: measured whole, n log n in their words.
  Extra columns pass through; columns named like a measurement, or fail_bits, are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.common import fresh, kept_columns, let, load, quoted

#: White space of the contract: \x20 \x09-\x0D; fixed values.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

#: Rule i fails where its expression holds; its bit is 1 << i. Append only: policies name bits.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("repeated_lines", "3 * n_dup_lines > n_lines and n_dup_lines >= 3"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_windows"]

#: Policy versions: the mask of rules that reject.
POLICIES = {1: BASE, 2: BASE | BIT["symbols"] | BIT["short_words"] | BIT["long_words"], 3: (1 << len(RULES)) - 1}
POLICY = 3


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES)), " "), "")


def repeat_words(w: Column) -> Column:
    """How many words lie in 3-word windows that occur twice or more. ``w``: a bound array."""
    n = F.size(w)
    hashes = F.transform(F.slice(w, 1, n - 2), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))

    def covered(h: Column) -> Column:
        by_hash = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        again = let(
            by_hash,
            lambda s: F.filter(s, lambda x, i: F.coalesce(F.when(i > 0, F.get(s, i - 1)["h"] == x["h"]), F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))),
        )
        starts = F.transform(again, lambda x: x["i"])
        return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2)))))

    return F.when(n < 3, F.lit(0)).otherwise(let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))))


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    m = F.struct(
        let(words(F.col(text)), lambda w: F.struct(F.size(w).alias("n"), repeat_words(w).alias("r"))).alias("w"),
        F.length(F.translate(t, SPACES, "")).alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d"))).alias("l"),
    )
    got = {"n_words": "w.n", "word_chars": "word_chars", "n_symbols": "n_symbols", "n_dup_lines": "l.d", "n_repeat_words": "w.r", "n_lines": "l.n"}
    rest = kept_columns(df, list(got))
    (name,) = fresh(rest, "measures")
    return df.select(*map(quoted, rest), m.alias(name)).select(*map(quoted, rest), *[F.col(f"{name}.{v}").cast("bigint").alias(k) for k, v in got.items()])


def ledger(df: DataFrame, text: str = "text", rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """``df`` with the measurements and ``fail_bits``."""
    bits = F.lit(0).cast("bigint")
    for i, (_, fails) in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint"))
    return measure(df.drop("fail_bits"), text).withColumn("fail_bits", bits)


def kept(mask: int = POLICIES[POLICY]) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(mask).cast("bigint")) == 0


def ablation(book: DataFrame, mask: int = POLICIES[POLICY], rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """Per rule of the policy: rows it fails, rows that only it rejects, and rows kept without it."""
    by_mask = book.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask).cast("bigint")).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    of = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << i).cast("bigint").alias("bit")) for i, (name, _) in enumerate(rules) if mask >> i & 1])).alias("r")
    x = by_mask.select("b", "n", of).select("b", "n", "r.rule", "r.bit")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("bigint")
    return x.groupBy("rule", "bit").agg(
        total(F.col("b").bitwiseAND(F.col("bit")) != 0).alias("failed"),
        total(F.col("b") == F.col("bit")).alias("only"),
        total(F.col("b").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0).alias("kept_without"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = ledger(load(spark, sf_dir, "documents").select("doc_id", "text"))
    base_failed = F.col("fail_bits").bitwiseAND(F.lit(BASE).cast("bigint")) != 0
    return book.select("doc_id", *MEASURES, base_failed.alias("base_failed"), kept().alias("kept"), "n_lines", "fail_bits")


def ablation_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the current policy rejects, alone and with others, over all documents."""
    return ablation(ledger(load(spark, sf_dir, "documents").select("doc_id", "text")))


ORACLE = r"""
with d as (select doc_id, coalesce(text, '') as t from documents),
s as (select *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from d),
p as (select doc_id, unnest(w) as x, generate_subscripts(w, 1) as i from s),
t as (select doc_id, i, x, lead(x) over v as y, lead(x, 2) over v as z from p window v as (partition by doc_id order by i)),
g2 as (select doc_id, i, count(*) over (partition by doc_id, x, y, z) as c from t where z is not null),
r as (select doc_id, count(distinct p) as n_repeat from (select doc_id, unnest([i, i+1, i+2]) as p from g2 where c > 1) group by doc_id),
m as (select s.doc_id, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
      (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines,
      coalesce(n_repeat, 0)::bigint as n_repeat_words, len(l)::bigint as n_lines from s left join r using (doc_id)),
b as (select *, (case when n_words < 50 then 1 else 0 end + case when 100 * n_repeat_words > 50 * n_words then 2 else 0 end
      + case when 10 * n_symbols > n_words then 4 else 0 end + case when word_chars < 2 * n_words then 8 else 0 end
      + case when word_chars > 20 * n_words then 16 else 0 end + case when 3 * n_dup_lines > n_lines and n_dup_lines >= 3 then 32 else 0 end)::bigint as fail_bits from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 as base_failed, fail_bits = 0 as kept, n_lines, fail_bits from b
"""

ABLATION_ORACLE = f"""
with l as ({ORACLE}), r(rule, bit) as (values ('few_words', 1), ('repeated_windows', 2), ('symbols', 4), ('short_words', 8), ('long_words', 16), ('repeated_lines', 32))
select rule, bit::bigint as bit, count(*) filter (fail_bits & bit <> 0) as failed, count(*) filter (fail_bits = bit) as "only", count(*) filter (fail_bits - (fail_bits & bit) = 0) as kept_without from l, r group by rule, bit
"""
