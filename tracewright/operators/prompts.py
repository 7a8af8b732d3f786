"""Chat messages as a model's text: turns in a template, prompts with completions, and a check of their tokens.

A template is a pair of format strings around a turn's role and content and what opens the model's own turn; a model's
own one can be given. Null contents count as empty; a call without content shows its name and arguments.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.text import estimate_tokens


class Template(NamedTuple):
    """``turn`` takes role and content; ``preamble`` stands before the first turn, the tools' schema for instance."""

    turn: str = "<|im_start|>%s\n%s<|im_end|>\n"
    opening: str = "<|im_start|>assistant\n"
    preamble: str = ""


def turn_text(template: Template, role: Column, content: Column, tool: Column, arguments: Column) -> Column:
    empty = lambda c: F.coalesce(c, F.lit(""))
    call = F.when(arguments.isNotNull(), F.concat(F.lit('<tool_call>\n{"name": "'), empty(tool), F.lit('", "arguments": '), arguments, F.lit("}\n</tool_call>")))
    said = F.when(empty(content) == "", F.coalesce(call, F.lit(""))).otherwise(F.concat_ws("\n", content, call))
    return F.format_string(template.turn, role, said)


def rendered(messages: DataFrame, by: list[str], order: str = "idx", template: Template = Template()) -> DataFrame:
    """All turns of a group in order, as one text."""
    one = F.struct(order, turn_text(template, *map(F.col, ("role", "content", "tool", "arguments"))).alias("_t"))
    return messages.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["_t"]), "").alias("rendered"))


def prompt_and_completion(messages: DataFrame, by: list[str], part: str = "part", order: str = "idx", template: Template = Template()) -> DataFrame:
    """``part`` tells context ('prompt') from what is learned ('completion'); the prompt ends with the opening of the model's turn,
    which the completion, then, does not repeat."""
    text = {p: rendered(messages.where(F.col(part) == p), by, order, template).withColumnRenamed("rendered", p) for p in ("prompt", "completion")}
    both = text["completion"].join(text["prompt"], by, "left")
    rest = F.when(F.startswith("completion", F.lit(template.opening)), F.substr("completion", F.lit(len(template.opening) + 1))).otherwise(F.col("completion"))
    return both.select(*by, F.concat(F.coalesce("prompt", F.lit("")), F.lit(template.opening)).alias("prompt"), rest.alias("completion"))


def goal_fits(content: Column, most: int = 2048, count: Callable[[Column], Column] = estimate_tokens) -> Column:
    """A first message too long for its share is a reason to leave the session out, not to cut it."""
    return count(F.coalesce(content, F.lit(""))) <= most


def tokenizer_count(vocabulary: str) -> Callable[[Column], Column]:
    """A count of tokens by a tokenizers file, for ``goal_fits`` and for the cost of chunks: one call a batch of texts; null has none.

    ``vocabulary`` is the file's content, so executors need no folder of the driver's.
    """

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([len(e.ids) for e in _tokenizer(vocabulary).encode_batch(texts.fillna("").astype(str).tolist(), add_special_tokens=False)], dtype="int64")

    return count


@lru_cache(maxsize=2)
def _tokenizer(vocabulary: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(vocabulary)
    t.no_truncation()
    t.no_padding()
    return t


def token_check(texts: DataFrame, vocabulary: str, column: str = "rendered", least: float = 0.9) -> DataFrame:
    """Tokens of each text by a tokenizers file, and whether their decoding keeps ``least`` of its characters; null has none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = _tokenizer(vocabulary)
        for f in frames:
            text = f[column].fillna("").astype(str).tolist()
            ids = [e.ids for e in t.encode_batch(text, add_special_tokens=False)]
            back = t.decode_batch(ids, skip_special_tokens=False)
            yield f.drop(columns=column).assign(n_tokens=[len(x) for x in ids], whole=[len(b) >= least * len(a) for a, b in zip(text, back)])

    keys = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in texts.schema if x.name != column)
    return texts.mapInPandas(run, f"{keys}, n_tokens bigint, whole boolean")
