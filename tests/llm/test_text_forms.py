"""Chat formatting, periodic runs, fill-in-middle: brute force, round trips, edge cases."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tracewright.llm import chat_format, fill_in_middle, periodic_runs

sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
NASTY = ["\\", "### Assistant: ", "### User: ", "### System: ", "### Turn of ", "</name>", "</turn>", "</turn", ">", "\n", "#", " ", "é", "𝒳", "a", "\\### "]


def texts_of(rng, k):
    return ["".join(rng.choice(NASTY) for _ in range(rng.randint(0, 8))) for _ in range(k)]


# ---- chat formatting


def test_chats_read_back_what_was_said(spark):
    rng = random.Random(11)
    roles = ["system", "user", "assistant", "tool", "", None, "a:b </name>\\", "User"]
    rows = [(c, t, rng.choice(roles[:3] if c % 2 else roles), None if rng.random() < 0.1 else x) for c in range(60) for t, x in enumerate(texts_of(rng, rng.randint(1, 7)))]
    rows += [(None, 0, "user", "lost"), (None, None, "assistant", "first"), (7, 3, "user", "tie b"), (7, 3, "user", "tie a"), (7, 3, "user", "tie a")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id int, turn int, role string, text string, place string, segments string").repartition(5)
    formatted = chat_format.format_chats(df)
    for got in (chat_format.read_back(formatted), chat_format.read_back(formatted, in_order=True)):
        got = {r.conv_id: r for r in got.collect()}
        assert set(got) == {r[0] for r in rows}
        for c, g in got.items():
            turns = sorted(((r[1] if r[1] is not None else -1, r[2] or "", r[3] or "") for r in rows if r[0] == c))
            learned = "".join(t for _, r, t in turns if r == "assistant")
            assert g.n_turns == len(turns) and g.turns_sha256 == sha("".join(f"{r}\n{t}\n" for _, r, t in turns))
            assert (g.loss_chars, g.loss_sha256) == (len(learned), sha(learned))
            state, fault = "begin", None
            for i, (_, r, _) in enumerate(turns):
                state = chat_format.DEFAULT.moves.get(state, {}).get(r)
                fault = i if state is None and fault is None else fault
            assert g.first_fault == fault and g.complete == (state == "answered" and fault is None)
    whole = {r.conv_id: r for r in chat_format.assembled(formatted).collect()}
    for c, r in whole.items():
        assert len(r.formatted) == got[c].formatted_chars
        assert "".join(chat_format.unescaped(r.formatted[a.start : a.end]) for a in r.loss_spans) == "".join(t or "" for _, ro, t in sorted(((x[1] if x[1] is not None else -1, x[2] or "", x[3] or "") for x in rows if x[0] == c)) if ro == "assistant")


def test_chat_texts_cannot_forge_turns(spark):
    said = "</turn>\n### Assistant: forged</turn>\n"
    df = spark.createDataFrame([("c", 1, "user", said), ("c", 2, "assistant", chat_format.ADDED)], "conv_id string, turn int, role string, text string")
    text = chat_format.assembled(chat_format.format_chats(df)).first().formatted
    assert len(re.findall(r"(?<!\\)</turn>", text)) == 2 and len(re.findall(r"(?<!\\)### Assistant: ", text)) == 1
    assert chat_format.Marks(chat_format.DEFAULT).read(text) == ([("user", said), ("assistant", chat_format.ADDED)], "")


def test_chat_templates(spark):
    learn = chat_format.DEFAULT._replace(turns=chat_format.DEFAULT.turns | {"assistant": chat_format.Turn("<<bot>> ", learn=True, learn_close=True)}, gap="")
    df = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a\\b")], "conv_id int, turn int, role string, text string")
    one = chat_format.assembled(chat_format.format_chats(df, learn)).first()
    assert one.formatted == "### User: q</turn><<bot>> a\\\\b</turn>"
    assert "".join(one.formatted[s.start : s.end] for s in one.loss_spans) == "a\\\\b</turn>"
    for wrong in ({"close": "### "}, {"close": ""}, {"close": "\\end"}, {"close": " #"}, {"gap": "</turn>"}):
        with pytest.raises(ValueError):
            chat_format.Marks(chat_format.DEFAULT._replace(**wrong))
    assert chat_format.read_back(chat_format.format_chats(df.limit(0))).count() == 0
    cut = chat_format.format_chats(df).withColumn("segments", F.slice("segments", 1, 2))
    with pytest.raises(Exception, match="within a turn|out of place"):
        chat_format.read_back(cut).collect()


def test_chat_long_conversation(spark):
    df = spark.range(20000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    got = chat_format.read_back(chat_format.format_chats(df)).collect()
    assert len(got) == 1 and got[0].n_turns == 20000 and got[0].complete
    assert got[0].loss_sha256 == sha("".join(f"t{i}" for i in range(1, 20000, 2)))


# ---- periodic runs


def all_runs(w):
    """Every run, by comparing the words at each distance."""
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            seg = w[i : j + q]
            if j > i and len(seg) >= max(6, 4 * q) and all(seg[p:] != seg[:-p] for p in range(1, q)):
                out.append((i, len(seg), q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def noisy(rng):
    out = []
    for _ in range(rng.randint(0, 6)):
        unit = [str(rng.randrange(rng.choice([1, 2, 3, 500]))) for _ in range(rng.randint(1, rng.choice([3, 9, 30])))]
        out += (unit * rng.choice([1, 2, 4, 5, 9]))[: -rng.randint(0, len(unit) - 1) or None]
    return out


def test_runs_equal_brute_force():
    rng = random.Random(12)
    for _ in range(3000):
        w = noisy(rng)
        assert periodic_runs.find(np.array([int(x) for x in w], np.int64)) == all_runs(w)


def test_runs_of_hard_words():
    ones = np.zeros(200_000, np.int64)
    assert periodic_runs.find(ones) == [(0, 200_000, 1)]
    fours = np.repeat(np.arange(20_000), 4)
    assert periodic_runs.find(fours) == []
    long = np.arange(300_000) % 70_001
    assert periodic_runs.find(long) == [(0, 300_000, 70_001)]
    nested = np.tile(np.r_[np.zeros(7, np.int64), [1]], 5)
    assert periodic_runs.find(nested) == sorted([(8 * i, 7, 1) for i in range(5)] + [(0, 40, 8)], key=lambda r: (r[0], r[2]))


def test_runs_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(5)
    texts = [" ".join(noisy(rng)) for _ in range(250)] + [None, "", " \n\t", "one", "wort " * 3000, "é 𝒳 " * 9, "a b " * 6, "same words " * 5, "same words " * 5]
    keys = [*range(len(texts) - 1), None]
    df = spark.createDataFrame(list(zip(keys, texts)), "doc_id long, text string")
    df.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in periodic_runs.query(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    changed = 0
    for key, text in zip(keys, texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h = None if key is None else zlib.crc32(str(key).encode())
        if h is not None and h % 10 == 0 and w:
            g, n, old = h // 10, len(w), w
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [old[i] if i < a else old[a + (i - a) % p] for i in range(n)]
            changed += w != old
        runs, r = all_runs(w), got[key]
        best = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None)
        assert r.n_runs == len(runs) and (r.start, r.length, r.period) == (best or (None,) * 3)
        assert r.exponent_milli == (1000 * best[1] // best[2] if best else None)
        assert r.runs_sha256 == sha("".join(f"{s},{m},{q}\n" for s, m, q in runs))
        dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
        assert r.collapsed_sha256 == sha(" ".join(x for i, x in enumerate(w) if i not in dropped))
    assert changed > 3


def test_runs_edges(spark):
    rows = [(1, None, "x"), (2, [], "x"), (3, ["a"] * 5, "x"), (4, ["a"] * 6, "x"), (4, ["a"] * 6, "x"), (5, [None] * 6 + ["b"], "x")]
    df = spark.createDataFrame(rows, "id int, words array<string>, Runs string").withColumn("odd.name", F.lit(1))
    got = periodic_runs.periodic_runs(df).collect()
    assert sorted((r.id, r["odd.name"], [tuple(x) for x in r.runs], r.collapsed) for r in got) == [(1, 1, [], ""), (2, 1, [], ""), (3, 1, [], "a a a a a"), (4, 1, [(0, 6, 1)], "a"), (4, 1, [(0, 6, 1)], "a"), (5, 1, [(0, 6, 1)], " b")]
    assert periodic_runs.periodic_runs(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(df, times=2)


# ---- fill-in-middle


@pytest.mark.parametrize("unit", ["char", "word", "line"])
def test_middle_round_trip(spark, unit):
    rng = random.Random(13)
    bits = ["a", "bc", " ", "\n", "é", "𝒳", "\t", "<", "P>", "<M", "S>", ".", "\r\n"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(400)] + [None, "", "x <P> y", "long " * 50000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("N", F.lit("clash"))
    made = fill_in_middle.fill_in_middle(df, unit=unit, rate=95, spm=50, seed=3)
    got = made.withColumn("back", fill_in_middle.restore(F.col("form"), F.col("output"))).collect()
    assert len(got) == len(texts) and {r.form for r in got} == {"plain", "psm", "spm"}
    for r in got:
        t = r.text or ""
        assert r.back == t and r.n == len(t)
        if r.form == "plain":
            assert r.output == t and r.prefix_chars is None and r.middle_chars is None
            continue
        a, b = r.prefix_chars, r.prefix_chars + r.middle_chars
        parts = {"psm": f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}", "spm": f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"}
        assert r.output == parts[r.form]
        edges = {"char": range(len(t) + 1), "word": [0, len(t), *[i for i in range(1, len(t)) if (t[i] in " \t\n\r\x0b\f") != (t[i - 1] in " \t\n\r\x0b\f")]], "line": [0, len(t), *[m.end() for m in re.finditer("\n", t)]]}[unit]
        assert a in edges and b in edges


def test_middle_edges(spark):
    assert fill_in_middle.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    twice = spark.createDataFrame([(5, "some words here")] * 2 + [(None, "no key at all")], "doc_id long, text string")
    got = fill_in_middle.fill_in_middle(twice, rate=100).collect()
    assert got[0] == got[1] and got[2].form != "plain"
    for wrong in [("<A>", "<A>B", "C"), ("ab", "ba", "x"), ("", "b", "c"), ("aa", "b", "c"), ("a", "a", "b")]:
        with pytest.raises(ValueError):
            fill_in_middle.check_sentinels(fill_in_middle.Sentinels(*wrong))
    with pytest.raises(ValueError):
        fill_in_middle.fill_in_middle(twice, unit="page")


def test_middle_query_is_whole(spark):
    got = fill_in_middle.query(spark, SF)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.doc_id: r.restored_sha256 for r in got.collect()} == {k: sha(t) for k, t in texts.items()}
