"""License scans: sentences to known licence-sentence identifiers, identifier sequences to ordered rules.

A text is cut into sentences, at blank lines, at sentence ends (not in ``v. 2`` or before ``either
version``) and before lines that start a notice or a numbered item; other newlines are spaces, so
hard-wrapped notices are whole. Sentences are normalised (lower case, punctuation and white space to
single spaces). One pattern finds all known phrases of a sentence, from left to right and specific ones first, and a
table gives each its identifier; so a sentence that names several licences has them all. SPDX lines are read as expressions, by
token: identifiers joined by OR, AND and WITH (an exception). Other sentences leave no trace, so any prose may stand
between. Rules are tried in order on the sequence of identifiers; a rule uses up the identifiers it names, nearest ones
first, again until it no longer fits, so a specific licence hides the general sentence it contains and no other.

Only texts, and of them only sentences, that hold one of a few plain words are looked at. All of it is array and string functions
within a row: no shuffle.

Defined results
  null or empty text: no sentences, no licences, verdict ``none``.
  verdict ``restricted``: a licence that is not permissive, also as one of a choice; ``unknown``: known phrases without a rule
  alone, or a licence named by an SPDX line or a Creative Commons name that is not in the tables; ``permissive``: all others.
  A licence that a text says it is not under counts as a known phrase without a rule. Several licences: listed in rule order.
  very long texts: scanned whole. Repeated rows: alike. Empty table: empty result.
  Extra columns pass through; columns named like an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.common import let, load, lower_ascii

#: Plain words of which each known phrase has one; fixed values, as all tables of this module.
PROBES = ["licen", "gpl", "copyright", "spdx", "permission", "warrant", "redistribution", "endorse", "creative", "attribution", "cc0", "domain", "reserved", "released", "distributed"]
CC_BY = r"\bcc[^a-z0-9]+by\b"
NAMED = r"(?:under|or|and)(?: the)?(?: terms of(?: the)?)?(?: either(?: of)?)?(?: the)?"
VERSION = r"(?: as published by (?:[a-z]+ ){1,10}?(?:either )?| )(?:version |v )?"
#: Identifier and pattern of known phrases, on normalised sentences; of those that begin at one place the first counts.
SENTENCES: list[tuple[str, str]] = [
    ("Denied", r"not (?:released|licensed|distributed|available|offered) under(?: the)?(?: terms of(?: the)?)? (?:mit|expat|isc|apache|bsd|mozilla public|gnu (?:lesser |affero )?general public) licen[cs]e"),
    ("Apache2Comply", r"you may not use this file except in compliance with the license"),
    ("AsIsBasis", r"distributed under the license is distributed on an as is basis"),
    ("Apache2Ref", NAMED + r" apache licen[cs]e (?:version |v )?2\b"),
    ("MitRef", NAMED + r" (?:mit|expat) licen[cs]e"),
    ("IscRef", NAMED + r" isc licen[cs]e"),
    ("Bsd3Ref", NAMED + r" (?:3 clause bsd|bsd 3 clause|new bsd|modified bsd|revised bsd) licen[cs]e"),
    ("Bsd2Ref", NAMED + r" (?:2 clause bsd|bsd 2 clause|simplified bsd|freebsd) licen[cs]e"),
    ("MitGrant", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("MitKeep", r"the above copyright notice and this permission notice shall be included"),
    ("AsIsMit", r"the software is provided as is without warranty of any kind"),
    ("LgplRef", r"(?:gnu )?lesser general public licen[cs]e|\blgpl\b|\blgplv[0-9]"),
    ("AgplRef", r"(?:gnu )?affero general public licen[cs]e|\bagpl\b|\bagplv[0-9]"),
    ("Gpl3Ref", r"(?:gnu )?general public licen[cs]e" + VERSION + r"3\b|\bgpl (?:version |v )?3\b|\bgpl ?v3\b"),
    ("Gpl2Ref", r"(?:gnu )?general public licen[cs]e" + VERSION + r"2\b|\bgpl (?:version |v )?2\b|\bgpl ?v2\b"),
    ("GplRef", r"gnu general public licen[cs]e|\bgpl\b"),
    ("BsdUse", r"redistribution and use in source and binary forms"),
    ("BsdNotice", r"redistributions of source code must retain the above copyright notice"),
    ("BsdBinary", r"redistributions in binary form must reproduce the above copyright notice"),
    ("BsdNoEndorse", r"neither the name of .* may be used to endorse"),
    ("CcByNcNd4", r"\bcc by nc nd 4 0\b|attribution noncommercial noderivatives 4 0\b"),
    ("CcByNcSa4", r"\bcc by nc sa 4 0\b|attribution noncommercial sharealike 4 0\b"),
    ("CcByNc4", r"\bcc by nc 4 0\b|attribution noncommercial 4 0\b"),
    ("CcBySa4", r"\bcc by sa 4 0\b|attribution sharealike 4 0\b"),
    ("CcBy4", r"\bcc by 4 0\b|creative commons attribution 4 0\b"),
    ("CcOther", r"\bcc by\b|creative commons attribution\b"),
    ("Cc0", r"\bcc0 1 0\b|creative commons zero\b"),
    ("Mpl2Ref", r"mozilla public licen[cs]e(?: version| v)? 2\b"),
    ("PublicDomain", r"(?:released|placed|dedicated) (?:in|into|to) the public domain"),
    ("AllRights", r"all rights reserved"),
    ("Copyright", r"^copyright (?:c )?[0-9]{4}"),
    ("SomeLicense", r"(?:licensed|released|distributed) (?=under\b)"),
]
#: SPDX identifiers, lower case, by ours; those of GNU licences come with endings of their own.
SPDX = {"SpdxApache2": ["apache-2.0"], "SpdxMit": ["mit"], "SpdxIsc": ["isc"], "SpdxBsd2": ["bsd-2-clause"], "SpdxBsd3": ["bsd-3-clause"], "SpdxMpl2": ["mpl-2.0"], "SpdxCc0": ["cc0-1.0"], "SpdxUnlicense": ["unlicense"]}
SPDX |= {"CcBy4": ["cc-by-4.0"], "CcBySa4": ["cc-by-sa-4.0"], "CcByNc4": ["cc-by-nc-4.0"], "CcByNcSa4": ["cc-by-nc-sa-4.0"], "CcByNcNd4": ["cc-by-nc-nd-4.0"]}
SPDX |= {name: [v + end for v in versions for end in ("", "+", "-only", "-or-later")] for name, versions in {"SpdxGpl2": ["gpl-2.0"], "SpdxGpl3": ["gpl-3.0"], "SpdxLgpl": ["lgpl-2.0", "lgpl-2.1", "lgpl-3.0"], "SpdxAgpl3": ["agpl-3.0"]}.items()}
SPDX_TERM = r"(?:\([ \t]*)*[a-z0-9](?:[a-z0-9.+-]*[a-z0-9+])?(?:[ \t]*\))*"
SPDX_LINE = r"spdx-license-identifier:[ \t]*(" + SPDX_TERM + r"(?:[ \t]+(?:or|and|with)[ \t]+" + SPDX_TERM + r")*)"
#: Licence and the identifiers it is made of, in order, others between them allowed; "?" marks one that may be missing.
RULES: list[tuple[str, list[str]]] = [
    ("Apache-2.0", ["Apache2Ref", "Apache2Comply", "AsIsBasis?"]),
    ("Apache-2.0", ["Apache2Ref"]),
    ("Apache-2.0", ["SpdxApache2"]),
    ("MIT", ["MitGrant", "MitKeep", "AsIsMit?"]),
    ("MIT", ["MitRef"]),
    ("MIT", ["SpdxMit"]),
    ("ISC", ["IscRef"]),
    ("ISC", ["SpdxIsc"]),
    ("BSD-3-Clause", ["BsdUse", "BsdNotice", "BsdBinary", "BsdNoEndorse"]),
    ("BSD-2-Clause", ["BsdUse", "BsdNotice", "BsdBinary"]),
    ("BSD-3-Clause", ["Bsd3Ref"]),
    ("BSD-3-Clause", ["SpdxBsd3"]),
    ("BSD-2-Clause", ["Bsd2Ref"]),
    ("BSD-2-Clause", ["SpdxBsd2"]),
    ("AGPL-3.0", ["AgplRef"]),
    ("AGPL-3.0", ["SpdxAgpl3"]),
    ("LGPL", ["LgplRef"]),
    ("LGPL", ["SpdxLgpl"]),
    ("GPL-3.0", ["Gpl3Ref"]),
    ("GPL-3.0", ["SpdxGpl3"]),
    ("GPL-2.0", ["Gpl2Ref"]),
    ("GPL-2.0", ["SpdxGpl2"]),
    ("GPL", ["GplRef"]),
    ("CC-BY-NC-ND-4.0", ["CcByNcNd4"]),
    ("CC-BY-NC-SA-4.0", ["CcByNcSa4"]),
    ("CC-BY-NC-4.0", ["CcByNc4"]),
    ("CC-BY-SA-4.0", ["CcBySa4"]),
    ("CC-BY-4.0", ["CcBy4"]),
    ("CC0-1.0", ["Cc0"]),
    ("CC0-1.0", ["SpdxCc0"]),
    ("MPL-2.0", ["Mpl2Ref"]),
    ("MPL-2.0", ["SpdxMpl2"]),
    ("Unlicense", ["SpdxUnlicense"]),
    ("Public-Domain", ["PublicDomain"]),
]
PERMISSIVE = ["Apache-2.0", "MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-4.0", "CC0-1.0", "Unlicense", "Public-Domain"]
#: Names of licences that no rule knows.
UNKNOWN = ["SpdxOther", "CcOther"]
#: Blank lines (in comments, lines without letters and digits), lines that start a notice or item, sentence ends.
SENTENCE_CUT = (
    r"\n[^\p{L}\p{N}\n]*(?=\n)"
    r"|\n(?=[^\p{L}\p{N}\n]*(copyright[ \t]+(\(c\)|[0-9\x{a9}])|all rights reserved|spdx|permission is hereby|redistribution|neither the name|[0-9a-z]{1,2}[.)][ \t]))"
    r"|([!?]|;(?!\s+either version)|\.(?!(?<=\bv\.|\bver\.)\s+[0-9]))[ \t\r\n]+"
)
OTHER = r"[^a-z0-9]+"


def worth_a_look(text: Column) -> Column:
    """Whether a text in lower case holds what known phrases need."""
    out = F.contains(text, F.lit("cc")) & text.rlike(CC_BY)
    for probe in reversed(PROBES):
        out = F.contains(text, F.lit(probe)) | out
    return out


def phrases(sentence: Column) -> Column:
    """The identifiers of all known phrases of a normalised sentence, in text order; that it is under some licence counts only if none is known."""
    either = "|".join(p for _, p in SENTENCES)

    def named(hit: Column) -> Column:
        out = F.lit("SomeLicense")  # the one that is known by what follows it
        for name, pattern in reversed(SENTENCES[:-1]):
            out = F.when(hit.rlike(f"^(?:{pattern})$"), name).otherwise(out)
        return out

    ids = F.transform(F.regexp_extract_all(sentence, F.lit(f"(?:{either})"), F.lit(0)), named)
    return let(ids, lambda xs: F.filter(xs, lambda x: (x != "SomeLicense") | F.forall(xs, lambda y: y == "SomeLicense")))


def spdx_ids(sentence: Column) -> Column:
    """The identifiers of the SPDX expressions in a sentence as it stands, without exceptions."""
    table = F.create_map(*[F.lit(x) for name, tokens in SPDX.items() for t in tokens for x in (t, name)])
    tokens = F.regexp_extract_all(F.array_join(F.regexp_extract_all(sentence, F.lit(SPDX_LINE), F.lit(1)), " or "), F.lit(r"[a-z0-9.+-]+"), F.lit(0))
    known = let(tokens, lambda ts: F.filter(ts, lambda t, i: ~t.isin("or", "and", "with") & F.coalesce(F.get(ts, i - 1) != "with", F.lit(True))))
    ids = F.transform(known, lambda t: F.coalesce(F.try_element_at(table, t), F.lit("SpdxOther")))
    return F.when(F.contains(sentence, F.lit("spdx")), ids).otherwise(F.array().cast("array<string>"))


def sentence_ids(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    normal = lambda s: F.trim(F.regexp_replace(F.regexp_replace(s, SPDX_LINE, " "), OTHER, " "))
    sentences = lambda low: F.filter(F.split(low, SENTENCE_CUT), worth_a_look)
    ids = F.flatten(F.transform(sentences(lower_ascii(t)), lambda s: F.concat(spdx_ids(s), phrases(normal(s)))))
    return F.when(let(F.lower(t), worth_a_look), ids).otherwise(F.array().cast("array<string>"))


def licences(ids: Column) -> Column:
    """Licences found in the sequence, each once, in rule order."""
    state = F.struct(ids.alias("left"), F.array().cast("array<string>").alias("found"))
    for name, parts in RULES:
        state = _apply(state, name, parts)
    return F.array_distinct(state["found"])


def used(left: Column, parts: list[str]) -> Column:
    """Positions that all matches of a rule take: each identifier goes on with the latest match that waits for it."""
    none = F.array().cast("array<int>")
    needed = len([p for p in parts if not p.endswith("?")])
    # w0: matches with the first part, w1: with two, and so on, as positions; a match holds the last ones of its list
    begin = F.struct(F.lit(0).alias("at"), *[F.array().cast("array<array<int>>").alias(f"w{j}") for j in range(len(parts))])

    def step(acc: Column, x: Column) -> Column:
        out = [acc[f"w{j}"] for j in range(len(parts))]
        for j, p in enumerate(parts):
            hit = x == p.rstrip("?")
            if j == 0:
                out[0] = F.when(hit, F.concat(acc["w0"], F.array(F.array(acc["at"])))).otherwise(out[0])
            else:
                before = acc[f"w{j - 1}"]
                hit = hit & (F.size(before) > 0)
                out[j - 1] = F.when(hit, F.slice(before, 1, F.greatest(F.size(before) - 1, F.lit(0)))).otherwise(out[j - 1])
                out[j] = F.when(hit, F.concat(acc[f"w{j}"], F.array(F.concat(F.get(before, F.size(before) - 1), F.array(acc["at"]))))).otherwise(out[j])
        return F.struct((acc["at"] + 1).alias("at"), *[c.alias(f"w{j}") for j, c in enumerate(out)])

    done = lambda acc: F.flatten(F.concat(*[acc[f"w{j}"] for j in range(needed - 1, len(parts))]))
    fits = F.lit(True)
    for p in parts[:needed]:
        fits = fits & F.array_contains(left, p)
    return F.when(fits, F.aggregate(left, begin, step, done)).otherwise(none)


def _apply(state: Column, name: str, parts: list[str]) -> Column:
    def one(s: Column) -> Column:
        left = s["left"]
        taken = lambda u: F.struct(F.filter(left, lambda x, i: ~F.array_contains(u, i)).alias("left"), F.concat(s["found"], F.array(F.lit(name))).alias("found"))
        if len(parts) == 1:
            return F.when(F.array_contains(left, parts[0]), F.struct(F.filter(left, lambda x: x != parts[0]).alias("left"), F.concat(s["found"], F.array(F.lit(name))).alias("found"))).otherwise(s)
        return let(used(left, parts), lambda u: F.when(F.size(u) > 0, taken(u)).otherwise(s))

    return let(state, one)


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with sentence_ids, licences (arrays) and verdict: permissive, restricted, unknown or none."""
    out = df.withColumn("sentence_ids", sentence_ids(F.col(text)))
    out = out.withColumn("licences", F.when(F.size("sentence_ids") > 0, licences(F.col("sentence_ids"))).otherwise(F.array().cast("array<string>")))
    permissive = F.forall("licences", lambda x: x.isin(PERMISSIVE))
    unknown = (F.size("licences") == 0) | F.exists("sentence_ids", lambda x: x.isin(UNKNOWN))
    return out.withColumn("verdict", F.when(F.size("sentence_ids") == 0, "none").when(~permissive, "restricted").when(unknown, "unknown").otherwise("permissive"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(load(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", F.size("sentence_ids").cast("bigint").alias("n_sentences"), F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licences", ",").alias("licences"), "verdict"
    )


# The SQL has tables of its own: plain phrases instead of patterns, found by their places, which a longer phrase that holds the place hides; and rules as orders of places.
_NAMES = "mit:MitRef:mit|expat:MitRef:mit|isc:IscRef:isc|3 clause bsd:Bsd3Ref:bsd3|bsd 3 clause:Bsd3Ref:bsd3|2 clause bsd:Bsd2Ref:bsd2|bsd 2 clause:Bsd2Ref:bsd2"
_REFS = [(f"{lead}{the}{name} license", ident) for name, ident in [x.split(":")[:2] for x in _NAMES.split("|")] for lead in ("under ", "or ", "and ", "under the terms of ") for the in ("", "the ")]
_REFS += [(f"{lead}{the}apache license {v}2 0", "Apache2Ref") for lead in ("under ", "or ", "and ", "under the terms of ") for the in ("", "the ") for v in ("", "version ")]
_REFS += [(f"not {verb} under {the}{name} license", "Denied") for verb in ("released", "licensed", "distributed") for the in ("", "the ") for name in ("mit", "apache", "gnu general public")]
_REFS += [(f"gnu general public license {v}{n}", f"Gpl{n}Ref") for v in ("", "version ", "v ") for n in (2, 3)]
_REFS += [(f"gnu general public license as published by the free software foundation {e}version {n}", f"Gpl{n}Ref") for e in ("", "either ") for n in (2, 3)]
_REFS += [("gnu general public license", "GplRef"), ("gnu lesser general public license", "LgplRef"), ("gnu affero general public license", "AgplRef"), ("mozilla public license version 2", "Mpl2Ref"), ("mozilla public license v 2", "Mpl2Ref")]
_REFS += [("you may not use this file except in compliance with the license", "Apache2Comply"), ("distributed under the license is distributed on an as is basis", "AsIsBasis")]
_REFS += [("permission is hereby granted free of charge to any person obtaining a copy", "MitGrant"), ("the above copyright notice and this permission notice shall be included", "MitKeep"), ("the software is provided as is without warranty of any kind", "AsIsMit")]
_REFS += [("redistribution and use in source and binary forms", "BsdUse"), ("redistributions of source code must retain the above copyright notice", "BsdNotice"), ("redistributions in binary form must reproduce the above copyright notice", "BsdBinary")]
_REFS += [(f"cc by{x} 4 0", f"CcBy{y}4") for x, y in [(" nc nd", "NcNd"), (" nc sa", "NcSa"), (" nc", "Nc"), (" sa", "Sa"), ("", "")]] + [("cc0 1 0", "Cc0"), ("creative commons zero", "Cc0"), ("creative commons attribution 4 0", "CcBy4")]
_REFS += [(f"{a} {b} the public domain", "PublicDomain") for a in ("released", "placed", "dedicated") for b in ("in", "into", "to")] + [("all rights reserved", "AllRights")] + [(f"{a} under", "SomeLicense") for a in ("licensed", "released", "distributed")]
_SPDX = "mit:SpdxMit apache-2.0:SpdxApache2 isc:SpdxIsc bsd-2-clause:SpdxBsd2 bsd-3-clause:SpdxBsd3 mpl-2.0:SpdxMpl2 gpl-2.0-only:SpdxGpl2 gpl-2.0-or-later:SpdxGpl2 gpl-2.0:SpdxGpl2 gpl-3.0-only:SpdxGpl3 gpl-3.0-or-later:SpdxGpl3 gpl-3.0:SpdxGpl3 lgpl-2.1-only:SpdxLgpl lgpl-3.0-only:SpdxLgpl agpl-3.0-only:SpdxAgpl3 cc0-1.0:SpdxCc0"
_LICENCES = "Apache2Ref:Apache-2.0:1 SpdxApache2:Apache-2.0:1 MitGrant+MitKeep:MIT:2 MitRef:MIT:2 SpdxMit:MIT:2 IscRef:ISC:3 SpdxIsc:ISC:3 BsdUse+BsdNotice+BsdBinary+BsdNoEndorse:BSD-3-Clause:4 Bsd3Ref:BSD-3-Clause:4.2 SpdxBsd3:BSD-3-Clause:4.2 BsdUse+BsdNotice+BsdBinary-BsdNoEndorse:BSD-2-Clause:4.1 Bsd2Ref:BSD-2-Clause:4.3 SpdxBsd2:BSD-2-Clause:4.3 AgplRef:AGPL-3.0:5 SpdxAgpl3:AGPL-3.0:5 LgplRef:LGPL:6 SpdxLgpl:LGPL:6 Gpl3Ref:GPL-3.0:7 SpdxGpl3:GPL-3.0:7 Gpl2Ref:GPL-2.0:8 SpdxGpl2:GPL-2.0:8 GplRef:GPL:9 CcByNcNd4:CC-BY-NC-ND-4.0:10 CcByNcSa4:CC-BY-NC-SA-4.0:11 CcByNc4:CC-BY-NC-4.0:12 CcBySa4:CC-BY-SA-4.0:13 CcBy4:CC-BY-4.0:14 Cc0:CC0-1.0:15 SpdxCc0:CC0-1.0:15 Mpl2Ref:MPL-2.0:16 SpdxMpl2:MPL-2.0:16 PublicDomain:Public-Domain:18"
_values = lambda rows: ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


def _order(parts: str) -> str:
    """The regex of a rule on identifiers joined by commas; what follows a minus must not come later."""
    wanted, _, no = parts.partition("-")
    return "regexp_matches(l, '(^|.*,)" + "(,|,.*,)".join(wanted.split("+")) + "(,|$)')" + (f" and not contains(l, '{no}')" if no else "")


_FOUND = " union all ".join(f"select doc_id, '{lic}' as lic, {rank} as rank from l where {_order(parts)}" for parts, lic, rank in (x.rsplit(":", 2) for x in _LICENCES.split()))
ORACLE = rf"""
with recursive d as (select doc_id, row_number() over () as n, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
g as materialized (select n, regexp_split_to_array(regexp_replace(t, '\n\s*(spdx|copyright|all rights|permission is|redistribution|neither the|[0-9][.)])', chr(1) || '\1', 'g'), chr(1) || '|\n[^a-z0-9\n]*\n|[.!?;][ \t\r\n]+') as ss from d where regexp_matches(t, 'licen[cs]e|gpl|copyright|spdx|permission|warrant|redistribution|endorse|creative|attribution|cc0|cc.by|domain|reserved|released|distributed')),
s as (select n, unnest(ss) as raw, generate_subscripts(ss, 1) as i from g),
sp0 as (select n, i, regexp_extract_all(regexp_replace(regexp_extract(raw, 'spdx-license-identifier:[ \t]*([^\n]*)', 1), '[ \t]with[ \t]+[^ \t]+', '', 'g'), '[a-z0-9][a-z0-9.+-]*') as toks from s where contains(raw, 'spdx-license')),
sp as (select n, i, unnest(toks) as tok, generate_subscripts(toks, 1) as p from sp0),
spi as (select n, i, p - 1000 as place, coalesce(x.id, 'SpdxOther') as id from sp left join (values {_values([tuple(x.split(":")) for x in _SPDX.split()])}) x(tok, id) using (tok) where tok not in ('or', 'and')),
x as materialized (select n, i, ' ' || trim(regexp_replace(regexp_replace(raw, 'spdx-license-identifier:[^\n]*', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) || ' ' as x from s),
ph(p, id) as (values {_values([(f" {p} ", i) for p, i in _REFS])}),
w as materialized (select n, i, x from x where regexp_matches(x, 'licen[cs]e|permission|warrant|redistribution|endorse|creative|cc0|cc by|domain|reserved|under')),
o as (select n, i, strpos(x, p) as place, strpos(x, p) + length(p) - 2 as stop, id from w join ph on contains(x, p)
  union all select n, i, strpos(x, ' neither the name of '), 100000, 'BsdNoEndorse' from w where regexp_matches(x, ' neither the name of .* may be used to endorse')
  union all select n, i, 1, 16, 'Copyright' from x where regexp_matches(x, '^ copyright (c )?[0-9]{{4}}')),
k as (select n, i, place, id from o where not exists (select 1 from o b where b.n = o.n and b.i = o.i and b.id <> 'SomeLicense' and (o.id = 'SomeLicense' or b.place < o.place and b.stop > o.place or b.place = o.place and b.stop > o.stop))
  union all select * from spi),
l as (select doc_id, any_value(d.n) as n, coalesce(string_agg(k.id, ',' order by i, place), '') as l, count(k.id) as c from d left join k using (n) group by doc_id, d.n),
f as ({_FOUND}),
h as (select doc_id, string_agg(lic, ',' order by rank) as ls, bool_and(lic in ('Apache-2.0', 'MIT', 'ISC', 'BSD-2-Clause', 'BSD-3-Clause', 'CC-BY-4.0', 'CC0-1.0', 'Public-Domain')) as fine from (select doc_id, lic, min(rank) as rank from f group by 1, 2) group by 1)
select l.doc_id, c as n_sentences, l as sentence_ids, coalesce(ls, '') as licences, case when c = 0 then 'none' when not coalesce(fine, true) then 'restricted' when ls is null or contains(l, 'SpdxOther') then 'unknown' else 'permissive' end as verdict
from l left join h on h.doc_id is not distinct from l.doc_id
"""
