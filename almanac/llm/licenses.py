"""License scans: ordered signature rules behind a keyword filter, overlaps settled by priority and containment.

Only DataFrame functions are used, row by row: no shuffle, no Python on the executors. Rules are
patterns over the words of a text, lower-cased and joined by single spaces, so that line breaks,
case and punctuation do not matter.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from almanac.llm.columns import beside, lower_ascii, match_spans

# Fixed values of the base rules: phrase, label.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
_GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_RAW_GAP = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"

# Kinds of rules by priority, and how sure a detection of the kind is.
TAG, NOTICE, ADDRESS, TITLE, FAMILY = range(5)
SURENESS = (1.0, 0.95, 0.9, 0.8, 0.5)

# label | kind pattern | kind pattern ... ; t tag, n sentence of the text or notice, u address, v title with
# version, f title alone. "v?" and similar are part of the patterns; patterns match whole words.
RULES = """
mit | t: license identifier mit | n: permission is hereby granted free of charge to any person obtaining a copy of this software | u: opensource org licenses mit | v: (expat|x11) mit license | f: (the )?mit licen[sc]e( mit)?
mit-0 | t: license identifier mit 0 | v: mit no attribution | u: opensource org licenses mit 0
apache-2.0 | t: license identifier apache 2 0 | n: licensed under the apache licen[sc]e version 2 0 | u: apache org licenses license 2 0 | v: apache (software )?licen[sc]e (version |v )?2( 0)? | v: apache 2 0 licen[sc]e
apache-1.1 | t: license identifier apache 1 1 | v: apache software license version 1 1 | u: apache org licenses license 1 1
apache | f: apache (software )?licen[sc]e | f: apache software foundation license
gpl-3.0 | t: license identifier gpl 3 0( only| or later)? | n: licensed under the (gnu )?general public license version 3 | n: gnu general public license as published by the free software foundation either version 3 | v: gnu (general public license|gpl) (version |v )?3( 0)?
gpl-3.0 | t: identifier gpl 3 0( only| or later)? | v: gpl ?v?3( 0)? | u: gnu org licenses gpl 3 0
gpl-2.0 | n: licensed under the (gnu )?general public license version 2 | n: gnu general public license as published by the free software foundation either version 2 | v: gnu (general public license|gpl) (version |v )?2( 0)?
gpl-2.0 | t: identifier gpl 2 0( only| or later)? | v: gpl ?v?2( 0)? | u: gnu org licenses (old licenses )?gpl 2 0
gpl | f: (gnu )?general public license | f: gnu public license
lgpl-2.1 | n: gnu lesser general public license as published by the free software foundation either version 2 1 | v: (gnu )?lesser general public license (version |v )?2 1
lgpl-2.1 | t: identifier lgpl 2 1( only| or later)? | v: lgpl ?v?2 1 | u: gnu org licenses (old licenses )?lgpl 2 1
lgpl-3.0 | n: gnu lesser general public license as published by the free software foundation either version 3 | v: (gnu )?lesser general public license (version |v )?3
lgpl-3.0 | t: identifier lgpl 3 0( only| or later)? | v: lgpl ?v?3( 0)? | u: gnu org licenses lgpl 3 0
lgpl-2.0 | v: (gnu )?library general public license (version |v )?2 | f: gnu library general public license
lgpl | f: (gnu )?lesser general public license
agpl-3.0 | n: gnu affero general public license as published by the free software foundation either version 3 | v: (gnu )?affero general public license (version |v )?3 | f: (gnu )?affero general public license
agpl-3.0 | t: identifier agpl 3 0( only| or later)? | v: agpl ?v?3( 0)? | u: gnu org licenses agpl 3 0
gfdl | n: terms of the gnu free documentation license version 1 [123] | v: free documentation license version 1 [123] | f: gnu free documentation license
bsd-2-clause | t: license identifier bsd 2 clause | v: bsd 2 clause( simplified)? licen[sc]e | v: simplified bsd license | u: opensource org licenses bsd 2 clause
bsd-3-clause | t: license identifier bsd 3 clause | v: bsd 3 clause licen[sc]e | v: (new|modified|revised) bsd license | u: opensource org licenses bsd 3 clause
bsd-4-clause | t: license identifier bsd 4 clause | v: (original|old) bsd license | v: bsd 4 clause
bsd-3-clause | n: neither the name of .{1,80} may be used to endorse or promote products derived from this software
bsd | f: bsd (style )?licen[sc]e | f: berkeley software distribution license
bsd | n: redistribution and use in source and binary forms with or without modification are permitted
0bsd | t: license identifier 0bsd | v: (zero clause|0 clause) bsd | v: 0bsd licen[sc]e
mpl-2.0 | n: subject to the terms of the mozilla public license v ?2 0 | v: mozilla public license (version |v )?2( 0)? | u: mozilla org mpl 2 0
mpl-2.0 | t: identifier mpl 2 0 | v: mpl ?v?2 0 | u: mozilla org mpl 2 0
mpl-1.1 | n: subject to the mozilla public license version 1 1 | v: mozilla public license (version |v )?1 1
mpl | f: mozilla public license
epl-2.0 | n: terms of the eclipse public license 2 0 | v: eclipse public license (version |v )?2( 0)? | u: eclipse org legal epl 2 0
epl-2.0 | t: identifier epl 2 0 | v: epl ?v?2 0
epl-1.0 | n: terms of the eclipse public license v1 0 | v: eclipse public license (version |v )?1( 0)? | u: eclipse org legal epl v10
epl | f: eclipse public license
edl-1.0 | v: eclipse distribution license (version |v )?1 0 | f: eclipse distribution license
cddl-1.0 | n: terms of the common development and distribution license | v: common development and distribution license (cddl )?(version |v )?1 0 | f: common development and distribution license
cddl-1.1 | t: identifier cddl 1 1 | v: cddl ?v?1 1 | f: cddl gpl
cpl-1.0 | v: common public license (version |v )?1 0 | f: common public license
ipl-1.0 | v: ibm public license (version |v )?1 0 | f: ibm public license
isc | t: license identifier isc | v: isc licen[sc]e | u: opensource org licenses isc
isc | n: permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
zlib | t: license identifier zlib | v: zlib( libpng)? licen[sc]e | u: opensource org licenses zlib
zlib | n: this software is provided as is without any express or implied warranty in no event will the authors be held liable
libpng | t: license identifier libpng( 2 0)? | v: libpng license
bsl-1.0 | t: license identifier bsl 1 0 | n: distributed under the boost software license version 1 0 | v: boost software license( version)?( 1 0)? | u: boost org license 1 0
busl-1.1 | v: business source license (version |v )?1 1 | f: business source license
busl-1.1 | t: identifier busl 1 1
unlicense | t: license identifier unlicense | v: the unlicense | u: unlicense org
unlicense | n: this is free and unencumbered software released into the public domain
wtfpl | t: license identifier wtfpl | v: wtfpl( version 2)? | u: wtfpl net
wtfpl | v: do what the f\\S* you want to public license
artistic-2.0 | t: license identifier artistic 2 0 | v: artistic license (version |v )?2( 0)? | u: opensource org licenses artistic 2 0
artistic-1.0 | t: license identifier artistic 1 0 | v: artistic license (version |v )?1( 0)? | v: clarified artistic license
artistic | f: (the )?artistic license
perl | n: under the same terms as perl( itself)? | f: perl license
python-2.0 | t: license identifier (python|psf) 2 0 | v: python software foundation license( version 2)? | f: psf license
ruby | t: license identifier ruby | f: ruby s? ?license
php-3.01 | t: license identifier php 3 01 | n: subject to version 3 0?1 of the php license | v: php license (version |v )?3 01
php | f: php license
postgresql | t: license identifier postgresql | f: postgresql licen[sc]e
openssl | t: license identifier openssl | f: openssl license | f: dual openssl and ssleay license
ofl-1.1 | t: license identifier ofl 1 1 | n: licensed under the sil open font license version 1 1 | v: (sil )?open font license (version |v )?1 1 | u: scripts sil org ofl | f: open font license
eupl-1.2 | n: licensed under the eupl version 1 2 | v: european union public licen[sc]e (version |v )?1 2 | f: european union public licen[sc]e
eupl-1.2 | t: identifier eupl 1 2 | v: eupl ?v?1 2 | u: joinup ec europa eu .{1,40} eupl
eupl-1.1 | t: identifier eupl 1 1 | v: eupl ?v?1 1
cecill-2.1 | t: license identifier cecill 2 1 | v: cecill (version |v )?2 1 | u: cecill info licences licence cecill v2 1
cecill | f: cecill( b| c)?( free software)? licen[sc]e | u: cecill info
ms-pl | t: license identifier ms pl | v: microsoft public license | f: microsoft permissive license
ms-rl | t: license identifier ms rl | v: microsoft reciprocal license
ncsa | t: license identifier ncsa | v: (university of illinois )?ncsa open source license | f: ncsa license
afl-3.0 | n: licensed under the academic free license version 3 0 | v: academic free license (version |v )?3 0 | f: academic free license
osl-3.0 | n: licensed under the open software license version 3 0 | v: open software license (version |v )?3 0 | f: open software license
upl-1.0 | t: license identifier upl 1 0 | v: universal permissive license (version |v )?1 0 | f: universal permissive license
vim | t: license identifier vim | f: vim license
x11 | t: license identifier x11 | f: x11 license
ijg | n: based in part on the work of the independent jpeg group | f: independent jpeg group license
curl | t: license identifier curl | f: curl license
json | n: the software shall be used for good not evil | f: json license
beerware | n: you can buy me a beer in return | v: beer ?ware license( revision 42)? | t: license identifier beerware
sspl-1.0 | v: server side public license( version| v)?( ?1)? | f: sspl license
elastic-2.0 | t: license identifier elastic 2 0 | v: elastic license (version |v )?2( 0)? | f: elastic license
polyform | v: polyform (noncommercial|small business|strict|shield) license( 1 0 0)? | u: polyformproject org licenses
bittorrent-1.1 | v: bittorrent open source license (version |v )?1 1 | f: bittorrent open source license
mulan-2.0 | t: license identifier mulanpsl 2 0 | n: licensed under mulan psl v2 | v: mulan permissive software license( version| v)?( ?2)?
cc0-1.0 | t: license identifier cc0 1 0 | v: cc0 1 0( universal)? | u: creativecommons org publicdomain zero 1 0 | f: cc0
cc-by-4.0 | t: license identifier cc by 4 0 | n: licensed under (a )?(the )?cc by 4 0 | v: cc by 4 0
cc-by-3.0 | t: license identifier cc by 3 0 | n: licensed under (a )?(the )?cc by 3 0 | v: cc by 3 0
cc-by-sa-4.0 | t: license identifier cc by sa 4 0 | n: licensed under (a )?(the )?cc by sa 4 0 | v: cc by sa 4 0
cc-by-sa-3.0 | t: license identifier cc by sa 3 0 | n: licensed under (a )?(the )?cc by sa 3 0 | v: cc by sa 3 0
cc-by-nc-4.0 | t: license identifier cc by nc 4 0 | n: licensed under (a )?(the )?cc by nc 4 0 | v: cc by nc 4 0
cc-by-nc-sa-4.0 | t: license identifier cc by nc sa 4 0 | n: licensed under (a )?(the )?cc by nc sa 4 0 | v: cc by nc sa 4 0
cc-by-nc-nd-4.0 | t: license identifier cc by nc nd 4 0 | n: licensed under (a )?(the )?cc by nc nd 4 0 | v: cc by nc nd 4 0
cc-by-nd-4.0 | t: license identifier cc by nd 4 0 | n: licensed under (a )?(the )?cc by nd 4 0 | v: cc by nd 4 0
cc-by-4.0 | u: creativecommons org licenses by 4 0
cc-by-3.0 | u: creativecommons org licenses by 3 0
cc-by-sa-4.0 | u: creativecommons org licenses by sa 4 0
cc-by-sa-3.0 | u: creativecommons org licenses by sa 3 0
cc-by-nc-4.0 | u: creativecommons org licenses by nc 4 0
cc-by-nc-sa-4.0 | u: creativecommons org licenses by nc sa 4 0
cc-by-nc-nd-4.0 | u: creativecommons org licenses by nc nd 4 0
cc-by-nd-4.0 | u: creativecommons org licenses by nd 4 0
cc-by-4.0 | v: creative commons attribution (licen[sc]e )?4 0( international)?
cc-by-sa-4.0 | v: creative commons attribution share ?alike 4 0( international)?
cc-by-nc-4.0 | v: creative commons attribution non ?commercial 4 0( international)?
cc-by-nc-sa-4.0 | v: creative commons attribution non ?commercial share ?alike 4 0( international)?
cc-by-nd-4.0 | v: creative commons attribution no ?deriv(atives|s) 4 0( international)?
cc | f: creative commons( attribution)?( share ?alike)? licen[sc]e | f: licensed under creative commons
odbl-1.0 | t: license identifier odbl 1 0 | v: open database license( odbl)?( version| v)?( ?1 0)? | u: opendatacommons org licenses odbl
odc-by-1.0 | v: open data commons attribution license( version| v)?( ?1 0)? | u: opendatacommons org licenses by
pddl-1.0 | v: public domain dedication and licen[sc]e( version| v)?( ?1 0)? | u: opendatacommons org licenses pddl
public-domain | n: (released|placed|dedicated) (in|into|to) the public domain | f: public domain software
ogl-3.0 | n: contains public sector information licensed under the open government licence v ?3 0 | v: open government licence( version| v)?( ?3 0)? | u: nationalarchives gov uk doc open government licence
openrail | v: (big(science|code) )?open ?rail( m)? license | f: responsible ai license
llama | v: llama [23]( [0-9])? community license( agreement)? | f: community license agreement
gemma | v: gemma terms of use
proprietary | n: proprietary and confidential | f: proprietary license | n: unauthorized copying of this file via any medium is strictly prohibited
proprietary | n: copyright (c )?[0-9]{4}.{1,60} all rights reserved
"""

# Stands for a part of a pattern that matches more than a few texts.
_ANY = "\0"


def matched_texts(pattern: str) -> set[str]:
    """All texts a pattern of the table matches; what is open in it (``.{1,60}``, ``[0-9]``, ``\\S*``) is one NUL."""
    found, rest = _alternatives(pattern)
    if rest:
        raise ValueError(f"not a pattern of the table: {pattern}")
    return found


def _alternatives(pattern: str) -> tuple[set[str], str]:
    found, so_far = set(), {""}
    while pattern and pattern[0] != ")":
        head, pattern = pattern[0], pattern[1:]
        if head == "|":
            found, so_far = found | so_far, {""}
            continue
        if head == "(":
            part, pattern = _alternatives(pattern)
            pattern = pattern[1:]
        elif head == "[":
            inside, pattern = pattern.split("]", 1)
            part = {_ANY} if "-" in inside else set(inside)
        elif head == "\\":
            part, pattern = {_ANY}, pattern[1:]
        else:
            part = {_ANY} if head == "." else {head}
        if pattern.startswith("{"):
            pattern = pattern.split("}", 1)[1]
        elif pattern.startswith("*"):
            pattern = pattern[1:]
        elif pattern.startswith("?"):
            pattern, part = pattern[1:], part | {""}
        so_far = {a + b for a in so_far for b in part}
    return found | so_far, pattern


def signal_words(pattern: str) -> list[str]:
    """Words of which every text with a match of the pattern holds one: the longest of each matched text."""
    return sorted({
        max((w for w in text.split(" ") if _ANY not in w), key=lambda w: (len(w), w)) for text in matched_texts(pattern)
    })


def _rules() -> list[tuple[str, int, str, list[str]]]:
    """Label, kind, pattern and signal words of each rule, in order."""
    kinds = {"t": TAG, "n": NOTICE, "u": ADDRESS, "v": TITLE, "f": FAMILY}
    out = []
    for line in RULES.strip().splitlines():
        label, *patterns = [part.strip() for part in line.split(" | ")]
        for part in patterns:
            kind, pattern = part.split(": ", 1)
            out.append((label, kinds[kind], f" (?:{pattern})(?= )", signal_words(pattern)))
    return out


def _constant(value: list, kind: str) -> Column:
    """A value of the plan: one literal, which the optimizer reads once."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _rule_column() -> Column:
    names = ("label", "kind", "pattern", "signals")
    return _constant(
        [dict(zip(names, rule)) for rule in _rules()],
        "array<struct<label:string,kind:int,pattern:string,signals:array<string>>>",
    )


def words_joined(text: Column) -> Column:
    """The words in lower case with one space before, between and after them."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(lower_ascii(text), _GAP, " ")), F.lit(" "))


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _detections(joined: Column, signals: Column) -> Column:
    """Detections that no other one of at least the same priority contains, by start.

    In this order (start, longest first, priority) a detection is contained exactly if an earlier
    one of the same or a higher priority ends at or behind its end.
    """
    # Patterns take the space before the first word along; it is no part of a detection.
    candidates = F.filter(_rule_column(), lambda r: (
        F.arrays_overlap(r["signals"], signals) & F.rlike(joined, r["pattern"])
    ))
    found = F.flatten(F.transform(candidates, lambda r: F.transform(
        match_spans(joined, r["pattern"]),
        lambda s: F.struct(
            (s["start"] + 1).alias("start"), (-s["end"]).alias("least"), r["kind"].alias("kind"), r["label"].alias("label")
        ),
    )))

    def step(acc: Column, d: Column) -> Column:
        inside = F.exists(F.slice(acc["ends"], F.lit(1), d["kind"] + 1), lambda e: e >= -d["least"])
        return F.struct(
            F.transform(acc["ends"], lambda e, k: F.when((k == d["kind"]) & (-d["least"] > e), -d["least"]).otherwise(e))
            .alias("ends"),
            F.when(inside, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(d))).alias("kept"),
        )

    return F.aggregate(
        F.sort_array(found),
        F.struct(
            F.array(*[F.lit(-1)] * len(SURENESS)).alias("ends"),
            F.array().cast("array<struct<start:int,least:int,kind:int,label:string>>").alias("kept"),
        ),
        step, lambda acc: acc["kept"],
    )


def license_labels(df: DataFrame, text: str = "text") -> DataFrame:
    """Add what a text says about its license.

    Columns: ``n_words``; ``n_base``, ``first_word``, ``last_word`` and ``base_labels`` of the base
    phrases; ``labels``, also of the rules; ``score``, how sure the surest detection is (0 without
    one); ``detections`` (``start``, ``end`` in the joined words, ``kind``, ``label``). A null or
    empty text has no words and no labels. Every row gives one row; input columns named like a
    result give way.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    # Every text of a rule or phrase holds one of its signal words, found in one pass over the words of the text.
    wanted = {w for _, _, _, words in _rules() for w in words}.union(*[signal_words(p) for p, _ in BASE])
    kept = "array<struct<start:int,least:int,kind:int,label:string>>"
    phrases = " (?:" + "|".join(p for p, _ in BASE) + ")(?= )"
    step = beside(df, {"_llm_words": F.split(F.lower(whole), _RAW_GAP, -1)})
    step = beside(step, {
        "n_words": F.size(F.array_remove("_llm_words", "")).cast("long"),
        "_llm_signals": F.array_intersect("_llm_words", _constant(sorted(wanted), "array<string>")),
    }).drop("_llm_words")
    step = beside(step, {"_llm_joined": F.when(F.size("_llm_signals") > 0, words_joined(whole))})
    none = F.array()
    step = beside(step, {
        "_llm_base": F.when(F.col("_llm_joined").contains("license"), match_spans(F.col("_llm_joined"), phrases)).otherwise(
            none.cast("array<struct<start:int,end:int,got:string>>")),
        "_llm_found": F.when(F.col("_llm_joined").isNotNull(), _detections(F.col("_llm_joined"), F.col("_llm_signals"))).otherwise(none.cast(kept)),
    })

    def word_at(span: Column) -> Column:
        return F.when(F.size("_llm_base") > 0, _spaces(F.substring(F.col("_llm_joined"), F.lit(1), span["start"]))).cast("long")

    def has(phrase: str) -> Column:
        return F.exists("_llm_base", lambda s: s["got"] == " " + phrase)

    base = F.array(*[F.when(has(phrase), F.lit(label)) for phrase, label in BASE])
    sure = F.array(*[F.lit(s) for s in SURENESS])
    return beside(step, {
        "n_base": F.size("_llm_base").cast("long"),
        "first_word": word_at(F.get("_llm_base", F.lit(0))),
        "last_word": word_at(F.get("_llm_base", F.size("_llm_base") - 1)),
        "base_labels": F.array_join(F.sort_array(F.array_compact(base)), ","),
        "labels": F.array_join(F.sort_array(F.array_union(
            F.array_compact(base), F.transform("_llm_found", lambda d: d["label"])
        )), ","),
        "score": F.coalesce(F.array_max(F.concat(
            F.transform("_llm_found", lambda d: F.get(sure, d["kind"])),
            F.transform("_llm_base", lambda s: F.lit(SURENESS[FAMILY])),
        )), F.lit(0.0)),
        "detections": F.transform("_llm_found", lambda d: F.struct(
            d["start"].alias("start"), (-d["least"]).alias("end"), d["kind"].alias("kind"), d["label"].alias("label")
        )),
    }).drop("_llm_signals", "_llm_joined", "_llm_base", "_llm_found")


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses named in all documents."""
    return license_labels(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"
    )
