"""License scan by ordered signature rules.

Texts become words; a rule is a small regex over the words, gated by a keyword that it can't match without. A text that
holds none of the rules' keywords is passed over at once. Of the detections in a text, one is suppressed if another of
at least its priority contains its interval of words (of equal intervals the one of higher priority, then of the rule
that comes first, stays). What is left gives the labels and, as the highest weight, the score.

Rules are written as units that stand for one word each: a regex without blanks; ``?unit`` may be missing; ``*3`` stands
for up to three words of any kind. DataFrame functions only; nothing is shuffled: a row's hits are judged in one fold over them in
order, which remembers how far hits of each priority reach and no hit itself.

Defined cases: null or empty text has no words, labels '' and score 0; null and repeated ids stay row by row; an empty
table gives an empty result; whole texts are scanned; further columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP, WORD, texts

#: Weight of a detection by its rule's priority.
WEIGHTS = {1: 0.3, 2: 0.6, 3: 0.8, 4: 1.0}
#: Base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: label | priority | rule. The order matters only between equal intervals of equal priority.
RULES = """
mit | 3 | mit licen[cs]e *2 copyright
mit | 3 | licen[cs]ed under *1 mit ?licen[cs]e
mit | 3 | released under *1 mit ?licen[cs]e
mit | 3 | distributed under *1 mit ?licen[cs]e
mit | 3 | permission is hereby granted free of charge to any person obtaining a copy
mit | 3 | the above copyright notice and this permission notice shall be included in all copies
mit | 2 | mit style licen[cs]e
mit | 2 | expat licen[cs]e
mit | 2 | mit x11 ?licen[cs]e
mit-0 | 3 | mit no attribution ?licen[cs]e
x11 | 2 | x11 licen[cs]e
isc | 3 | permission to use copy modify and ?or distribute this software for any purpose
isc | 2 | isc licen[cs]e
apache | 4 | apache licen[cs]e ?version 2 0
apache | 4 | apache licen[cs]e ?version 1 [01]
apache | 4 | http www apache org licenses license 2 0
apache | 3 | licen[cs]ed under the apache ?software licen[cs]e
apache | 3 | apache software licen[cs]e
apache | 3 | you may not use this file except in compliance with the licen[cs]e
apache | 3 | licen[cs]ed to the apache software foundation
apache | 2 | apache 2 ?0 licen[cs]e
apache | 2 | apache 2 0
apache | 2 | asl 2 ?0
gpl | 4 | gnu general public licen[cs]e ?as *6 version [123]
gpl | 4 | gnu general public licen[cs]e ?version v?[123]
gpl | 4 | gnu gpl v?[123]
gpl | 3 | under the terms of the gnu general public licen[cs]e
gpl | 3 | either version [123] of the licen[cs]e or ?at ?your ?option any later version
gpl | 3 | gpl v?[123] ?0 or later
gpl | 3 | gpl v?[123] ?0 only
gpl | 3 | licen[cs]ed under *1 gpl
gpl | 2 | gplv[123]
gpl | 2 | gpl v?[123]
gpl | 2 | gpl licen[cs]e
gpl | 2 | gnu gpl
gpl-exception | 3 | gpl with classpath exception
gpl-exception | 3 | classpath exception
gpl-exception | 3 | gcc runtime library exception
gpl-exception | 3 | bison exception
gpl-exception | 3 | autoconf exception
gpl-exception | 3 | linux syscall note
lgpl | 4 | gnu (?:lesser|library) general public licen[cs]e
lgpl | 4 | (?:lesser|library) general public licen[cs]e ?version v?[23]
lgpl | 3 | (?:lesser|library) general public licen[cs]e
lgpl | 2 | lgplv[23]
lgpl | 2 | lgpl v?[23]
lgpl | 2 | lgpl
agpl | 4 | gnu affero general public licen[cs]e
agpl | 3 | affero general public licen[cs]e
agpl | 2 | agplv3
agpl | 2 | agpl
sspl | 4 | server side public licen[cs]e
sspl | 2 | sspl
gfdl | 4 | gnu free documentation licen[cs]e
gfdl | 2 | gfdl
bsd | 4 | bsd [0234] clause
bsd | 4 | (?:two|three|four) clause bsd
bsd | 4 | [234] clause bsd
bsd | 3 | redistribution and use in source and binary forms
bsd | 3 | redistributions of source code must retain the above copyright notice
bsd | 3 | redistributions in binary form must reproduce the above copyright notice
bsd | 3 | neither the name of *8 may be used to endorse
bsd | 3 | all advertising materials mentioning features
bsd | 3 | (?:new|modified|simplified|revised|original) bsd
bsd | 3 | freebsd licen[cs]e
bsd | 2 | bsd ?style licen[cs]e
bsd | 2 | bsd licen[cs]ed
mpl | 4 | mozilla public licen[cs]e ?version ?v?[12] ?[01]
mpl | 3 | subject to the terms of the mozilla public licen[cs]e
mpl | 3 | mozilla public licen[cs]e
mpl | 2 | mpl [12] [01]
epl | 4 | eclipse public licen[cs]e
epl | 2 | epl v?[12] ?0
edl | 4 | eclipse distribution licen[cs]e
cddl | 4 | common development and distribution licen[cs]e
cddl | 2 | cddl
cpl | 4 | common public licen[cs]e
cpal | 4 | common public attribution licen[cs]e
ibm-pl | 4 | ibm public licen[cs]e
npl | 4 | netscape public licen[cs]e
eupl | 4 | european union public licen[cs]e
eupl | 2 | eupl
osl | 4 | open software licen[cs]e
afl | 4 | academic free licen[cs]e
ecl | 4 | educational community licen[cs]e
artistic | 4 | artistic licen[cs]e ?version ?[12] ?0
artistic | 3 | artistic licen[cs]e
perl | 3 | same terms as perl itself
zlib | 4 | zlib libpng licen[cs]e
zlib | 3 | zlib licen[cs]e
zlib | 3 | the origin of this software must not be misrepresented
libpng | 3 | libpng licen[cs]e
libtiff | 3 | libtiff licen[cs]e
openssl | 3 | openssl licen[cs]e
openssl | 3 | this product includes software developed by the openssl project
ssleay | 3 | ssleay licen[cs]e
curl | 3 | curl licen[cs]e
php | 4 | php licen[cs]e ?version ?[23] ?0?[01]?
python | 4 | python software foundation licen[cs]e
python | 3 | psf licen[cs]e
ruby | 3 | ruby licen[cs]e
tcl | 3 | tcl tk licen[cs]e
vim | 3 | vim licen[cs]e
w3c | 4 | w3c software ?notice ?and licen[cs]e
ncsa | 4 | university of illinois ncsa open source licen[cs]e
ncsa | 3 | ncsa ?open ?source licen[cs]e
postgresql | 3 | postgresql licen[cs]e
unicode | 3 | unicode licen[cs]e ?agreement
icu | 3 | icu licen[cs]e
boost | 4 | boost software licen[cs]e
boost | 2 | bsl 1 0
busl | 4 | business source licen[cs]e
elastic | 4 | elastic licen[cs]e ?2?v?2? ?0
commons-clause | 4 | commons clause ?licen[cs]e
polyform | 4 | polyform *3 licen[cs]e
confluent | 4 | confluent community licen[cs]e
timescale | 4 | timescale licen[cs]e
redis | 4 | redis source available licen[cs]e
wtfpl | 4 | do what the fuck you want to public licen[cs]e
wtfpl | 3 | wtfpl
beerware | 4 | beer ?ware licen[cs]e
beerware | 3 | beerware
unlicense | 4 | this is free and unencumbered software released into the public domain
unlicense | 3 | the unlicense
unlicense | 2 | unlicense
cc0 | 4 | creative commons zero
cc0 | 4 | cc0 1 0 ?universal
cc0 | 3 | cc0
cc-by | 4 | creative commons attribution ?licen[cs]e
cc-by | 4 | creative commons attribution [1234] ?[05] ?international ?licen[cs]e
cc-by | 3 | cc by [1234] [05]
cc-by-sa | 4 | creative commons attribution share ?alike
cc-by-sa | 4 | creative commons attribution sharealike
cc-by-sa | 3 | cc by sa
cc-by-nc | 4 | creative commons attribution non ?commercial
cc-by-nc | 4 | creative commons attribution noncommercial
cc-by-nc | 3 | cc by nc
cc-by-nc-sa | 4 | cc by nc sa
cc-by-nc-nd | 4 | cc by nc nd
cc-by-nd | 4 | creative commons attribution no ?derivatives
cc-by-nd | 4 | creative commons attribution noderivatives
cc-by-nd | 3 | cc by nd
cc | 2 | creative commons ?licen[cs]e
odbl | 4 | open database licen[cs]e
odc-by | 4 | open data commons attribution licen[cs]e
pddl | 4 | public domain dedication and licen[cs]e
ofl | 4 | sil open font licen[cs]e
ofl | 3 | open font licen[cs]e
ogl | 3 | open government licen[cs]e
lppl | 4 | latex project public licen[cs]e
hpnd | 4 | historical permission notice and disclaimer
ms-pl | 4 | microsoft public licen[cs]e
ms-rl | 4 | microsoft reciprocal licen[cs]e
apsl | 4 | apple public source licen[cs]e
cecill | 4 | cecill ?free ?software licen[cs]e
cecill | 3 | cecill
mulan | 4 | mulan ?permissive ?software licen[cs]e
openrail | 4 | open ?responsible ?ai rail
openrail | 4 | responsible ai licen[cs]e
openrail | 4 | openrail ?m ?licen[cs]e
llama | 4 | llama *2 community licen[cs]e
gemma | 3 | gemma terms of use
nasa | 3 | nasa open source agreement
intel | 3 | intel open source licen[cs]e
sun | 3 | sun public licen[cs]e
sleepycat | 3 | sleepycat licen[cs]e
sybase | 3 | sybase open watcom public licen[cs]e
zope | 4 | zope public licen[cs]e
qpl | 4 | q public licen[cs]e
naumen | 3 | naumen public licen[cs]e
rpl | 3 | reciprocal public licen[cs]e
motosoto | 3 | motosoto open source licen[cs]e
simpl | 3 | simple public licen[cs]e
upl | 4 | universal permissive licen[cs]e
blueoak | 4 | blue oak model licen[cs]e
public-domain | 3 | dedicated to the public domain
public-domain | 3 | (?:placed|released) (?:in|into) the public domain
public-domain | 2 | public domain
proprietary | 3 | all rights reserved
proprietary | 3 | proprietary and confidential
proprietary | 3 | unauthorized copying of this file
proprietary | 3 | end user licen[cs]e agreement
proprietary | 3 | not for redistribution
proprietary | 2 | proprietary licen[cs]e
non-commercial | 3 | for non commercial use only
non-commercial | 3 | for noncommercial use only
non-commercial | 3 | for research purposes only
evaluation | 3 | for evaluation purposes only
dual | 3 | dual licen[cs]ed under
dual | 3 | dual licen[cs]ed
copyright | 1 | copyright ?c (?:19|20)[0-9][0-9]
copyright | 1 | copyright c
warranty | 1 | without warranty of any kind
warranty | 1 | without any warranty
warranty | 1 | as is without warranty
warranty | 1 | merchantability ?or ?and fitness for a particular purpose
warranty | 1 | in no event shall the ?authors? ?or ?copyright ?holders? be liable
grant | 1 | licen[cs]ed under ?the ?terms ?of
grant | 1 | see the licen[cs]e file
grant | 1 | see licen[cs]e
grant | 1 | subject to the following conditions
"""
#: Identifiers that follow an SPDX tag, as words, by label; a rule is made for each.
SPDX = {"mit": "mit", "apache": "apache 2 0", "gpl": "gpl [123] 0", "lgpl": "lgpl [23] [01]", "agpl": "agpl 3 0", "bsd": "bsd [0234] clause", "mpl": "mpl 2 0", "epl": "epl [12] 0", "cddl": "cddl 1 [01]", "isc": "isc", "zlib": "zlib", "unlicense": "unlicense", "cc0": "cc0 1 0", "cc-by": "cc by [1234] [05]", "boost": "bsl 1 0", "wtfpl": "wtfpl", "artistic": "artistic [12] 0", "ofl": "ofl 1 [01]", "eupl": "eupl 1 [012]", "upl": "upl 1 0", "postgresql": "postgresql", "ncsa": "ncsa", "afl": "afl [123] [01]", "osl": "osl [123] [01]", "ms-pl": "ms pl", "ms-rl": "ms rl", "blueoak": "blueoak 1 0 0", "odbl": "odbl 1 0", "lppl": "lppl 1 3c?", "zope": "zpl 2 [01]", "busl": "busl 1 1", "elastic": "elastic 2 0", "sspl": "sspl 1 0", "python": "psf 2 0", "php": "php 3 01?", "hpnd": "hpnd", "mit-0": "mit 0", "x11": "x11", "curl": "curl", "openssl": "openssl"}

#: Words too common to tell a license by; only the choice of gate words hangs on them.
COMMON = set("the and for mit not all with only later version style model source open itself neither free same use under you may any name terms see purpose conditions community".split())


def compile_rule(rule: str) -> tuple[str, str]:
    """The rule as a regex over words that each stand between blanks of their own, and its longest run of plain words, which a match can't be without.

    A rule's first unit is one that can't be missing, so that its regex starts with a blank."""
    out, run, needed = "", "", ""
    for unit in rule.split():
        plain = ""
        if unit[0] == "*":
            out += f"(?: [^ ]+ ){{0,{unit[1:]}}}"
        elif unit[0] == "?":
            out += f"(?: {unit[1:]} )?"
        else:
            out += f" {unit} "
            plain = re.match(r"[a-z0-9]*(?![?*{])", unit)[0]
        whole = plain and plain == unit
        run += f" {plain} " if whole else f" {plain}" if plain else ""
        needed = max(needed, run, key=len)
        run = run if whole else ""
    return out, needed


def rules(raw: bool = False) -> list[tuple[int, str, int, str, str]]:
    """(number, label, priority, regex, keyword) in order, the base phrases first; ``raw``: as written, not as regexes."""
    lines = [(label, 2, phrase) for phrase, label in BASE.items()]
    lines += [(label, int(priority), rule) for label, priority, rule in (re.split(r" \| ", x, maxsplit=2) for x in RULES.strip().splitlines())]
    lines += [(label, 4, f"spdx licen[cs]e identifier {name}") for label, name in SPDX.items()]
    lines += [(label, 3, f"licen[cs]e {name}") for label, name in SPDX.items()]
    return [(k, label, priority, *((rule, compile_rule(rule)[1]) if raw else compile_rule(rule))) for k, (label, priority, rule) in enumerate(lines)]


def needed_words(rule: str) -> list[str]:
    """Beginnings of words, of three signs or more, that a match can't be without; where there are none, the rule's first two words."""
    units = [unit for unit in rule.split() if unit[0] not in "*?"]
    return [m[0] for unit in units if (m := re.match(r"[a-z][a-z0-9]{2,}(?![?*{])", unit))] or [" ".join(units[:2])]


def gate_words() -> list[str]:
    """A few words of which each rule needs one, by greedy cover; where a text holds none of them, no rule matches."""
    needs = []
    for *_, rule, _ in rules(raw=True):
        words = needed_words(rule)
        words = [w for w in words if w not in COMMON] or words
        needs.append([w for w in words if len(w) > 5 and " " not in w] or words)  # longer words are rarer
    chosen: list[str] = []
    while needs:
        tally: dict[str, int] = {}
        for words in needs:
            for w in {p[:n] for p in words for n in range(len(p) if " " in p else min(5, len(p)), len(p) + 1)}:
                tally[w] = tally.get(w, 0) + 1
        best = max(tally, key=lambda w: (tally[w], len(w), w))
        chosen.append(best)
        needs = [words for words in needs if not any(best in w for w in words)]
    return chosen


def gate_of(text: Column) -> Column:
    """Whether a text in small letters holds one of the gate's words; two words may stand apart by any signs."""
    gate = F.lit(False)
    for word in gate_words():
        first, *rest = word.split()
        gate = gate | (F.contains(text, F.lit(first)) & F.rlike(text, F.lit(f"{first}{GAP}{rest[0]}")) if rest else F.contains(text, F.lit(first)))
    return gate


def _starts(wrapped: Column, pattern: Column) -> Column:
    """Numbers of the words at which matches begin."""
    marked = F.regexp_replace(wrapped, F.concat(F.lit(" ("), F.substring(pattern, 2, 10_000), F.lit(")")), F.lit(" \u0001$1"))
    words = F.split(F.btrim(marked), "  ")
    return F.filter(F.transform(words, lambda w, i: F.when(w.startswith("\u0001"), i).otherwise(-1)), lambda i: i >= 0)


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and n_kept (detections left) of every row of ``docs``."""
    known = rules()
    base = len(BASE)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = F.regexp_extract_all(F.translate("text", letters, letters.lower()), F.lit(WORD), 0)
    table = F.array(*(F.struct(F.lit(k).alias("rule"), F.lit(label).alias("label"), F.lit(p).alias("priority"), F.lit(pattern).alias("pattern"), F.lit(keyword).alias("keyword")) for k, label, p, pattern, keyword in known))
    some = texts(docs).select("doc_id", F.size(F.regexp_extract_all("text", F.lit(WORD), 0)).cast("long").alias("n_words"), F.when(gate_of(F.lower("text")), F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" "))).alias("wrapped"))
    some = some.withColumn("passed", F.when(F.col("wrapped").isNotNull(), F.filter(table, lambda r: F.contains(F.col("wrapped"), r["keyword"]))))

    def found(r: Column) -> Column:
        sizes = F.transform(F.regexp_extract_all("wrapped", r["pattern"], F.lit(0)), lambda m: F.floor((F.length(m) - F.length(F.replace(m, F.lit(" "), F.lit("")))) / 2).cast("int"))
        return F.zip_with(_starts(F.col("wrapped"), r["pattern"]), sizes, lambda s, n: F.struct(s.cast("long").alias("start"), (s + n).cast("long").alias("end"), r["priority"].alias("priority"), r["rule"].alias("rule"), r["label"].alias("label")))

    # whatever contains a hit comes before it in this order
    ordered = F.array_sort(F.transform(F.flatten(F.transform("passed", found)), lambda h: F.struct(h["start"], (-h["end"]).alias("end"), (-h["priority"]).alias("priority"), h["rule"], h["label"])))
    none = F.array().cast("array<string>")
    begin = F.struct(
        *(F.lit(-1).cast("long").alias(f"reach_{p}") for p in WEIGHTS), F.lit(0).cast("long").alias("n_base"), F.lit(None).cast("long").alias("first_word"), F.lit(None).cast("long").alias("last_word"),
        none.alias("base_labels"), none.alias("labels"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("n_kept"),
    )

    def step(acc: Column, h: Column) -> Column:
        """``acc`` holds how far hits of each priority or more reach so far, and the results."""
        end, priority, is_base, contained, weight = -h["end"], -h["priority"], h["rule"] < base, F.lit(False), F.lit(0.0)
        for p, w in WEIGHTS.items():
            contained = F.when(priority == p, acc[f"reach_{p}"] >= end).otherwise(contained)
            weight = F.when(priority == p, w).otherwise(weight)
        label = F.array(h["label"])
        return F.struct(
            *(F.when(priority >= p, F.greatest(acc[f"reach_{p}"], end)).otherwise(acc[f"reach_{p}"]).alias(f"reach_{p}") for p in WEIGHTS),
            (acc["n_base"] + is_base.cast("long")).alias("n_base"),
            F.when(is_base, F.coalesce(acc["first_word"], h["start"])).otherwise(acc["first_word"]).alias("first_word"),
            F.when(is_base, h["start"]).otherwise(acc["last_word"]).alias("last_word"),
            F.when(is_base, F.array_union(acc["base_labels"], label)).otherwise(acc["base_labels"]).alias("base_labels"),
            F.when(is_base | ~contained, F.array_union(acc["labels"], label)).otherwise(acc["labels"]).alias("labels"),
            F.when(contained, acc["score"]).otherwise(F.greatest(acc["score"], weight)).alias("score"),
            (acc["n_kept"] + (~contained).cast("long")).alias("n_kept"),
        )

    hits = some.select("doc_id", "n_words", F.aggregate(F.coalesce(ordered, F.array().cast("array<struct<start:bigint,end:bigint,priority:int,rule:int,label:string>>")), begin, step).alias("hits"))
    joined = lambda c: F.array_join(F.array_sort(F.col(f"hits.{c}")), ",").alias(c)
    return hits.select("doc_id", "n_words", "hits.n_base", "hits.first_word", "hits.last_word", joined("base_labels"), joined("labels"), "hits.score", "hits.n_kept")


def oracle() -> str:
    """The same in DuckDB's SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ",\n".join(f"({k}, {quote(label)}, {p}, {quote(pattern)}, {quote(keyword)})" for k, label, p, pattern, keyword in rules())
    weight = " ".join(f"when {p} then {w}::double" for p, w in WEIGHTS.items())
    contained = " ".join(f"when {p} then coalesce(max(case when priority >= {p} then stop end) over w >= stop, false)" for p in WEIGHTS)
    base = len(BASE)
    return rf"""
with rules(rule, label, priority, pattern, keyword) as (values {values}),
docs as (select row_number() over () as row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents),
wrapped as (select row, ' ' || array_to_string(words, '  ') || ' ' as t from docs),
marked as (select row, rule, label, priority, regexp_extract_all(t, pattern) as m, string_split(trim(regexp_replace(t, ' (' || substr(pattern, 2) || ')', ' ' || chr(1) || '\1', 'g'), ' '), '  ') as w from wrapped join rules on contains(t, keyword) where regexp_matches(t, pattern)),
starts as (select row, rule, label, priority, m, list_filter(list_transform(range(len(w)), lambda i: case when starts_with(w[i + 1], chr(1)) then i else -1 end), lambda i: i >= 0) as s from marked),
hits as (select row, rule, label, priority, unnest(s) as start, unnest(list_transform(m, lambda x: (length(x) - length(replace(x, ' ', ''))) // 2)) as size from starts),
ends as (select *, start + size as stop from hits),
judged as (select *, case priority {contained} end as contained from ends window w as (partition by row order by start, stop desc, priority desc, rule rows between unbounded preceding and 1 preceding)),
grouped as (select row, count(*) filter (where rule < {base}) as n_base, min(start) filter (where rule < {base}) as first_word, max(start) filter (where rule < {base}) as last_word,
  array_to_string(list_sort(list(distinct label) filter (where rule < {base})), ',') as base_labels, array_to_string(list_sort(list(distinct label) filter (where rule < {base} or not contained)), ',') as labels,
  max(case when contained then 0::double else case priority {weight} end end) as score, count(*) filter (where not contained) as n_kept from judged group by row)
select doc_id, cast(len(words) as bigint) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0::double) as score, coalesce(n_kept, 0) as n_kept
from docs left join grouped using (row)
"""
