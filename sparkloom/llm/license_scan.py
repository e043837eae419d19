"""License scans by ordered signature rules, in DataFrame operations alone.

A text becomes its words, joined by one space. Each rule has a regex over the words, keywords, a label and a priority. Every
match contains one of the keywords as a word, so the regex is tried only on texts that have it: the words of a text are
intersected with all keywords once, and the few that are left decide which rules run. Detections are intervals of words. One
is suppressed if another interval contains it and has a higher priority, or the same and more words.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from .common import ascii_lower, table

#: Labels and phrases whose places are counted in any case.
BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
BASE_PRIORITY = 60
#: Words that stand in texts of all kinds, and so make poor keywords.
COMMON = frozenset("a an the of in to and or for by with without under is are as any no not this that it from on version you must may shall see all first second free open work works use used using new one two other use be".split())


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    keywords: tuple[str, ...]
    regex: str


def needed_words(regex: str) -> list[str]:
    """Words that each match of a regex contains: those outside of groups, classes and optional letters."""

    def hole(group: re.Match) -> str:
        # What a group stands beside is a whole word if a space is between them in all of its alternatives.
        parts = group[1].split("|")
        return " " * all(p.startswith(" ") for p in parts) + "\0" + " " * all(p.endswith(" ") for p in parts)

    plain, last = regex, None
    while plain != last:  # from the innermost group on
        last, plain = plain, re.sub(r"\((?:\?:)?([^()]*)\)[?*]?", hole, plain)
    plain = re.sub(r"\[[^\]]*\]\??|.\?|\\.", "\0", plain)
    return [w for w in plain.split(" ") if w and "\0" not in w]


def keywords_of(regex: str) -> tuple[str, ...]:
    """The keyword that is rarest by its length, if the regex has one; else both spellings of license."""
    words = [w for w in needed_words(regex) if w not in COMMON]
    if words:
        return (max(words, key=lambda w: (not w.isdigit(), len(w), w)),)
    for spelled in ("licen[cs]ed", "licen[cs]es", "licen[cs]e"):
        if re.search(rf"(?:^| ){re.escape(spelled)}(?: |$)", regex):
            return (spelled.replace("[cs]", "s"), spelled.replace("[cs]", "c"))
    raise ValueError(f"name the keywords of the rule {regex}")


#: Signatures that no family of names gives: label, priority, regex, and keywords where keywords_of() finds no good one.
SIGNATURES = (
    ("bsd", 40, r"(?:new |modified |simplified |revised )?bsd (?:style )?licen[cs]ed?"),
    ("bsd-2-clause", 55, r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("mit", 50, r"(?:the )?mit licen[cs]ed?"),
    ("mit", 55, r"(?:released|licen[cs]ed|distributed|available|provided) under (?:the )?(?:terms of (?:the )?)?mit(?: licen[cs]e)?"),
    ("mit", 80, r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", 90, r"spdx licen[cs]e identifier mit"),
    ("mit", 45, r"(?:x11|expat) licen[cs]e", "x11", "expat"),
    ("isc", 55, r"(?:the )?isc licen[cs]e"),
    ("isc", 60, r"permission to use copy modify and or distribute this software for any purpose"),
    ("isc", 90, r"spdx licen[cs]e identifier isc"),
    ("zlib", 55, r"zlib (?:libpng )?licen[cs]e"),
    ("unlicense", 60, r"(?:the )?unlicen[cs]e", "unlicense", "unlicence"),
    ("unlicense", 70, r"free and unencumbered software released into the public domain"),
    ("wtfpl", 60, r"wtfpl(?: version 2)?"),
    ("wtfpl", 65, r"do what the fuck you want to public licen[cs]e"),
    ("psf-2.0", 60, r"python software foundation licen[cs]e"),
    ("postgresql", 60, r"postgresql licen[cs]e"),
    ("ncsa", 60, r"university of illinois ncsa open source licen[cs]e"),
    ("ms-pl", 60, r"microsoft public licen[cs]e"),
    ("ms-rl", 60, r"microsoft reciprocal licen[cs]e"),
    ("public-domain", 50, r"(?:in|into|to) the public domain"),
    ("public-domain", 55, r"dedicated to the public domain"),
    ("proprietary", 35, r"all rights reserved"),
    ("proprietary", 45, r"proprietary (?:and confidential|licen[cs]e)"),
    ("proprietary", 45, r"end user licen[cs]e agreement"),
    ("proprietary", 45, r"eula"),
    ("no-warranty", 20, r"as is without warranty of any kind"),
    ("see-license", 15, r"see (?:the )?licen[cs]e(?: file)?(?: for (?:more )?(?:details|information))?", "license", "licence"),
    ("license-reference", 10, r"licen[cs]ed under the"),
    ("beerware", 60, r"(?:the )?beer ware licen[cs]e", "beer"),
    ("beerware", 70, r"you can buy me a beer in return"),
    ("json", 60, r"json licen[cs]e"),
    ("json", 75, r"the software shall be used for good not evil"),
    ("openssl", 60, r"openssl licen[cs]e"),
    ("openssl", 70, r"this product includes software developed by the openssl project"),
    ("openssl", 70, r"includes cryptographic software written by eric young"),
    ("php", 60, r"php licen[cs]e"),
    ("php", 70, r"this product includes php software"),
    ("ruby", 60, r"ruby licen[cs]e"),
    ("vim", 60, r"vim licen[cs]e"),
    ("w3c", 60, r"w3c software (?:notice and )?(?:and document )?(?:notice and )?licen[cs]e"),
    ("zpl", 60, r"zope public licen[cs]e"),
    ("zpl-2.1", 70, r"zope public licen[cs]e (?:version )?2 1"),
    ("npl", 60, r"netscape public licen[cs]e"),
    ("ipl-1.0", 65, r"ibm public licen[cs]e(?: version)? 1 0"),
    ("cpl-1.0", 65, r"common public licen[cs]e(?: version)? 1 0"),
    ("cpl", 50, r"common public licen[cs]e", "common"),
    ("sleepycat", 60, r"sleepycat (?:software )?(?:public )?licen[cs]e"),
    ("qpl", 60, r"q public licen[cs]e", "q"),
    ("watcom", 60, r"sybase open watcom (?:public )?licen[cs]e"),
    ("rpsl", 60, r"realnetworks public source licen[cs]e"),
    ("spl", 60, r"sun public licen[cs]e"),
    ("sissl", 60, r"sun industry standards source licen[cs]e"),
    ("apsl", 60, r"apple public source licen[cs]e"),
    ("apsl-2.0", 70, r"apple public source licen[cs]e (?:version )?2 0"),
    ("apl-1.0", 60, r"adaptive public licen[cs]e"),
    ("aal", 60, r"attribution assurance licen[cs]e"),
    ("lppl", 60, r"latex project public licen[cs]e"),
    ("lppl-1.3c", 70, r"latex project public licen[cs]e (?:version )?1 3c"),
    ("lpl", 60, r"lucent public licen[cs]e"),
    ("motosoto", 60, r"motosoto open source licen[cs]e"),
    ("naumen", 60, r"naumen public licen[cs]e"),
    ("nethack", 60, r"nethack general public licen[cs]e"),
    ("oclc-2.0", 60, r"oclc research public licen[cs]e(?: version)? 2 0"),
    ("pddl-1.0", 65, r"(?:open data commons )?public domain dedication and licen[cs]e"),
    ("odc-by-1.0", 65, r"open data commons attribution licen[cs]e"),
    ("odbl", 60, r"open data commons open database licen[cs]e"),
    ("mit-0", 65, r"mit no attribution(?: licen[cs]e)?"),
    ("mit-0", 65, r"mit 0"),
    ("0bsd", 65, r"0bsd"),
    ("0bsd", 75, r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided"),
    ("blueoak-1.0.0", 65, r"blue oak model licen[cs]e(?: 1 0 0)?"),
    ("commons-clause", 65, r"commons clause licen[cs]e condition(?: v1 0)?"),
    ("commons-clause", 60, r"commons clause", "clause"),
    ("elastic-2.0", 65, r"elastic licen[cs]e (?:version )?2 0"),
    ("elastic", 55, r"elastic licen[cs]e"),
    ("sspl-1.0", 65, r"server side public licen[cs]e(?: (?:version |v ?)?1)?"),
    ("sspl-1.0", 60, r"sspl(?: 1 0)?"),
    ("busl-1.1", 65, r"business source licen[cs]e(?: 1 1)?"),
    ("busl-1.1", 65, r"busl 1 1"),
    ("polyform-noncommercial", 65, r"polyform noncommercial licen[cs]e"),
    ("polyform-small-business", 65, r"polyform small business licen[cs]e"),
    ("polyform-strict", 65, r"polyform strict licen[cs]e"),
    ("llama-community", 65, r"llama (?:2 |3 |3 1 |3 2 |3 3 )?community licen[cs]e(?: agreement)?"),
    ("openrail", 60, r"(?:creativeml )?(?:bigscience )?open ?rail(?: m)? licen[cs]e", "openrail", "rail"),
    ("openrail", 60, r"creativeml open rail m"),
    ("gemma", 60, r"gemma terms of use"),
    ("cdla-permissive-1.0", 65, r"community data licen[cs]e agreement permissive(?: version)?(?: 1 0)?"),
    ("cdla-sharing-1.0", 65, r"community data licen[cs]e agreement sharing(?: version)?(?: 1 0)?"),
    ("cdla-permissive-2.0", 70, r"cdla permissive 2 0"),
    ("cdla-permissive-1.0", 70, r"cdla permissive 1 0"),
    ("hippocratic", 60, r"hippocratic licen[cs]e"),
    ("anti-996", 60, r"anti 996 licen[cs]e"),
    ("unicode", 60, r"unicode (?:data files and software )?licen[cs]e(?: agreement)?"),
    ("ftl", 60, r"freetype (?:project )?licen[cs]e"),
    ("libpng", 60, r"libpng licen[cs]e"),
    ("ijg", 65, r"independent jpeg group (?:s )?licen[cs]e"),
    ("ijg", 60, r"this software is based in part on the work of the independent jpeg group"),
    ("curl", 60, r"curl licen[cs]e"),
    ("tcl", 60, r"tcl tk licen[cs]e"),
    ("hpnd", 60, r"historical permission notice and disclaimer"),
    ("cnri-python", 60, r"cnri (?:open source )?licen[cs]e(?: agreement)?"),
    ("python-2.0", 65, r"python licen[cs]e (?:version )?2 0"),
    ("ecl-2.0", 65, r"educational community licen[cs]e(?: version)?(?: 2 0)?"),
    ("efl-2.0", 65, r"eiffel forum licen[cs]e(?: version)?(?: 2)?"),
    ("eudatagrid", 60, r"eu datagrid software licen[cs]e"),
    ("fair", 60, r"fair licen[cs]e"),
    ("frameworx", 60, r"frameworx (?:open )?licen[cs]e"),
    ("ipa", 60, r"ipa font licen[cs]e"),
    ("lgpllr", 60, r"lesser general public licen[cs]e for linguistic resources"),
    ("miros", 60, r"miros licen[cs]e"),
    ("mulanpsl-2.0", 65, r"mulan permissive software licen[cs]e(?: v2| version 2)?"),
    ("mulanpsl-2.0", 65, r"mulanpsl (?:2 0|v2)"),
    ("nasa-1.3", 65, r"nasa open source agreement(?: 1 3)?"),
    ("ngpl", 60, r"nethack licen[cs]e"),
    ("ntp", 60, r"ntp licen[cs]e"),
    ("oset-pl-2.1", 60, r"oset (?:foundation )?public licen[cs]e"),
    ("rpl-1.5", 65, r"reciprocal public licen[cs]e(?: 1 5)?"),
    ("rscpl", 60, r"ricoh source code public licen[cs]e"),
    ("simpl-2.0", 60, r"simple public licen[cs]e(?: 2 0)?"),
    ("ucl-1.0", 60, r"upstream compatibility licen[cs]e"),
    ("upl-1.0", 65, r"universal permissive licen[cs]e(?: v ?1 0)?"),
    ("vsl-1.0", 60, r"vovida software licen[cs]e"),
    ("xnet", 60, r"x net licen[cs]e", "net"),
    ("zlib-acknowledgement", 60, r"zlib libpng licen[cs]e with acknowledgement"),
    ("zlib", 70, r"altered source versions must be plainly marked as such"),
    ("boost", 75, r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software"),
    ("apache-2.0", 75, r"licensed under the apache licen[cs]e version 2 0 the licen[cs]e you may not use this file except in compliance"),
    ("apache-2.0", 75, r"www apache org licenses license 2 0"),
    ("mpl-2.0", 75, r"this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0"),
    ("mpl-2.0", 75, r"mozilla org mpl 2 0"),
    ("gpl", 60, r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e"),
    ("lgpl", 60, r"this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e"),
    ("gpl", 45, r"www gnu org licenses gpl(?: html)?"),
    ("lgpl", 45, r"www gnu org licenses lgpl(?: html)?"),
    ("agpl", 45, r"www gnu org licenses agpl(?: html)?"),
    ("gpl-with-classpath-exception", 75, r"classpath exception"),
    ("gpl-with-font-exception", 70, r"gpl font exception"),
    ("gpl-with-autoconf-exception", 70, r"autoconf (?:configure script )?exception"),
    ("bsd-3-clause", 70, r"nor the names of its contributors may be used to endorse or promote products"),
    ("bsd-4-clause", 72, r"all advertising materials mentioning features or use of this software must display"),
    ("bsd", 60, r"redistributions of source code must retain the above copyright notice"),
    ("bsd", 60, r"redistributions in binary form must reproduce the above copyright notice"),
    ("mit", 60, r"the above copyright notice and this permission notice shall be included in all copies"),
    ("isc", 60, r"permission to use copy modify and distribute this software for any purpose with or without fee"),
    ("ofl", 65, r"this font software is licen[cs]ed under the sil open font licen[cs]e"),
    ("cc-by-sa", 60, r"licen[cs]ed under a creative commons attribution share ?alike", "commons"),
    ("cc-by", 58, r"licen[cs]ed under a creative commons attribution", "commons"),
    ("cc-by-sa", 60, r"released under cc by sa"),
    ("public-domain", 60, r"this work is in the public domain"),
    ("public-domain", 60, r"no copyright is claimed", "claimed"),
    ("public-domain", 60, r"placed in the public domain", "domain"),
    ("copyleft", 40, r"copyleft"),
    ("proprietary", 45, r"unauthorized (?:copying|distribution|use|reproduction)", "unauthorized"),
    ("proprietary", 45, r"confidential and proprietary"),
    ("proprietary", 45, r"trade secrets? of", "trade"),
    ("proprietary", 45, r"not for redistribution", "redistribution"),
    ("proprietary", 50, r"for internal use only", "internal"),
    ("proprietary", 40, r"reproduction in whole or in part (?:is prohibited|without (?:written )?permission)", "reproduction"),
    ("proprietary", 45, r"may not be (?:copied|reproduced|redistributed|reverse engineered)", "copied", "reproduced", "redistributed", "reverse"),
    ("non-commercial", 45, r"for non ?commercial (?:use|purposes) only", "commercial", "noncommercial"),
    ("non-commercial", 45, r"for (?:academic|research|personal) use only", "academic", "research", "personal"),
    ("non-commercial", 45, r"not for commercial use", "commercial"),
    ("dual-license", 40, r"dual licen[cs]ed"),
    ("dual-license", 40, r"licen[cs]ed under either of"),
    ("no-warranty", 20, r"without warranty of any kind"),
    ("no-warranty", 20, r"provided as is", "provided"),
    ("no-warranty", 25, r"without even the implied warranty of merchantability"),
    ("no-liability", 20, r"in no event shall the (?:authors?|copyright holders?|contributors?) be liable"),
    ("copyright", 12, r"copyright (?:c|notices?|holders?)"),
    ("copyright", 12, r"copyrighted"),
)


def _rules() -> list[Rule]:
    found: list[Rule] = []

    def add(label: str, priority: int, regex: str, *keywords: str) -> None:
        found.append(Rule(label, priority, keywords or keywords_of(regex), f"(?<= ){regex}(?= )"))

    # The GNU family: full and short names, with and without a version, "or later" and SPDX identifiers.
    later = r"(?: (?:of the license )?or (?:at your option )?any later version| or later)"
    gnu = {
        "gpl": (r"(?:gnu )?general public licen[cs]e", ("1", "2", "3")),
        "lgpl": (r"(?:gnu )?(?:lesser|library) general public licen[cs]e", ("2", "2 1", "3")),
        "agpl": (r"(?:gnu )?affero general public licen[cs]e", ("1", "3")),
        "gfdl": (r"(?:gnu )?free documentation licen[cs]e", ("1 1", "1 2", "1 3")),
    }
    for short, (name, versions) in gnu.items():
        add(short, 40, name)
        add(short, 30, short)
        for v in versions:
            dots = v.replace(" ", ".")
            zero = "" if " " in v else "(?: 0)?"
            full = rf"{name} (?:as published by the free software foundation )?(?:either )?(?:version|v) ?{v}{zero}"
            add(f"{short}-{dots}", 70, full)
            add(f"{short}-{dots}-or-later", 75, f"{full}{later}")
            # The version may follow the name without a space, as one word.
            names = (short, *(f"{short}{x}{v.split()[0]}" for x in ("", "v")))
            add(f"{short}-{dots}", 65, rf"{short}(?: version | v ?| |v)?{v}{zero}", *names)
            add(f"{short}-{dots}-or-later", 72, rf"{short}(?: version | v ?| |v)?{v}{zero}{later}", *names)
            add(f"{short}-{dots}", 90, rf"spdx licen[cs]e identifier {short} {v}{zero}(?: only)?")
            add(f"{short}-{dots}-or-later", 92, rf"spdx licen[cs]e identifier {short} {v}{zero} or later")
    # Creative Commons: short names, full names and addresses of every kind and version.
    parts = {"by": "attribution", "sa": r"share ?alike", "nd": r"no ?deriv(?:ative)?s?(?: works)?", "nc": r"non ?commercial"}
    for kind in ("by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd"):
        full = " ".join(parts[p] for p in kind.split())
        label, rank = "cc-" + kind.replace(" ", "-"), len(kind)
        add(label, 50 + rank, rf"cc {kind}", "cc")
        add(label, 50 + rank, rf"creative commons {full}(?: licen[cs]e)?", "commons")
        for v in ("1 0", "2 0", "2 5", "3 0", "4 0"):
            version = v.replace(" ", ".")
            add(f"{label}-{version}", 70 + rank, rf"cc {kind} v?{v}", "cc")
            add(f"{label}-{version}", 70 + rank, rf"creative commons {full} (?:licen[cs]e )?(?:version )?{v}(?: (?:international|unported|generic))?", "commons")
            add(f"{label}-{version}", 80 + rank, rf"creativecommons org licenses {kind} {v}", "creativecommons")
    add("cc0-1.0", 70, r"cc0(?: 1 0)?(?: universal)?")
    add("cc0-1.0", 75, r"creativecommons org publicdomain zero 1 0", "creativecommons")
    add("cc0-1.0", 70, r"creative commons (?:zero|public domain dedication)", "commons")
    # Versioned licenses: name, short name, versions.
    for label, name, short, versions in (
        ("apache", r"apache (?:software )?licen[cs]e", "apache", ("1 0", "1 1", "2 0")),
        ("mpl", r"mozilla public licen[cs]e", "mpl", ("1 0", "1 1", "2 0")),
        ("epl", r"eclipse public licen[cs]e", "epl", ("1 0", "2 0")),
        ("eupl", r"european union public licen[cs]e", "eupl", ("1 0", "1 1", "1 2")),
        ("cddl", r"common development and distribution licen[cs]e", "cddl", ("1 0", "1 1")),
        ("ofl", r"(?:sil )?open font licen[cs]e", "ofl", ("1 0", "1 1")),
        ("afl", r"academic free licen[cs]e", "afl", ("2 0", "2 1", "3 0")),
        ("artistic", r"artistic licen[cs]e", "artistic", ("1 0", "2 0")),
        ("osl", r"open software licen[cs]e", "osl", ("1 0", "2 0", "3 0")),
        ("bsl", r"boost software licen[cs]e", "bsl", ("1 0",)),
        ("odbl", r"open database licen[cs]e", "odbl", ("1 0",)),
        ("cecill", r"cecill free software licen[cs]e", "cecill", ("1 0", "2 0", "2 1")),
    ):
        add(label, 45, name)
        for v in versions:
            version, first = v.replace(" ", "."), v.split()[0]
            tail = rf"{v}" if v.split()[1] != "0" else rf"{first}(?: 0)?"
            add(f"{label}-{version}", 70, rf"{name} (?:version |v ?)?{tail}")
            add(f"{label}-{version}", 65, rf"{short} (?:version |v ?)?{tail}(?: licen[cs]e)?")
            add(f"{label}-{version}", 90, rf"spdx licen[cs]e identifier {short} {v}")
    # The BSD family by its number of clauses.
    numbers = {"0": "zero", "1": "one", "2": "two", "3": "three", "4": "four"}
    for digit, word in numbers.items():
        add(f"bsd-{digit}-clause", 70, rf"bsd (?:{digit}|{word}) clause(?: licen[cs]e)?", "bsd")
        add(f"bsd-{digit}-clause", 70, rf"(?:{digit}|{word}) clause bsd(?: licen[cs]e)?", "bsd")
        add(f"bsd-{digit}-clause", 90, rf"spdx licen[cs]e identifier {digit}?bsd {digit} clause")
    for label, priority, regex, *keywords in SIGNATURES:
        add(label, priority, regex, *keywords)
    return found


RULES = tuple(_rules())
#: A text without any of these words has no detection.
GATE = tuple(sorted({k for r in RULES for k in r.keywords} | {"mit", "apache", "cc"}))


def words_of(text: Column) -> Column:
    """The words in lower case, each between single spaces, with one at either end; empty for a text without words."""
    inner = F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    return F.when(inner == "", "").otherwise(F.concat(F.lit(" "), inner, F.lit(" ")))


def _spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


_INTERVALS = "array<struct<begin:int,end:int,label:string,priority:int>>"


def _intervals(words: Column, regex: Column, label: Column, priority: Column) -> Column:
    """The intervals [begin, end) of words where the regex matches, from the pieces between the matches."""
    empty = F.expr(f"cast(array() as {_INTERVALS})")

    def place(matches: Column) -> Column:
        zipped = F.arrays_zip(F.slice(F.split(words, regex, -1), F.lit(1), F.size(matches)).alias("piece"), matches.alias("match"))

        def step(acc: Column, x: Column) -> Column:
            at = acc["at"] + _spaces(x["piece"])
            end = at + _spaces(x["match"])
            one = F.struct((at - 1).alias("begin"), end.alias("end"), label.alias("label"), priority.alias("priority"))
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).cast(_INTERVALS).alias("out"))

        found = F.aggregate(zipped, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])
        return F.when(F.size(matches) > 0, found).otherwise(empty)

    # A list of one binds the matches, so that they are searched for once.
    return F.flatten(F.transform(F.array(F.regexp_extract_all(words, regex, F.lit(0))), place))


def detections(words: Column, present: Column, rules=RULES) -> Column:
    """All intervals of the rules of which a keyword is among the present ones."""
    table_of_rules = F.array(
        *(
            F.struct(F.lit(r.label).alias("label"), F.lit(r.priority).alias("priority"), F.array(*map(F.lit, r.keywords)).alias("keywords"), F.lit(r.regex).alias("regex"))
            for r in rules
        )
    )
    gated = F.filter(table_of_rules, lambda r: F.arrays_overlap(present, r["keywords"]))
    return F.flatten(F.transform(gated, lambda r: _intervals(words, r["regex"], r["label"], r["priority"])))


def base_places(words: Column) -> Column:
    found = [
        F.when(F.contains(words, F.lit(f" {phrase} ")), _intervals(words, F.lit(f"(?<= ){phrase}(?= )"), F.lit(label), F.lit(BASE_PRIORITY))).otherwise(
            F.expr(f"cast(array() as {_INTERVALS})")
        )
        for label, phrase in BASE
    ]
    return F.concat(*found)


def unsuppressed(found: Column) -> Column:
    """The intervals that no other one of higher priority, or of the same and more words, contains.

    They are gone through by their begins, longer and stronger ones first, so that what contains an interval came before it
    and has not ended yet; only such are kept at hand.
    """
    keyed = F.transform(found, lambda d: F.struct(d["begin"].alias("b"), (-d["end"]).alias("e"), (-d["priority"]).alias("p"), d.alias("d")))
    ordered = F.transform(F.array_sort(keyed), lambda x: x["d"])

    def step(acc: Column, d: Column) -> Column:
        at_hand = F.filter(acc["open"], lambda e: e["end"] > d["begin"])
        longer = lambda e: e["end"] - e["begin"] > d["end"] - d["begin"]
        beaten = F.exists(at_hand, lambda e: (e["end"] >= d["end"]) & ((e["priority"] > d["priority"]) | ((e["priority"] == d["priority"]) & longer(e))))
        return F.struct(
            F.concat(at_hand, F.array(d)).cast(_INTERVALS).alias("open"),
            F.when(beaten, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(d))).cast(_INTERVALS).alias("kept"),
        )

    empty = F.expr(f"cast(array() as {_INTERVALS})")
    return F.aggregate(ordered, F.struct(empty.alias("open"), empty.alias("kept")), step, lambda acc: acc["kept"])


def scan(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections.

    Null and empty texts have no words; long texts are read whole. ``n_base`` counts the places of the BASE phrases,
    first_word and last_word are the smallest and largest of their starts (null without any). ``labels`` joins the base
    labels and those of the detections that are not suppressed; equal intervals of equal priority all stay. The score is the
    largest priority among those and the base places, out of 100. Null ids and repeated rows pass through as they come, an
    empty table gives an empty result; further columns are not read; no rows are shuffled.
    """
    rows = docs.select("doc_id", words_of(F.col("text")).alias("_words"))
    present = F.array_intersect(F.split("_words", " "), F.array(*map(F.lit, GATE)))
    rows = rows.select("doc_id", "_words", present.alias("_present"))
    empty = F.expr(f"cast(array() as {_INTERVALS})")
    rows = rows.select(
        "doc_id",
        F.greatest(_spaces(F.col("_words")) - 1, F.lit(0)).cast("long").alias("n_words"),
        F.when(F.size("_present") > 0, F.struct(base_places(F.col("_words")).alias("base"), detections(F.col("_words"), F.col("_present")).alias("all"))).alias("_found"),
    )
    rows = rows.select("doc_id", "n_words", F.coalesce("_found.base", empty).alias("_base"), F.coalesce("_found.all", empty).alias("_all"))
    rows = rows.select("*", F.when(F.size("_all") > 0, unsuppressed(F.col("_all"))).otherwise(empty).alias("detections"))
    starts = F.transform("_base", lambda d: d["begin"].cast("long"))
    every = F.concat("_base", "detections")
    return rows.select(
        "doc_id",
        "n_words",
        F.size("_base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("_base", lambda d: d["label"]))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(every, lambda d: d["label"]))), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform(every, lambda d: d["priority"])) / 100.0, F.lit(0.0)).cast("double").alias("score"),
        "detections",
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("detections")


def _sql_regex(regex: str) -> str:
    """The regex over words with two spaces between them, each match with one of the spaces on either side."""
    inner = regex.removeprefix("(?<= )").removesuffix("(?= )")
    return " " + inner.replace(" ?", "\0").replace(" ", "  ").replace("\0", "(?:  )?") + " "


def _sql_rules() -> str:
    rows = [(r.label, r.priority, r.keywords, _sql_regex(r.regex), "false") for r in RULES]
    rows += [(label, BASE_PRIORITY, tuple(phrase.split()), _sql_regex(phrase), "true") for label, phrase in BASE]
    return ", ".join(f"({i}, '{label}', {priority}, [{', '.join(repr(k) for k in keywords)}], '{regex}', {base})" for i, (label, priority, keywords, regex, base) in enumerate(rows))


#: The same rules in another engine: places from the pieces between the matches, suppression by a join.
OP7_SQL = f"""
WITH rules AS (SELECT * FROM (VALUES {_sql_rules()}) v(rule, label, priority, keywords, regex, base)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
t AS (SELECT doc_id, w, '  ' || array_to_string(w, '  ') || '  ' AS s FROM d),
m AS (SELECT doc_id, rule, label, priority, base, regexp_extract_all(s, regex) AS found, string_split_regex(s, regex) AS pieces FROM t JOIN rules ON list_has_any(w, keywords)),
e AS (SELECT doc_id, rule, label, priority, base, unnest(found) AS x, generate_subscripts(found, 1) AS i, found, pieces FROM m WHERE len(found) > 0),
n AS (SELECT doc_id, label, priority, base, len(regexp_extract_all(x, '[^ ]+')) AS size,
  list_sum(list_transform(pieces[1:i], lambda p: len(regexp_extract_all(p, '[^ ]+')))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda p: len(regexp_extract_all(p, '[^ ]+')))), 0) AS b FROM e),
p AS (SELECT doc_id, label, priority, base, b::bigint AS b, (b + size)::bigint AS z FROM n),
o AS (SELECT * FROM p WHERE base OR NOT EXISTS (SELECT 1 FROM p AS q WHERE NOT q.base AND q.doc_id = p.doc_id AND q.b <= p.b AND q.z >= p.z
  AND (q.priority > p.priority OR (q.priority = p.priority AND q.z - q.b > p.z - p.b)))),
g AS (SELECT doc_id, count(*) FILTER (WHERE base) AS n_base, min(b) FILTER (WHERE base) AS first_word, max(b) FILTER (WHERE base) AS last_word,
  array_to_string(list_sort(list_distinct(list(label) FILTER (WHERE base))), ',') AS base_labels, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels, max(priority) / 100.0 AS score FROM o GROUP BY doc_id)
SELECT d.doc_id, len(w)::bigint AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::double AS score
FROM d LEFT JOIN g USING (doc_id)
"""
