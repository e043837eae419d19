import random
import re

from pyspark.sql import functions as F
from sparkloom.llm import license_scan as L

TEXTS = [
    (1, "Released under the MIT License. Copyright (c) 2020"),
    (2, None),
    (3, ""),
    (4, "!!! ---"),
    (5, "Licensed under the Apache License, Version 2.0; under the MIT license, and under the mit license"),
    (6, "CC BY-NC 4.0 and cc by nc. summit licenseX under the mit licenses"),
    (7, "This work is licensed under the GNU General Public License, version 3 or later."),
    (8, "SPDX-License-Identifier: GPL-2.0-only"),
    (9, "plain words only " * 3000 + " under the MIT license " + "filler " * 2000),
    (10, "Ünter thé mit license. under thé mit license. BSD 3-Clause license. All rights reserved."),
    (10, "Ünter thé mit license. under thé mit license. BSD 3-Clause license. All rights reserved."),
]
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def base_of(text):
    words = words_of(text)
    found = [(i, label) for label, phrase in L.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), len(found), min((i for i, _ in found), default=None), max((i for i, _ in found), default=None), ",".join(sorted({x for _, x in found}))


def detect(text):
    """The rules by Python's own engine, without keywords."""
    words = words_of(text)
    joined = " " + " ".join(words) + " " if words else ""
    found = set()
    for r in L.RULES:
        if words:
            for m in re.finditer(r.regex, joined):
                begin = joined[: m.start()].count(" ") - 1
                found.add((begin, begin + m.group().count(" ") + 1, r.label, r.priority))
    return {d for d in found if not any(e[0] <= d[0] and e[1] >= d[1] and (e[3] > d[3] or e[3] == d[3] and e[1] - e[0] > d[1] - d[0]) for e in found)}


def test_matches_python(spark):
    docs = spark.createDataFrame([(*t, 1, "x") for t in TEXTS], "doc_id long, text string, n_words int, labels string")
    got = L.scan(docs).collect()
    assert len(got) == len(TEXTS)
    texts = dict(TEXTS)
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_of(texts[r.doc_id])
        assert {tuple(d) for d in r.detections} == detect(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1
    labels = {r.doc_id: r.labels for r in got}
    assert labels[7] == "gpl-3-or-later,license-reference" and labels[8] == "gpl-2" and labels[2] == labels[4] == ""


def test_rules_are_many_and_valid():
    assert len(L.RULES) > 400 and len(L.SIGNATURES) > 150
    for r in L.RULES:
        assert re.compile(r.regex) and not re.search(r.regex, "")


def test_plan_is_native_without_shuffle(spark, docs):
    plan = L.scan(docs.select("doc_id", "text"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Join" not in plan and "Aggregate" not in plan


def test_empty_table(empty):
    assert L.scan(empty).collect() == []


def examples(regex):
    """Texts that a rule's regex matches: every branch of its groups once, with and without what is optional."""
    import itertools
    from re import _parser

    def expand(parsed):
        parts = []
        for op, value in parsed:
            name = str(op)
            if name == "LITERAL":
                parts.append([chr(value)])
            elif name == "IN":
                parts.append([chr(v) for _, v in value])
            elif name == "BRANCH":
                parts.append([x for branch in value[1] for x in expand(branch)])
            elif name == "SUBPATTERN":
                parts.append(expand(value[3]))
            elif name == "MAX_REPEAT":
                parts.append(([""] if value[0] == 0 else []) + expand(value[2]))
            else:
                assert name == "ASSERT", name
        return ["".join(x) for x in itertools.product(*parts)]

    return expand(_parser.parse(regex))


def test_every_match_has_a_keyword():
    for r in L.RULES:
        assert r.keywords and set(r.keywords) <= set(L.GATE)
        for text in examples(r.regex):
            assert re.search(r.regex, f" {text} ") and set(r.keywords) & set(text.split()), (r, text)


def test_every_rule_fires(spark):
    docs = spark.createDataFrame([(i, f"{max(examples(r.regex), key=len)}; x") for i, r in enumerate(L.RULES)], "doc_id long, text string")
    words = docs.select("doc_id", L.words_of(docs.text).alias("w"))
    present = F.array_intersect(F.split("w", " "), F.array(*map(F.lit, L.GATE)))
    found = {r.doc_id: {(d.label, d.priority) for d in r.d} for r in words.select("doc_id", L.detections(words.w, present).alias("d")).collect()}
    assert all((r.label, r.priority) in found[i] for i, r in enumerate(L.RULES))


def test_suppression_matches_comparing_all(spark):
    rng = random.Random(4)
    rows = []
    for i in range(60):
        found = [(b := rng.randint(0, 30), b + rng.randint(1, 6), rng.choice("xyz"), rng.choice([10, 20, 30])) for _ in range(rng.randint(0, 40))]
        rows.append((i, found))
    df = spark.createDataFrame(rows, f"i int, d {L._INTERVALS}")
    got = {r.i: sorted(map(tuple, r.u)) for r in df.select("i", L.unsuppressed(df.d).alias("u")).collect()}
    for i, found in rows:
        free = [d for d in found if not any(e[0] <= d[0] and e[1] >= d[1] and (e[3] > d[3] or e[3] == d[3] and e[1] - e[0] > d[1] - d[0]) for e in found)]
        assert got[i] == sorted(free)


def test_short_names_are_found_without_other_words(spark):
    texts = {"GFDL 1.3": "gfdl-1.3", "MPL 2.0": "mpl-2.0", "EPL 2.0": "epl-2.0", "EUPL 1.2": "eupl-1.2", "CDDL 1.0": "cddl-1.0", "OFL 1.1": "ofl-1.1", "OSL 3.0": "osl-3.0"}
    texts |= {"BSL 1.0": "bsl-1.0", "ODbL 1.0": "odbl-1.0", "CeCILL 2.1": "cecill-2.1", "EULA": "proprietary", "released under MIT": "mit", "proprietary and confidential": "proprietary"}
    texts["permission to use copy modify and or distribute this software for any purpose"] = "isc"
    docs = spark.createDataFrame([(i, f"see {t}, please") for i, t in enumerate(texts)], "doc_id long, text string")
    assert [r.labels for r in L.scan(docs).sort("doc_id").collect()] == list(texts.values())
