"""License scans: phrases against brute force, templates by cases."""

import random
import re

import pytest

from sparklore.llm import licenses

SCHEMA = "doc_id long, text string, n_words string, score string, phrases string"


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))


def brute(t):
    w = words(t)
    return sorted((i, i + len(p.split()), label) for p, label in licenses.PHRASES.items() for i in range(len(w))
                  if w[i:i + len(p.split())] == p.split())


def test_phrases_equal_brute_force():
    rng, scanner = random.Random(8), licenses.Scanner(licenses.TEMPLATES, licenses.PHRASES)
    parts = ["cc", "by", "CC-BY", "general", "public", "license", "all", "rights", "reserved.", "é", "by\x85", "İ", "x_y", "\n", "  ", "All rights"]
    for _ in range(1500):
        t = "".join(rng.choice(parts) + rng.choice([" ", "-", "", "\x7f"]) for _ in range(rng.randint(0, 25)))
        got = scanner.scan(t)
        assert got["n_words"] == len(words(t)) and got["places"] == brute(t), repr(t)
        assert 0 <= got["score"] <= 1


@pytest.mark.parametrize("template, text, end", [
    ("a [[b]] c", "a b c", 3), ("a [[b]] c", "a c", 2), ("a [[b]] c", "a b b c", -1), ("a [[b [[c]] d]] e", "a b d e", 4),
    ("a [[b [[c]] d]] e", "a b c d e", 5), ("a [[b [[c]] d]] e", "a c e", -1), ("a {{x:1..2}} b", "a q b", 3), ("a {{x:1..2}} b", "a q r b", 4),
    ("a {{x:1..2}} b", "a b", -1), ("a {{x:1..2}} b", "a b b", 3), ("a {{x:0..2}} b", "a b x b", 4), ("[[a]] b", "b", 1), ("a [[b]]", "a b", 2)])
def test_automaton(template, text, end):
    assert licenses.Automaton(template).longest(words(text) and licenses.words_of(text), 0) == end


@pytest.mark.parametrize("template", ["a [[b", "a ]] b", "{{x:0..1}} a", "[[a]]"])
def test_bad_templates(template):
    with pytest.raises(ValueError):
        licenses.Automaton(template)


def test_scan(spark):
    rows = [(1, "Licensed under CC BY-NC 4.0."), (2, "Licensed under the Apache License, Version 2.0."), (3, "Released under the MIT License."),
            (4, "This work is licensed under the GNU General Public License, version 3."), (5, "All rights reserved."), (6, None), (6, None), (7, ""),
            (8, "word " * 20000 + "licensed under the apache license version 2 1"), (9, "Copyright (c) 2020 by Some One. All rights reserved.")]
    table = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    got = sorted((r["doc_id"], r["n_words"], [p["label"] for p in r["phrases"]], [p["label"] for p in r["templates"]], round(r["score"], 2))
                 for r in licenses.scan(table).collect())
    assert got == [(1, 7, ["cc-by"], ["cc-by-nc-4.0"], 1.0), (2, 8, [], ["apache-2.0"], 1.0), (3, 5, [], ["mit"], 1.0),
                   (4, 12, ["gpl"], ["gpl-3.0"], 0.75), (5, 3, ["reserved"], [], 1.0), (6, 0, [], [], 0.0), (6, 0, [], [], 0.0), (7, 0, [], [], 0.0),
                   (8, 20008, [], [], 0.0), (9, 9, ["reserved"], ["copyright-notice"], 1.0)]
    assert licenses.scan(table.limit(0)).collect() == []


def plain(template):
    """A text of a template: optional words left out, replaceable ones filled in."""
    while "[[" in template:
        template = re.sub(r"\[\[[^\[\]]*\]\]", " ", template)
    return re.sub(r"\{\{[^}]*\}\}", "Some Holder", template)


@pytest.mark.parametrize("label", sorted(licenses.WHOLE_TEXTS))
def test_whole_texts(label):
    rng, scanner = random.Random(3), licenses.Scanner(licenses.TEMPLATES, licenses.PHRASES)
    template = licenses.WHOLE_TEXTS[label]
    text = plain(template)
    full = re.sub(r"\{\{[^}]*\}\}", "The Holders of it", template.replace("[[", "").replace("]]", ""))     # all optional words in
    for t in (text, full, "Intro words.\n" + text.upper() + "\nmore words", text.replace(" ", "\n * ")):
        assert label in {x for _, _, x in scanner.scan(t)["found"]}, t
    mandatory = [w.decode() for w in licenses.words_of(text)]
    fixed = [i for i, w in enumerate(mandatory) if w not in ("some", "holder")]
    # A word next to a replaceable region may be taken into it, so changed words are taken from within the wording.
    inner = [i for i in fixed if {i - 1, i + 1} <= set(fixed) and 0 < i < len(mandatory) - 1]
    for i in rng.sample(inner, min(40, len(inner))):
        changed = " ".join(mandatory[:i] + ["xyzzy"] + mandatory[i + 1:])
        assert label not in {x for _, _, x in scanner.scan(changed)["found"]}, (i, mandatory[i])
        dropped = " ".join(mandatory[:i] + mandatory[i + 1:])
        assert mandatory[i] in (mandatory[i - 1], mandatory[i + 1]) or label not in {x for _, _, x in scanner.scan(dropped)["found"]}, (i, mandatory[i])


def test_first_sentences_are_no_license():
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.PHRASES)
    for t in ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
              "Redistribution and use in source and binary forms, with or without modification, are permitted",
              "This software is provided 'as-is', without any express or implied warranty."):
        assert scanner.scan(t)["found"] == []
    two, three = (plain(licenses.WHOLE_TEXTS[f"bsd-{n}-clause-text"]) for n in (2, 3))
    assert [x for _, _, x in scanner.scan(two)["found"]] == ["bsd-2-clause-text"]
    assert [x for _, _, x in scanner.scan(three)["found"]] == ["bsd-3-clause-text"]
