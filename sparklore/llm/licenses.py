"""License scans by template markup (op 10).

A template is the wording of a license notice with two kinds of regions in it, both compiled
into one token automaton:

- ``[[ ... ]]``: optional words, nested at will;
- ``{{name:a..b}}``: replaceable, any ``a`` to ``b`` words.

Everything else is mandatory and must match word by word. Words are runs of ASCII letters and digits and of all
other characters above U+007F, lower case in A-Z. A text holds a license where a path through the
automaton accepts consecutive words. The automaton starts at its rarest way in: a text is searched
for the mandatory words that every match begins with, and runs only from there. Templates that begin with the same words share these
starts; a long text with one changed mandatory word is left at that word.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from sparklore.llm.common import of_worker, texts_of, with_arrow
from sparklore.llm.license_texts import WHOLE_TEXTS

# Fixed values of the contract: phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Wording of short license notices (public texts), with markup; whole texts are in ``license_texts``.
NOTICES: dict[str, str] = {
    "apache-2.0": "licensed under the apache license [[,]] version 2 0",
    "mit": "released under the mit license",
    "gpl-3.0": "licensed under the [[gnu]] general public license [[as published by the free software foundation]] "
               "[[either]] version 3 [[0]] [[of the license]]",
    "gpl-2.0": "licensed under the [[gnu]] general public license [[as published by the free software foundation]] "
               "[[either]] version 2 [[0]] [[of the license]]",
    "cc-by-nc-4.0": "licensed under [[a]] [[the]] cc by nc [[license]] [[version]] 4 0",
    "cc-by-4.0": "licensed under [[a]] [[the]] cc by [[license]] [[version]] 4 0",
    "cc-by-sa-4.0": "licensed under [[a]] [[the]] cc by sa [[license]] [[version]] 4 0",
    "copyright-notice": "copyright [[c]] {{year:1..2}} [[by]] {{holder:1..6}} all rights reserved",
}
TEMPLATES: dict[str, str] = NOTICES | WHOLE_TEXTS
_WORD_BYTES = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
                    for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_WORD_BYTES).split()


class Automaton:
    """States are numbers; each has words that lead on, possibly a step by any word, and free steps."""

    def __init__(self, template: str):
        self.by_word: list[dict[bytes, int]] = [{}]
        self.by_any: list[int] = [-1]
        self.free: list[list[int]] = [[]]
        tokens = re.findall(r"\[\[|\]\]|\{\{[^}]*\}\}|[^\[\]{}]+", template)
        end, rest = self._sequence(0, tokens, 0)
        if rest != len(tokens):
            raise ValueError(f"unbalanced markup in {template!r}")
        self.accepts = end
        first = self._closure({0})
        if end in first or any(self.by_any[s] >= 0 for s in first):
            raise ValueError("a template must begin with a mandatory or optional word")
        #: The words a match can begin with.
        self.starts = {w for s in first for w in self.by_word[s]}

    def _new(self) -> int:
        self.by_word.append({})
        self.by_any.append(-1)
        self.free.append([])
        return len(self.free) - 1

    def _sequence(self, state: int, tokens: list[str], i: int) -> tuple[int, int]:
        while i < len(tokens) and tokens[i] != "]]":
            token = tokens[i]
            if token == "[[":
                inside = self._new()
                self.free[state].append(inside)
                end, i = self._sequence(inside, tokens, i + 1)
                if i >= len(tokens):
                    raise ValueError("an optional region has no end")
                after = self._new()
                self.free[state].append(after)
                self.free[end].append(after)
                state = after
            elif token.startswith("{{"):
                low, high = map(int, re.fullmatch(r"\{\{[^:}]*:(\d+)\.\.(\d+)\}\}", token).groups())
                ways = []
                for n in range(high):
                    if n >= low:
                        ways.append(state)
                    following = self._new()
                    self.by_any[state] = following
                    state = following
                for s in ways:
                    self.free[s].append(state)
            else:
                for word in words_of(token):
                    fresh = self._new()     # a state of its own, so that words never join two regions
                    self.free[state].append(fresh)
                    following = self._new()
                    self.by_word[fresh][word] = following
                    state = following
            i += 1
        return state, i

    def _closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states

    def longest(self, words: list[bytes], start: int) -> int:
        """End of the longest accepted run of words from ``start``; -1 if there is none."""
        states, best = self._closure({0}), -1
        for i in range(start, len(words)):
            word = words[i]
            states = {t for s in states for t in (self.by_word[s].get(word, -1), self.by_any[s]) if t >= 0}
            if not states:
                break
            states = self._closure(states)
            if self.accepts in states:
                best = i + 1
        return best


def _starts(joined: bytes, wanted: bytes):
    """Numbers of the words at which ``wanted`` (blanks around it) stands in the joined words."""
    at, number, counted = joined.find(wanted), 0, 0
    while at >= 0:
        number += joined.count(b" ", counted, at)
        counted = at
        yield number
        at = joined.find(wanted, at + 1)


class Scanner:
    def __init__(self, templates: dict[str, str], phrases: dict[str, str]):
        self.phrases = [(b" " + b" ".join(words_of(p)) + b" ", label) for p, label in phrases.items()]
        self.automata = {label: Automaton(t) for label, t in templates.items()}
        #: First words of templates, and of which templates.
        self.starts: dict[bytes, list[str]] = {}
        for label, a in self.automata.items():
            for w in a.starts:
                self.starts.setdefault(w, []).append(label)

    def scan(self, text: str) -> dict:
        words = words_of(text)
        joined = b" " + b" ".join(words) + b" "
        places = []                                       # (start, end, label) of phrases
        for phrase, label in self.phrases:
            places += [(start, start + phrase.count(b" ") - 1, label) for start in _starts(joined, phrase)]
        found = []                                        # of templates
        for first, labels in self.starts.items():
            for start in _starts(joined, b" " + first + b" "):
                for label in labels:
                    end = self.automata[label].longest(words, start)
                    if end >= 0:
                        found.append((start, end, label))
        covered, upto = 0, 0
        for start, end, _ in sorted(places + found):
            covered += max(0, end - max(start, upto))
            upto = max(upto, end)
        return {"n_words": len(words), "places": sorted(places), "found": sorted(found),
                "score": covered / len(words) if words else 0.0}


SPAN = "array<struct<start:long,end:long,label:string>>"


def scan(docs: DataFrame, text: str = "text", templates: dict[str, str] | None = None,
         phrases: dict[str, str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with n_words, phrases and templates (spans in words, end exclusive), score.

    ``templates``: spans of accepted license notices, from each start the longest. ``score``: share of
    the words that stand in a span. Null counts as the empty text: no words, no spans, score 0. Columns of
    ``docs`` with these names are replaced.
    """
    used = (TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases)
    new = {"n_words": "long", "phrases": SPAN, "templates": SPAN, "score": "double"}
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string())]))

    def run(batch: pa.RecordBatch) -> dict:
        scanner = of_worker(("licenses", repr(used)), lambda: Scanner(*used))     # automata are compiled once per worker
        rows = [scanner.scan(t) for t in texts_of(batch.column(0))]
        spans = [[[dict(zip(("start", "end", "label"), s)) for s in r[k]] for r in rows] for k in ("places", "found")]
        return {"n": pa.array([r["n_words"] for r in rows], pa.int64()), "p": pa.array(spans[0], span),
                "t": pa.array(spans[1], span), "s": pa.array([r["score"] for r in rows], pa.float64())}

    return with_arrow(docs, run, new, [text], [c for c in (docs.columns if keep is None else keep) if c not in new],
                      state=True)
