"""License scans by ordered signature rules (operator 12).

A text becomes its lower-cased words (``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased), joined by single
spaces.  ``license_rules`` holds some three hundred hand-written rules in falling priority.

1. Keyword prefilter: the words that every match of a pattern holds are read off the pattern (``needed_words``).  A text's
   set of words is met with the index of those words, so a text without license words tries no pattern, and none is
   skipped that could match.
2. Patterns of the rules that are left run over the whole text, at word borders.  Each match is an interval of words.
3. Suppression: matches are taken in the order of priority, longer ones first among equals; one that lies inside an interval
   already taken goes ("apache license" inside "apache license version 2 0").  Overlaps that are no containment stay.
4. The base phrases are fixed; all their places are counted and their labels stay whatever suppression says.

``score`` is the largest confidence of what is left (base phrases count as notices), 0 without a detection.

Cases: null and empty texts, and texts without words, have no words, places or labels and score 0; a null doc_id is kept;
very long texts are read whole; repeated rows are all answered; an empty table gives an empty result; other columns, also of
the same names as the results, are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.llm.common import slices
from foldspark.llm.license_rules import RULES_TEXT

# The base phrases and their labels.
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Confidence of a base phrase.
BASE_CONFIDENCE = 0.75

_SEPARATORS = bytes(c for c in range(128) if not (chr(c).isdigit() or chr(c).isalpha()))
_TO_WORDS = bytes.maketrans(_SEPARATORS + bytes(range(65, 91)), b" " * len(_SEPARATORS) + bytes(range(97, 123)))


def lower_words(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text: runs of ASCII letters, digits and all other characters above ASCII, A-Z lower-cased."""
    return text.translate(_TO_WORDS).split()


class Rule(NamedTuple):
    priority: int             # 0 goes first
    label: str
    confidence: float
    words: frozenset          # every match holds them
    pattern: re.Pattern


class Match(NamedTuple):
    rule: Rule
    first: int                # number of the first word
    last: int                 # number of the last word


def needed_words(pattern: str) -> frozenset[bytes]:
    """Words that every match holds: whole words of the pattern outside of groups, classes and quantified characters."""
    hole = "\0"
    pattern = re.sub(r"(\[[^\]]*\]|\.)(\{[^}]*\}|[?*+])?", hole, pattern)
    pattern = re.sub(r"[^()][?*+]", hole, pattern)

    def group(m: re.Match) -> str:
        """A hole; a group that begins or ends with a space leaves the word next to it whole.

        An optional group may be absent: then what is on its other side must be a border as well.
        """
        options, optional = m[1].split("|"), bool(m[2])
        opens = not optional or m.end() == len(m.string) or m.string[m.end()] == " "
        closes = not optional or m.start() == 0 or m.string[m.start() - 1] == " "
        return (" " if opens and all(o.startswith(" ") for o in options) else "") + hole \
            + (" " if closes and all(o.endswith(" ") for o in options) else "")

    while "(" in pattern:
        pattern = re.sub(r"\((?:\?:|\?P<\w+>)?([^()]*)\)([?*+]|\{[^}]*\})?", group, pattern)
    return frozenset(w.encode() for w in pattern.split() if hole not in w)


def parse_rules(text: str = RULES_TEXT) -> list[Rule]:
    rules, confidence = [], 0.0
    for line in filter(None, map(str.strip, text.splitlines())):
        if line.startswith("["):
            confidence = float(line.strip("[]").split()[1])
            continue
        label, pattern = (part.strip() for part in line.split(";"))
        rules.append(Rule(len(rules), label, confidence, needed_words(pattern),
                          re.compile(rf"(?<![^ ])(?:{pattern})(?![^ ])".encode())))
    return rules


class Scanner:
    """Rules with the index of their words: a rule is found under one of its words, the one that fewest rules share."""

    def __init__(self, rules: list[Rule]):
        self.rules = rules
        shared: dict[bytes, int] = {}
        for rule in rules:
            for word in rule.words:
                shared[word] = shared.get(word, 0) + 1
        self.gates: dict[bytes, list[Rule]] = {}
        for rule in rules:
            self.gates.setdefault(min(rule.words, key=lambda w: (shared[w], w)), []).append(rule)
        self.gate_words = frozenset(self.gates)
        self.phrases = [(b" " + phrase.encode() + b" ", label) for phrase, label in BASE_PHRASES.items()]

    def candidates(self, present: set[bytes]) -> list[Rule]:
        """The rules whose words all occur, by priority."""
        open_ = self.gate_words & present
        return sorted((r for word in open_ for r in self.gates[word] if r.words <= present), key=lambda r: r.priority)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, str]], list[Match]]:
        """(base places as (first word, label), surviving matches in the order of priority) of a text."""
        if not words:
            return [], []
        present = set(words)
        rules = self.candidates(present)
        base_words = [(phrase, label) for phrase, label in self.phrases if present.issuperset(phrase.split())]
        if not rules and not base_words:
            return [], []
        joined = b" ".join(words)
        starts = np.cumsum([0, *(len(w) + 1 for w in words)])[:-1].tolist()
        padded = b" " + joined + b" "
        base = []
        for phrase, label in base_words:
            at = padded.find(phrase)
            while at >= 0:
                base.append((bisect_right(starts, at) - 1, label))
                at = padded.find(phrase, at + 1)
        found = []
        for rule in rules:
            place = rule.pattern.groupindex.get("name", 0)
            found += [Match(rule, bisect_right(starts, m.start(place)) - 1, bisect_right(starts, m.end(place) - 1) - 1)
                      for m in rule.pattern.finditer(joined)]
        return sorted(base), suppress(found)


def suppress(matches: list[Match]) -> list[Match]:
    """Matches in the order of priority, longer and earlier first, without those inside an interval already taken.

    The taken intervals that lie in no other one have rising begins and ends, so one look per match decides.
    """
    taken, firsts, lasts = [], [], []
    for match in sorted(matches, key=lambda m: (m.rule.priority, m.first - m.last, m.first)):
        at = bisect_right(firsts, match.first)
        if at and lasts[at - 1] >= match.last:      # the last interval that begins no later reaches furthest
            continue
        taken.append(match)
        end = at
        while end < len(firsts) and lasts[end] <= match.last:      # intervals inside the new one stay taken, but decide nothing
            end += 1
        if at and firsts[at - 1] == match.first:
            at -= 1
        firsts[at:end], lasts[at:end] = [match.first], [match.last]
    return taken


@cache
def _scanner() -> Scanner:
    return Scanner(parse_rules())


def license_matches(documents: DataFrame) -> DataFrame:
    """(doc_id, n_words, base array<struct<word, label>>, matches array<struct<label, first, last, rule, confidence>>)."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    base_type = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
    match_type = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()),
                                     ("rule", pa.int32()), ("confidence", pa.float64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner()
        for batch in slices(batches):
            counts, bases, matches = [], [], []
            for text in batch.column(1).to_pylist():
                words = lower_words(text or b"")
                base, found = scanner.scan(words)
                counts.append(len(words))
                bases.append([{"word": w, "label": label} for w, label in base])
                matches.append([{"label": m.rule.label, "first": m.first, "last": m.last, "rule": m.rule.priority,
                                 "confidence": m.rule.confidence} for m in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(bases, base_type), pa.array(matches, match_type)],
                names=["doc_id", "n_words", "base", "matches"])

    return rows.mapInArrow(scan, "doc_id long, n_words long, base array<struct<word:bigint,label:string>>, matches "
                           "array<struct<label:string,first:bigint,last:bigint,rule:int,confidence:double>>")


def license_labels(documents: DataFrame) -> DataFrame:
    """One row per document: places and labels of the base phrases, all labels, and the score (operator 12)."""
    found = license_matches(documents)
    base = F.array_sort(F.array_distinct(F.transform("base", lambda b: b["label"])))
    labels = F.array_sort(F.array_distinct(F.concat(F.transform("base", lambda b: b["label"]),
                                                    F.transform("matches", lambda m: m["label"]))))
    sure = F.concat(F.transform("matches", lambda m: m["confidence"]), F.transform("base", lambda b: F.lit(BASE_CONFIDENCE)))
    words = F.transform("base", lambda b: b["word"])
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(words).alias("first_word"),
        F.array_max(words).alias("last_word"), F.array_join(base, ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"), F.coalesce(F.array_max(sure), F.lit(0.0)).alias("score"))
