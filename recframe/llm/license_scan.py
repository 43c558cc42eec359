"""Operator 3: licence scan by ordered signature rules.

Each text is normalised to its words (A-Z lower-cased) with one space before
each.  A keyword prefilter picks the rules worth running: first any of a few
anchor strings, then each rule's own keyword.  Matches are resolved in rule
order: a detection whose word interval lies inside one of a rule of higher
priority (or inside an equal or larger one of the same priority that was found
earlier) is suppressed.  The base phrases are always reported.

Defined cases: a null or empty text has no word, no place, empty labels and
score 0; overlapping places of different phrases all count; repeated rows give
one result each; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from recframe.llm.common import alnum_words, frugal, text_bytes, written_small
from recframe.llm.license_rules import ANCHORS, BASE, RULES, Rule


class Detection(NamedTuple):
    first: int  # word offsets, last not included
    last: int
    rule: Rule


def normalise(words: list[bytes]) -> bytes:
    return b" " + b" ".join(words) + b" " if words else b""


def detect(text: bytes, rules: tuple[Rule, ...] = RULES) -> list[Detection]:
    """All matches of all rules of a normalised text, in rule order."""
    if not any(a in text for a in ANCHORS):
        return []
    starts: np.ndarray | None = None
    out = []
    for rule in rules:
        if rule.keyword in text:
            places = [m.span() for m in rule.regex.finditer(text)]
            if places:
                if starts is None:  # the space before each word
                    starts = np.flatnonzero(np.frombuffer(text, np.uint8) == 0x20)
                words = np.searchsorted(starts, np.array(places)).tolist()
                out += [Detection(first, last, rule) for first, last in words]
    return out


class _Reach:
    """Largest interval end among those that start at or before a place (a
    Fenwick tree of maxima over the starts that occur)."""

    def __init__(self, firsts: list[int]):
        self.firsts = sorted(set(firsts))
        self.tree = [-1] * (len(self.firsts) + 1)

    def add(self, first: int, last: int) -> None:
        i = bisect_left(self.firsts, first) + 1
        while i < len(self.tree):
            self.tree[i] = max(self.tree[i], last)
            i += i & -i

    def until(self, first: int) -> int:
        i, best = bisect_right(self.firsts, first), -1
        while i:
            best = max(best, self.tree[i])
            i -= i & -i
        return best


def resolve(found: list[Detection]) -> list[Detection]:
    """Drop detections contained in a kept one of higher or equal rank.

    ``found`` is ordered by rule; within one priority longer intervals go first."""
    kept: list[Detection] = []
    reach = _Reach([d.first for d in found])
    for d in sorted(found, key=lambda d: (-d.rule.priority, d.first - d.last, d.first, d.rule.name)):
        if reach.until(d.first) < d.last:  # no kept interval starts before it and ends after it
            kept.append(d)
            reach.add(d.first, d.last)
    return kept


def scan_text(raw: bytes) -> tuple[int, int, int | None, int | None, str, str, float, list[Detection]]:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, detections."""
    words = alnum_words(raw)
    text = normalise(words)
    found = detect(text)
    kept = resolve(found)
    base = [d for d in found if d.rule.name.startswith("base-")]
    base_labels = {d.rule.label for d in base}
    labels = base_labels | {d.rule.label for d in kept}
    miss = 1.0
    for weight in {d.rule.name: d.rule.weight for d in kept}.values():
        miss *= 1.0 - weight
    starts = [d.first for d in base]
    return (len(words), len(base), min(starts, default=None), max(starts, default=None),
            ",".join(sorted(base_labels)), ",".join(sorted(labels)), round(1.0 - miss, 9) if kept else 0.0, kept)


_DIGEST = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
_SPANS = "array<struct<rule:string,label:string,first_word:int,end_word:int>>"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, the digest columns and the kept detections of each document."""
    return written_small(_scan(docs))


def _scan(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [scan_text(t or b"") for t in b.column("raw").to_pylist()]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 8
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            spans = [[{"rule": d.rule.name, "label": d.rule.label, "first_word": d.first, "end_word": d.last} for d in kept] for kept in cols[7]]
            kind = pa.list_(pa.struct([("rule", pa.string()), ("label", pa.string()), ("first_word", pa.int32()), ("end_word", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols[:7], kinds, strict=True)), pa.array(spans, kind)],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"])

    d = docs.select("doc_id", text_bytes().alias("raw"))
    return d.mapInArrow(frugal(run), f"doc_id {d.schema['doc_id'].dataType.simpleString()}, {_DIGEST}, detections {_SPANS}")


def license_digest(docs: DataFrame) -> DataFrame:
    """The registered query."""
    return written_small(_scan(docs).drop("detections"))


__all__ = ["BASE", "Detection", "detect", "license_digest", "resolve", "scan", "scan_text"]
