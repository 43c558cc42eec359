"""Operator 1: benchmark decontamination with one FM-index per training shard.

Test phrases (13 consecutive words of an item, or the whole of a shorter item)
are looked up in the words of the training texts.  A task gathers a shard of
documents and indexes its words: suffix array, Burrows-Wheeler transform, a
wavelet matrix for ranks, and suffix positions sampled at every 8th word and at
every stretch start.  All phrases are searched backwards at once; their rows are
located by walking to a sampled position; places become spans of words to
remove, merged per document.

Only words that the phrases use are symbols of the index.  A stretch of such
words shorter than the shortest phrase cannot hold one and is left out; this
changes no result.  Phrases travel as numbered words and places in them, in
blocks of bounded size (BLOCK_WORDS); a larger benchmark means more narrow
passes over the documents, each adding to the spans and items found so far, with
no shuffle.  Between passes the result is written, so one block lives at a time.

Defined cases: null and empty texts and items have no words; repeated rows give
one result each; item_ids that repeat count once; a null item_id reads as "";
an empty benchmark leaves every document clean; an empty table gives an empty
result; extra columns are carried by ``find_spans`` whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recframe.llm.common import (ALNUM_WORD, LOWER, blocks, flat, frugal, merge_intervals, mix, span_hashes, text_bytes,
                                 window_hashes, word_spans, written_small)
from recframe.llm.suffix import suffix_array

WINDOW = 13
#: Words of benchmark text in one broadcast block, at most (20 bytes each); an item is never cut.
BLOCK_WORDS = 2_000_000
#: Bytes of training text in one shard.
SHARD_BYTES = 8 << 20
SAMPLE = 8


class Phrases:
    """Distinct phrases of a block of items, each a place in the numbered words
    of the items, and the items that hold it."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.names = sorted({i for i, _ in items})
        number = {name: k for k, name in enumerate(self.names)}
        owner = np.array([number[i] for i, _ in items], np.int64)
        low = LOWER[np.frombuffer(b"".join(t for _, t in items), np.uint8)]
        offs = np.concatenate([[0], np.cumsum([len(t) for _, t in items], dtype=np.int64)]).astype(np.int64)
        starts, ends, rows = word_spans(low, offs, ALNUM_WORD)
        self.hashes, ids = np.unique(span_hashes(low, starts, ends), return_inverse=True)
        self.words = (ids + 1).astype(np.int32)
        counts = np.bincount(rows, minlength=len(items))
        size = np.minimum(counts, window)
        windows = np.where(counts > 0, counts - size + 1, 0)
        item = np.repeat(np.arange(len(items)), windows)
        place = np.repeat(np.cumsum(counts) - counts - (np.cumsum(windows) - windows), windows) + np.arange(int(windows.sum()))
        length = size[item]
        # equal phrases stand together in the order of their fingerprints; words decide
        order = np.lexsort((window_hashes(mix(self.words.astype(np.uint64)), place, length), length))
        item, place, length = item[order], place[order], length[order]
        same = np.zeros(len(place), bool)
        same[1:] = length[1:] == length[:-1]
        for j in range(window):
            at = np.flatnonzero(same & (length > j))
            same[at] = self.words[place[at] + j] == self.words[place[at - 1] + j]
        phrase = np.cumsum(~same) - 1
        held = np.unique(phrase * max(1, len(self.names)) + owner[item])
        holders, self.held = np.divmod(held, max(1, len(self.names)))
        self.held = self.held.astype(np.int32)
        place, length = place[~same].astype(np.int32), length[~same]
        self.held_from = np.searchsorted(holders, np.arange(len(place) + 1))
        self.by_length = [(int(n), np.flatnonzero(length == n), place[length == n]) for n in np.unique(length)]
        self.shortest = self.by_length[0][0] if self.by_length else 0

    def items(self, phrases: np.ndarray) -> list[str]:
        """Names of the items that hold any of the phrases."""
        held = np.concatenate([self.held[self.held_from[p]:self.held_from[p + 1]] for p in np.unique(phrases).tolist()])
        return [self.names[k] for k in np.unique(held).tolist()]

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """1.. for a word of the phrases, 0 for any other."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at + 1, 0)


class WaveletMatrix:
    """Ranks of symbols in a sequence: one bit array with prefix counts a level."""

    def __init__(self, seq: np.ndarray, top: int):
        self.bits = max(1, int(top).bit_length())
        self.zeros: list[int] = []
        self.ones: list[np.ndarray] = []
        for level in range(self.bits - 1, -1, -1):
            bit = (seq >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(int(len(seq) - bit.sum()))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])
        #: where each symbol's block begins in the last level
        self.begin = self._descend(np.arange(top + 1), np.zeros(top + 1, np.int64))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, ones, zeros in zip(range(self.bits - 1, -1, -1), self.ones, self.zeros, strict=True):
            one = ones[at].astype(np.int64)
            at = np.where((symbol >> level) & 1, zeros + one, at - one)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` before place ``at``."""
        return self._descend(symbol, at) - self.begin[symbol]


class FMIndex:
    """Index of a sequence of symbols in which 0 ends a stretch."""

    def __init__(self, text: np.ndarray, top: int):
        n = len(text)
        ends = text == 0
        # every stretch end is a symbol of its own, smaller than all words
        first = np.where(ends, np.cumsum(ends) - 1, text + int(ends.sum()))
        self.sa = suffix_array(first, 1)
        self.bwt = text[self.sa - 1]  # the text ends with 0, so the one before place 0 is an end
        self.wavelet = WaveletMatrix(self.bwt, top)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])
        starts = np.empty(n, bool)
        starts[0] = True
        starts[1:] = ends[:-1]
        marked = starts | (np.arange(n) % SAMPLE == 0) | ends
        self.sampled = marked[self.sa]
        self.sample_rank = np.cumsum(self.sampled) - 1
        self.samples = self.sa[self.sampled]
        del self.sa

    def search(self, words: np.ndarray, places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows [lo, hi) of the suffixes that begin with the ``length`` words from each place."""
        lo = np.zeros(len(places), np.int64)
        hi = np.full(len(places), len(self.bwt), np.int64)
        live = np.arange(len(places))
        for j in range(length - 1, -1, -1):
            c = words[places[live] + j]
            lo[live] = self.less[c] + self.wavelet.rank(c, lo[live])
            hi[live] = self.less[c] + self.wavelet.rank(c, hi[live])
            gone = hi[live] <= lo[live]
            hi[live[gone]] = lo[live[gone]]
            live = live[~gone]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each row: walk back to a sampled position."""
        out = np.zeros(len(rows), np.int64)
        todo, row, steps = np.arange(len(rows)), rows.copy(), 0
        while len(todo):
            hit = self.sampled[row]
            out[todo[hit]] = self.samples[self.sample_rank[row[hit]]] + steps
            todo, row = todo[~hit], row[~hit]
            c = self.bwt[row]
            row = self.less[c] + self.wavelet.rank(c, row)
            steps += 1
        return out


class Shard:
    """Documents of one shard, their indexable words and where these stand."""

    def __init__(self, phrases: Phrases):
        self.phrases, self.docs, self.bytes = phrases, 0, 0
        self.symbols: list[np.ndarray] = []
        self.rows: list[np.ndarray] = []
        self.places: list[np.ndarray] = []
        self.n_words: list[np.ndarray] = []

    def add(self, data: np.ndarray, offs: np.ndarray) -> None:
        low = LOWER[data]
        starts, ends, rows = word_spans(low, offs, ALNUM_WORD)
        counts = np.bincount(rows, minlength=len(offs) - 1)
        sym = self.phrases.symbols(span_hashes(low, starts, ends))
        place = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
        # stretches: consecutive known words of one document
        known = sym > 0
        head = known.copy()
        head[1:] &= ~(known[:-1] & (rows[1:] == rows[:-1]))
        run = np.cumsum(head) - 1
        length = np.bincount(run[known], minlength=int(head.sum()))
        use = known.copy()
        use[known] = length[run[known]] >= max(1, self.phrases.shortest)
        head &= use
        # a 0 before each stretch but the first of the shard; the index adds the last one
        sym, rows, place, head = sym[use], rows[use] + self.docs, place[use], head[use]
        at = np.flatnonzero(head)
        self.symbols.append(np.insert(sym, at, 0))
        self.rows.append(np.insert(rows, at, -1))
        self.places.append(np.insert(place, at, -1))
        self.n_words.append(counts)
        self.docs += len(offs) - 1
        self.bytes += len(data)

    def find(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words of each document; rows (document, start, stop, phrase) by
        document; where the rows of each document begin."""
        n_words = np.concatenate(self.n_words) if self.n_words else np.zeros(0, np.int64)
        hits = [np.zeros((4, 0), np.int64)]
        text = np.append(np.concatenate(self.symbols), 0) if self.symbols else np.zeros(1, np.int64)
        if len(text) > 1:
            rows, places = np.concatenate(self.rows), np.concatenate(self.places)
            index = FMIndex(text, len(self.phrases.hashes))
            for length, nums, at in self.phrases.by_length:
                lo, hi = index.search(self.phrases.words, at, length)
                n = hi - lo
                pos = index.locate(np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum())))
                hits.append(np.stack([rows[pos], places[pos], places[pos] + length, np.repeat(nums, n)]))
        found = np.concatenate(hits, axis=1)
        found = found[:, np.argsort(found[0], kind="stable")]
        return n_words, found, np.searchsorted(found[0], np.arange(self.docs + 1))


_FOUND = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("items", pa.list_(pa.string()))])
_FOUND_SQL = "struct<n_words:bigint,spans:array<struct<start:bigint,stop:bigint>>,items:array<string>>"


def _merge(old: dict | None, n_words: int, hits: np.ndarray, phrases: Phrases) -> dict:
    if not hits.shape[1]:
        return old or {"n_words": n_words, "spans": [], "items": []}
    before = old["spans"] if old else []
    s, e = merge_intervals(np.append(hits[1], [x["start"] for x in before]).astype(np.int64), np.append(hits[2], [x["stop"] for x in before]).astype(np.int64))
    names = phrases.items(hits[3])
    if old and old["items"]:
        names = sorted({*names, *old["items"]})
    return {"n_words": n_words, "spans": [{"start": a, "stop": b} for a, b in zip(s.tolist(), e.tolist(), strict=True)], "items": names}


def _phrase_blocks(benchmark: DataFrame, window: int) -> Iterator[tuple[Phrases, bool]]:
    """Blocks of items, each at most about BLOCK_WORDS words, and whether it is the last."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), text_bytes().alias("t")).distinct()
    size = items.agg(F.sum(F.octet_length("t")).alias("b")).first()["b"] or 0
    n = max(1, -(-int(size) // (2 * BLOCK_WORDS)))  # a word takes two bytes at least, with its separator
    for b in range(n):
        rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b).collect()
        yield Phrases([(r["i"], bytes(r["t"])) for r in rows], window), b == n - 1


def find_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, carry: list[str] | None = None) -> DataFrame:
    """Columns ``row`` (a struct of the columns in ``carry``, by default all) and
    ``found``: n_words, merged spans of contaminated words, and the item_ids that
    occur."""
    spark = docs.sparkSession
    row = F.struct(*(carry or docs.columns)).alias("row")
    kind = docs.select(row).schema["row"].dataType.simpleString()
    out = docs.select(row, F.lit(None).cast(_FOUND_SQL).alias("found"), text_bytes().alias("raw"))
    for phrases, last in _phrase_blocks(benchmark, window):
        shared = spark.sparkContext.broadcast(phrases)
        names = ["row", "found"] if last else ["row", "found", "raw"]

        def run(batches: Iterator[pa.RecordBatch], shared=shared, names=names) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            shard = Shard(shared.value)

            def flush() -> Iterator[pa.RecordBatch]:
                n_words, hits, begin = shard.find()
                at = 0
                for b in held:
                    old = b.column("found").to_pylist() if b.column("found").null_count < b.num_rows else [None] * b.num_rows
                    found = [_merge(o, int(n_words[at + i]), hits[:, begin[at + i]:begin[at + i + 1]], shard.phrases) for i, o in enumerate(old)]
                    at += b.num_rows
                    cols = {"row": b.column("row"), "found": pa.array(found, _FOUND), "raw": b.column("raw")}
                    yield pa.RecordBatch.from_arrays([cols[c] for c in names], names)

            for batch in batches:
                for b in blocks(batch, "raw"):
                    shard.add(*flat(b.column("raw")))
                    held.append(b)
                    if shard.bytes >= SHARD_BYTES:
                        yield from flush()
                        held, shard = [], Shard(shared.value)
            yield from flush()

        kinds = {"row": kind, "found": _FOUND_SQL, "raw": "binary"}
        out = out.mapInArrow(frugal(run), ", ".join(f"{c} {kinds[c]}" for c in names))
        if not last:
            out = written_small(out)
            shared.destroy()
    return out


def n_hit():
    """Words covered by the merged spans."""
    return F.aggregate("found.spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])


def is_contaminated():
    """At least one word in twenty is hit."""
    return (n_hit() > 0) & (20 * n_hit() >= F.col("found.n_words"))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The registered query."""
    found = find_spans(docs, benchmark, carry=["doc_id"])
    return written_small(found.select("row.doc_id", "found.n_words", n_hit().alias("n_hit"), F.size("found.items").cast("long").alias("n_items"),
                                      F.sha2(F.concat_ws(",", "found.items"), 256).alias("items_sha256"), is_contaminated().alias("contaminated")))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """All columns of the documents that are not contaminated."""
    return written_small(find_spans(docs, benchmark).where(~is_contaminated()).select("row.*"))
