"""Operator 5: removal of repeated word sequences found by recompression.

Each word covered by a window of WINDOW words that also starts earlier (in a
document of smaller id, or before it in the same one) is removed.

Recompression (Jez 2013) renames the token sequence in rounds: first runs of one
word become one symbol, then in each round every symbol draws a coin from its own
name and a (0, 1) neighbour pair becomes one new symbol.  Names are fingerprints
of what they stand for, so all tasks name alike with no exchange.  The new symbol
depends only on an interval of words around it, so equal windows hold the same
symbols in their interior.

1. Documents are dealt into buckets.  Each computes LEVELS rounds and, for every
   window, the least key among the symbols whose whole interval lies in it; the
   key is the fingerprint of the interval's words.
2. One exchange finds keys that occur twice (``shared_keys``): only windows with
   a shared key can repeat.  Windows without an interior symbol (long runs,
   periodic text) always go on.
3. The windows that remain are verified: equal windows of a bucket are settled
   there, all but the first being repeats; the first goes into one exchange by a
   96-bit fingerprint, where the earliest place of each stays.
4. The repeats return to their buckets as intervals and are cut out.

Windows are judged on the input.  Defined cases: null and empty texts have no
words; texts under WINDOW words stay; a null doc_id stands before all others;
rows that share a doc_id are one document's rows, and the same start in them is
not earlier; an empty table gives an empty result; ``dedup`` carries extra
columns of any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recframe.llm.common import (PACKED, SPACE_WORD, Roller, buckets_for, flat, frugal_cogroup, frugal_group, has_key, id_or_least,
                                 merge_intervals, mix, pack, packed_table, row_key, shared_keys, slices, span_hashes, text_bytes,
                                 total_bytes, unpack, window_hashes, word_spans)

WINDOW = 20
LEVELS = 3
BUCKET_BYTES = 2 << 20
KEYS_PER_PART = 200_000
WINDOWS_PER_PART = 200_000
#: Bytes of text (or one word), or words, that are fingerprinted at once.
PIECE = 64 << 10

_U = np.uint64
_CHECK = Roller(0xA0761D6478BD642F | 1)
_GAMMA = np.array([0x9E3779B97F4A7C15], _U)  # an array: scalars warn where they wrap


def high_symbols(words: np.ndarray, doc: np.ndarray, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray]:
    """[lo, hi) word intervals on which the symbols of the last level depend.

    ``words`` are word fingerprints, ``doc`` the document of each.  An interval
    that reaches past its document stands for a symbol that depends on the
    document's end; no window contains it.  Both ends grow with the symbols."""
    n = len(words)
    new = np.ones(n, bool)
    new[1:] = (words[1:] != words[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, n))
    # a run is named by its word and length; it ends where the neighbours differ
    name = mix(words[first] + length.astype(_U) * _GAMMA)
    lo, hi, doc = first - 1, first + length + 1, doc[first]
    for level in range(levels):
        coin = (mix(name + _GAMMA * _U(level + 1)) >> _U(63)).astype(bool)
        joins = np.zeros(len(name), bool)  # with the next symbol
        joins[:-1] = ~coin[:-1] & coin[1:] & (doc[:-1] == doc[1:])
        joined = np.append(False, joins[:-1])
        # a symbol left alone is alone because of the neighbour it could have joined
        left, right = lo.copy(), hi.copy()
        alone_right = np.flatnonzero(~coin & ~joins)
        alone_right = alone_right[alone_right + 1 < len(name)]
        alone_right = alone_right[doc[alone_right] == doc[alone_right + 1]]
        right[alone_right] = hi[alone_right + 1]
        alone_left = np.flatnonzero(coin & ~joined)
        alone_left = alone_left[alone_left > 0]
        alone_left = alone_left[doc[alone_left] == doc[alone_left - 1]]
        left[alone_left] = lo[alone_left - 1]
        pair = np.flatnonzero(joins)
        name = name.copy()
        name[pair] = mix(name[pair] * _U(3) + mix(name[pair + 1] + _GAMMA))
        right[pair] = hi[pair + 1]
        keep = ~joined
        name, lo, hi, doc = name[keep], left[keep], right[keep], doc[keep]
    return lo, hi


def range_min(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """min(values[lo:hi]) for each non-empty range, by doubling tables."""
    out = np.zeros(len(lo), _U)
    size, step, level = hi - lo, 1, values
    while step <= size.max(initial=0):
        here = np.flatnonzero((size >= step) & (size < 2 * step))
        out[here] = np.minimum(level[lo[here]], level[hi[here] - step])
        level = np.minimum(level[:-step], level[step:]) if len(level) > step else level
        step *= 2
    return out


def word_names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """``span_hashes`` of all words, some at a time: its passes need 40 bytes for one of text."""
    out = np.empty(len(starts), _U)
    for i, j in slices(np.append(starts, ends[-1:]), PIECE):
        at = starts[i]
        out[i:j] = span_hashes(data[at:ends[j - 1]], starts[i:j] - at, ends[i:j] - at)
    return out


def window_names(words: np.ndarray, at: np.ndarray, *roll: Roller) -> np.ndarray:
    """``window_hashes`` of the windows at increasing places, some at a time."""
    out = np.empty(len(at), _U)
    for i, j in slices(np.append(at, at[-1:] + 1), PIECE):
        out[i:j] = window_hashes(words[at[i]:at[j - 1] + WINDOW], at[i:j] - at[i], WINDOW, *roll)
    return out


class BucketText:
    """Words, windows and window keys of the distinct documents of a bucket."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        starts, ends, doc = word_spans(data, offs, SPACE_WORD)
        self.doc = doc.astype(np.int32)
        self.words = word_names(data, starts, ends)
        del starts, ends, doc
        counts = np.bincount(self.doc, minlength=len(offs) - 1)
        self.first = np.cumsum(counts) - counts
        end = np.repeat(np.cumsum(counts), counts)
        #: places where a window starts
        self.at = np.flatnonzero(np.arange(len(self.words)) + WINDOW <= end)

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key of every interior symbol, least key of each window, whether it has one)."""
        if not len(self.at):
            return np.zeros(0, _U), np.zeros(0, _U), np.zeros(0, bool)
        lo, hi = high_symbols(self.words, self.doc)
        inside = (lo >= 0) & (hi <= len(self.words))
        key = np.full(len(lo), ~_U(0), _U)
        key[inside] = window_hashes(self.words, lo[inside], hi[inside] - lo[inside])
        a = np.searchsorted(lo, self.at)
        b = np.searchsorted(hi, self.at + WINDOW, side="right")
        has = b > a
        least = np.zeros(len(self.at), _U)
        least[has] = range_min(key, a[has], b[has])
        return key, least, has


_WINDOWS = "part int, bucket int, h binary, c binary, id binary, at binary, doc binary, s_doc binary, s_lo binary, s_hi binary"
_GONE = "bucket int, doc binary, lo binary, hi binary"


def _runs(doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows as merged word intervals: (document, first word, end)."""
    order = np.lexsort((at, doc))
    doc, at = doc[order], at[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + WINDOW)) if len(at) else np.zeros(0, bool)
    heads = np.flatnonzero(new)
    last = np.append(heads[1:], len(at)) - 1 if len(at) else heads
    return doc[heads].astype(np.int32), at[heads].astype(np.int32), (at[last] + WINDOW).astype(np.int32)


def window_rows(bucket: int, ids: np.ndarray, text: BucketText, wanted: np.ndarray, n_parts: int) -> pa.Table:
    """Windows of a bucket that may repeat elsewhere, packed by fingerprint, and
    the intervals already known to repeat."""
    _, least, has = text.keys()
    at = text.at[~has | has_key(least, wanted)]
    del least, has
    h = window_names(text.words, at)
    c = (window_names(text.words, at, _CHECK) >> _U(32)).astype(np.uint32)
    doc = text.doc[at]
    start = (at - text.first[doc]).astype(np.int32)
    del at
    order = np.lexsort((start, ids[doc], c, h))
    h, c, doc, start = h[order], c[order], doc[order], start[order]
    del order
    new = np.append(True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])) if len(h) else np.zeros(0, bool)
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    first = (ids[doc] == ids[doc[head]]) & (start == start[head])
    del new, head
    s_doc, s_lo, s_hi = _runs(doc[~first], start[~first])
    h, c, doc, start = h[first], c[first], doc[first], start[first]
    rows = [(p, bucket, *cols, b"", b"", b"") for p, cols in
            pack(h, n_parts, c, ids[doc], start, doc)]
    if len(s_doc):
        rows.append((bucket % n_parts, bucket, b"", b"", b"", b"", b"", s_doc.tobytes(), s_lo.tobytes(), s_hi.tobytes()))
    cols = list(zip(*rows, strict=True)) if rows else [()] * 10
    return pa.Table.from_arrays([pa.array(x, pa.int32()) for x in cols[:2]] + [pa.array(x, pa.binary()) for x in cols[2:]],
                                ["part", "bucket", "h", "c", "id", "at", "doc", "s_doc", "s_lo", "s_hi"])


def later_windows(part: pa.Table) -> pa.Table:
    """Of equal windows all but those at the earliest place, back to the buckets
    as intervals."""
    h, row = unpack(part.column("h").to_pylist(), _U)
    c, ids, at, doc = (unpack(part.column(n).to_pylist(), k)[0] for n, k in (("c", np.uint32), ("id", np.int64), ("at", np.int32), ("doc", np.int32)))
    order = np.lexsort((at, ids, c, h))
    h, c, ids, at, doc, row = h[order], c[order], ids[order], at[order], doc[order], row[order]
    new = np.append(True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])) if len(h) else np.zeros(0, bool)
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    later = (ids != ids[head]) | (at != at[head])
    at, doc, row = at[later].astype(np.int64), doc[later], row[later]
    buckets = part.column("bucket").to_pylist()
    out = [(b, d, lo, hi) for b, d, lo, hi in zip(buckets, *(part.column(x).to_pylist() for x in ("s_doc", "s_lo", "s_hi")), strict=True) if d]
    order = np.argsort(row, kind="stable")
    at, doc, row = at[order], doc[order], row[order]
    heads = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
    for lo, hi in zip(heads, np.append(heads[1:], len(row)), strict=False):
        out.append((buckets[row[lo]], *(x.tobytes() for x in _runs(doc[lo:hi], at[lo:hi]))))
    cols = list(zip(*out, strict=True)) if out else [()] * 4
    return pa.Table.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(x, pa.binary()) for x in cols[1:])], ["bucket", "doc", "lo", "hi"])


def _run(docs: DataFrame, carry: Column, finish: Callable[[pa.Table, list[list[tuple[int, int]]]], pa.Table], schema) -> DataFrame:
    """``finish(bucket rows, removed word intervals of each row)`` after all rounds."""
    n_bytes = total_bytes(docs)
    n = buckets_for(n_bytes, BUCKET_BYTES)
    key_parts = n_bytes // 40 // KEYS_PER_PART + 1
    window_parts = n_bytes // 20 // WINDOWS_PER_PART + 1
    texts = docs.select(F.pmod(row_key(), F.lit(n)).cast("int").alias("bucket"), row_key().alias("key"), id_or_least().alias("id"),
                        carry.alias("row"), text_bytes().alias("raw"))

    def distinct(part: pa.Table) -> tuple[np.ndarray, BucketText, np.ndarray]:
        keys, first = np.unique(part.column("key").to_numpy(), return_index=True)
        return part.column("id").to_numpy()[first], BucketText(*flat(part.column("raw").take(pa.array(first)))), keys

    def pick(part: pa.Table) -> pa.Table:
        key, least, has = distinct(part)[1].keys()
        used = has_key(key, np.unique(least[has]))
        return packed_table(part.column("bucket")[0].as_py(), key[used], key_parts)

    def cut(part: pa.Table, wanted: pa.Table) -> pa.Table:
        if not part.num_rows:
            return window_rows(0, np.zeros(0, np.int64), BucketText(np.zeros(0, np.uint8), np.zeros(1, np.int64)), np.zeros(0, _U), 1)
        ids, text, _ = distinct(part)
        want = np.sort(np.frombuffer(b"".join(wanted.column("keys").to_pylist()), _U))
        return window_rows(part.column("bucket")[0].as_py(), ids, text, want, window_parts)

    def close(part: pa.Table, gone: pa.Table) -> pa.Table:
        doc, lo, hi = (np.frombuffer(b"".join(gone.column(c).to_pylist()), np.int32) for c in ("doc", "lo", "hi"))
        order = np.argsort(doc, kind="stable")
        doc, lo, hi = doc[order], lo[order], hi[order]
        keys = part.column("key").to_numpy()
        spans = []
        for d in np.searchsorted(np.unique(keys), keys):
            a, b = np.searchsorted(doc, d), np.searchsorted(doc, d, side="right")
            s, e = merge_intervals(lo[a:b], hi[a:b])
            spans.append(list(zip(s.tolist(), e.tolist(), strict=True)))
        return finish(part, spans)

    shared = shared_keys(texts.groupBy("bucket").applyInArrow(frugal_group(pick), PACKED))
    windows = texts.groupBy("bucket").cogroup(shared.groupBy("bucket")).applyInArrow(frugal_cogroup(cut), _WINDOWS)
    gone = windows.groupBy("part").applyInArrow(frugal_group(later_windows), _GONE)
    return texts.groupBy("bucket").cogroup(gone.groupBy("bucket")).applyInArrow(frugal_cogroup(close), schema)


def keep_words(raw: bytes, gone: list[tuple[int, int]]) -> tuple[int, bytes]:
    """(words of the text, the kept ones joined by one space)."""
    words = raw.split()
    n = len(words)
    for s, e in reversed(gone):
        del words[s:e]
    return n, b" ".join(words)


def dedup_digest(docs: DataFrame) -> DataFrame:
    """The registered query."""
    def finish(part: pa.Table, gone: list[list[tuple[int, int]]]) -> pa.Table:
        kept = [keep_words(r, g) for r, g in zip(part.column("raw").to_pylist(), gone, strict=True)]
        return pa.Table.from_arrays(
            [pa.array([r["doc_id"] for r in part.column("row").to_pylist()], part.schema.field("row").type.field("doc_id").type),
             pa.array([n for n, _ in kept], pa.int64()), pa.array([sum(e - s for s, e in g) for g in gone], pa.int64()),
             pa.array([hashlib.sha256(t).hexdigest() for _, t in kept], pa.string())],
            ["doc_id", "n_words", "n_removed", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _run(docs, F.struct("doc_id"), finish, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")


def dedup(docs: DataFrame) -> DataFrame:
    """All columns of ``docs``; texts that lose words become their kept words
    joined by one space, other texts (null ones too) stay as they are."""
    def finish(part: pa.Table, gone: list[list[tuple[int, int]]]) -> pa.Table:
        rows = part.column("row").combine_chunks()
        names = [f.name for f in rows.type]
        cols = rows.flatten()
        i = names.index("text")
        cols[i] = pa.array([keep_words(raw, g)[1].decode() if g else old for old, raw, g in
                            zip(cols[i].to_pylist(), part.column("raw").to_pylist(), gone, strict=True)], cols[i].type)
        return pa.Table.from_arrays(cols, names)

    return _run(docs, F.struct("*"), finish, docs.schema)
