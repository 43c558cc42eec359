"""Operator 9: removal of repeated substrings with suffix arrays.

Every byte covered by a string of ``width`` bytes (by default WIDTH) that also
starts at another place is removed, all its copies alike.

1. Documents are dealt into buckets of bounded size.  Each bucket picks anchors:
   GRAM-byte grams whose fingerprint is least among the grams of some string of
   that width (minimizers).  Equal strings hold an anchor of equal fingerprint.
2. One exchange finds the anchors that occur twice (``shared_keys``).
3. Around each such anchor the bucket cuts its context: all strings of the
   width that contain the anchor.  Equal contexts of a bucket settle each other
   and go on as one.  Contexts are exchanged by anchor into shards.
4. A shard sorts the suffixes of its contexts by their first bytes, up to the
   width (Larsson-Sadakane refinement), and every run of suffixes that share the
   width and span two places marks repeats.
5. An anchor whose contexts overflow one shard is split over several.  Each
   hands on its distinct strings, once each, as arrays of 128-bit fingerprints
   sorted and cut by their range; a range's sorted arrays are merged by binary
   search in the list of all their values.
6. Spans return to their buckets, packed, and are cut out.

Strings are judged on the input; matches never cross documents.  Defined cases:
null and empty texts have no bytes; texts under the width stay; repeated rows
(same id and text) are separate documents, so they repeat each other; an empty
table gives an empty result; ``dedup`` carries extra columns of any name.  Where
a removed span begins or ends inside a character, ``dedup`` drops the rest of
that character from the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recframe.llm.common import (PACKED, Roller, _BYTES, buckets_for, flat, frugal, frugal_cogroup, frugal_group, has_key, merge_intervals, mix, pack, packed_table, row_key,
                                 shared_keys, signed, slices, text_bytes, total_bytes, written_small)
from recframe.llm.suffix import equal_prefixes

WIDTH = 400
GRAM = 50
BUCKET_BYTES = 2 << 20
#: Bytes of contexts in one suffix array; positions must fit 21 bits.
SHARD_BYTES = 3 << 18
KEYS_PER_PART = 200_000
#: Bytes of text (or one text) whose anchors are found at once.
ANCHOR_BYTES = 256 << 10
#: Bytes of text for one range of the fingerprints of split anchors.
MERGE_BYTES = 4 << 20

_U = np.uint64
_NONE = _U(0xFFFFFFFFFFFFFFFF)
_ROLL, _ROLL2 = Roller(0xD1342543DE82EF95 | 1), Roller(0xAF251AF3B0F025B5 | 1)


def _sliding(x: np.ndarray, width: int, op: np.ufunc, fill: np.uint64) -> np.ndarray:
    """op over x[i : i + width] for every i, by prefix and suffix scans of blocks."""
    n = len(x)
    blocks = -(-(n + width) // width)
    pad = np.full(blocks * width, fill, _U)
    pad[:n] = x
    grid = pad.reshape(blocks, width)
    ahead = op.accumulate(grid, axis=1).ravel()
    back = op.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(back[:n], ahead[width - 1:width - 1 + n])


def anchors(data: np.ndarray, offs: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(place, fingerprint) of the anchors of all texts in ``data``, some whole
    texts at a time: the passes below need 100 bytes and more for one of text."""
    place, found = [np.zeros(0, np.int64)], [np.zeros(0, _U)]
    for lo, hi in slices(offs, ANCHOR_BYTES):
        p, h = _anchors(data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo], width)
        place.append(p + offs[lo])
        found.append(h)
    return np.concatenate(place), np.concatenate(found)


def _anchors(data: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    n, grams = len(data), width - GRAM + 1  # grams that one string holds
    if n < width:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    prefix = _ROLL.prefix(_BYTES[data])
    h = np.full(n, _NONE, _U)
    at = np.arange(n - GRAM + 1)
    h[:n - GRAM + 1] = np.minimum(_ROLL.spans(prefix, at, at + GRAM), _NONE - _U(1))
    left = np.repeat(offs[1:], np.diff(offs)) - np.arange(n)  # bytes to the end of the own text
    least = _sliding(np.where(left >= GRAM, h, _NONE), grams, np.minimum, _NONE)
    least[left < width] = 0  # no string of the width starts here
    # a gram is an anchor if it equals the least of one of the strings it is in
    back = _sliding(least[::-1], grams, np.maximum, _U(0))[::-1]
    place = np.flatnonzero((h == back) & (left >= GRAM))
    return _thin(place, h[place], np.searchsorted(offs, place, side="right"), grams)


def _thin(place: np.ndarray, h: np.ndarray, doc: np.ndarray, grams: int) -> tuple[np.ndarray, np.ndarray]:
    """In periodic text the same gram comes again every few bytes.  Of a chain of
    equal anchors keep the first and last in each stretch of grams // 2 bytes:
    every string that holds one of the chain still holds a kept one."""
    if not len(place):
        return place, h
    order = np.lexsort((place, h, doc))
    p, g, d = place[order], h[order], doc[order]
    new = np.append(True, (g[1:] != g[:-1]) | (d[1:] != d[:-1]) | (p[1:] - p[:-1] > grams))
    first = p[np.flatnonzero(new)][np.cumsum(new) - 1]
    stretch = (p - first) // max(1, grams // 2)
    edge = new | np.append(True, stretch[1:] != stretch[:-1])
    keep = edge | np.append(edge[1:], True)
    kept = np.sort(order[keep])
    return place[kept], h[kept]


def _contexts(offs: np.ndarray, place: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end) of the bytes that strings around each anchor cover."""
    doc = np.searchsorted(offs, place, side="right") - 1
    return doc, np.maximum(offs[doc], place + GRAM - width), np.minimum(offs[doc + 1], place + width)


_CONTEXT = "f long, h long, ctx binary, bucket int, key long, at int, n int, many boolean"
#: Settled spans of a bucket (who: key, at, n) or one range of a split anchor's strings (who: bucket, key, at).
_FOUND = "part int, bucket int, hi binary, lo binary, who binary, many binary"
_SPANS = "bucket int, who binary"


def cut_contexts(bucket: int, keys: np.ndarray, data: np.ndarray, offs: np.ndarray, copies: np.ndarray, wanted: np.ndarray,
                 width: int = WIDTH) -> pa.Table:
    """Contexts of the wanted anchors of one bucket.  Of contexts that are equal
    in the bucket one goes on; the spans of all of them are settled (ctx null)."""
    place, f = anchors(data, offs, width)
    hit = has_key(f, wanted)
    place, f = place[hit], f[hit]
    doc, lo, hi = _contexts(offs, place, width)
    h = np.zeros(len(doc), _U)
    for a, b in slices(offs):
        i, j = np.searchsorted(doc, (a, b))
        prefix = _ROLL2.prefix(_BYTES[data[offs[a]:offs[b]]])
        h[i:j] = _ROLL2.spans(prefix, lo[i:j] - offs[a], hi[i:j] - offs[a])
    order = np.lexsort((lo, doc, h, f))
    f, h, doc, lo, hi = f[order], h[order], doc[order], lo[order], hi[order]
    # in a short text, two places of one gram may have the same context; near the start of a longer one they share only its start
    other = np.append(True, (f[1:] != f[:-1]) | (doc[1:] != doc[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) if len(f) else np.zeros(0, bool)
    f, h, doc, lo, hi = f[other], h[other], doc[other], lo[other], hi[other]
    new = np.append(True, (f[1:] != f[:-1]) | (h[1:] != h[:-1])) if len(f) else np.zeros(0, bool)
    size = np.diff(np.append(np.flatnonzero(new), len(f)))
    many = np.repeat(size > 1, size) | (copies[doc] > 1)
    raw = data.tobytes()
    # settled: one row for each; then the representative with its bytes
    settled, send = np.flatnonzero(many), np.flatnonzero(new)
    which = np.concatenate([settled, send])
    ctx = [None] * len(settled) + [raw[a:b] for a, b in zip(lo[send].tolist(), hi[send].tolist(), strict=True)]
    group_many = np.maximum.reduceat(many, send) if len(send) else np.zeros(0, bool)
    flags = np.concatenate([np.ones(len(settled), bool), group_many])
    # settled rows only pass through the next exchange: spread, not gathered at their anchor
    to = np.concatenate([mix(keys[doc[settled]].view(_U) + lo[settled].astype(_U)), f[send]])
    rows = [signed(to), signed(h[which])]
    return pa.Table.from_arrays(
        [pa.array(rows[0]), pa.array(rows[1]), pa.array(ctx, pa.binary()), pa.array(np.full(len(which), bucket), pa.int32()),
         pa.array(keys[doc[which]]), pa.array(lo[which] - offs[doc[which]], pa.int32()), pa.array(hi[which] - lo[which], pa.int32()), pa.array(flags)],
        ["f", "h", "ctx", "bucket", "key", "at", "n", "many"])


def repeated_starts(ctx: list[bytes], place_id: np.ndarray, many: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array of a shard of contexts: (text offsets of contexts, whether the
    string of ``width`` bytes at each text position repeats, a representative of
    each group of equal strings).

    ``place_id`` identifies the place of each context's first byte in the corpus:
    one place seen through two contexts is no repeat."""
    text = np.frombuffer(b"".join(ctx), np.uint8)
    lens = np.array([len(c) for c in ctx], np.int64)
    base = np.concatenate([[0], np.cumsum(lens)])
    limit = np.repeat(base[1:].astype(np.int32), lens) - np.arange(len(text), dtype=np.int32)
    lead = limit >= width
    repeats = lead & np.repeat(many, lens)
    pos, new = equal_prefixes(text, limit, width)
    if len(pos):
        owner = np.searchsorted(base, pos, side="right") - 1
        pid = place_id[owner] + (pos - base[owner]).astype(_U)
        heads = np.flatnonzero(new)
        size = np.diff(np.append(heads, len(pos)))
        two = np.minimum.reduceat(pid, heads) != np.maximum.reduceat(pid, heads)
        repeats[pos] = np.repeat(two | np.maximum.reduceat(repeats[pos], heads), size)
        lead[pos] = new
    return base, repeats, lead


class _Shard:
    """Contexts of consecutive anchors of one partition, up to SHARD_BYTES."""

    def __init__(self, width: int) -> None:
        self.width = width
        self.f: list[int] = []
        self.h: list[int] = []
        self.ctx: list[bytes] = []
        self.rows: list[tuple[int, int, int, int]] = []
        self.many: list[bool] = []
        self.bytes = 0

    def solve(self, open_classes: set[int], n_parts: int) -> pa.RecordBatch:
        """Rows of _FOUND: settled spans, and for anchors that are split over
        shards the distinct strings to be merged with other shards."""
        f, h = np.array(self.f, np.int64), np.array(self.h, np.int64)
        new = np.append(True, (f[1:] != f[:-1]) | (h[1:] != h[:-1])) if len(f) else np.zeros(0, bool)
        heads = np.flatnonzero(new)
        size = np.diff(np.append(heads, len(f)))
        one = np.cumsum(new) - 1
        many = (size > 1) | (np.maximum.reduceat(np.array(self.many), heads) if len(heads) else np.zeros(0, bool))
        rows = np.array(self.rows, np.int64).reshape(-1, 4)  # bucket, key, at, n
        out = [rows[many[one]]]
        # an anchor with one distinct context, all of it in this shard, has nothing left to compare
        kind = f[heads]
        n_kind = np.repeat(*(lambda u: (u, u))(np.unique(kind, return_counts=True)[1])) if len(kind) else kind
        is_open = np.isin(kind, list(open_classes))
        work = np.flatnonzero((n_kind > 1) | is_open)
        exported = None
        if len(work):
            owners = rows[heads[work]]
            pid = mix(owners[:, 1].view(_U)) + owners[:, 2].astype(_U)
            ctx = [self.ctx[i] for i in heads[work]]
            base, repeats, lead = repeated_starts(ctx, pid, many[work], self.width)
            at = np.flatnonzero(repeats)
            if len(at):
                own = np.searchsorted(base, at, side="right") - 1
                cut = np.append(True, (at[1:] != at[:-1] + 1) | (own[1:] != own[:-1]))
                s, e = at[np.flatnonzero(cut)], at[np.flatnonzero(np.append(cut[1:], True))] + self.width
                own = own[np.flatnonzero(cut)]
                span = owners[own].copy()
                span[:, 2] += s - base[own]
                span[:, 3] = e - s
                out.append(span)
            if is_open.any():
                exported = self._export(ctx, base, repeats, lead, owners, is_open[work])
        return _packed(np.concatenate(out), exported, n_parts)

    def _export(self, ctx, base, repeats, lead, owners, is_open):
        """One row for each distinct string of a split anchor's contexts: the lead
        of its group stands for all, the others being settled by it."""
        data = np.frombuffer(b"".join(ctx), np.uint8)
        pos = np.flatnonzero(lead)
        own = np.searchsorted(base, pos, side="right") - 1
        pos, own = pos[is_open[own]], own[is_open[own]]
        values = _BYTES[data]
        hi = _ROLL.spans(_ROLL.prefix(values), pos, pos + self.width)
        lo = _ROLL2.spans(_ROLL2.prefix(values), pos, pos + self.width)
        rows = owners[own, :3].copy()
        rows[:, 2] += pos - base[own]
        return rows, hi, lo, repeats[pos]


def _packed(done: np.ndarray, exported: tuple | None, n_parts: int) -> pa.RecordBatch:
    """Settled spans (bucket, key, at, n) by bucket, strings of split anchors by
    the range of their fingerprint, each as one row of arrays."""
    rows: list[tuple] = []
    done = done[np.argsort(done[:, 0], kind="stable")]
    for own in np.split(done, np.flatnonzero(done[1:, 0] != done[:-1, 0]) + 1):
        if len(own):
            rows.append((int(own[0, 0]) % n_parts, int(own[0, 0]), None, None, own[:, 1:].tobytes(), None))
    if exported is not None:
        who, hi, lo, many = exported
        for part, arrays in pack(hi, n_parts, lo, who, many):
            rows.append((part, None, *arrays))
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    cols = list(zip(*rows, strict=True)) if rows else [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["part", "bucket", "hi", "lo", "who", "many"])


def _solve_shards(batches: Iterator[pa.RecordBatch], width: int, n_parts: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by anchor; a shard closes between anchors, or inside one
    that has more contexts than a shard holds."""
    shard, split = _Shard(width), None
    for b in batches:
        cols = [b.column(c).to_pylist() for c in ("f", "h", "ctx", "bucket", "key", "at", "n", "many")]
        settled: list[tuple[int, int, int, int]] = []
        for f, h, ctx, bucket, key, at, n, many in zip(*cols, strict=True):
            if ctx is None:
                settled.append((bucket, key, at, n))
                continue
            if shard.bytes + len(ctx) > SHARD_BYTES:
                same = shard.f[-1] == f
                yield shard.solve({split, f if same else None} - {None}, n_parts)
                split = f if same else (split if split == f else None)
                shard = _Shard(width)
            repeat = bool(shard.f) and shard.f[-1] == f and shard.h[-1] == h
            shard.f.append(f)
            shard.h.append(h)
            shard.ctx.append(b"" if repeat else ctx)
            shard.bytes += 0 if repeat else len(ctx)
            shard.rows.append((bucket, key, at, n))
            shard.many.append(many)
        if settled:
            yield _packed(np.array(settled, np.int64), None, n_parts)
    yield shard.solve({split} - {None}, n_parts)


def merge_shards(part: pa.Table, width: int = WIDTH) -> pa.Table:
    """Settled spans pass; of the strings of one fingerprint each is a repeat if
    two places or a repeated one are among them."""
    own = part.filter(part.column("bucket").is_valid())
    buckets, spans = own.column("bucket").to_pylist(), own.column("who").to_pylist()
    lists = part.filter(part.column("bucket").is_null())
    if len(lists):
        his = [np.frombuffer(x, _U) for x in lists.column("hi").to_pylist()]
        lo, many = (np.frombuffer(b"".join(lists.column(c).to_pylist()), k) for c, k in (("lo", _U), ("many", np.bool_)))
        who = np.frombuffer(b"".join(lists.column("who").to_pylist()), np.int64).reshape(-1, 3)
        hi = np.concatenate(his)
        values = np.unique(hi)
        group = np.concatenate([np.searchsorted(values, x) for x in his])  # each sorted list by binary search
        # strings that are alone in their group and in their own shard are no repeats
        near = np.flatnonzero((np.bincount(group, minlength=len(values))[group] > 1) | many)
        near = near[np.lexsort((lo[near], group[near]))]
        if len(near):
            g, low = group[near], lo[near]
            heads = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (low[1:] != low[:-1])))
            place = mix(who[near, 1].view(_U)) + who[near, 2].astype(_U)
            again = (np.minimum.reduceat(place, heads) != np.maximum.reduceat(place, heads)) | np.maximum.reduceat(many[near], heads)
            who = who[near[np.repeat(again, np.diff(np.append(heads, len(near))))]]
            who = who[np.argsort(who[:, 0], kind="stable")]
            for rows in np.split(who, np.flatnonzero(who[1:, 0] != who[:-1, 0]) + 1):
                if len(rows):
                    buckets.append(int(rows[0, 0]))
                    spans.append(np.column_stack([rows[:, 1:], np.full(len(rows), width)]).tobytes())
    return pa.Table.from_arrays([pa.array(buckets, pa.int32()), pa.array(spans, pa.binary())], ["bucket", "who"])


def _bucketed(docs: DataFrame, carry: Column, n_bytes: int) -> DataFrame:
    n = buckets_for(n_bytes, BUCKET_BYTES)
    return docs.select(F.pmod(row_key(), F.lit(n)).cast("int").alias("bucket"), row_key().alias("key"), carry.alias("row"), text_bytes().alias("raw"))


def _distinct_docs(part: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, bytes, offsets, copies) of the distinct documents of a bucket."""
    keys, first, copies = np.unique(part.column("key").to_numpy(), return_index=True, return_counts=True)
    data, offs = flat(part.column("raw").take(pa.array(first)))
    return keys, data, offs, copies


def _run(docs: DataFrame, carry: Column, finish: Callable[[pa.Table, list[list[tuple[int, int]]]], pa.Table], schema, width: int = WIDTH) -> DataFrame:
    """``finish(bucket rows, removed intervals of each row)`` after all rounds."""
    n_bytes = total_bytes(docs)
    n_merge = n_bytes // MERGE_BYTES + 1
    n_parts = max(1, n_bytes // 170 // KEYS_PER_PART + 1)
    texts = _bucketed(docs, carry, n_bytes)

    def pick(part: pa.Table) -> pa.Table:
        _, data, offs, copies = _distinct_docs(part)
        place, f = anchors(data, offs, width)
        twice = copies[np.searchsorted(offs, place, side="right") - 1] > 1
        return packed_table(part.column("bucket")[0].as_py(), np.concatenate([f, f[twice]]), n_parts)

    def cut(part: pa.Table, wanted: pa.Table) -> pa.Table:
        if not part.num_rows:
            return pa.table({n: [] for n in ("f", "h", "ctx", "bucket", "key", "at", "n", "many")}, schema=_context_schema())
        keys, data, offs, copies = _distinct_docs(part)
        want = np.sort(np.frombuffer(b"".join(wanted.column("keys").to_pylist()), _U))
        return cut_contexts(part.column("bucket")[0].as_py(), keys, data, offs, copies, want, width)

    def close(part: pa.Table, spans: pa.Table) -> pa.Table:
        key, at, n = np.frombuffer(b"".join(spans.column("who").to_pylist()), np.int64).reshape(-1, 3).T
        order = np.argsort(key, kind="stable")
        key, at, n = key[order], at[order], n[order]
        gone = []
        for k in part.column("key").to_pylist():
            lo, hi = np.searchsorted(key, k), np.searchsorted(key, k, side="right")
            s, e = merge_intervals(at[lo:hi], at[lo:hi] + n[lo:hi])
            gone.append(list(zip(s.tolist(), e.tolist(), strict=True)))
        return finish(part, gone)

    shared = shared_keys(texts.groupBy("bucket").applyInArrow(frugal_group(pick), PACKED))
    contexts = texts.groupBy("bucket").cogroup(shared.groupBy("bucket")).applyInArrow(frugal_cogroup(cut), _CONTEXT)
    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _solve_shards(batches, width, n_merge)

    def merge(part: pa.Table) -> pa.Table:
        return merge_shards(part, width)

    found = contexts.repartition("f").sortWithinPartitions("f", "h").mapInArrow(frugal(solve), _FOUND)
    spans = found.groupBy("part").applyInArrow(frugal_group(merge), _SPANS)
    return texts.groupBy("bucket").cogroup(spans.groupBy("bucket")).applyInArrow(frugal_cogroup(close), schema)


def _context_schema() -> pa.Schema:
    return pa.schema([("f", pa.int64()), ("h", pa.int64()), ("ctx", pa.binary()), ("bucket", pa.int32()), ("key", pa.int64()),
                      ("at", pa.int32()), ("n", pa.int32()), ("many", pa.bool_())])


def keep_bytes(raw: bytes, gone: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for s, e in gone:
        out.append(raw[at:s])
        at = e
    return b"".join([*out, raw[at:]])


def dedup_digest(docs: DataFrame) -> DataFrame:
    """The registered query."""
    def finish(part: pa.Table, gone: list[list[tuple[int, int]]]) -> pa.Table:
        raws = part.column("raw").to_pylist()
        return pa.Table.from_arrays(
            [pa.array([r["doc_id"] for r in part.column("row").to_pylist()], part.schema.field("row").type.field("doc_id").type),
             pa.array([len(r) for r in raws], pa.int64()), pa.array([sum(e - s for s, e in g) for g in gone], pa.int64()),
             pa.array([len(g) for g in gone], pa.int64()),
             pa.array([hashlib.sha256(keep_bytes(r, g)).hexdigest() for r, g in zip(raws, gone, strict=True)], pa.string())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return written_small(_run(docs, F.struct("doc_id"), finish, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))


def dedup(docs: DataFrame, width: int = WIDTH, min_words: int = 0) -> DataFrame:
    """All columns of ``docs``, the text without its repeated bytes (a null text
    stays null): the bytes of strings of ``width`` bytes that occur elsewhere, in
    runs that hold at least ``min_words`` words (or parts of words)."""
    def finish(part: pa.Table, gone: list[list[tuple[int, int]]]) -> pa.Table:
        rows = part.column("row").combine_chunks()
        if min_words:
            gone = [[(s, e) for s, e in spans if len(raw[s:e].split()) >= min_words] for raw, spans in zip(part.column("raw").to_pylist(), gone, strict=True)]
        names = [f.name for f in rows.type]
        cols = rows.flatten()
        i = names.index("text")
        cols[i] = pa.array([keep_bytes(raw, g).decode("utf-8", "ignore") if g else old for old, raw, g in
                            zip(cols[i].to_pylist(), part.column("raw").to_pylist(), gone, strict=True)], cols[i].type)
        return pa.Table.from_arrays(cols, names)

    return written_small(_run(docs, F.struct("*"), finish, docs.schema, width))
