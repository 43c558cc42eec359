"""Parts that were rewritten to cost less: the same results as plain re-statements of them."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("recframe.llm")

from recframe.llm import ann, common, recompress  # noqa: E402
from recframe.llm.suffix import equal_prefixes  # noqa: E402
from recframe.llm.suffix_dedup import SHARD_BYTES, anchors, repeated_starts  # noqa: E402


@pytest.mark.parametrize("rows, ids", [(7, 7), (300, 300), (300, 90), (2500, 2500)])
def test_collisions_are_counted_window_by_window(rows, ids, monkeypatch):
    """The first round whose windows hold enough ids, whatever round the query before ended in."""
    rng = np.random.default_rng(rows)
    x = rng.standard_normal((rows, 8)) * rng.choice([0.01, 0.2, 1.0], (rows, 1))
    x[rows // 2:] = x[rows // 2:].round(1)  # equal projections
    of = np.arange(rows) % ids
    proj = ann.lines(8)
    index = ann.CollisionIndex(x, proj, of)
    centres = np.concatenate([x[:20] @ proj, rng.standard_normal((20, 8)) @ proj])
    asked = []
    monkeypatch.setattr(index, "tally", lambda lo, size, tally=index.tally: asked.append(1) or tally(lo, size))
    got = list(index.candidates(centres, 5))
    p = x @ proj
    need = min(ids, 5 + int(ann.ENOUGH * ids))
    for c, rows_found in zip(centres, got, strict=True):
        for r in range(ann.ROUNDS):
            half = ann.START * ann.RATIO ** r
            want = np.flatnonzero(((p >= c - half) & (p <= c + half)).sum(1) >= np.ceil(ann.THRESHOLD * ann.LINES))
            if len(set(of[want])) >= need:
                break
        if len(set(of[want])) < min(ids, 5):
            want = np.arange(rows)
        assert rows_found.tolist() == want.tolist()
    assert len(asked) <= (ann.ROUNDS + 1) * len(centres)


@pytest.mark.parametrize("width", [1, 3, 8, 50])
def test_equal_prefixes_are_all_that_the_suffix_array_needs(width):
    """Runs of suffixes that share the width, in order; texts end where they end."""
    rng = np.random.default_rng(width)
    for letters in (1, 2, 30, 200):
        texts = [rng.integers(0, letters, n).astype(np.uint8).tobytes() for n in rng.integers(1, 120, 8)]
        texts += [t[int(rng.integers(0, 5)):] + b"\1" for t in texts[:4]]
        data, lens = b"".join(texts), [len(t) for t in texts]
        limit = np.repeat(np.cumsum(lens), lens) - np.arange(len(data))
        want: dict[bytes, list[int]] = {}
        for i in np.flatnonzero(limit >= width).tolist():
            want.setdefault(data[i:i + width], []).append(i)
        pos, new = equal_prefixes(np.frombuffer(data, np.uint8), limit.astype(np.int32), width)
        got = [sorted(p.tolist()) for p in np.split(pos, np.flatnonzero(new)[1:])] if len(pos) else []
        assert got == [v for _, v in sorted(want.items()) if len(v) > 1]


def test_a_shard_takes_little_memory():
    """A suffix array of a whole shard, with numpy's own accounts: under 64 bytes for one of text."""
    text = np.random.default_rng(1).integers(97, 123, SHARD_BYTES // 2).astype(np.uint8).tobytes()
    contexts = [t for i in range(0, len(text), 750) for t in (text[i:i + 750], text[i:i + 700])]
    tracemalloc.start()
    base, repeats, _ = repeated_starts(contexts, np.arange(len(contexts), dtype=np.uint64) << np.uint64(32), np.zeros(len(contexts), bool))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 * base[-1] and repeats.sum() == 2 * sum(max(0, n - 399) for n in np.diff(base)[1::2])


def _bucket(rng, n_words, lengths):
    """Texts of random words, the second half of them the first once more: (bytes, offsets)."""
    words = [rng.integers(97, 123, n).astype(np.uint8).tobytes() for n in rng.integers(*lengths, n_words)]
    texts = [b" ".join(words[i:i + 300]) for i in range(0, n_words, 300)] * 2
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts])


def test_a_bucket_of_words_takes_little_memory(monkeypatch):
    """All steps of operator 5 on a whole bucket, with numpy's own accounts: under 32 bytes for one of text."""
    data, offs = _bucket(np.random.default_rng(3), recompress.BUCKET_BYTES // 14, (2, 11))
    assert len(data) > 0.9 * recompress.BUCKET_BYTES
    monkeypatch.setattr(common, "_BYTE_ROLL", common.Roller(common._BYTE_ROLL.base))
    tracemalloc.start()
    text = recompress.BucketText(data, offs)
    _, least, has = text.keys()
    wanted = np.unique(least[has])
    del least, has
    rows = recompress.window_rows(0, np.arange(len(offs) - 1), text, wanted, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 * len(data)
    assert sum(len(x) for x in rows.column("h").to_pylist()) // 8 == len(text.at) // 2
    assert sum(len(x) for x in rows.column("s_doc").to_pylist()) // 4 == (len(offs) - 1) // 2


def test_names_made_in_pieces_are_those_of_the_whole():
    """Words longer than a piece, gaps between windows wider than one, no words at all."""
    rng = np.random.default_rng(4)
    data, offs = _bucket(rng, 30_000, (1, 20))
    data = np.concatenate([data, np.full(recompress.PIECE + 9, 97, np.uint8), data])
    offs = np.concatenate([offs, offs + offs[-1] + recompress.PIECE + 9])
    for d, o in ((data, offs), (data[:0], offs[:1])):
        starts, ends, _ = common.word_spans(d, o, common.SPACE_WORD)
        words = recompress.word_names(d, starts, ends)
        assert (words == common.span_hashes(d, starts, ends)).all()
    words = rng.integers(0, 9, 3 * recompress.PIECE).astype(np.uint64)
    at = np.arange(len(words) - recompress.WINDOW + 1)
    for some in (at, at[(at < 100) | (at > 2 * recompress.PIECE)], at[:0]):
        for roll in ((), (recompress._CHECK,)):
            assert (recompress.window_names(words, some, *roll) == common.window_hashes(words, some, recompress.WINDOW, *roll)).all()


def test_every_step_of_recompression_hands_its_memory_back(spark, monkeypatch):
    seen = []
    for name in ("frugal_group", "frugal_cogroup"):
        monkeypatch.setattr(recompress, name, lambda f, wrap=getattr(common, name): seen.append(f.__name__) or wrap(f))
    text = " ".join(str(i) for i in range(25))
    got = recompress.dedup_digest(spark.createDataFrame([(1, text), (2, text), (3, None)], "doc_id long, text string"))
    assert {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in got.collect()} == {1: (25, 0), 2: (25, 25), 3: (0, 0)}
    assert sorted(seen) == ["close", "cut", "later_windows", "pick"]


def test_least_grams_are_dealt_evenly():
    """Anchors are least fingerprints, all near 0; no range of their exchange gets more than its share, none is lost."""
    data = np.random.default_rng(2).integers(97, 123, 200_000).astype(np.uint8)
    _, keys = anchors(data, np.array([0, len(data)]), 200)
    keys = np.concatenate([keys, keys[:100]])
    rows = common.packed_table(7, keys, 8).to_pylist()
    got = [np.frombuffer(r["keys"], np.uint64) for r in rows]
    assert max(map(len, got)) < 1.5 * len(set(keys.tolist())) / 8
    assert {(r["part"], r["bucket"]) for r in rows} == {(p, 7) for p in range(8)}
    many = {k: m for r, ks in zip(rows, got, strict=True) for k, m in zip(ks.tolist(), np.frombuffer(r["many"], np.bool_).tolist(), strict=True)}
    values, counts = np.unique(keys, return_counts=True)
    assert many == dict(zip(values.tolist(), (counts > 1).tolist(), strict=True)) and sum(map(len, got)) == len(values)


def test_a_worker_keeps_nothing_of_a_task(monkeypatch):
    """What a Python task held goes back when its work ends, not when the worker gets another task."""
    said = []
    monkeypatch.setattr(common, "hand_back", lambda done=False: said.append("end" if done else "start"))
    batch = pa.record_batch({"x": [1]})
    out = common.frugal(lambda batches: (said.append("work") or b for b in batches))(iter([batch]))
    assert [x.num_rows for x in out] == [1]
    table = pa.table({"x": [1]})
    assert common.frugal_group(lambda t: said.append("work") or t)(table) is table
    assert common.frugal_cogroup(lambda a, b: said.append("work") or b)(table, table) is table
    assert said == ["start", "work", "end"] * 3
