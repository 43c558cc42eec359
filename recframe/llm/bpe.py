"""Operator 7: byte-level BPE encoding and decoding with the tiktoken library.

The ranks come from a local rank file whose path is a parameter.  Long texts
are cut before the regex split at boundaries no match can cross, so memory
stays at a piece; ids are decoded as raw bytes.

Defined cases: a null text counts as empty (no ids); repeated rows give one
result each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from recframe.llm.common import blocks, frugal, text_bytes, written_small

#: Characters of text handed to the library at once.
PIECE_CHARS = 1 << 16


@functools.lru_cache(maxsize=4)
def encoding(rank_path: str, pattern: str):
    """The tiktoken encoding of a rank file, once per Python worker."""
    import tiktoken

    with open(rank_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_cut(text: str, start: int) -> int:
    """First place at or after ``start`` that no match of the pattern crosses,
    or the end of the text.

    Before a space that follows a non-space character and precedes an ASCII
    letter: the match on the left ends at the space (no alternative goes on
    from a non-space into a space), and the one on the right begins with it.
    """
    at = max(start, 1)
    while (at := text.find(" ", at)) >= 0:
        if at + 1 < len(text) and text[at + 1].isascii() and text[at + 1].isalpha() and not text[at - 1].isspace():
            return at
        at += 1
    return len(text)


def pieces(text: str, limit: int = PIECE_CHARS) -> Iterator[str]:
    at = 0
    while len(text) - at > limit:
        stop = safe_cut(text, at + limit)
        yield text[at:stop]
        at = stop
    yield text[at:]


def encode(enc, text: str, limit: int = PIECE_CHARS) -> list[int]:
    """Ids of the whole text, as ``encode_ordinary`` gives them."""
    if len(text) <= limit:
        return enc.encode_ordinary(text)
    return [i for piece in pieces(text, limit) for i in enc.encode_ordinary(piece)]


def tokenize(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """doc_id and token ids (array<int>) of each document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_path, pattern)
        for b in batches:
            ids = [encode(enc, t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    d = docs.select("doc_id", "text")
    return written_small(d.mapInArrow(frugal(run), f"doc_id {d.schema['doc_id'].dataType.simpleString()}, ids array<int>"))


def detokenize(tokens: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """doc_id and the raw bytes (binary) that the ids stand for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_path, pattern)
        for b in batches:
            out = [enc.decode_bytes(ids or []) for ids in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    d = tokens.select("doc_id", "ids")
    return d.mapInArrow(frugal(run), f"doc_id {d.schema['doc_id'].dataType.simpleString()}, bytes binary")


@functools.lru_cache(maxsize=4)
def _decimal(n_vocab: int) -> list[str]:
    return [str(i) for i in range(n_vocab)]


def round_trip(docs: DataFrame, rank_path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Encode, decode and fingerprint every document in one narrow pass: doc_id,
    n_tokens, ids_sha256, decoded_sha256 and, if wanted, ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_path, pattern)
        decimal = _decimal(enc.n_vocab + 1)
        for batch in batches:
            for b in blocks(batch, "raw"):
                counts, ids_sha, text_sha = [], [], []
                kept = array("i")
                for value in b.column("raw").to_pylist():
                    n, as_ids, as_text = 0, hashlib.sha256(), hashlib.sha256()
                    for piece in pieces(value.decode()):
                        ids = enc.encode_ordinary(piece)
                        if ids:
                            as_ids.update((("," if n else "") + ",".join(map(decimal.__getitem__, ids))).encode())
                            as_text.update(enc.decode_bytes(ids))
                            n += len(ids)
                            if with_ids:
                                kept.extend(ids)
                    counts.append(n)
                    ids_sha.append(as_ids.hexdigest())
                    text_sha.append(as_text.hexdigest())
                cols = [b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    edge = np.concatenate([[0], np.cumsum(counts)])
                    cols.append(pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(np.frombuffer(kept, np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    d = docs.select("doc_id", text_bytes().alias("raw"))
    ids = ", ids array<int>" if with_ids else ""
    return written_small(d.mapInArrow(frugal(run), f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string{ids}"))
