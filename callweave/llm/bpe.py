"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .subwords import encoder, read_ranks, tokenizer_of

_TYPES = {
    "n_tokens": ("long", pa.int64()),
    "ids": ("array<int>", pa.list_(pa.int32())),
    "offsets": ("array<int>", pa.list_(pa.int32())),
    "ids_sha256": ("string", pa.string()),
    "decoded_sha256": ("string", pa.string()),
}
_tables: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def byte_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all tokens end to end, where each id's bytes start, and how many there are.

    For .json vocabularies the byte-to-character mapping is reversed; tokens outside it (special
    tokens) stand for their own UTF-8.
    """
    if path not in _tables:
        if path.endswith(".tiktoken"):
            tokens = {i: t for t, i in read_ranks(path).items()}
        else:
            from .subwords import byte_chars

            back = {c: b for b, c in enumerate(byte_chars())}
            tokens = {i: bytes(back[c] for c in t) if all(c in back for c in t) else t.encode() for t, i in tokenizer_of(path).get_vocab(with_added_tokens=True).items()}
        size = np.zeros(max(tokens) + 1, np.int64)
        for i, t in tokens.items():
            size[i] = len(t)
        flat = np.frombuffer(b"".join(tokens.get(i, b"") for i in range(len(size))), np.uint8)
        _tables[path] = flat, np.cumsum(size) - size, size
    return _tables[path]


def spread(starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of each run of `size` items, end to end."""
    ends = np.cumsum(size)
    return np.repeat(starts - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def decode_ids(ids: np.ndarray, path: str) -> tuple[bytes, np.ndarray]:
    """All bytes of the ids, and where in them each id's bytes start.

    A character split over several tokens is whole again once their bytes are joined; cutting in
    between would break it, so callers decode to text only at document bounds.
    """
    flat, starts, size = byte_table(path)
    own = size[ids]
    return flat[spread(starts[ids], own)].tobytes(), np.cumsum(own) - own


def encode(docs: DataFrame, path: str, pattern: str | None = None, columns: tuple[str, ...] = ("n_tokens", "ids", "offsets"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of docs with the ids of their whole texts.

    columns: n_tokens; ids; offsets (the byte at which each token starts in the UTF-8 text);
    ids_sha256 (of the ids as little-endian unsigned 32-bit integers); decoded_sha256 (of the bytes
    that decoding the ids gives). A null text counts as empty, an empty one has no ids (the digests
    are those of no bytes). Null or repeated ids are rows like others; other columns are dropped. One
    narrow pass over the input: no shuffle, memory bounded by a few MB of text at a time.
    """
    kinds = [_TYPES[c] for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoder(path, pattern)
        for batch in slices(batches):
            ids, n = made.encode(batch.column("text").to_pylist())
            ends = np.concatenate([[0], np.cumsum(n)])
            out: dict[str, object] = {"n_tokens": n}
            raw = ids.astype("<u4").tobytes() if "ids_sha256" in columns else b""
            if "ids_sha256" in columns:
                out["ids_sha256"] = [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            if {"offsets", "decoded_sha256"} & set(columns):
                text, at = decode_ids(ids, path)
                at = np.concatenate([at, [len(text)]])
                first = at[ends]
                if "decoded_sha256" in columns:
                    out["decoded_sha256"] = [hashlib.sha256(text[a:b]).hexdigest() for a, b in zip(first[:-1], first[1:], strict=True)]
                if "offsets" in columns:
                    out["offsets"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(at[:-1] - np.repeat(first[:-1], n), pa.int32()))
            if "ids" in columns:
                out["ids"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(out[c] if isinstance(out[c], pa.Array) else pa.array(out[c], t) for c, (_, t) in zip(columns, kinds, strict=True))], names=["id", *columns])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, " + ", ".join(f"{c} {s}" for c, (s, _) in zip(columns, kinds, strict=True))).withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Rows of tokens with the bytes and, where they are valid UTF-8, the text of their ids (else null).

    Null ids give null bytes; no ids give no bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for ids in batch.column("ids"):
                found.append(None if not ids.is_valid else decode_ids(ids.values.to_numpy(zero_copy_only=False).astype(np.int64), path)[0])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.binary())], names=["id", "decoded"])

    kind = tokens.select(id_col).schema[0].dataType.simpleString()
    out = tokens.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, decoded binary")
    text = F.when(F.expr("is_valid_utf8(cast(decoded as string))"), F.col("decoded").cast("string"))
    return out.select(F.col("id").alias(id_col), "decoded", text.alias("text"))
