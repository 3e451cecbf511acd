"""Token counts by batch encoding inside Arrow functions that return lengths only."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import Chunks, text_segments

#: Chunks whose counts a Python worker remembers; a bound on memory, without effect on results.
MEMO = 400_000
#: UTF-8 bytes that one call of the library gets.
CALL_BYTES = 1 << 20

_tokenizers: dict[bytes, object] = {}


def digest(spec: str) -> bytes:
    """A name for the JSON text ``spec`` of a tokenizer, by which workers remember what hangs on it."""
    return hashlib.sha256(spec.encode()).digest()


def tokenizer(spec: str):
    """The worker's tokenizer for the JSON text ``spec``, parsed once."""
    key = digest(spec)
    if key not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ["RAYON_NUM_THREADS"] = "1"
        from tokenizers import Tokenizer

        made = Tokenizer.from_str(spec)
        made.no_truncation()
        made.no_padding()
        _tokenizers[key] = made
    return _tokenizers[key]


def encode_lengths(tok, chunks: list[str], call_bytes: int = CALL_BYTES) -> list[int]:
    """Numbers of ids of the chunks, in calls balanced by bytes."""
    out: list[int] = []
    batch: list[str] = []
    size = 0
    for chunk in chunks:
        batch.append(chunk)
        size += len(chunk) if chunk.isascii() else len(chunk.encode())
        if size >= call_bytes:
            out += [len(e) for e in tok.encode_batch_fast(batch, add_special_tokens=False)]
            batch, size = [], 0
    return out + [len(e) for e in tok.encode_batch_fast(batch, add_special_tokens=False)] if batch else out


_memos: dict[bytes, dict[str, int]] = {}


def _counted(tok, chunks: list[str], memo: dict[str, int]) -> np.ndarray:
    missing = [c for c in chunks if c not in memo]
    if missing:
        if len(memo) + len(missing) > MEMO:
            memo.clear()
            missing = chunks
        found = dict(zip(missing, encode_lengths(tok, missing)))
        kept = {c: n for c, n in found.items() if len(c) <= 64}
        memo.update(kept)
        return np.fromiter((found[c] if c in found else memo[c] for c in chunks), np.int64, len(chunks))
    return np.fromiter(map(memo.__getitem__, chunks), np.int64, len(chunks))


def _counter(spec) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(spec.value)
        # a worker may meet several tokenizers, and a chunk has other ids in each
        memo = _memos.setdefault(digest(spec.value), {})
        for ids, raw in text_segments(batches):
            cut = Chunks([t.decode("utf-8", "replace") if t else "" for t in raw])
            n = cut.sums(
                np.array(encode_lengths(tok, cut.heads), np.int64), _counted(tok, [" " + c for c in cut.tails], memo)
            )
            size = pa.array([len(t) if t else 0 for t in raw], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, size, pa.array(n)], names=["id", "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, spec_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of every whole text by the tokenizer in ``spec_path`` (a file of the driver).

    For byte-level tokenizers whose pattern joins a blank to what follows.  Texts are cut where no
    token can cross (see :class:`Chunks`), segments hold about equal numbers of bytes, and each
    distinct chunk of a segment is encoded once.  Special strings in a text are treated as
    the library does by default; nothing is added, cut or padded.  A null text counts as empty (0, 0); repeated
    rows and null ids are returned as they come; other columns are ignored.
    """
    spark = docs.sparkSession
    with open(spec_path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_counter(spec), f"id {kind}, n_bytes bigint, n_tokens bigint")
