"""Byte-level BPE: ranked merges folded by Spark over the byte arrays of distinct words.

Texts are handled in blocks of some megabytes.  An Arrow function cuts the texts of a block into the words of the pattern and
returns a row for each distinct word, then rows of texts as numbers of words.  In the same stage and without a
shuffle, ``aggregate`` folds merges over each distinct word, taking the least-ranked neighbouring pair
each time, and concatenates the binary pieces of the ids it got.  A second Arrow function, which gets the rows in the same
order, puts ids and pieces of each text together.  The rank map is a literal: a perfect hash table over pairs
of ids, so that a look-up costs one array access instead of a scan of a Spark map.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from claimloom.llm.common import frugal, stored, text_segments

#: Words of more bytes are merged by a heap in Python, with the same ids; a fold would take time in the square of the length.
LONGEST_FOLD = 192
#: Text bytes of a block: the larger, the fewer words are folded in more than one block.
BLOCK = 16 << 20
#: Words that are folded once beforehand at most, the commonest of about so many documents; both bound memory and time, no id hangs on them.
MEMO_WORDS, MEMO_DOCS = 200_000, 8_000
#: Distinct words of a row batch, and word numbers of a row of texts, that an Arrow function returns at once.
_WORDS_AT_ONCE, _CODES_AT_ONCE = 8192, 1 << 18
_RANK_BITS = 17


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a tiktoken file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def pair_table(ranks: dict[bytes, int]) -> tuple[list[int], list[int]]:
    """All pairs of ids that merge, as displaced rows in one array: (cells, place of each id's row).

    Cell ``rows[left] + right`` holds ``(left + 1) * 2**17 + rank`` if the pair merges; another owner's cell, 0 or
    nothing (beyond the array) else.  Rows go where all their cells are free, long rows first.
    """
    of: dict[int, list[tuple[int, int]]] = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                of.setdefault(left, []).append((right, rank))
    n_ids = max(ranks.values(), default=0) + 1
    size = 3 * sum(map(len, of.values())) + n_ids
    while (found := _displaced(of, n_ids, size)) is None:
        size = size * 3 // 2
    return found


def _displaced(of: dict[int, list[tuple[int, int]]], n_ids: int, size: int) -> tuple[list[int], list[int]] | None:
    """The table and places of rows of (right, rank) in ``size`` cells; None if a row finds no room."""
    owned = np.zeros(size, np.int64)
    rows = np.zeros(n_ids, np.int64)
    single = []
    start = 0
    for left, members in sorted(of.items(), key=lambda row: -len(row[1])):
        if len(members) == 1:
            single.append((left, *members[0]))
            continue
        rights, found = (np.array(x, np.int64) for x in zip(*members))
        # from where the last row went on, around the array
        for at in range(0, size - n_ids, 64):
            turns = (start + at + np.arange(64)) % (size - n_ids)
            fits = np.flatnonzero((owned[turns[:, None] + rights] == 0).all(axis=1))
            if len(fits):
                break
        else:
            return None
        start = rows[left] = turns[fits[0]]
        owned[start + rights] = left + 1 << _RANK_BITS | found
    if single:
        lefts, rights, found = np.array(single, np.int64).T
        places = np.flatnonzero(owned == 0)[: len(lefts)]
        rows[lefts] = places - rights
        owned[places] = lefts + 1 << _RANK_BITS | found
    return np.trim_zeros(owned, "b").tolist(), rows.tolist()


def _literal(values, kind: str) -> Column:
    """An array literal: the cast of a split string, which Catalyst folds to a constant."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def fold_merges(word: Column, ranks: dict[bytes, int]) -> Column:
    """Ids of a word (array of byte values, not empty) by ranked merges, as a column expression.

    Steps of the fold take turns: one finds the pair of least rank, the next one merges it, until there is none.
    """
    table, places = pair_table(ranks)
    cells, rows = _literal(table, "bigint"), _literal(places, "int")
    of_byte = _literal([ranks.get(bytes([b]), -1) for b in range(256)], "int")
    none = 1 << (_RANK_BITS + 12)

    def step(state: Column, _: Column) -> Column:
        ids, best = state["ids"], state["best"]

        def rated(left: Column, k: Column) -> Column:
            # rank * 4096 + position where the cell is this row's own; at least ``none`` where it is another's or nobody's; null beyond the table
            rank = F.get(cells, F.get(rows, left) + F.get(ids, k + 1)).bitwiseXOR(F.shiftleft((left + 1).cast("bigint"), _RANK_BITS))
            return F.shiftleft(rank, 12).bitwiseOR(k.cast("bigint"))

        found = F.coalesce(F.array_min(F.transform(ids, rated)), F.lit(none).cast("bigint"))
        at, rank = best.bitwiseAND(F.lit(4095)).cast("int"), F.shiftright(best, 12).cast("int")
        merged = F.flatten(F.array(F.slice(ids, F.lit(1), at), F.array(rank), F.slice(ids, at + 3, F.size(ids))))
        look = F.struct(ids.alias("ids"), found.alias("best"))
        put = F.struct(merged.alias("ids"), F.lit(None).cast("bigint").alias("best"))
        return F.when(best.isNull(), look).when(best < none, put).otherwise(state)

    start = F.struct(F.transform(word, lambda b: F.get(of_byte, b.cast("int"))).alias("ids"), F.lit(None).cast("bigint").alias("best"))
    # a search and a merge for each byte but one, and a last search
    return F.aggregate(F.sequence(F.lit(2), 2 * F.size(word)), start, step, lambda state: state["ids"])


def concat_pieces(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The bytes that an array of ids stands for, as a column expression; unknown ids give nothing, null gives null."""
    pieces = [""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token.hex()
    every = F.split(F.lit(",".join(pieces)), ",")
    return F.aggregate(ids, F.lit(b""), lambda done, k: F.concat(done, F.coalesce(F.unhex(F.get(every, k)), F.lit(b""))))


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for one long word with a heap of pairs: n log n."""
    parts: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
    after = list(range(1, len(parts))) + [-1]
    before = list(range(-1, len(parts) - 1))
    heap = []

    def offer(i: int) -> None:
        j = after[i]
        if j >= 0 and (rank := ranks.get(parts[i] + parts[j])) is not None:
            heapq.heappush(heap, (rank, i, len(parts[i]), len(parts[j])))

    for i in range(len(parts) - 1):
        offer(i)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        if parts[i] is None or len(parts[i]) != a or (j := after[i]) < 0 or len(parts[j]) != b:
            continue
        parts[i] += parts[j]
        parts[j] = None
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    return [ranks[p] for p in parts if p is not None]


class _Rows:
    """Ragged rows as one flat array."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray):
        self.flat, self.sizes = flat, sizes.astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def joined(self, picks: np.ndarray) -> np.ndarray:
        """The picked rows one after another."""
        n = self.sizes[picks]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.arange(total) + np.repeat(self.starts[picks] - (ends - n), n)]


_memo: dict[int, dict[bytes, bytes]] = {}


def _known(memo) -> dict[bytes, bytes]:
    """Words that were folded beforehand and their ids as little-endian 32-bit integers; one set is held at a time."""
    if memo is None:
        return {}
    if memo.id not in _memo:
        _memo.clear()
        out = _memo[memo.id] = {}
        for words, word_sizes, ids, id_sizes in memo.value:
            ends, stops = (np.cumsum(np.frombuffer(sizes, np.int32)).tolist() for sizes in (word_sizes, id_sizes))
            out.update((words[a:b], ids[4 * c : 4 * d]) for a, b, c, d in zip([0, *ends], ends, [0, *stops], stops))
    return _memo[memo.id]


class _Memo:
    """Broadcast blobs and a name by which a Python worker remembers what it made of them."""

    def __init__(self, broadcast, name: int):
        self.broadcast, self.id = broadcast, name

    @property
    def value(self) -> list[tuple[bytes, ...]]:
        return self.broadcast.value


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of words and their ids -> four binaries a batch."""
    for batch in batches:
        out = []
        for column, kind in zip(batch.columns, (np.uint8, np.int32)):
            flat, sizes = _flat(column, kind)
            out += [flat.astype(kind).tobytes(), sizes.astype(np.int32).tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array([b], pa.binary()) for b in out], names=["words", "word_sizes", "ids", "id_sizes"])


def _schema(kind: T.DataType) -> T.StructType:
    """A row is a distinct word of a block (byte values, or ids if they are known) or a few texts as word numbers."""
    out = T.StructType().add("block", T.LongType()).add("word", T.ArrayType(T.ShortType())).add("known", T.ArrayType(T.IntegerType()))
    return out.add("keys", T.ArrayType(kind)).add("counts", T.BinaryType()).add("codes", T.BinaryType())


def _cut(held, pattern: str, schema: T.StructType, memo=None):
    """Texts -> for each block a row for each distinct word, in the order of their numbers, then rows of texts."""
    types = [to_arrow_type(f.dataType) for f in schema]
    names = schema.names

    def rows(block: int, n: int, **columns) -> pa.RecordBatch:
        # empty lists instead of nulls: Spark's writer of Arrow goes over all of a column's null lists again at every row
        own = {"block": pa.array(np.full(n, block), pa.int64()), "keys": pa.array([[]] * n, types[3]), **columns}
        return pa.RecordBatch.from_arrays([own.get(name, pa.nulls(n, t)) for name, t in zip(names, types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(pattern).findall
        part = TaskContext.get().partitionId()
        before = _known(memo)
        for turn, (keys, raw) in enumerate(text_segments(batches, BLOCK)):
            block = part << 32 | turn
            number: dict[str, int] = defaultdict(count().__next__)
            code = number.__getitem__
            codes: list[np.ndarray] = []
            for k, text in enumerate(raw):
                found = find(text.decode("utf-8", "replace")) if text else []
                raw[k] = None
                codes.append(np.fromiter(map(code, found), np.int32, len(found)))
            words = list(number)
            del number, code
            for at in range(0, len(words), _WORDS_AT_ONCE):
                some = [w.encode() for w in words[at : at + _WORDS_AT_ONCE]]
                ids = [before.get(w) or (_long(w, held.value) if len(w) > LONGEST_FOLD else b"") for w in some]
                left = [b"" if i else w for w, i in zip(some, ids)]
                yield rows(block, len(some), word=_lists(left, np.uint8, pa.int16()), known=_lists(ids, np.int32, pa.int32()))
            del words
            start = size = 0
            for k, one in enumerate(codes):
                size += len(one)
                if size >= _CODES_AT_ONCE or k == len(codes) - 1:
                    n = k + 1 - start
                    yield rows(
                        block,
                        1,
                        keys=pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), keys.slice(start, n)),
                        counts=pa.array([np.fromiter(map(len, codes[start : k + 1]), np.int64, n).tobytes()], pa.binary()),
                        codes=pa.array([np.concatenate(codes[start : k + 1]).tobytes()], pa.binary()),
                    )
                    start, size = k + 1, 0

    return run


def _long(word: bytes, ranks: dict[bytes, int]) -> bytes:
    return np.array(merge_long(word, ranks), np.int32).tobytes()


def _lists(blobs: list[bytes], kind, to: pa.DataType) -> pa.Array:
    """A list of numbers for each blob."""
    values = np.frombuffer(b"".join(blobs), kind)
    sizes = np.fromiter(map(len, blobs), np.int64, len(blobs)) // values.itemsize
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values).cast(to))


def _flat(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """Values of a column of lists or binaries one after another, and how many each row has."""
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary())
        ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = column.buffers()[2]
        return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.empty(0, np.uint8), np.diff(ends)
    return np.asarray(column.flatten()).astype(kind), np.asarray(column.value_lengths()).astype(np.int64)


def _joined(with_ids: bool):
    """Distinct words with ids and pieces, then texts as numbers of words -> rows of texts."""

    def texts(row: dict, ids_of: _Rows, bytes_of: _Rows) -> pa.RecordBatch:
        codes, counts = np.frombuffer(row["codes"].as_buffer(), np.int32), np.frombuffer(row["counts"].as_buffer(), np.int64)
        n_tokens: list[int] = []
        every: list = []
        back: list = []
        stop = 0
        for n in counts.tolist():
            picks = codes[stop : stop + n]
            stop += n
            ids = ids_of.joined(picks).astype("<i4")
            text = bytes_of.joined(picks).tobytes()
            n_tokens.append(len(ids))
            every.append(ids if with_ids else hashlib.sha256(ids.tobytes()).hexdigest())
            back.append(text if with_ids else hashlib.sha256(text).hexdigest())
        kinds = (pa.list_(pa.int32()), pa.binary()) if with_ids else (pa.string(), pa.string())
        names = ["id", "n_tokens", *(("ids", "decoded") if with_ids else ("ids_sha256", "decoded_sha256"))]
        columns = [row["keys"].values, pa.array(n_tokens, pa.int64()), pa.array(every, kinds[0]), pa.array(back, kinds[1])]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        gathered: list[tuple] = []
        rows = None
        for batch in batches:
            blocks = np.asarray(batch.column("block"))
            is_text = ~np.asarray(batch.column("codes").is_null())
            breaks = np.flatnonzero((np.diff(blocks) != 0) | is_text[1:] | is_text[:-1]) + 1
            for at, stop in zip([0, *breaks.tolist()], [*breaks.tolist(), batch.num_rows]):
                if blocks[at] != block:
                    block, gathered, rows = blocks[at], [], None
                if not is_text[at]:
                    piece = batch.slice(at, stop - at)
                    gathered.append((*_flat(piece.column("ids"), np.int32), *_flat(piece.column("piece"), np.uint8)))
                    continue
                if rows is None:
                    empty = (np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.uint8), np.empty(0, np.int64))
                    flat = [np.concatenate(x) for x in zip(empty, *gathered)]
                    rows, gathered = (_Rows(flat[0], flat[1]), _Rows(flat[2], flat[3])), []
                yield texts({n: batch.column(n)[at] for n in ("keys", "counts", "codes")}, *rows)

    return run


def _folded_before(rows: DataFrame, held, pattern: str, fold: Column, n_words: int) -> _Memo:
    """The commonest words of a few documents with their ids, folded by all tasks."""
    spark = rows.sparkSession
    schema = _schema(rows.schema["id"].dataType)
    share = min(1.0, MEMO_DOCS / max(1, rows.count()))
    few = rows.sample(share, seed=7).mapInArrow(frugal(_cut(held, pattern, schema)), schema).where("size(word) > 0")
    common = few.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(n_words)
    # written first: a plan that adapts is told anew after each stage, and the fold's literals would be told with it
    common = stored(common.select("word").repartition(spark.sparkContext.defaultParallelism * 2, "word"), "common-words")
    packed = common.select("word", fold.alias("ids")).mapInArrow(_packed, "words binary, word_sizes binary, ids binary, id_sizes binary")
    blobs = [tuple(map(bytes, row)) for row in packed.collect()]
    return _Memo(spark.sparkContext.broadcast(blobs), hash(tuple(blobs)))


def encode(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    digests: bool = False,
    memo_words: int | None = None,
) -> DataFrame:
    """Encode every whole text and decode its ids again.

    Returns (id, n_tokens, ids array<int>, decoded binary), or with ``digests`` (id, n_tokens, ids_sha256,
    decoded_sha256) where the ids are hashed as little-endian unsigned 32-bit integers.  A null text
    counts as empty; no special tokens are made; repeated rows and null ids are returned as they come; other
    columns are ignored, whatever their names; an empty table gives an empty table.  ``memo_words`` of the commonest words (MEMO_WORDS
    unless given) are folded beforehand; with 0 every block folds all of its words, which takes longer and spares the driver a second plan.
    """
    words = MEMO_WORDS if memo_words is None else memo_words
    ranks = read_ranks(ranks_path)
    held = docs.sparkSession.sparkContext.broadcast(ranks)
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    fold = fold_merges(F.col("word"), ranks)
    memo = _folded_before(rows, held, pattern, fold, words) if words else None
    cut = rows.mapInArrow(frugal(_cut(held, pattern, _schema(kind), memo)), _schema(kind))
    ids = F.when(F.size("word") > 0, fold).otherwise(F.col("known"))
    folded = cut.select("block", ids.alias("ids"), "keys", "counts", "codes")
    decoded = folded.select("*", concat_pieces(F.col("ids"), ranks).alias("piece"))
    schema = T.StructType().add("id", kind).add("n_tokens", T.LongType())
    if digests:
        schema = schema.add("ids_sha256", T.StringType()).add("decoded_sha256", T.StringType())
    else:
        schema = schema.add("ids", T.ArrayType(T.IntegerType())).add("decoded", T.BinaryType())
    return decoded.mapInArrow(frugal(_joined(not digests)), schema)


def decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids") -> DataFrame:
    """Adds ``decoded`` (binary): the concatenation of the ids' byte pieces; unknown ids give nothing, null gives null.

    An empty array gives no bytes; a column ``decoded`` that is there already is replaced; other columns and all rows stay.
    """
    return encoded.withColumn("decoded", concat_pieces(F.col(ids_col), read_ranks(ranks_path)))
