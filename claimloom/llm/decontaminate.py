"""Benchmark decontamination through a distributed positional inverted index.

The index is cut by documents: a segment holds some megabytes of text and stores its terms and, term by term, the
positions of every token.  It knows nothing of the benchmark and is written once to the shared folder.  The
benchmark's windows come in blocks of bounded size, one after another, and each block is looked up in all segments,
which leave the lists of terms that it does not ask for alone.  In a segment each window starts with
the posting list of its rarest term, moved to the window's start, and is intersected with the offset-adjusted
lists of the other terms, rarest first, until every list has agreed: exact phrases.  Windows of which
all terms, each as often as the window has it, lie in any order in a span of ``slop`` extra words around an
occurrence of the rarest one are proximity matches.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm.common import SEGMENT_BYTES, scratch, text_segments

WINDOW = 10
#: Benchmark words that one broadcast holds; larger benchmarks are searched block after block.
QUERY_WORDS = 1 << 20
_WORD_BYTES = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_TABLE = bytes(c if c in _WORD_BYTES else 32 for c in _FOLD)


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased words (digits, letters, everything beyond ASCII) of a UTF-8 text; null has none."""
    return text.translate(_TABLE).split() if text else []


class Windows:
    """Windows of benchmark items as term numbers, for one block of items."""

    def __init__(self, items: list[tuple], width: int = WINDOW):
        number: dict[bytes, int] = {}
        rows: dict[bytes, int] = {}
        terms: list[list[int]] = []
        owner: list[tuple[int, int]] = []
        self.item_ids = [i for i, _ in items]
        for at, (_, text) in enumerate(items):
            codes = [number.setdefault(w, len(number)) for w in words_of(text)]
            for k in range(max(1, len(codes) - width + 1) if codes else 0):
                window = codes[k : k + width]
                key = np.array(window, np.int64).tobytes()
                if key not in rows:
                    rows[key] = len(terms)
                    terms.append(window)
                owner.append((rows[key], at))
        self.vocabulary = pa.array(list(number), pa.binary())
        self.size = np.array([len(t) for t in terms], np.int64)
        self.terms = np.full((len(terms), width), -1, np.int64)
        for k, window in enumerate(terms):
            self.terms[k, : len(window)] = window
        pairs = np.array(sorted(set(owner)), np.int64).reshape(-1, 2)
        self.owner_items = pairs[:, 1]
        self.owner_starts = np.searchsorted(pairs[:, 0], np.arange(len(terms) + 1))


def query_blocks(items: DataFrame, id_col: str, text_col: str, width: int = WINDOW) -> Iterator[Windows]:
    """The benchmark in blocks of about QUERY_WORDS words, fetched one after another."""
    rows = items.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    block, words = [], 0
    for row in rows.where("text is not null").toLocalIterator():
        block.append((row["id"], bytes(row["text"])))
        words += len(words_of(block[-1][1]))
        if words >= QUERY_WORDS:
            yield Windows(block, width)
            block, words = [], 0
    if block:
        yield Windows(block, width)


INDEX = "segment bigint, ids array<{kind}>, n_words binary, terms array<binary>, lengths binary, steps binary"


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId() << 32
    for segment, (ids, texts) in enumerate(text_segments(batches, SEGMENT_BYTES)):
        number: dict[bytes, int] = defaultdict(count().__next__)
        found, counts = [], []
        for text in texts:
            words = words_of(text)
            counts.append(len(words))
            found.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
        codes = np.concatenate(found)
        positions = np.argsort(codes, kind="stable")  # list after list, each in order
        blobs = np.array(counts, np.int64), np.bincount(codes, minlength=len(number)).astype(np.int32), np.diff(positions, prepend=0).astype(np.int32)
        n_words, lengths, steps = (pa.array([b.tobytes()], pa.binary()) for b in blobs)
        whole = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        yield pa.RecordBatch.from_arrays(
            [pa.array([part + segment], pa.int64()), whole(ids), n_words, whole(pa.array(list(number), pa.binary())), lengths, steps],
            names=[c.split()[0] for c in INDEX.split(", ")],
        )


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the positional index of all tokens of ``docs`` to the shared folder; returns its table, a row per segment."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = INDEX.format(kind=docs.schema[id_col].dataType.simpleString())
    path = scratch(spark, "positional-index")
    rows.mapInArrow(_index, schema).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


class _Segment:
    """A segment's documents and its posting lists of the terms that the block ``q`` asks for."""

    def __init__(self, row: dict, q: Windows):
        blob = lambda n, kind: np.frombuffer(row[n].as_buffer(), kind)
        self.n_words = blob("n_words", np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.n_words)])
        terms = row["terms"].values
        places = pc.fill_null(pc.index_in(q.vocabulary.cast(terms.type), value_set=terms), -1).to_numpy()
        self.terms = np.flatnonzero(places >= 0)
        lists = places[self.terms]
        lengths = blob("lengths", np.int32).astype(np.int64)
        self.lengths = lengths[lists]
        self.list_starts = np.cumsum(self.lengths) - self.lengths
        first = (np.cumsum(lengths) - lengths)[lists]
        positions = np.cumsum(blob("steps", np.int32), dtype=np.int64)
        self.positions = positions[np.arange(int(self.lengths.sum())) + np.repeat(first - self.list_starts, self.lengths)]
        self.span = int(self.starts[-1]) + 1
        # one sorted array of (term, position): the posting lists one after another
        self.keys = np.repeat(self.terms, self.lengths) * self.span + self.positions

    def ranked(self, q: Windows) -> tuple[np.ndarray, np.ndarray]:
        """Per window: offsets from its rarest term on; windows with a term that is absent here are left out."""
        place = np.full(len(q.vocabulary) + 1, -1, np.int64)
        place[self.terms] = np.arange(len(self.terms))
        at = place[q.terms]
        length = np.where(at >= 0, self.lengths[at] if len(self.lengths) else 0, 0)
        length = np.where(q.terms < 0, np.iinfo(np.int64).max, length)
        order = np.argsort(length, axis=1, kind="stable")
        alive = np.flatnonzero((length > 0).all(axis=1) & (q.size > 0))
        self.place = place
        return order, alive

    def anchors(self, q: Windows, order: np.ndarray, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, position of an occurrence of its rarest term)."""
        lists = self.place[q.terms[alive, order[alive, 0]]]
        n = self.lengths[lists]
        first = np.repeat(self.list_starts[lists] - (np.cumsum(n) - n), n)
        return np.repeat(alive, n), self.positions[first + np.arange(int(n.sum()))]

    def holds(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        wanted = term * self.span + position
        k = np.searchsorted(self.keys, wanted)
        return (k < len(self.keys)) & (self.keys[np.minimum(k, len(self.keys) - 1)] == wanted)

    def phrases(self, q: Windows) -> tuple[np.ndarray, np.ndarray]:
        """(window, start) of all exact occurrences that stay within one document."""
        if not len(self.keys):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        order, alive = self.ranked(q)
        outs = []
        for part in np.array_split(alive, max(1, len(alive) // 256)):
            window, position = self.anchors(q, order, part)
            start = position - order[window, 0]
            doc = np.searchsorted(self.starts, position, "right") - 1
            ok = (start >= self.starts[doc]) & (start + q.size[window] <= self.starts[doc + 1])
            window, start = window[ok], start[ok]
            for k in range(1, q.terms.shape[1]):
                offset = order[window, k]
                asked = offset < q.size[window]
                ok = ~asked | self.holds(np.where(asked, q.terms[window, offset], 0), start + offset)
                window, start = window[ok], start[ok]
            outs.append((window, start))
        return np.concatenate([w for w, _ in outs]), np.concatenate([s for _, s in outs])

    def count(self, term: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Postings of each term from ``low`` to ``high``, both included."""
        base = term * self.span
        return np.searchsorted(self.keys, base + high, "right") - np.searchsorted(self.keys, base + low, "left")

    def near(self, q: Windows, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, anchor) where size + slop words of one document hold an occurrence of the rarest term and all other terms.

        A term that the window repeats must occur as often.
        """
        if not len(self.keys):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        order, alive = self.ranked(q)
        outs = []
        for part in np.array_split(alive, max(1, len(alive) // 256)):
            window, anchor = self.anchors(q, order, part)
            doc = np.searchsorted(self.starts, anchor, "right") - 1
            first, last = self.starts[doc], self.starts[doc + 1] - 1
            reach = q.size[window] + slop - 1
            for k in range(q.terms.shape[1]):
                ok = self._enough(q, window, k, np.maximum(anchor - reach, first), np.minimum(anchor + reach, last))
                window, anchor, first, last, reach = (x[ok] for x in (window, anchor, first, last, reach))
            # spans by start, the lowest first; an anchor that has its span is done
            for back in range(int(reach.max(initial=-1)), -1, -1):
                start = anchor - back
                live = np.flatnonzero(back <= reach)
                for k in range(q.terms.shape[1]):
                    low, high = np.maximum(start[live], first[live]), np.minimum(start[live] + reach[live], last[live])
                    live = live[self._enough(q, window[live], k, low, high)]
                outs.append((window[live], anchor[live]))
                rest = np.ones(len(window), bool)
                rest[live] = False
                window, anchor, first, last, reach = (x[rest] for x in (window, anchor, first, last, reach))
        window, anchor = (np.concatenate([np.empty(0, np.int64), *x]) for x in (zip(*outs) if outs else ((), ())))
        order = np.lexsort((anchor, window))
        return window[order], anchor[order]

    def _enough(self, q: Windows, window: np.ndarray, k: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether the ``k``-th term of each window occurs from ``low`` to ``high`` as often as in the window."""
        term = q.terms[window, k]
        needed = (q.terms[window] == term[:, None]).sum(axis=1)
        return (term < 0) | (self.count(np.maximum(term, 0), low, high) >= needed)


def _scalars(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for row in range(batch.num_rows):
            yield {n: batch.column(k)[row] for k, n in enumerate(batch.schema.names)}


RANGES = "starts array<bigint>, stops array<bigint>, items array<string>"


def _hits(seg: _Segment, q: Windows) -> dict[int, tuple[np.ndarray, np.ndarray, list[str]]]:
    """Of each document with a phrase: starts and stops of its hit ranges, and the items found."""
    window, start = seg.phrases(q)
    marks = np.zeros(seg.span + 1, np.int64)
    np.add.at(marks, start, 1)
    np.add.at(marks, start + q.size[window], -1)
    hit = np.cumsum(marks) > 0
    doc = np.searchsorted(seg.starts, start, "right") - 1
    items: dict[int, set[int]] = {}
    for d, w in np.unique(np.stack([doc, window], axis=1), axis=0).tolist() if len(doc) else []:
        items.setdefault(d, set()).update(q.owner_items[q.owner_starts[w] : q.owner_starts[w + 1]].tolist())
    out = {}
    for d, found in items.items():
        inside = np.diff(hit[seg.starts[d] : seg.starts[d + 1]].astype(np.int8), prepend=0, append=0)
        out[d] = np.flatnonzero(inside == 1), np.flatnonzero(inside == -1), sorted(str(q.item_ids[i]) for i in found)
    return out


def _listed(ranges: list[tuple]) -> list[pa.Array]:
    starts, stops, items = zip(*ranges) if ranges else ((), (), ())
    return [pa.array(starts, pa.list_(pa.int64())), pa.array(stops, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))]


def _reports(held):
    """Segments -> per document: id, n_words and its hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _scalars(batches):
            seg = _Segment(row, held.value)
            hits = _hits(seg, held.value)
            ranges = _listed([hits.get(d, ((), (), ())) for d in range(len(seg.n_words))])
            yield pa.RecordBatch.from_arrays([row["ids"].values, pa.array(seg.n_words), *ranges], names=["id", "n_words", "starts", "stops", "items"])

    return run


def _hit_documents(held):
    """Segments -> per document with hits: segment, place in it and the hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _scalars(batches):
            hits = _hits(_Segment(row, held.value), held.value)
            at = [pa.array([row["segment"].as_py()] * len(hits), pa.int64()), pa.array(list(hits), pa.int32())]
            yield pa.RecordBatch.from_arrays([*at, *_listed(list(hits.values()))], names=["segment", "doc", "starts", "stops", "items"])

    return run


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in _scalars(batches):
        ids, n_words = row["ids"].values, np.frombuffer(row["n_words"].as_buffer(), np.int64)
        at = [pa.array(np.full(len(ids), row["segment"].as_py(), np.int64)), pa.array(np.arange(len(ids), dtype=np.int32))]
        yield pa.RecordBatch.from_arrays([*at, ids, pa.array(n_words)], names=["segment", "doc", "id", "n_words"])


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hits, counts, digests, ranges = [], [], [], []
        for row in batch.select(["starts", "stops", "items"]).to_pylist():
            merged: list[list[int]] = []
            for a, b in sorted(zip(row["starts"] or (), row["stops"] or ())):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            items = sorted(set(row["items"] or ()))
            hits.append(sum(b - a for a, b in merged))
            counts.append(len(items))
            digests.append(hashlib.sha256(",".join(items).encode()).hexdigest())
            ranges.append(([a for a, _ in merged], [b for _, b in merged], items))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("id"), batch.column("n_words"), pa.array(hits, pa.int64()), pa.array(counts, pa.int64()),
                pa.array(digests, pa.string()), *_listed(ranges),
            ],
            names=["id", "n_words", "n_hit", "n_items", "items_sha256", "starts", "stops", "items"],
        )


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    width: int = WINDOW,
) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, starts, stops, items): one row per row of ``docs``.

    ``starts``/``stops`` are the ranges of hit words.  Items of fewer than ``width`` words, but not none, are
    one window of their own length.  Null texts have no words; null and empty items match nothing; an empty
    benchmark leaves every document clean and an empty table gives an empty table.  Rows of the benchmark that repeat an id count
    once.  If ids of documents repeat, each row is judged alone.  Other columns are ignored.  A text is indexed whole
    whatever its length; it must fit a task, as a row does.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    blocks = query_blocks(items, item_id_col, item_text_col, width)
    block, more = next(blocks, Windows([], width)), next(blocks, None)
    index = build_index(docs, id_col, text_col)
    if more is None:
        held = spark.sparkContext.broadcast(block)
        found = index.mapInArrow(_reports(held), f"id {kind}, n_words bigint, {RANGES}")
    else:
        # a block's hits are written before the next one is fetched; only documents with hits are shuffled with them
        schema = f"segment bigint, doc int, {RANGES}"
        hits = _by_block(index, chain([block, more], blocks), _hit_documents, schema, "benchmark-hits")
        lists = [F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "stops", "items")]
        rows = index.select("segment", "ids", "n_words").mapInArrow(_documents, f"segment bigint, doc int, id {kind}, n_words bigint")
        found = rows.join(hits.groupBy("segment", "doc").agg(*lists), ["segment", "doc"], "left").drop("segment", "doc")
    return found.mapInArrow(
        _summary, f"id {kind}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, {RANGES}"
    )


def _by_block(index: DataFrame, blocks: Iterable[Windows], search, schema: str, name: str) -> DataFrame:
    """What ``search`` finds in the segments, a job for each block; one block at a time is held."""
    spark = index.sparkSession
    path = scratch(spark, name)
    for block in blocks:
        held = spark.sparkContext.broadcast(block)
        index.mapInArrow(search(held), schema).write.mode("append").parquet(path)
        held.unpersist()
    return spark.read.schema(schema).parquet(path)


def _matches(held, slop: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = held.value
        for row in _scalars(batches):
            seg = _Segment(row, q)
            out: dict[str, list] = {"id": [], "item": [], "kind": [], "position": []}
            exact = seg.phrases(q)
            keys = row["ids"].values.to_pylist()
            seen = set()
            for kind, (window, at) in (("phrase", exact), ("proximity", seg.near(q, slop))):
                doc = np.searchsorted(seg.starts, at, "right") - 1
                for w, d, p in zip(window.tolist(), doc.tolist(), at.tolist()):
                    if kind == "phrase":
                        seen.add((w, d))
                    elif (w, d) in seen:
                        continue
                    for i in q.owner_items[q.owner_starts[w] : q.owner_starts[w + 1]].tolist():
                        out["id"].append(keys[d])
                        out["item"].append(str(q.item_ids[i]))
                        out["kind"].append(kind)
                        out["position"].append(p - int(seg.starts[d]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(out["id"], row["ids"].values.type), pa.array(out["item"], pa.string()),
                    pa.array(out["kind"], pa.string()), pa.array(out["position"], pa.int64()),
                ],
                names=["id", "item", "kind", "position"],
            )

    return run


def matches(
    docs: DataFrame,
    items: DataFrame,
    slop: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    width: int = WINDOW,
) -> DataFrame:
    """(id, item, kind, position): phrase matches by start, proximity matches by their rarest term's place.

    A window is matched by proximity at an occurrence of its rarest term where some ``size + slop`` words in a row hold
    that and all other terms, each as often as the window has it; windows that the document holds as a phrase are not repeated.
    Null and empty texts and items match nothing; an empty table on either side gives an empty table.  Rows of ``docs`` that
    share an id, or have none, are searched each by itself and give rows each.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    blocks = query_blocks(items, item_id_col, item_text_col, width)
    blocks = chain([next(blocks, Windows([], width))], blocks)
    schema = f"id {kind}, item string, kind string, position bigint"
    return _by_block(build_index(docs, id_col, text_col), blocks, lambda held: _matches(held, slop), schema, "benchmark-matches")
