"""URL rules looked up in a sorted array of 64-bit digests.

The rules' (host, path) strings are hashed with xxHash64; the sorted digests, the places of the full strings and
the strings themselves form one file in the shared folder, which Spark distributes to the executors and
Python workers map into memory.  For each url the digests of its host suffixes joined with the path
prefixes of the lengths that rules have are probed by vectorised binary search; a hit counts only
where the stored string is the same, so collisions are harmless.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm.common import shared_folder

#: Urls that are probed at once.
BATCH = 8192
_HEAD = struct.Struct("<qq")


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path) of a url; both empty for null or without ``://``."""
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    stop = min((k for c in "/?#" if (k := rest.find(c)) >= 0), default=len(rest))
    tail = rest[stop:]
    cut = min((k for c in "?#" if (k := tail.find(c)) >= 0), default=len(tail))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:stop])
    return host, tail[:cut]


def pack(rules: list[tuple[str, str, str]]) -> bytes:
    """(verdict, host, path) rules as one file: counts, digests in order, string offsets, verdicts, strings.

    Of a rule given twice, ``allow`` wins.  A string is ``host``, a zero byte, ``path``.
    """
    table: dict[bytes, int] = {}
    for verdict, host, path in rules:
        key = host.encode() + b"\0" + path.encode()
        table[key] = max(table.get(key, 0), int(verdict == "allow"))
    keys = sorted(table, key=lambda k: (xxhash.xxh64_intdigest(k), k))
    digests = np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64)
    offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int64)
    strings = b"".join(keys)
    verdicts = np.array([table[k] for k in keys], np.uint8)
    # numbers of dots in hosts and lengths of paths, so that no reader has to go through the strings
    parts = [k.partition(b"\0") for k in keys]
    dots, lengths = sorted({h.count(b".") for h, _, _ in parts}), sorted({len(p) for _, _, p in parts})
    shapes = np.array([len(dots), *dots, *lengths], np.int64)
    return _HEAD.pack(len(keys), len(strings)) + digests.tobytes() + offsets.tobytes() + strings + verdicts.tobytes() + shapes.tobytes()


class Digests:
    """A packed rule file mapped into memory."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            n, size = _HEAD.unpack(f.read(_HEAD.size))
        view = np.memmap(path, np.uint8, "r")
        at = _HEAD.size
        self.digests = view[at : at + 8 * n].view(np.uint64)
        at += 8 * n
        self.offsets = view[at : at + 8 * (n + 1)].view(np.int64)
        at += 8 * (n + 1)
        self.strings = view[at : at + size]
        self.verdicts = view[at + size : at + size + n]
        # what rules look like: labels of hosts and lengths of paths, in which candidates are made
        shapes = view[at + size + n :].view(np.int64)
        self.labels, self.paths = shapes[1 : shapes[0] + 1].tolist(), shapes[shapes[0] + 1 :].tolist()

    def string(self, k: int) -> bytes:
        return self.strings[self.offsets[k] : self.offsets[k + 1]].tobytes()

    def find(self, keys: list[bytes]) -> np.ndarray:
        """The rule of each string, or -1."""
        out = np.full(len(keys), -1, np.int64)
        if not keys or not len(self.digests):
            return out
        asked = np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64)
        place = np.searchsorted(self.digests, asked)
        for k in np.flatnonzero((place < len(self.digests)) & (self.digests[np.minimum(place, len(self.digests) - 1)] == asked)):
            at = int(place[k])
            while at < len(self.digests) and self.digests[at] == asked[k]:
                if self.string(at) == keys[k]:
                    out[k] = at
                    break
                at += 1
        return out

    def candidates(self, host: str, path: str) -> list[bytes]:
        """Strings of the rules that could fit."""
        h, p = host.encode(), path.encode()
        labels = h.split(b".")
        suffixes = {b".".join(labels[len(labels) - 1 - n :]) for n in self.labels if n < len(labels)} if h else {b""}
        return [s + b"\0" + p[:n] for s in suffixes for n in self.paths if n <= len(p)]


_open: dict[str, Digests] = {}


def _judge(name: str, default: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _open:
            _open[name] = Digests(SparkFiles.get(name))
        table = _open[name]
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                split = [split_url(u) for u in part.column(1).to_pylist()]
                asked = [table.candidates(h, p) if h or p else [] for h, p in split]
                owner = np.repeat(np.arange(len(asked)), [len(a) for a in asked])
                found = table.find([k for a in asked for k in a])
                rules: list[str | None] = [None] * len(split)
                verdicts = [default] * len(split)
                for row, rule in zip(owner[found >= 0].tolist(), found[found >= 0].tolist()):
                    text = table.string(rule).replace(b"\0", b"").decode()
                    if rules[row] is None or (len(text), text) > (len(rules[row]), rules[row]):
                        rules[row] = text
                        verdicts[row] = "allow" if table.verdicts[rule] else "block"
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([h for h, _ in split], pa.string()),
                        pa.array([p for _, p in split], pa.string()),
                        pa.array(rules, pa.string()),
                        pa.array(verdicts, pa.string()),
                    ],
                    names=["id", "host", "path", "rule", "verdict"],
                )

    return run


def distribute(spark: SparkSession, content: bytes) -> str:
    """Put ``content`` in the shared folder and have every executor fetch it; returns the file's name."""
    name = f"url-digests-{xxhash.xxh128_hexdigest(content)}.bin"
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark).rstrip('/')}/{name}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(path, True)
    out.write(content)
    out.close()
    spark.sparkContext.addFile(path.toString() if "://" in path.toString() or ":/" in path.toString() else os.path.abspath(path.toString()))
    return name


def filter_urls(
    pages: DataFrame,
    rules: list[tuple[str, str, str]],
    default: str = "allow",
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """(id, host, path, rule, verdict) of every url by the longest (verdict, host, path) rule that fits.

    A rule fits its host and all subdomains where the path starts with the rule's; of equally long ones the last in the order of their
    strings counts, and of verdicts on one rule ``allow``; without one ``rule`` is
    null and the verdict is ``default``.  A null url or one without ``://`` has an empty host and path and no
    rule.  Repeated rows and null ids are returned as they come; other columns are ignored.
    """
    name = distribute(pages.sparkSession, pack(rules))
    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    return rows.mapInArrow(_judge(name, default), f"id {kind}, host string, path string, rule string, verdict string")
