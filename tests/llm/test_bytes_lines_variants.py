"""Importance resampling, line dedup and spelling variants against brute force; odd rows of each."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from claimloom.llm.automaton import LETTERS, PIECE, START, WORDS, advance, find, finished
from claimloom.llm.importance import bucket_counts, resample
from claimloom.llm.line_dedup import drop_shared_lines
from claimloom.llm.variants import Order, Shelf, Wavelet, group_variants, near_words, word_counts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LETTER = re.compile(r"[A-Za-zÀ-ÿ]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=" aZé9ÿĀ×_ß語\n", max_size=30)), max_size=8))
def test_words_by_bytes_are_those_of_the_patterns(texts):
    for table, pattern in ((WORDS, WORD), (LETTERS, LETTER)):
        found = find(pa.array(texts, pa.string()), table)
        words = [found.data[s : s + n].tobytes().decode() for s, n in zip(found.starts, found.lengths, strict=True)]
        owned = [words[a:b] for a, b in zip(found.firsts[:-1], found.firsts[1:], strict=True)]
        assert owned == [pattern.findall((t or "").translate(LOW)) for t in texts]


def test_slices_of_a_column_are_read_from_their_own_offsets():
    found = find(pa.array(["aa bb", "cc", None, "dd ee"]).slice(1, 3), WORDS)
    assert list(found.firsts) == [0, 1, 1, 3]


@pytest.mark.parametrize("lengths", [[0, 1, 2, PIECE - 1, PIECE, PIECE + 1], [5 * PIECE, 3, 7 * PIECE + 11, 0, 200_003]])
def test_registers_of_spans_of_any_length(lengths):
    data = np.random.default_rng(3).integers(0, 256, sum(lengths), np.uint8)
    lengths = np.array(lengths)
    starts = np.cumsum(lengths) - lengths
    state = advance(np.full(len(lengths), START), data, starts, lengths)
    assert finished(state).tolist() == [zlib.crc32(data[s : s + n].tobytes()) for s, n in zip(starts, lengths, strict=True)]


def _features(text, longest):
    words = WORD.findall((text or "").translate(LOW))
    return [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


@pytest.mark.parametrize("longest", [1, 3])
def test_resampling_by_brute_force(spark, longest):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["Été", "x" * 150]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randrange(0, 60))) for _ in range(120)] + [None, "", "...", texts_long(rng)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(7, texts[7])]
    target = [" ".join(rng.choices(vocabulary[:9], k=40)) for _ in range(10)] + [None]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    buckets = 97
    s = Counter(zlib.crc32(f.encode()) % buckets for _, t in docs for f in _features(t, longest))
    t = Counter(zlib.crc32(f.encode()) % buckets for x in target for f in _features(x, longest))
    assert dict(bucket_counts(frame, longest=longest, buckets=buckets).collect()) == dict(s)
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    expected = []
    for i, text in docs:
        found = _features(text, longest)
        weight = sum(gain(zlib.crc32(f.encode()) % buckets) for f in found)
        h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        expected.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(_features(text, 1)) >= 20))
    order = sorted((x for x in expected if x[4]), key=lambda x: (-x[3], x[0]))
    drawn = len(order) * 30 // 100
    rank = Counter((x[:4], i + 1) for i, x in enumerate(order[:drawn])) + Counter((x[:4], None) for x in order[drawn:] + [x for x in expected if not x[4]])
    got = resample(frame, aim, percent=30, longest=longest, buckets=buckets).collect()
    assert Counter((tuple(r[:4]), r[4]) for r in got) == rank


def texts_long(rng):
    return " ".join(rng.choices(["alpha", "beta", "gamma"], k=100_000))


def test_resampling_of_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a " * 30, 1, "x"), (None, None, 2, "x"), (1, "b " * 30, 3, "x")], "doc_id bigint, text string, score int, key string")
    none = spark.createDataFrame([], "item_id int, text string")
    got = resample(docs, none, percent=100).collect()
    assert sorted((r["id"] is None, r["n_features"]) for r in got) == [(False, 30), (True, 0), (True, 30)]
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2]
    assert resample(docs.limit(0), docs).count() == 0
    assert all(r["rank"] is None for r in resample(docs, none, percent=10).collect())


def _lines_by_hand(docs, least_docs=3, least_chars=20):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOW)
    holders = {}
    for i, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least_chars:
                holders.setdefault(key(line), set()).add(i)
    gone = {k: max(h, key=lambda i: (i is not None, i or 0)) for k, h in holders.items() if len(h) >= least_docs}
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [line for line in lines if key(line) not in gone or gone[key(line)] == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return Counter(out)


def test_shared_lines_by_brute_force(spark):
    rng = random.Random(9)
    lines = [f"Line number {i} of the common stock of lines" for i in range(12)] + ["short", "", "  ", "É" * 20, "x" * 19]
    dress = lambda s: rng.choice(["", " ", "\t\r"]) + rng.choice([s, s.upper().replace("É", "É"), s.lower()]) + rng.choice(["", "\x0b ", "\x85"])
    docs = [(i, "\n".join(dress(rng.choice(lines)) for _ in range(rng.randrange(0, 9)))) for i in range(60)]
    docs += [(3, docs[3][1]), (3, lines[0]), (None, lines[0] + "\n" + lines[1]), (None, lines[0]), (70, None), (71, ""), (72, "\n\n")]
    docs += [(80, "\n".join(f"{lines[0]}\nown line {i}" for i in range(30_000)))]
    frame = spark.createDataFrame([(i, t, "a", 1) for i, t in docs], "doc_id bigint, text string, lines string, lost int")
    got = Counter(tuple(r) for r in drop_shared_lines(frame).select("id", "text", "n_lines", "n_dropped").collect())
    assert got == _lines_by_hand(docs)
    assert drop_shared_lines(frame.limit(0)).count() == 0


def test_lines_only_held_by_rows_without_id_stay(spark):
    frame = spark.createDataFrame([(None, "a line of at least twenty letters")] * 4, "doc_id bigint, text string")
    assert {r["n_dropped"] for r in drop_shared_lines(frame).collect()} == {0}


def _near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    short, long = sorted((a, b), key=len)
    if len(short) == len(long):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def test_wavelet_tree_reports_all_points_of_rectangles():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 64, 100):
        values = rng.permutation(n)
        tree = Wavelet(values)
        left, right, low, high = (rng.integers(0, n + 1, 50) for _ in range(4))
        asker, found = tree.report(left, right, low, high)
        expected = [(q, v) for q in range(50) for v in values[left[q] : max(left[q], right[q])].tolist() if low[q] <= v < high[q]]
        assert sorted(zip(asker.tolist(), found.tolist(), strict=True)) == sorted(expected)


def test_intervals_of_prefixes():
    words = [b"aab", b"aba", b"abb", b"bab", b"\xffab"]
    order = Order(np.array([list(w) for w in words], np.uint8))
    low, high = order.intervals(np.array([list(b"abz"), list(b"\xffab")], np.uint8))
    assert [(low[j, 0], high[j, 0]) for j in range(3)] == [(0, 5), (0, 3), (1, 3)] and high[3, 0] - low[3, 0] == 0
    assert [(low[j, 1], high[j, 1]) for j in range(4)] == [(0, 5), (4, 5), (4, 5), (4, 5)]


@pytest.mark.parametrize("block", [7, 1 << 16])
def test_near_words_by_brute_force_and_roots(spark, block):
    rng = random.Random(11)
    words = {"".join(rng.choices("abÿ", k=rng.randrange(1, 7))) for _ in range(220)} | {"é" * 9, "é" * 10, "é" * 4 + "a" + "é" * 5}
    long = "".join(rng.choices("abc", k=20_000))
    words |= {long, long[:9999] + "z" + long[10_000:], long + "q", "y" + long}
    counts = {w: rng.choice([3, 4, 6, 9, 20, 50, 200]) for w in sorted(words)}
    frame = spark.createDataFrame(list(counts.items()), "word string, n bigint").repartition(5)
    near = {w: [x for x in words if _near(w, x)] for w in words}
    got = Counter((r["word"], r["near"], r["near_n"]) for r in near_words(frame, block).collect())
    assert got == Counter((w, x, counts[x]) for w, xs in near.items() for x in xs)
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    expected = {(w, counts[w], len(near[w]), form[w], counts.get(form[w]), root(w)) for w in words}
    assert {(r["word"], r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in group_variants(frame, block=block).collect()} == expected


def test_a_shelf_is_asked_in_both_halves():
    rows = np.array([list(b"hallo"), list(b"hello"), list(b"hullo"), list(b"jello")], np.uint8)
    shelf = Shelf.of(rows, np.array([1, 2, 3, 4]))
    found = set()
    for latter in (True, False):
        asker, place = shelf.near(np.array([list(b"hello")], np.uint8), latter)
        found |= {shelf.forward.rows[p].tobytes() for p in place}
    assert found == {b"hallo", b"hullo", b"jello"}


def test_words_and_slips(spark):
    docs = [(i, "Übermaß ÉCOLE école naïve×naïve abc ĀĀĀĀĀ " + "Straße " * (i % 4)) for i in range(200)] + [(None, "école"), (5, None), (5, ""), (5, "x" * 300_000)]
    frame = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id bigint, text string, n int")
    expected = Counter()
    for i, t in docs:
        for run in LETTER.findall(t or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            expected[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 7 == 0 else run] += 1
    expected = {w: n for w, n in expected.items() if len(w) >= 5 and n >= 3}
    assert dict(word_counts(frame, slip=7).collect()) == expected
    assert group_variants(word_counts(frame.limit(0))).count() == 0
