"""Toxicity by a gap-weighted subsequence-kernel support vector machine with Nystroem landmarks.

Each word is mapped to all its subsequences of three letters within a bounded span; every letter skipped between
them multiplies the weight by ``DECAY``, and marks inside a word (``t.r.a.s.h``) are gaps, not letters.
The kernel of two words is the product of these maps, each divided by the root of its own squared weights.
Because the map is explicit, landmarks fold into one weight per subsequence, and scoring a word costs
a look-up per subsequence.  Words of labelled sentences train the machine; a sentence's label is that of
its document, so words are first weighed by how much more often toxic documents hold them.
A document is judged by its strongest word, the number of words beyond the margin and its length.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import Words, bounded_sample, frugal, logistic, sigmoid, text_segments

DECAY = 0.7
SPAN = 6
#: Labelled documents of each class that a model is fitted on at most.
SAMPLE = 3000
#: Text bytes scored at once.
SEGMENT = 6 << 20
#: Words whose maps span the machine's space.
LANDMARKS = 192
#: Bounds on the words that the machine is fitted on, all taken from the sample's whole texts: words that mark toxic documents, words
#: that start like them, the commonest and other calm words, and calm words that an earlier turn of the fit took for marks.
MARKED, KIN, COMMON_CALM, OTHER_CALM, HARD = 2000, 2000, 4000, 12_000, 4000
#: Marked words, and calm words, that the fit sees with letters put in.
VEILED, DULL = 60, 600
#: Margins at which a document's words are counted.
STEPS = (0.0, 0.3, 0.6, 0.9)
_SIGNALS = 2 * len(STEPS) + 5
#: Longer words are scored in overlapping pieces.
PIECE = 40
_ALPHABET = 48
_START, _END = 46, 47
_STRIP = re.compile(r"^[\W_]+|[\W_]+$")
_LOOKS = str.maketrans("013457@$", "oieastas")
_OFFSETS = [(d1, d2) for d2 in range(2, SPAN + 1) for d1 in range(1, d2)]


def normal(word: str) -> str:
    """Lower case without marks at the ends; digits and signs that stand for letters inside are read as those."""
    word = _STRIP.sub("", word.lower())
    return word.translate(_LOOKS) if any(c.isalpha() for c in word) else ""


def _letter(c: str) -> int:
    if "a" <= c <= "z":
        return ord(c) - 96
    return 27 + ord(c) % 19 if c.isalpha() else 0


_letters: dict[str, int] = {}


def _coded(word: str) -> list[int]:
    out = [_START]
    for c in word:
        k = _letters.get(c)
        if k is None:
            k = _letters[c] = _letter(c)
        out.append(k)
    out.append(_END)
    return out


def _by_length(words: list[str], block: int = 16384) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions in ``words``, their codes as one array) for words of one length."""
    groups: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        if w:
            groups.setdefault(len(w), []).append(k)
    for members in groups.values():
        for at in range(0, len(members), block):
            part = members[at : at + block]
            yield np.array(part), np.array([_coded(words[k]) for k in part], np.int32)


def _subsequences(codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(codes of subsequences, which are real, weight) for each pair of offsets."""
    n = codes.shape[1]
    for d1, d2 in _OFFSETS:
        if d2 >= n:
            continue
        a, b, c = codes[:, : n - d2], codes[:, d1 : n - d2 + d1], codes[:, d2:]
        yield (a * _ALPHABET + b) * _ALPHABET + c, (a > 0) & (b > 0) & (c > 0), DECAY ** (d2 - 2)


def feature_map(words: list[str]) -> np.ndarray:
    """Normalised subsequence maps, a row per word (for landmarks and other small sets)."""
    out = np.zeros((len(words), _ALPHABET**3), np.float32)
    for at, codes in _by_length(words):
        size = np.zeros(len(at))
        for subs, real, weight in _subsequences(codes):
            rows = np.repeat(at, subs.shape[1]).reshape(subs.shape)
            np.add.at(out, (rows[real], subs[real]), weight)
            size += real.sum(axis=1) * weight**2
        out[at] /= np.sqrt(np.maximum(size, 1e-12))[:, None]
    return out


class Landmarks:
    """Maps of a few words without the subsequences that none of them has."""

    def __init__(self, words: list[str]):
        whole = feature_map(words)
        own = np.flatnonzero(whole.any(axis=0))
        self.maps = np.ascontiguousarray(whole[:, own])
        #: place of each subsequence in ``maps``; the last place is that of all others
        self.place = np.full(whole.shape[1], len(own), np.int32)
        self.place[own] = np.arange(len(own))
        self.turned = np.concatenate([self.maps.T, np.zeros((1, len(words)), np.float32)])

    def table(self, weights: np.ndarray) -> np.ndarray:
        """Weights of the landmarks as one weight per subsequence."""
        return np.append(weights @ self.maps, 0.0)[self.place]


def project(words: list[str], table: np.ndarray | Landmarks) -> np.ndarray:
    """Products of the words' normalised maps with each row of ``table`` or each landmark: (words, rows)."""
    few = isinstance(table, Landmarks)
    turned = table.turned if few else np.ascontiguousarray(table.T)
    out = np.zeros((len(words), turned.shape[1]))
    for at, codes in _by_length(words, 256 if turned.shape[1] > 1 else 16384):
        size = np.zeros(len(at))
        total = np.zeros((len(at), turned.shape[1]))
        for subs, real, weight in _subsequences(codes):
            total += (turned[table.place[subs] if few else subs] * real[:, :, None]).sum(axis=1) * weight
            size += real.sum(axis=1) * weight**2
        out[at] = total / np.sqrt(np.maximum(size, 1e-12))[:, None]
    return out


def _pieces(word: str) -> list[str]:
    return [word] if len(word) <= PIECE else [word[k : k + PIECE] for k in range(0, len(word) - PIECE // 2, PIECE // 2)]


class Model:
    def __init__(self, table: np.ndarray, bias: float, weights: np.ndarray):
        self.table, self.bias, self.weights = table.astype(np.float32), bias, weights

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Margins of raw words; words without letters get the least margin."""
        clean = [normal(w) for w in words]
        place: dict[str, int] = {}
        own = np.fromiter((place.setdefault(c, len(place)) for c in clean), np.int64, len(clean))
        distinct = list(place)
        short = [c if len(c) <= PIECE else "" for c in distinct]
        out = project(short, self.table[None, :])[:, 0] + self.bias
        for k, c in enumerate(distinct):
            if len(c) > PIECE:
                out[k] = (project(_pieces(c), self.table[None, :])[:, 0] + self.bias).max()
        out[[k for k, c in enumerate(distinct) if not c]] = -2.0
        return out[own]

    def signals(self, texts: list[str]) -> np.ndarray:
        """Per text: strongest margin, words beyond each step of the margin, length; the last column is 1."""
        words = Words([t.lower() for t in texts])
        scores = self.word_scores(words.distinct) if words.distinct else np.empty(0)
        each = scores[words.codes]
        top = words.highest(each, -2.0)
        hits = np.stack([words.sums(each > step) for step in STEPS], axis=1)
        for k, spelled in _spelled(words):
            more = self.word_scores(spelled)
            top[k] = max(top[k], more.max())
            hits[k] += [(more > step).sum() for step in STEPS]
        size = np.log1p(words.counts)
        some = (hits > 0) * 1.0
        return np.concatenate(
            [top[:, None], some, np.log1p(hits), size[:, None], some[:, -2:] * size[:, None], np.ones((len(texts), 1))], axis=1
        )

    def scores(self, texts: list[str]) -> np.ndarray:
        return sigmoid(self.signals(texts) @ self.weights) if texts else np.empty(0)


def _spelled(words: Words, least: int = 4) -> Iterator[tuple[int, list[str]]]:
    """Words that a text spells with blanks between letters: (text, the joined runs)."""
    single = np.fromiter((len(w) == 1 and w.isalpha() for w in words.distinct), bool, len(words.distinct))
    if not single.any():
        return
    flag = single[words.codes]
    owner = words.owner()
    at = np.flatnonzero(flag)
    if not len(at):
        return
    breaks = np.flatnonzero((np.diff(at) != 1) | (np.diff(owner[at]) != 0)) + 1
    found: dict[int, list[str]] = {}
    for run in np.split(at, breaks):
        if len(run) >= least:
            found.setdefault(int(owner[run[0]]), []).append("".join(words.distinct[c] for c in words.codes[run]))
    yield from found.items()


def _machine(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Linear machine with squared hinge loss by Newton steps in the primal; last column of x is 1."""
    w = np.zeros(x.shape[1])
    shrink = np.full(x.shape[1], ridge)
    shrink[-1] = 1e-6
    active = None
    for _ in range(40):
        now = y * (x @ w) < 1
        if active is not None and (now == active).all():
            break
        active = now
        gram, target = np.diag(shrink), np.zeros(x.shape[1])
        rows = np.flatnonzero(active)
        for at in range(0, len(rows), 4096):
            part = x[rows[at : at + 4096]]
            weighted = part * cost[rows[at : at + 4096], None]
            gram += weighted.T @ part
            target += weighted.T @ y[rows[at : at + 4096]]
        w = np.linalg.solve(gram, target)
    return w


def _disguised(word: str, rng: np.random.Generator) -> list[str]:
    """The word with a mark between all letters, with one letter doubled, and with one letter put in."""
    k = int(rng.integers(1, max(2, len(word))))
    mark = ".-*_'"[int(rng.integers(0, 5))]
    extra = "xhzq"[int(rng.integers(0, 4))]
    return [mark.join(word), word[:k] + word[k - 1] + word[k:], word[:k] + extra + word[k:], word[:k] + mark + word[k:]]


def fit(texts: list[str], labels: list[int], landmarks: int = LANDMARKS, seed: int = 7) -> Model:
    """Fit on whole labelled texts.  Without both classes, every text scores the share of label 1."""
    y = np.array(labels)
    n1, n0 = int((y == 1).sum()), int((y == 0).sum())
    if not n1 or not n0:
        constant = np.zeros(_SIGNALS)
        constant[-1] = 8.0 if n1 else -8.0
        return Model(np.zeros(_ALPHABET**3), -1.0, constant)
    rng = np.random.default_rng(seed)
    seen = [Counter(), Counter()]
    heads = [Counter(), Counter()]
    least = 2 if n1 < 100 else 3
    for label in (1, 0):
        for text in (t for t, y1 in zip(texts, labels) if y1 == label):
            words = {n for w in set(text.lower().split()) if 3 <= len(n := normal(w)) <= PIECE}
            seen[label].update(words)
            starts = {w[:k] for w in words for k in range(5, min(9, len(w)))}
            heads[label].update(starts if label else starts & heads[1].keys())
        if label:  # rarer starts are never asked for
            heads[1] = Counter({h: c for h, c in heads[1].items() if c >= 2 * least})

    def odds(at: list[Counter], w: str) -> float:
        return np.log((at[1][w] + 0.3) / (n1 + 1)) - np.log((at[0][w] + 0.3) / (n0 + 1))

    strong = {w: odds(seen, w) * np.sqrt(c) for w, c in seen[1].items() if c >= least and odds(seen, w) > 1.6}
    stems = {h for h, c in heads[1].items() if c >= 2 * least and len(h) >= 5 and odds(heads, h) > 1.6}
    kin = [w for w in seen[1] if w not in strong and any(w[:k] in stems for k in range(5, min(9, len(w)))) and odds(seen, w) > 0.5]
    good = sorted(strong, key=lambda w: (-strong[w], w))[:MARKED]
    if not good:
        good = sorted(seen[1], key=lambda w: (-odds(seen, w), w))[:20]
    calm = sorted((w for w in seen[0] if odds(seen, w) < 0.7), key=lambda w: (-seen[0][w], w))
    rest = COMMON_CALM + rng.permutation(max(0, len(calm) - COMMON_CALM))[:OTHER_CALM]
    calm = calm[:COMMON_CALM] + [calm[k] for k in rest]
    chosen = good[: landmarks * 2 // 3]
    chosen += [calm[k] for k in np.linspace(0, len(calm) - 1, max(1, landmarks - len(chosen))).astype(int)] if calm else []
    base = Landmarks(chosen)
    kernel = (base.maps @ base.maps.T).astype(np.float64)
    value, vector = np.linalg.eigh(kernel + 1e-6 * np.eye(len(chosen)))
    root = vector / np.sqrt(np.maximum(value, 1e-6)) @ vector.T
    clear = [w for w in good if odds(seen, w) > 3 and len(w) >= 4]
    veiled = [v for w in clear[:VEILED] for _ in range(4) for v in _disguised(w, rng)]
    veiled = [n for v in veiled if (n := normal(v))]
    plus = good + kin[:KIN] + veiled
    # calm words with letters put in must stay calm
    dull = [n for w in calm[:DULL] for v in _disguised(w, rng)[:3] if len(w) >= 4 and (n := normal(v))]
    minus = calm + dull
    every = [w for w in seen[0] if odds(seen, w) < 0.7]
    model = None
    for turn in range(4):
        x = np.ones((len(plus) + len(minus), len(chosen) + 1))
        for at in range(0, len(x), 4096):
            x[at : at + 4096, :-1] = project((plus + minus)[at : at + 4096], base) @ root
        sign = np.concatenate([np.ones(len(plus)), -np.ones(len(minus))])
        often = np.concatenate([[np.sqrt(seen[1][w] + 1.0) for w in plus], [np.sqrt(seen[0][w] + 1.0) for w in minus]])
        cost = often * np.where(sign > 0, 0.5 / often[sign > 0].sum(), 0.5 / max(1e-9, often[sign < 0].sum())) * 4000
        w = _machine(x, sign, cost, ridge=0.01)
        model = Model(base.table(root @ w[:-1]), float(w[-1]), np.zeros(_SIGNALS))
        if turn < 3 and every:
            margins = project(every, model.table[None, :])[:, 0] + model.bias
            taken = set(minus)
            worst = [every[k] for k in np.argsort(-margins, kind="stable")[:HARD] if margins[k] > -0.3]
            minus = minus + [v for v in worst if v not in taken]
    model.weights = logistic(model.signals(texts), y.astype(float), ridge=0.3)
    return model


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = sorted((row["doc_id"], row["text"] or "", row["y"]) for batch in batches for row in batch.to_pylist())
    model = fit([t for _, t, _ in got], [y for _, _, y in got])
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` documents of each class of ``labels`` (doc_id, ``label``), chosen by hash of the id.

    An id with both labels counts as 1; labels other than 0 and 1, null ids and ids of no document are left out; a null text is empty;
    rows that repeat an id all count.  One task of an executor gets the sample and fits; only the model comes to the driver.
    Without any labelled document the model scores all alike.
    """
    ids = labels.select("doc_id", F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    chosen = bounded_sample(ids.groupBy("doc_id").agg(F.max("y").alias("y")), "y", "doc_id", sample)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    found = rows.repartition(1).mapInArrow(frugal(_fitted), "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else fit([], [])


def _scored(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for ids, raw in text_segments(batches, SEGMENT):
            texts = [t.decode("utf-8", "replace") if t else "" for t in raw]
            yield pa.RecordBatch.from_arrays([ids, pa.array(model.scores(texts))], names=["id", "score"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): probability of label 1 for every whole text; null counts as empty.

    Repeated rows and null ids are returned as they come; other columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(frugal(_scored(held)), f"id {kind}, score double")
