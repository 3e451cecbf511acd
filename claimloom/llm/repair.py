"""Token-id output compressed by Re-Pair grammars, one per shard, with random-access decoding.

Documents are range-partitioned by id, encoded, closed with an end id, and packed into shards.  In a shard frequent
neighbouring pairs are replaced by nonterminals, round after round, until no pair is frequent; a round replaces many of
the most frequent pairs at once, the more frequent one where two overlap.  Pairs inside words go first, on the distinct words,
where each counts as often as its word occurs; then all pairs do.  No pair crosses a document.  A shard stores its rules,
the expansion length of each rule, the compressed sequence and each document's place in it, so one document
can be expanded without the others.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import cache
from string import ascii_letters

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimloom.llm.common import frugal, scratch, text_segments
from claimloom.llm.token_counts import digest, tokenizer

#: A round replaces all frequent pairs that occur at least this part as often as the most frequent one.
SPREAD = 64
#: A pair must occur so often to get a rule.
LEAST_USES = 8
SHARD_BYTES = 20 << 20
#: What stands in the place of a symbol: the end of a document; the second half of a pair that was replaced.
_GAP, _GONE = -1, -2

SHARD = (
    "part int, shard int, n_ids bigint, base int, doc_ids array<{kind}>, doc_starts binary, doc_sizes binary,"
    " rules binary, lengths binary, sequence binary"
)


def compress(ids: np.ndarray, sizes: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of documents of ``sizes`` -> (sequence, places of documents in it, rules as pairs).

    Nonterminals are numbered from ``base`` on, in the order of ``rules``.
    """
    return _reduced(_Sequence(ids, sizes), base, np.empty((0, 2), np.int32))


def compress_words(
    flat: np.ndarray, each: np.ndarray, codes: np.ndarray, counts: np.ndarray, end_id: int, base: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of ``each`` ids, and documents of ``counts`` of them by number -> (ids of each document, and as above).

    A document has ``end_id`` behind its words.
    """
    stops = np.cumsum(counts)
    words, starts, rules = _reduced(_Sequence(flat, each, np.bincount(codes, minlength=len(each))), base, np.empty((0, 2), np.int32))
    short = np.diff(starts, append=len(words))
    picks = np.insert(codes, stops, len(each))
    ids = _gather(np.append(words, np.int32(end_id)), np.append(short, 1), picks)
    of_docs = lambda n: np.diff(np.concatenate([[0], np.cumsum(n[codes])])[stops], prepend=0) + 1
    return of_docs(each), *_reduced(_Sequence(ids, of_docs(short)), base, rules)


def _reduced(seq: _Sequence, base: int, rules: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same of a sequence that ``rules`` were used in already."""
    newest = 0  # number of the first pair with a rule of the last round, if those come first
    while True:
        chosen = newest + np.flatnonzero(seq.uses[newest:] >= LEAST_USES)
        if not len(chosen):
            if not newest:
                break
            newest = 0  # a last look at all pairs
            continue
        n = seq.uses[chosen]
        least = n.max() / SPREAD
        chosen = chosen[n >= least]
        at, rule, used = _places(seq, *seq.places(chosen), chosen)
        pairs = seq.pairs[chosen[used]]
        first = len(seq.uses)
        seq.replace(at, base + len(rules) + rule)
        newest = first if least <= LEAST_USES else 0
        rules = np.concatenate([rules, np.stack([pairs >> 32, pairs & 0xFFFFFFFF], axis=1).astype(np.int32)])
    s = seq.symbols[seq.symbols != _GONE]
    gaps = np.flatnonzero(s == _GAP)
    starts = np.concatenate([[0], gaps[:-1] + 1]) - np.arange(len(gaps)) if len(gaps) else np.empty(0, np.int64)
    return s[s != _GAP], starts.astype(np.int64), rules


class _Sequence:
    """Symbols of documents, a gap behind each, with the places of every frequent pair.

    Places stay where they are: a replaced pair's first place gets the new symbol, its second one is passed over.  A pair is
    numbered from 1 on when it first occurs LEAST_USES times, which is when its newer symbol is made, as it only becomes rarer
    later.  ``pairs`` and ``uses`` hold each pair and how often it occurs now, counted exactly; in a document with a weight that often.
    """

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, weights: np.ndarray | None = None):
        length = len(ids) + len(sizes)
        kind = np.int32 if length < 1 << 31 else np.int64
        gap = np.cumsum(sizes) + np.arange(len(sizes))
        keep = np.ones(length, bool)
        keep[gap] = False
        self.symbols = np.full(length, _GAP, np.int32)
        self.symbols[keep] = ids
        self.weights = None if weights is None else np.repeat(weights, sizes + 1)  # of each place
        self.after, self.before = np.arange(1, length + 1, dtype=kind), np.arange(-1, length - 1, dtype=kind)
        self.number = np.zeros(length, np.int32)  # of the pair at each place, 0 for rare ones and none
        self.pairs, self.uses = np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.lists: list[tuple[int, np.ndarray, np.ndarray]] = []  # (first number, sizes of the lists, places)
        keep[:-1] &= keep[1:]
        self._add(np.flatnonzero(keep))

    def _add(self, at: np.ndarray) -> None:
        """Number the frequent ones of the pairs at the places ``at``, which occur nowhere else."""
        if not len(at):
            return
        a, b = self.symbols[at].astype(np.int64), self.symbols[self.after[at]]
        bits, low = int(max(a.max(), b.max())).bit_length(), len(self.symbols).bit_length()
        if 2 * bits + low < 64:  # pair and place fit one number, which sorts fastest
            a <<= bits
            a |= b
            a <<= low
            a |= at
            a.sort()
            at = a & ((1 << low) - 1)
            a >>= low
        else:
            bits = 32
            a = a << bits | b
            order = np.argsort(a, kind="stable")
            a, at = a[order], at[order]
        starts = np.concatenate([[0], np.flatnonzero(a[1:] != a[:-1]) + 1])
        n = np.diff(starts, append=len(a))
        uses = n if self.weights is None else np.add.reduceat(self.weights[at], starts)
        frequent = uses >= LEAST_USES
        pairs = a[starts[frequent]]
        at, n = at[np.repeat(frequent, n)], n[frequent]
        first = len(self.uses)
        size = (first + len(n)).bit_length()
        both = at << size
        both |= np.repeat(np.arange(first, first + len(n)), n)
        both.sort()
        self.number[both >> size] = both & ((1 << size) - 1)
        self.lists.append((first, n, at.astype(self.after.dtype)))
        self.pairs = np.concatenate([self.pairs, (pairs >> bits) << 32 | pairs & ((1 << bits) - 1)])
        self.uses = np.concatenate([self.uses, uses[frequent]])

    def places(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the pairs of the ascending numbers ``chosen``, in order, and which of them is at each)."""
        bits = len(chosen).bit_length()
        found = []
        for first, sizes, places in self.lists:
            low, high = np.searchsorted(chosen, [first, first + len(sizes)])
            if low < high:
                picks = chosen[low:high] - first
                both = _gather(places, sizes, picks).astype(np.int64) << bits
                both |= np.repeat(np.arange(low, high), sizes[picks])
                found.append(both)
        both = np.concatenate(found)
        both.sort()  # before the look at what stands there now, which is faster in order
        at = both >> bits
        both &= (1 << bits) - 1
        still = np.flatnonzero(self.number[at] == chosen.astype(np.int32)[both])
        return at[still], both[still]

    def replace(self, at: np.ndarray, symbols: np.ndarray) -> None:
        """Put ``symbols`` in the place of the pairs at ``at``, which do not overlap, and number the pairs they form."""
        second = self.after[at]
        right = self.after[second]
        self.symbols[at], self.symbols[second] = symbols, _GONE
        self.after[at], self.before[right] = right, at
        left = self.before[at]
        for gone in (at, second, left):  # before the first place of all stands the last gap, which has no pair
            np.subtract.at(self.uses, self.number[gone], 1 if self.weights is None else self.weights[gone])
            self.number[gone] = 0
        self.uses[0] = 0
        both = np.stack([left, at], axis=1).ravel()
        both = both[np.flatnonzero((both >= 0) & (np.diff(both, prepend=-2) > 0))]
        self._add(both[np.flatnonzero((self.symbols[both] != _GAP) & (self.symbols[self.after[both]] != _GAP))])


def _places(seq: _Sequence, at: np.ndarray, rule: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, number of the pair at each, which ones are used): where the pairs ``chosen``, found at ``at``, are replaced.

    Of two that overlap the more frequent one is, of equally frequent ones that with the less hash, so copies of a passage
    are cut alike; in runs of one pair the leftmost.  Pairs that are replaced at less than half of LEAST_USES places are
    left out; the first of all never is.
    """
    after, pairs = seq.after, seq.pairs[chosen]
    mixed = pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    rank = np.empty(len(pairs), np.int32)
    rank[np.lexsort((mixed, -seq.uses[chosen]))] = np.arange(len(pairs))
    place, touch = rank[rule], after[at[:-1]] == at[1:]
    free = np.ones(len(at), bool)
    free[1:] &= ~(touch & (place[:-1] < place[1:]))
    free[:-1] &= ~(touch & (place[1:] < place[:-1]))
    free = np.flatnonzero(free)
    at, rule = at[free], rule[free]
    fresh = np.ones(len(at), bool)
    fresh[1:] = after[at[:-1]] != at[1:]
    later = np.flatnonzero(~fresh)
    if len(later):
        k = np.arange(len(later))
        nth = k - np.maximum.accumulate(np.where(np.diff(later, prepend=-2) != 1, k, 0))  # in its run, behind the leftmost
        at, rule = np.delete(at, later[nth % 2 == 0]), np.delete(rule, later[nth % 2 == 0])
    used = np.bincount(rule, None if seq.weights is None else seq.weights[at], len(pairs)) >= LEAST_USES // 2
    ok = np.flatnonzero(used[rule])
    return at[ok], (np.cumsum(used) - 1)[rule[ok]], used


def expansion_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """Ids that each rule stands for; a rule only uses earlier ones."""
    out = np.zeros(len(rules), np.int64)
    deepest = np.maximum.accumulate(rules.max(axis=1, initial=0)) - base
    start = 0
    while start < len(rules):
        stop = int(np.searchsorted(deepest, start))  # up to there rules only use those that are done
        part = rules[start:stop]
        out[start:stop] = np.where(part < base, 1, out[np.maximum(part - base, 0)]).sum(axis=1)
        start = stop
    return out


def expand(sequence: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """The ids that a piece of a compressed sequence stands for."""
    s = np.asarray(sequence, np.int32)
    while True:
        at = s >= base
        if not at.any():
            return s
        n = np.where(at, 2, 1)
        ends = np.cumsum(n)
        out = np.empty(int(ends[-1]), np.int32)
        out[ends[~at] - 1] = s[~at]
        pair = rules[s[at] - base]
        out[ends[at] - 2] = pair[:, 0]
        out[ends[at] - 1] = pair[:, 1]
        s = out


def expand_all(sequence: np.ndarray, rules: np.ndarray, lengths: np.ndarray, base: int) -> np.ndarray:
    """The same for a whole shard: every rule is expanded once, then all symbols are looked up in one pass."""
    if not len(rules):
        return np.asarray(sequence, np.int32)
    table = np.concatenate([np.arange(base, dtype=np.int32), expand(rules.reshape(-1), rules, base)])
    sizes = np.ones(base + len(rules), np.int64)
    sizes[base:] = lengths
    return _gather(table, sizes, np.asarray(sequence, np.int64))


_memos: dict[bytes, dict] = {}
#: Words whose ids a Python worker remembers for each tokenizer; a bound on memory, without effect on results.
MEMO = 500_000


#: A sign that stands between words encoded in one call; words that hold it are encoded alone.
_BETWEEN = "\u00ae"
_STOPS = b".,;:!?#$%&*)\""
_BLANKS = b" \n"
#: Words of letters up to U+00FF, and kinds of bytes; a letter is one byte, or _LEAD and any byte but those of the two signs.
_LETTERS = "^[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+$"
_LETTER, _STOP, _BLANK, _LEAD, _SIGN = range(1, 6)
_KINDS = bytearray(256)
for _signs, _kind in ((ascii_letters.encode(), _LETTER), (_STOPS, _STOP), (_BLANKS, _BLANK), (b"\xc3", _LEAD), (b"\x97\xb7", _SIGN)):
    for _sign in _signs:
        _KINDS[_sign] = _kind


def _byte_signs() -> dict[int, str]:
    """The signs that byte-level tokenizers write for the bytes of each character up to U+00FF."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    sign = dict(zip(shown, map(chr, shown))) | {b: chr(256 + k) for k, b in enumerate(sorted({*range(256)} - {*shown}))}
    return {c: "".join(sign[b] for b in chr(c).encode()) for c in range(256)}


_SIGNS = _byte_signs()


@cache
def _letters_only(tok):
    """(the library's tokenizer with the same merges for words of letters alone, the ids that end a word), or None.

    Such words, in lower case and up to U+00FF, pass normalising and cutting unchanged, so both are left out; they are most of the work.
    """
    spec = json.loads(tok.to_str())
    model, cuts = spec["model"], (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    end = model.get("end_of_word_suffix")
    bytewise = len(cuts) == 2 and cuts[0]["type"] == "Split" and cuts[0]["pattern"].get("Regex") == _CUTS and cuts[1]["type"] == "ByteLevel"
    changes = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
    others = (model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "ignore_merges"))
    if model["type"] != "BPE" or not end or any(others) or not bytewise or cuts[1]["add_prefix_space"] or not {*changes} <= {"NFC", "Replace", "Lowercase"}:
        return None
    if not all(x in model["vocab"] and x + end in model["vocab"] for signs in _SIGNS.values() for x in signs):
        return None
    from tokenizers import Tokenizer, models, pre_tokenizers

    # no word comes twice, so nothing is kept for the next time
    plain = Tokenizer(models.BPE(model["vocab"], [tuple(m) for m in model["merges"]], cache_capacity=0, end_of_word_suffix=end))
    plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    closes = np.zeros(max(model["vocab"].values()) + 1, bool)
    closes[[k for token, k in model["vocab"].items() if token.endswith(end)]] = True
    return plain, closes


#: The cuts at which words of letters are known to stay whole.
_CUTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _strings(words: pa.Array) -> list[str]:
    return words.to_numpy(zero_copy_only=False).tolist()  # faster than to_pylist


def _of_letters(tok, words: list[str]) -> dict[str, bytes]:
    """Ids as bytes of those ``words`` that are letters up to U+00FF in lower case; none if the tokenizer is another one."""
    made = _letters_only(tok)
    if not made:
        return {}
    plain, closes = made
    table = pa.array(words, pa.large_string())
    known = _strings(table.filter(pc.and_(pc.match_substring_regex(table, _LETTERS), pc.equal(table, pc.utf8_lower(table)))))
    out: dict[str, bytes] = {}
    for at in range(0, len(known), 50_000):
        part = known[at : at + 50_000]
        signs = [w if w.isascii() else w.translate(_SIGNS) for w in part]
        texts = [" ".join(signs[k : k + 64]) for k in range(0, len(signs), 64)]
        ids = np.array([i for e in plain.encode_batch_fast(texts, add_special_tokens=False) for i in e.ids], np.int32)
        raw, start = ids.tobytes(), 0
        for word, stop in zip(part, (4 * np.flatnonzero(closes[ids]) + 4).tolist(), strict=True):
            out[word] = raw[start:stop]
            start = stop
    return out


def _fresh(tok, words: list[str]) -> dict[str, bytes]:
    """Ids of words as bytes; many words share a call, kept apart by a sign that always is one id of its own."""
    sign = tok.encode(_BETWEEN, add_special_tokens=False).ids
    out = _of_letters(tok, words)
    plain = [w for w in words if w not in out and _BETWEEN not in w] if len(sign) == 1 else []
    for at in range(0, len(plain), 50_000):
        part = plain[at : at + 50_000]
        texts = [f" {_BETWEEN} ".join([*part[k : k + 64], ""]) for k in range(0, len(part), 64)]
        ids = np.array([i for e in tok.encode_batch_fast(texts, add_special_tokens=False) for i in e.ids], np.int32)
        stops = np.flatnonzero(ids == sign[0])
        raw, start = ids.tobytes(), 0
        for word, stop in zip(part, (4 * stops).tolist()):
            out[word] = raw[start:stop]
            start = stop + 4
    for word in words:
        if word not in out:
            out[word] = np.array(tok.encode(word, add_special_tokens=False).ids, np.int32).tobytes()
    return out


def _encoded(tok, chunks: list[str] | pa.Array, memo: dict) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the chunks one after another, and how many each has.

    The tokenizer lower-cases, so words of letters are looked up in lower case.  ``memo`` holds words as one Arrow array, their
    ids one after another and how many each has; words are looked up there all at once.
    """
    forms = chunks if isinstance(chunks, pa.Array) else pa.array(chunks, pa.large_string())
    forms = pc.if_else(pc.match_substring_regex(forms, _LETTERS), pc.utf8_lower(forms), forms)
    if not memo:
        memo.update(words=pa.array([], pa.large_string()), ids=np.empty(0, np.int32), sizes=np.empty(0, np.int64))
    known, flat, sizes = memo["words"], memo["ids"], memo["sizes"]
    found = pc.index_in(forms, value_set=known)
    picks = pc.fill_null(found, -1).to_numpy().astype(np.int64)
    if found.null_count:
        missing = forms.filter(pc.is_null(found)).dictionary_encode()
        picks[picks < 0] = len(known) + missing.indices.to_numpy()
        words = _strings(missing.dictionary)
        made = _fresh(tok, words)
        blobs = [made[w] for w in words]
        fresh = np.frombuffer(b"".join(blobs), np.int32)
        n = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
        # the commonest words come early; when the memo is full it stays as it is
        short = np.flatnonzero(pc.less_equal(pc.utf8_length(missing.dictionary), 64))[: max(0, MEMO - len(known))]
        if len(short):
            memo["words"] = pa.concat_arrays([known, missing.dictionary.take(pa.array(short))])
            memo["ids"] = np.concatenate([flat, _gather(fresh, n, short)])
            memo["sizes"] = np.concatenate([sizes, n[short]])
        flat, sizes = np.concatenate([flat, fresh]), np.concatenate([sizes, n])
    return _gather(flat, sizes, picks), sizes[picks]


def _words(raw: list) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of UTF-8 texts, the words of all texts by number, and how many each text has.

    Texts are cut at blanks and line ends, which this tokenizer drops, and before marks that end a word behind a letter up to
    U+00FF, as it never joins the two.  Marks that special strings are made of stay where they are.
    """
    texts = [t or b"" for t in raw]
    joined = b"\n".join([*texts, b""])
    try:
        joined.decode()
    except UnicodeDecodeError:
        texts = [t.decode("utf-8", "replace").encode() for t in texts]
        joined = b"\n".join([*texts, b""])
    kind = np.frombuffer(joined.translate(_KINDS), np.uint8)
    blank, letter = kind == _BLANK, kind == _LETTER
    letter[1:] |= (kind[:-1] == _LEAD) & (kind[1:] != _SIGN)
    cut = blank.copy()  # a word ends at this byte: before it if it is blank, else behind it
    edges = np.flatnonzero(np.diff(kind == _STOP))  # no run of marks is the last, which is a line end
    if len(kind) and kind[0] == _STOP:
        edges = edges[1:]
    before, last = edges[::2], edges[1::2]
    cut[before[letter[before] & blank[last + 1]]] = True
    at = np.flatnonzero(cut)
    ends = at + 1 - np.cumsum(blank[at])  # places in the bytes without blanks
    full = np.diff(ends, prepend=0) > 0
    offsets = np.append(0, ends[full])
    packed = joined.translate(None, _BLANKS)
    words = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(packed)).dictionary_encode()
    closed = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    counts = np.diff(np.cumsum(full)[np.searchsorted(at, closed)], prepend=0)
    return words.dictionary, words.indices.to_numpy().astype(np.int64), counts


def _gather(flat: np.ndarray, sizes: np.ndarray, picks: np.ndarray) -> np.ndarray:
    starts = np.cumsum(sizes) - sizes
    n = sizes[picks]
    total = int(n.sum())
    return flat[np.arange(total) + np.repeat(starts[picks] - (np.cumsum(n) - n), n)]


def _shards(spec, end_id: int, schema_names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(spec.value)
        memo = _memos.setdefault(digest(spec.value), {})
        base = max(tok.get_vocab_size(with_added_tokens=True), end_id + 1)
        part = TaskContext.get().partitionId()
        for shard, (doc_ids, raw) in enumerate(text_segments(batches, SHARD_BYTES)):
            words, codes, counts = _words(raw)
            flat, each = _encoded(tok, words, memo)
            sizes, sequence, starts, rules = compress_words(flat, each, codes, counts, end_id, base)
            lengths = expansion_lengths(rules, base)
            values = [
                pa.array([part], pa.int32()),
                pa.array([shard], pa.int32()),
                pa.array([int(sizes.sum())], pa.int64()),
                pa.array([base], pa.int32()),
                pa.ListArray.from_arrays(pa.array([0, len(doc_ids)], pa.int32()), doc_ids),
                *(
                    pa.array([x.tobytes()], pa.binary())
                    for x in (starts, sizes.astype(np.int64), rules.astype(np.int32), lengths, sequence)
                ),
            ]
            yield pa.RecordBatch.from_arrays(values, names=schema_names)

    return run


def write_shards(
    docs: DataFrame, spec_path: str, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Encode every whole text and write Re-Pair shards in ascending order of ids to ``path`` (Parquet).

    A null text counts as empty and yields the end id alone; equal ids are ordered by text; null ids come
    first; other columns are ignored; an empty table gives no shards.  Special strings inside texts are treated as the library does by
    default.  The tokenizer must lower-case, drop white space and keep letters and marks apart, as the one this is made for does: texts
    are cut at blanks and plain words are looked up in lower case.
    """
    spark = docs.sparkSession
    with open(spec_path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.repartitionByRange("id").sortWithinPartitions("id", "text")
    names = [c.split()[0] for c in SHARD.split(", ")]
    packed = rows.mapInArrow(frugal(_shards(spec, end_id, names)), SHARD.format(kind=kind))
    packed.write.option("compression", "zstd").parquet(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            col = {n: batch.column(k)[row] for k, n in enumerate(batch.schema.names)}
            blob = lambda n, kind: np.frombuffer(col[n].as_buffer(), kind)
            starts, sizes = blob("doc_starts", np.int64), blob("doc_sizes", np.int64)
            rules = blob("rules", np.int32).reshape(-1, 2)
            ids = expand_all(blob("sequence", np.int32), rules, blob("lengths", np.int64), col["base"].as_py())
            ends = np.cumsum(sizes)
            raw = ids.astype("<u4").tobytes()
            crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist())]
            n = len(starts)
            yield pa.RecordBatch.from_arrays(
                [
                    col["doc_ids"].values,
                    pa.array(np.full(n, col["part"].as_py(), np.int32)),
                    pa.array(np.full(n, col["shard"].as_py(), np.int32)),
                    pa.array(ends - sizes),
                    pa.array(sizes),
                    pa.array(crc, pa.int64()),
                ],
                names=["id", "part", "shard", "local", "n_tokens", "ids_crc32"],
            )


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) decoded from the files; ``start`` counts the ids of all documents before."""
    shards = spark.read.parquet(path)
    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()
    # one row per shard of some megabytes of text
    before = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = shards.select("part", "shard", "n_ids").withColumn("offset", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    rows = shards.mapInArrow(
        _read, f"id {kind}, part int, shard int, local bigint, n_tokens bigint, ids_crc32 bigint"
    )
    return rows.join(offsets.drop("n_ids"), ["part", "shard"]).select(
        "id", (F.col("offset") + F.col("local")).alias("start"), "n_tokens", "ids_crc32"
    )


def read_document(shard: dict, k: int) -> np.ndarray:
    """Ids of the ``k``-th document of one shard row, without expanding the others."""
    starts = np.frombuffer(shard["doc_starts"], np.int64)
    sequence = np.frombuffer(shard["sequence"], np.int32)
    stop = starts[k + 1] if k + 1 < len(starts) else len(sequence)
    rules = np.frombuffer(shard["rules"], np.int32).reshape(-1, 2)
    return expand(sequence[starts[k] : stop], rules, shard["base"])


def round_trip(docs: DataFrame, spec_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write shards to the shared folder and read them back; see :func:`write_shards` and :func:`read_shards`."""
    spark = docs.sparkSession
    path = scratch(spark, "token-shards")
    write_shards(docs, spec_path, path, end_id, id_col, text_col)
    return read_shards(spark, path)
