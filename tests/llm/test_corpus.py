"""The corpus operators against brute force, the libraries themselves, and odd inputs."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash

from claimloom.llm import byte_bpe, decontaminate, embeddings, pii, quality, queries, repair, simhash, token_counts, toxicity, urls

RNG = random.Random(11)
WORDS = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(1, 6))) for _ in range(60)]
ODD = [None, "", " ", "\n\t ", "a", "x" * 3000, "  a  b \n c\n\n d  ", "é è 日本語 don't 12 34!!", "<|endoftext|> b <|endoftext|>", "a \u00ae b", "same words here", "same words here"]


def prose(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


TEXTS = ODD + [prose(RNG.randint(1, 80)) for _ in range(40)]


def documents(spark, texts=TEXTS):
    rows = [(k, t, "x", "y", 0, 7) for k, t in enumerate(texts)]
    # further columns must not matter, whatever their names
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, id string, fp int, n_tokens int")


def empty(spark):
    return documents(spark).limit(0)


def plain_fingerprint(text):
    words = [w.decode() for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def least_reachable(ids, linked):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def test_simhash_against_brute_force(spark):
    texts = TEXTS + [TEXTS[-1] + " x", TEXTS[-1]] + [prose(400)] * 3
    long = texts[-1].split()
    texts += [" ".join([*long[:k], "zz", *long[k + 1 :]]) for k in range(0, 400, 9)]  # more than a short list of near copies
    got = {r["id"]: r for r in simhash.near_duplicates(documents(spark, texts)).collect()}
    prints = {k: plain_fingerprint(t) for k, t in enumerate(texts)}
    assert {k: r["fp"] & (1 << 64) - 1 for k, r in got.items()} == prints
    pairs = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    assert {k: r["component"] for k, r in got.items()} == least_reachable(prints, pairs)
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_triples_cover_every_choice_of_shared_bytes():
    from itertools import combinations

    assert all(any(set(t) <= set(c) for t in simhash.TRIPLES) for c in combinations(range(8), simhash.MIN_SHARED_BYTES))


@pytest.mark.parametrize("block", [simhash.BLOCK, 16])  # one block, several blocks and their pairs
def test_long_lists_link_like_short_ones(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    base = RNG.getrandbits(64)
    prints = {base} | {base ^ sum(1 << b for b in RNG.sample(range(64), 2)) for _ in range(80)} | {RNG.getrandbits(64) for _ in range(50)}
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    got = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp bigint")).collect()
    near = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3]
    # a tile's forest may tie fingerprints that hang together only through others, never any that do not
    assert least_reachable(signed, [tuple(r) for r in got]) == least_reachable(signed, near)


def test_token_counts_are_the_library_s(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    got = {r["id"]: (r["n_bytes"], r["n_tokens"]) for r in token_counts.count_tokens(documents(spark), path).collect()}
    assert got == {k: (len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for k, t in enumerate(TEXTS)}
    assert token_counts.count_tokens(empty(spark), path).count() == 0


def test_byte_bpe_is_the_library_s_and_decodes(spark):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = byte_bpe.read_ranks(path)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["id"]: r for r in byte_bpe.encode(documents(spark), path, public_tokenizers.PATTERN).collect()}
    for k, t in enumerate(TEXTS):
        assert got[k]["ids"] == enc.encode_ordinary(t or ""), t
        assert bytes(got[k]["decoded"]) == (t or "").encode()
    assert byte_bpe.encode(empty(spark), path, public_tokenizers.PATTERN).count() == 0
    for word in (b"abcdefgh" * 40, b"aaaa", b"a"):
        assert byte_bpe.merge_long(word, ranks) == enc.encode_ordinary(word.decode())


def test_shards_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    repair.write_shards(documents(spark).repartition(5), path, str(tmp_path / "s"))
    got = {r["id"]: r for r in repair.read_shards(spark, str(tmp_path / "s")).collect()}
    start, every = 0, {}
    for k, t in enumerate(TEXTS):
        every[k] = ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        assert (got[k]["start"], got[k]["n_tokens"], got[k]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), t
        start += len(ids)
    for row in spark.read.parquet(str(tmp_path / "s")).collect():
        for k, doc in enumerate(row["doc_ids"]):
            assert repair.read_document(row.asDict(), k).tolist() == every[doc]
    assert repair.round_trip(empty(spark), path).count() == 0


@pytest.mark.parametrize("ids", [[], [5], [5, 5, 5, 5] * 20, [1, 2, 3] * 30 + [9]])
def test_grammar_expands_to_its_input(ids):
    sizes = np.array([len(ids) // 2, len(ids) - len(ids) // 2])
    s, starts, rules = repair.compress(np.array(ids, np.int32), sizes, 100)
    assert repair.expand(s, rules, 100).tolist() == ids
    assert repair.expand_all(s, rules, repair.expansion_lengths(rules, 100), 100).tolist() == ids
    assert repair.expand(s[starts[1] :], rules, 100).tolist() == ids[sizes[0] :]


def test_grammar_goes_on_until_no_pair_is_frequent():
    passage = list(range(64))
    ids = np.array((passage + [99]) * 100, np.int32)
    s, _, rules = repair.compress(ids, np.array([len(ids)]), 100)
    assert repair.expand(s, rules, 100).tolist() == ids.tolist()
    assert len(s) < 20 and repair.expansion_lengths(rules, 100).max() >= 65
    assert max(Counter(zip(s[:-1].tolist(), s[1:].tolist())).values()) < repair.LEAST_USES


@pytest.mark.parametrize("base", [60, 1 << 30])  # symbols that leave no room for places beside pairs, too
def test_words_are_cut_first_and_pairs_until_none_is_frequent(base):
    rng = np.random.default_rng(5)
    each = rng.integers(0, 6, 300)  # some words have no ids
    flat = rng.integers(base - 60, base - 1, each.sum()).astype(np.int32)
    counts = np.array([0, 1, *rng.integers(0, 60, 400), 0])
    codes = np.minimum(rng.zipf(1.3, counts.sum()), len(each)) - 1
    words = np.split(flat, np.cumsum(each)[:-1])
    docs = [[*(i for k in part for i in words[k].tolist()), base - 1] for part in np.split(codes, np.cumsum(counts)[:-1])]
    sizes, s, starts, rules = repair.compress_words(flat, each, codes, counts, base - 1, base)
    parts = [part.tolist() for part in np.split(s, starts[1:])]
    assert sizes.tolist() == [len(d) for d in docs] and [repair.expand(part, rules, base).tolist() for part in parts] == docs
    assert repair.expansion_lengths(rules, base).tolist() == [len(repair.expand(r, rules, base)) for r in rules]
    assert max(Counter(pair for part in parts for pair in zip(part, part[1:])).values()) < repair.LEAST_USES
    plain, _, others = repair.compress(np.array(sum(docs, []), np.int32), sizes, base)
    assert len(s) + 2 * len(rules) < len(plain) + 2 * len(others)


def test_a_full_memo_of_words_changes_no_ids(monkeypatch):
    monkeypatch.setattr(repair, "MEMO", 3)
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        tok, memo = token_counts.tokenizer(f.read()), {}
    for words in (["the", "x" * 65, "The", "a1"], ["a1", "of", "no", "the"], ["no", "a1", "<|endoftext|>"]):
        flat, sizes = repair._encoded(tok, words, memo)
        got = [part.tolist() for part in np.split(flat, np.cumsum(sizes)[:-1])]
        assert got == [tok.encode(w, add_special_tokens=False).ids for w in words]
    assert memo["words"].to_pylist() == ["the", "a1", "of"]


def test_frequent_pair_behind_a_rare_one_of_its_bucket_gets_the_rule():
    code = lambda a, b: ((a * 0x9E3779B1 ^ b * 0x85EBCA6B) & 0xFFFFFFFF) >> 12
    first, rare, frequent = {}, None, None
    for a in range(2000):
        for b in range(2000, 2004):
            if (old := first.setdefault(code(a, b), (a, b))) != (a, b) and old[0] != a and old[1] != b and code(a, b):
                rare, frequent = old, (a, b)
    docs = [rare, *[frequent] * 20]
    s, _, rules = repair.compress(np.array(docs, np.int32).reshape(-1), np.full(len(docs), 2), 5000)
    assert rules.tolist() == [list(frequent)] and s.tolist() == [*rare, *[5000] * 20]


def brute_contamination(text, items):
    words = [w.decode() for w in decontaminate.words_of(text.encode() if text else None)]
    hit, found = set(), set()
    for item, body in items:
        q = [w.decode() for w in decontaminate.words_of(body.encode() if body else None)]
        n = min(10, len(q))
        for k in range(max(1, len(q) - 9) if q else 0):
            for p in range(len(words) - n + 1):
                if words[p : p + n] == q[k : k + n]:
                    hit |= set(range(p, p + n))
                    found.add(str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def test_decontamination_against_brute_force(spark, monkeypatch):
    items = [(1, prose(25)), (2, "Solo word"), (3, ""), (4, None), (5, prose(10)), (5, prose(12)), (6, "a a a a a a a a a a a a")]
    texts = [*TEXTS, "x " + items[0][1] + " y", items[0][1].upper(), " ".join(items[0][1].split()[3:15]), "solo-WORD solo word", items[4][1] + " " + items[5][1], "a " * 30]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    want = {k: brute_contamination(t, items) for k, t in enumerate(texts)}
    read = lambda df: {r["id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in df.collect()}
    assert read(decontaminate.contamination(documents(spark, texts), table)) == want
    monkeypatch.setattr(decontaminate, "QUERY_WORDS", 12)  # several blocks of queries
    assert read(decontaminate.contamination(documents(spark, texts), table)) == want
    assert all(v[1] == 0 for v in read(decontaminate.contamination(documents(spark, texts), table.limit(0))).values())
    assert decontaminate.contamination(empty(spark), table).count() == 0


def test_blocks_of_queries_keep_rows_of_repeated_and_null_ids_apart(spark, monkeypatch):
    items = [(k, prose(14)) for k in range(4)]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    texts = [t for _, t in items] + [prose(14), items[0][1], None, None]
    rows = [(7, t) for t in texts] + [(None, t) for t in texts] + [(1, texts[1])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = sorted((str(i), *brute_contamination(t, items)) for i, t in rows)
    for words in (1 << 20, 12):  # one block of queries, several
        monkeypatch.setattr(decontaminate, "QUERY_WORDS", words)
        got = decontaminate.contamination(docs, table).collect()
        assert sorted((str(r["id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in got) == want


def test_index_holds_every_token_of_whole_texts(spark):
    texts = ["b A b", None, "", "c-a", prose(30_000)]
    rows = decontaminate.build_index(documents(spark, texts).repartition(1)).collect()
    got = Counter()
    for row in rows:
        starts = np.cumsum([0, *np.frombuffer(row["n_words"], np.int64)])
        positions = np.cumsum(np.frombuffer(row["steps"], np.int32))
        words = np.repeat(np.array([bytes(t).decode() for t in row["terms"]]), np.frombuffer(row["lengths"], np.int32))
        for word, at in zip(words.tolist(), positions.tolist()):
            doc = int(np.searchsorted(starts, at, "right")) - 1
            got[row["ids"][doc], word, at - int(starts[doc])] += 1
    want = Counter((k, w, at) for k, t in enumerate(texts) for at, w in enumerate((t or "").lower().replace("-", " ").split()))
    assert got == want


def test_matches_of_odd_rows_in_several_blocks(spark, monkeypatch):
    items = [(1, prose(12)), (1, "lone"), (2, prose(15)), (3, None), (4, "")]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    texts = [items[0][1], None, "", "x lone y lone", items[2][1] + " " + items[0][1]]
    docs = spark.createDataFrame([(i, t, "z") for i in (5, 5, None) for t in texts], "doc_id bigint, text string, item string")
    for words in (1 << 20, 10):
        monkeypatch.setattr(decontaminate, "QUERY_WORDS", words)
        got = Counter((r["id"], r["item"], r["position"]) for r in decontaminate.matches(docs, table).collect() if r["kind"] == "phrase")
        each = Counter({("1", at): 1 for at in (0, 1, 2)}) + Counter([("1", 1), ("1", 3)]) + Counter([("2", k) for k in range(6)] + [("1", 15 + k) for k in range(3)])
        assert got == Counter({(i, *key): n * times for i, times in ((5, 2), (None, 1)) for key, n in each.items()})
        assert decontaminate.matches(docs.limit(0), table).count() == 0
        assert decontaminate.matches(docs, table.limit(0)).count() == 0


def test_phrase_and_proximity_matches(spark):
    item = "one two three four five six seven eight nine ten"
    near = "one two three four five x six seven eight nine y ten"
    table = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    got = decontaminate.matches(documents(spark, [item, near, "one two", "z " + item]), table).collect()
    assert {(r["id"], r["kind"]) for r in got} == {(0, "phrase"), (1, "proximity"), (3, "phrase")}


def brute_proximity(text, item, slop):
    words, q = text.split(), item.split()
    n = min(10, len(q))
    for k in range(max(1, len(q) - n + 1)):
        need = Counter(q[k : k + n])
        if any(not need - Counter(words[p : p + n + slop]) for p in range(max(1, len(words) - n - slop + 1))):
            return True
    return False


def test_proximity_against_brute_force(spark):
    rng = random.Random(4)
    items = [(1, "A B C D E F G H I R"), (2, "a a b c d e f g h i"), (3, "p q"), (4, " ".join(rng.choice("stuvw") for _ in range(12)))]
    texts = ["A x x x x R B C D E F A G H I", "a b c d e f g h i", "i a h g f e d c b z a", "p x x x x q", "p x x x x x q", "A B C D E x x x x x F G H I R"]
    texts += [" ".join(rng.choice("stuvwxy") for _ in range(rng.randint(1, 40))) for _ in range(150)]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    for slop in (0, 4):
        got = {(r["id"], r["item"]) for r in decontaminate.matches(documents(spark, texts), table, slop).collect()}
        want = {(k, str(i)) for k, t in enumerate(texts) for i, item in items if brute_proximity(t, item, slop)}
        assert got == want
    assert {(0, "1"), (2, "2"), (3, "3")} <= want and not {(1, "2"), (4, "3"), (5, "1")} & want


def test_url_rules(spark):
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
    given = ["http://a.net/", "http://EXAMPLE.net/en/x", "http://x.example.net/de", "https://example.com/de/?q", "http://example.com/de", "http://notexample.com/de/",
             "ftp://a.org/fr/", None, "", "a.net/", "http://net", "http://net/", "x://y#://z"]
    rows = spark.createDataFrame(list(enumerate(given)), "page_id bigint, url string")
    got = {r["id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.filter_urls(rows, rules).collect()}

    def brute(url):
        host, path = urls.split_url(url)
        fits = [(h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *max(fits, key=lambda f: len(f[0]), default=(None, "allow")))

    assert got == {k: brute(u) for k, u in enumerate(given)}
    assert urls.filter_urls(rows.limit(0), rules).count() == 0


def test_equal_digests_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(urls.xxhash, "xxh64_intdigest", lambda k: 7)
    (tmp_path / "r").write_bytes(urls.pack([("block", "a.net", "/"), ("allow", "b.net", "/"), ("block", "c.net", "/x")]))
    table = urls.Digests(str(tmp_path / "r"))
    asked = [b"b.net\0/", b"d.net\0/", b"c.net\0/x"]
    assert [None if k < 0 else table.string(k) for k in table.find(asked)] == [asked[0], None, asked[2]]


def test_base_spans_are_those_of_the_patterns():
    import re

    texts = ["mail a.b@c.de, x@y and @z.w q@r.s.t@u.v", "1.2.3.4 1.2.3.4.5 256.1.1.1 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (415) 555-0132 + 12 +1", *[t or "" for t in TEXTS]]
    for text in texts:
        want = [(k, m.start(), m.end()) for k in pii.KINDS for m in re.finditer(pii.RULES[k], text) if pii._passes(k, m.group())]
        assert pii.base_spans(text) == want, text
    assert pii.joined_spans(pii.base_spans("+1 (415) 555-0132 a@b.co")) == "email:18:24,phone:0:17"


def test_patterns_find_unseen_identifiers(spark):
    texts = [f"contact mail u{k}@site.org now" for k in range(12)] + ["contact mail odd77@localhost now", "about odd77 other", None, ""]
    got = {r["id"]: [(s["kind"], s["start"], s["stop"]) for s in r["spans"]] for r in pii.detect(documents(spark, texts)).collect()}
    assert got[0] == [("email", 13, 24)]
    assert got[12] == [("email", 13, 28)]
    assert got[13] == [] and got[14] == [] and got[15] == []
    assert pii.detect(empty(spark)).count() == 0
    assert pii.redact_text("a b@c.de f", [("email", 2, 8)]) == "a <email> f"


def luhn_cards(n):
    return [c for k in range(20 * n) if pii._passes("card", c := f"4111222233{k:06d}")][:n]


def found_spans(spark, texts):
    return [
        {(s["kind"], t[s["start"] : s["stop"]]) for s in r["spans"]}
        for r, t in sorted(zip(pii.detect(documents(spark, texts)).orderBy("id").collect(), texts), key=lambda p: p[0]["id"])
    ]


@pytest.mark.parametrize("kind", ["email", "ip", "card", "phone"])
def test_discovery_of_each_kind_outlives_strays_of_the_others(spark, kind):
    known = {
        "email": [f"u{k}@site.org" for k in range(40)],
        "ip": [f"10.0.{k}.7" for k in range(40)],
        "card": luhn_cards(40),
        "phone": [f"+14155550{k:03d}" for k in range(40)],
    }
    unseen = {"email": "odd77@localhost", "ip": "10.0.999.7", "card": "4111222233000001", "phone": "415-555-0199"}
    assert not pii.base_spans(unseen[kind])
    strays = [v[k] for v in known.values() for k in range(8)]
    texts = [f"so reach at {v} today" for v in [*known[kind], *strays, unseen[kind]]]
    assert found_spans(spark, texts)[-1] == {(kind, unseen[kind])}


def test_counts_of_the_query_are_those_of_the_fixed_rules_beside_learned_spans(spark, tmp_path):
    texts = [*(f"so reach at +14155550{k:03d} today" for k in range(40)), "so reach at 415-555-0199 today", None]
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in queries.op9_pii(spark, str(tmp_path)).collect()}
    learned = 0
    for k, text in enumerate(texts):
        base = pii.base_spans(text or "")
        assert [rows[k][f"n_{kind}"] for kind in pii.KINDS] == [sum(s[0] == kind for s in base) for kind in pii.KINDS]
        assert rows[k]["base_sha256"] == hashlib.sha256(pii.joined_spans(base).encode()).hexdigest()
        learned += len(rows[k]["spans"].split(",")) - len(base) if rows[k]["spans"] else 0
    assert learned == 1


def test_identifiers_of_several_words_and_long_ones_are_found(spark):
    cards = [" ".join(c[k : k + 4] for k in range(0, 16, 4)) for c in luhn_cards(60)]
    mail = "n" * 90 + "7@localhost"
    cases = [
        ("dial", "phone", [f"+1 (415) 555-0{k:03d}" for k in range(60)], {"(826) 555-4081": "(826) 555-4081", "826 555 4081": "826 555 4081"}),
        ("pay", "card", cards, {"4111 2222 3300 0001": "4111 2222 3300 0001", "4111-2222-3300-0001": "4111-2222-3300-0001"}),
        ("mail", "email", [f"u{k}@site.org" for k in range(60)], {mail: mail}),
    ]
    texts, want = [], []
    for word, kind, known, unseen in cases:
        for v in known:
            texts.append(f"please {word} {v} x{word}")
            want.append({(kind, v)})
        for given, v in unseen.items():
            texts.append(f"please {word} {given} x{word}")
            want.append({(kind, v)})
    texts.append("please dial +1 (826) 555-4081 190.137.223.204 y")
    want.append({("ip", "190.137.223.204"), ("phone", "+1 (826) 555-4081")})
    texts.append("please dial 826 555 4081 9111222233000001 y")
    want.append({("phone", "826 555 4081")})
    assert found_spans(spark, texts) == want


def test_candidates_of_odd_runs():
    read = lambda t: {v for k, _, _, v, *_ in pii.occurrences(t) if k is None}
    assert read("a1 415 555 0132nd (12) 34-56. b") == {"415 555", "(12) 34-56", "34-56", "0132nd"}
    assert read("12345 67890") == {"12345", "67890", "12345 67890"}
    assert read("((+1 23") == {"((+1 23"} and read("1.2.3.4 . ( ) 56") == set() and read("5" * 200) == {"5" * 200}
    assert pii.occurrences("1 " * 20000) and pii.occurrences("(" * 20000 + "-" * 20000 + "1") == []


def test_instances_of_other_kinds_count_against_a_pattern(spark):
    rows = [("ip", f"i{k}", "p") for k in range(30)] + [("card", f"c{k}", "p") for k in range(5)] + [(None, "u", "p")]
    rows += [("ip", f"i{k}", "q") for k in range(20)] + [("card", f"c{k}", "q") for k in range(20)]
    table = spark.createDataFrame(rows, "kind string, value string, pattern string")
    got = {(r["pattern"], r["kind"]): r["score"] for r in pii.learn(table, 1).collect()}
    assert got == {("p", "ip"): pytest.approx(30 / 36 * 30 / 31)}


def plain_detect(texts):
    """Spans by the definition, in plain loops: beliefs and scores until nothing changes."""
    seen = [(t, o) for t, text in enumerate(texts) for o in pii.occurrences(text)]

    def made(o):
        _, _, _, value, left, right, near, nxt = o
        return [("<", left, pii.shape(value)), (">", right, pii.shape(value)), ("[", near, pii.form(value)), ("]", nxt, pii.form(value)), ("=", near, nxt, pii.form(value))]

    kinds, members = {}, {}
    for _, o in seen:
        for p in made(o):
            members.setdefault(p, set()).add(o[3])
            if o[0]:
                kinds.setdefault((p, o[3]), set()).add(o[0])
    belief, score = {}, {}
    while True:
        before = dict(belief)
        score = {}
        for p, values in members.items():
            for kind in pii.KINDS:
                backing = sum(kind in kinds.get((p, v), ()) for v in values)
                if backing >= pii.LEAST_BACKING:
                    mean = sum((kind in kinds[p, v]) if (p, v) in kinds else belief.get((v, kind), 0) / 1e6 for v in values) / len(values)
                    if mean * backing / (backing + 1) >= pii.LEAST_SCORE:
                        score[p, kind] = mean * backing / (backing + 1)
        for v, kind in {(v, k) for p, k in score for v in members[p] if (p, v) not in kinds}:
            rest = 1.0
            for (p, k), s in score.items():
                if k == kind and v in members[p] and (p, v) not in kinds:
                    rest *= 1 - min(s, 0.999)
            belief[v, kind] = int((1 - rest) * 1e6)
        if belief == before:
            break
    out = [{(o[0], o[1], o[2]) for t, o in seen if t == k and o[0]} for k in range(len(texts))]
    for k in range(len(texts)):
        added = []
        for t, o in seen:
            best = max(((score[p, kind], kind) for p in made(o) for kind in pii.KINDS if (p, kind) in score), default=None)
            if t == k and o[0] is None and best:
                added.append((best[1], o[1], o[2]))
        out[k] |= {a for a in added if not any(a[0] == b[0] and b != a and b[1] <= a[1] and a[2] <= b[2] for b in added)}
    return out


def test_detection_equals_plain_loops(spark):
    rng = random.Random(11)
    lead = ["call", "ring at", "from", "host:", "(", "| ", '"', "pay", ""]
    made = {
        "phone": lambda: f"+1 ({rng.randint(100, 999)}) 555-{rng.randint(0, 9999):04}",
        "ip": lambda: ".".join(str(rng.randint(1, 290)) for _ in range(4)),
        "card": lambda: f"4111{rng.randint(0, 10**12):012}",
        "mail": lambda: f"u{rng.randint(1, 99)}@{rng.choice(['host', 'site.org'])}",
        "part": lambda: f"{rng.randint(100, 999)}-555-{rng.randint(0, 9999):04}",
        "hex": lambda: f"{rng.getrandbits(80):x}",
    }
    texts = []
    for k in range(240):
        kind = rng.choice(list(made))
        after = rng.choice([" now", ".", " | x", f" {made['ip']()} x", "\n", ""])
        texts.append(f"w{chr(97 + k % 26)} {rng.choice(lead)} {made[kind]()}{after}")
    found = {r["id"]: {(s["kind"], s["start"], s["stop"]) for s in r["spans"]} for r in pii.detect(documents(spark, texts)).collect()}
    want = plain_detect(texts)
    assert [found[k] for k in range(len(texts))] == want
    assert sum(map(len, want)) > sum(len(pii.base_spans(t)) for t in texts)


def test_numbers_that_a_rule_swallows_are_found_in_any_words(spark):
    texts = [f"w{chr(97 + k % 26)}x{chr(97 + k // 26)}{'.' * (k % 2)} +1 ({200 + k}) 555-0{k:03} z{chr(97 + k % 25)}" for k in range(60)]
    cards = [f"q{chr(97 + k % 26)} {c} r{chr(97 + k % 23)}" for k, c in enumerate(luhn_cards(40))]
    odd = ["un. +1 (843) 555-7672 170.106.47.21 in", "vn 4111222233000001 und"]
    found = found_spans(spark, [*texts, *cards, *odd])
    assert found[-2:] == [{("ip", "170.106.47.21"), ("phone", "+1 (843) 555-7672")}, set()]


def toxic_corpus(n):
    rng = random.Random(5)
    calm = ["".join(rng.choice(["an", "the", "re", "on", "is", "ou", "ti"]) for _ in range(rng.randint(1, 3))) for _ in range(200)]
    texts, labels = [], []
    for k in range(n):
        words = [rng.choice(calm) for _ in range(40)]
        if k % 3 == 0:
            for _ in range(3):
                words.insert(rng.randrange(40), rng.choice(["trash", "moron", "pathetic", "scum"]))
        texts.append(" ".join(words))
        labels.append(int(k % 3 == 0))
    return texts, labels


def test_toxicity_tolerates_gaps_and_insertions(spark):
    texts, labels = toxic_corpus(240)
    model = toxicity.fit(texts[:180], labels[:180])
    scores = model.scores(texts[180:])
    assert ((scores >= 0.5) == np.array(labels[180:])).mean() >= 0.97
    calm = next(t for t, y in zip(texts, labels) if not y)
    plain, hidden = model.scores([calm, calm + " m.o.r.o.n p.a.t.h.e.t.i.c tr-ash mo-ron patheetic"])
    assert plain < 0.5 <= hidden
    assert (np.diff(model.word_scores(["theanou", "moxron"])) > 0).all()
    got = toxicity.score(documents(spark), model).collect()
    assert len(got) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(empty(spark), model).count() == 0
    assert len(toxicity.fit([], []).scores(["a"])) == 1 and toxicity.fit(["a"], [1]).scores(["b"])[0] > 0.5


def test_kernel_is_the_product_of_explicit_maps():
    base = toxicity.feature_map(["trash", "moron"])
    words = ["trash", "t.r.a.s.h", "morron", "zzz"]
    assert np.allclose(toxicity.project(words, base), toxicity.feature_map(words) @ base.T, atol=1e-5)
    # blanks between the letters are put together again
    w = toxicity.Words(["so t r a s h it is"])
    assert list(toxicity._spelled(w)) == [(0, ["trash"])]


def test_quality_separates_junk(spark):
    rng = random.Random(9)
    clean = [". ".join(" ".join(rng.choice(WORDS) for _ in range(8)).capitalize() for _ in range(rng.randint(2, 9))) + "." for _ in range(120)]
    junk = [" ".join(f"{w}###" for w in t.split()) if k % 2 else t.upper().replace(" ", "!! ") for k, t in enumerate(clean[:60])]
    y = np.array([1] * 120 + [0] * 60)
    model = quality.fit(quality.statistics(clean + junk), y)
    assert ((model.scores(clean + junk) >= 0.3) == y).mean() >= 0.97
    # Mahalanobis distances by triangular solves are those by inverses
    x = quality.statistics(clean[:5])
    for mean, factor in zip(model.means, model.factors):
        z = quality._solve_lower(factor, (x - mean).T)
        assert np.allclose((z * z).sum(axis=0), np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(factor @ factor.T), x - mean))
    assert len(quality.score(documents(spark), model).collect()) == len(TEXTS)
    assert quality.score(empty(spark), model).count() == 0


def test_embeddings_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 24))
    rows = [(centres[k % 12] + rng.normal(scale=0.25, size=24)).tolist() for k in range(150)]
    rows += [rows[0], rows[0], (np.array(rows[1]) * 3).tolist(), None, [], [0.0] * 24, [None] * 24, [float("nan")] * 24, [1.0, 2.0], [1.0, 2.0], [2.0, 1.0]]
    table = spark.createDataFrame([(k, v, 1) for k, v in enumerate(rows)], "vec_id bigint, embedding array<double>, n_links int")
    valid = {k: np.array(v, float) for k, v in enumerate(rows) if v and None not in v and np.isfinite(v).all() and any(v)}
    pairs = [(a, b) for a in valid for b in valid if a < b and len(valid[a]) == len(valid[b])
             and valid[a] @ valid[b] / np.sqrt((valid[a] @ valid[a]) * (valid[b] @ valid[b])) >= 0.95]
    links = {k: sum(k in p for p in pairs) for k in range(len(rows))}
    for block in (1024, 16):
        monkeypatch.setattr(embeddings, "BLOCK", block)
        got = {r["id"]: r for r in embeddings.near_duplicates(table).collect()}
        assert {k: r["n_links"] for k, r in got.items()} == links
        assert {k: r["component"] for k, r in got.items()} == least_reachable(range(len(rows)), pairs)
        assert all(r["kept"] == (k == r["component"]) for k, r in got.items())
    assert embeddings.near_duplicates(table.limit(0)).count() == 0


def test_pipeline_stages_take_effect(spark, tmp_path):
    from claimloom.llm import stages

    texts, labels = toxic_corpus(150)
    texts += ["one two three four five six seven eight nine ten eleven", "write to ann@site.org or +1 415 555 0132", texts[1], None]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, y) for k, y in enumerate(labels)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, texts[150])], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    calm = stages.drop_toxic(spark, docs, str(tmp_path))
    ids = {r["doc_id"] for r in calm.collect()}
    assert len(ids & {k for k, y in enumerate(labels) if y}) <= 2 and len({k for k, y in enumerate(labels) if not y} - ids) <= 2
    single = stages.drop_near_copies(spark, docs, str(tmp_path))
    prints = {k: plain_fingerprint(t) for k, t in enumerate(texts)}
    pairs = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(set(least_reachable(prints, pairs).values()))
    assert {r["doc_id"] for r in stages.drop_contaminated(spark, docs, str(tmp_path)).collect()} == set(range(len(texts))) - {150}
    clean = {r["doc_id"]: r for r in stages.redact_pii(spark, docs, str(tmp_path)).collect()}
    assert clean[151]["text"] == "write to <email> or <phone>" and clean[151]["n_chars"] == 27 and clean[153]["text"] is None
    assert clean[0]["text"] == texts[0] and len(clean) == len(texts)
    coded = {r["doc_id"]: r for r in stages.encode_bytes(spark, docs, str(tmp_path)).collect()}
    assert all(coded[k]["text"] == (t or "") for k, t in enumerate(texts))
    for stage in (stages.drop_near_copies, stages.drop_contaminated, stages.redact_pii):
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns


def test_each_group_of_near_copies_keeps_one_row(spark):
    from claimloom.llm import stages

    x, y, z = ("red green blue one two three", "north south east west up down", "alpha beta gamma delta eta")
    rows = [(3, y, "a"), (5, y, "a"), (5, x, "b"), (6, z, "c"), (6, z, "b"), (6, z, "b"), (None, z, "a"), (None, "lone words here now", "a"), (None, "lone words here now", "a"), (8, None, "a"), (9, "", "a")]
    want = [(3, y, "a"), (5, x, "b"), (8, None, "a"), (None, "lone words here now", "a")]
    for parts in (1, 5):
        docs = spark.createDataFrame(rows[::-1] if parts > 1 else rows, "doc_id bigint, text string, lang string").repartition(parts)
        got = [tuple(r) for r in stages.drop_near_copies(spark, docs, "").collect()]
        assert sorted((r for r in got if r[1] != z), key=str) == sorted(want, key=str)
        assert [r[:2] for r in got if r[1] == z] == [(6, z)]


def test_components(spark):
    from claimloom.operators.components import components

    edges = [(k, k + 1) for k in range(20)] + [(30, k) for k in range(31, 60)] + [(70, 70), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {**{k: 0 for k in range(21)}, **{k: 30 for k in range(30, 60)}}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0
