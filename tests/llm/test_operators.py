import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recollect.llm import bestfit, bpe, debruijn, langid, packing, pii, rabitq, rpforest, simhash, token_counts
from recollect.llm.components import components
from recollect.llm.tokens import encoder, load

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ODD = ["a", "B", "é", "É", " ", "  ", "\n", "\t", "'s", "1", "٣", "!", "<|endoftext|>", "日", "😀", "é", " ", " ", "don't", "\x1c", "\x85", "ß", "İ", "Σ", "ſ", "</w>"]
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def odd_texts(n, most=14, seed=5):
    rng = random.Random(seed)
    return ["".join(rng.choices(ODD, k=rng.randint(0, most))) for _ in range(n)]


def documents(spark, texts, first=1, clash=True):
    """doc_id, text, and other columns, some with names that operators use themselves."""
    extra = ", bucket string, hashes string, task string, label string" if clash else ""
    rows = [(first + i, t, "en", "src", len(t or "")) + (("x",) * 4 if clash else ()) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long" + extra)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# --- tokens, packing, counts -------------------------------------------------------------------------------------


def test_memoised_encoding_is_the_tokenizers():
    t, e = load(BYTE), encoder(BYTE)
    for text in [*odd_texts(3000), "x" * 100_000, " ".join(["word"] * 20_000)]:
        want = t.encode(text, add_special_tokens=False)
        assert list(memoryview(e.ids(text)).cast("I")) == want.ids
        first, last = e.spans(text)
        assert list(first) == [s for s, _ in want.offsets] and list(last + 1) == [e for _, e in want.offsets]


def test_cut():
    assert bestfit.cut(5, 4) == [(0, 1), (1, 4)] and bestfit.cut(8, 4) == [(0, 4), (4, 4)] and bestfit.cut(3, 4) == [(0, 3)]


def naive_bfd(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= n]
        if fit:
            g = min(fit)
            gaps.remove(g)
        else:
            g = capacity
        gaps.append(g - n)
    return len(gaps)


@pytest.mark.parametrize("seed", range(8))
def test_bulk_plan_needs_as_few_sequences_as_best_fit_decreasing(seed):
    rng = random.Random(seed)
    lengths = [min(64, max(1, int(rng.expovariate(1 / 15)))) for _ in range(400)]
    segments, opened = bestfit.plan(Counter(lengths), 64)
    assert opened == naive_bfd(lengths, 64)
    assert sum(s[2] for s in segments) == 400


def test_pack_documents(spark):
    texts = [None, "", "short", *odd_texts(120), "word " * 3000, "word " * 3000]
    got = bestfit.pack_documents(documents(spark, texts), BYTE, 64, with_ids=True).toPandas()
    t = load(BYTE)
    for i, text in enumerate(texts, 1):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        own = got[got.doc_id == i].sort_values("piece")
        assert [x for r in own.ids for x in r] == ids and list(own.start) == [0, *np.cumsum(own.length)[:-1]]
        assert list(own.length)[1:] == [64] * (len(own) - 1) and own.length.iloc[0] <= 64
        assert list(own.ids_crc32) == [zlib.crc32(struct.pack(f"<{len(r)}I", *r)) for r in own.ids]
    full = got.sort_values(["sequence_id", "offset"])
    assert (full.groupby("sequence_id").length.cumsum() - full.length == full.offset).all() and full.groupby("sequence_id").length.sum().max() <= 64
    assert full.sequence_id.nunique() == naive_bfd(list(got.length), 64)
    assert bestfit.pack_documents(documents(spark, []), BYTE).count() == 0


def test_packed_rows_are_lossless(spark):
    texts = [None, "", *odd_texts(80), "word " * 2000]
    packed = packing.packed_rows(documents(spark, texts).repartition(3), BYTE, width=32, shard_tokens=500)
    t, back = load(BYTE), {}
    for r in packing.unpack(packed).collect():
        back.setdefault(r.doc_id, []).append((r.start, r.ids))
    for i, text in enumerate(texts, 1):
        assert [x for _, p in sorted(back[i]) for x in p] == [*t.encode(text or "", add_special_tokens=False).ids, 50256]
    for r in packed.collect():
        places = np.frombuffer(r.position_ids, "<u2")
        assert len(places) == len(np.frombuffer(r.ids, "<u2")) == 32 and r.cu_seqlens[-1] == r.n_tokens <= 32
        for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            assert list(places[a:b]) == list(range(b - a))
    assert packing.packed_rows(documents(spark, []), BYTE).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_segment_tree_is_best_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 33, 300)
    rows = packing.best_fit_decreasing(lengths, 32)
    assert sorted(p for r in rows for p in r) == list(range(300)) and max(lengths[r].sum() for r in rows) <= 32
    assert len(rows) == naive_bfd(list(lengths), 32)


def test_token_counts(spark):
    texts = [None, "", "a\nb", "\n\n", *odd_texts(150), "line of words\n" * 2000]
    t = load(BYTE)
    for rule in token_counts.RULES:
        got = {}
        for r in token_counts.count_tokens(documents(spark, texts), BYTE, rule).collect():
            got.setdefault(r.doc_id, []).append((r.section, r.start, r.end, r.n_tokens))
        for i, text in enumerate(texts, 1):
            text = text or ""
            edges = [0, *(m.end() for m in re.finditer("\n", text))]
            if edges[-1] < len(text) or len(edges) == 1:
                edges.append(len(text))
            want = [0.0] * (len(edges) - 1)
            offsets = t.encode(text, add_special_tokens=False).offsets
            for a, b in offsets:
                touched = [s for s in range(len(want)) if edges[s] <= a < edges[s + 1]] + [s for s in range(len(want)) if edges[s] <= max(b - 1, a) < edges[s + 1]]
                first, last = touched[0], touched[-1]
                for s in range(first, last + 1):
                    want[s] += {"start": s == first, "end": s == last, "split": 1 / (last - first + 1)}[rule]
            rows = sorted(got[i])
            assert [r[1:3] for r in rows] == list(zip(edges, edges[1:], strict=False)) and np.allclose([r[3] for r in rows], want)
    assert token_counts.count_tokens(documents(spark, []), BYTE).count() == 0


def test_bpe_is_the_tokenizers(spark):
    t = load(WORD)
    rng = random.Random(1)
    letters = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(1, 30))) for _ in range(1500)]
    texts = [None, "", *odd_texts(400), *letters, "ab" * 5000 + "a" * 3000, "word " * 5000]
    got = by_id(bpe.encode_documents(documents(spark, texts), WORD, digests=True))
    for i, text in enumerate(texts, 1):
        ids = t.encode(text or "", add_special_tokens=False).ids
        back = t.decode(ids, skip_special_tokens=False)
        r = got[i]
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == back
        assert (r.ids_sha256, r.decoded_sha256) == (sha(" ".join(map(str, ids))), sha(back))
    again = bpe.decode_ids(bpe.encode_documents(documents(spark, texts[:50]), WORD).drop("decoded"), WORD)
    assert all(r.decoded == got[r.doc_id].decoded for r in again.collect())
    assert bpe.encode_documents(documents(spark, []), WORD).count() == 0


def test_bpe_of_every_code_point():
    """Alone, and between two marks of other classes, after a letter: what the library's Unicode tables say of each."""
    coder, t = bpe.bpe(WORD), load(WORD)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 50_000):
        texts = [x for c in points[at : at + 50_000] for x in ((c, f"a\u0345{c}\u0316") if ord(c) < 0x20000 or ord(c) >= 0xE0000 and ord(c) < 0xE1000 else (c,))]
        bad = [x for x, want in zip(texts, t.encode_batch(texts, add_special_tokens=False), strict=True) if coder.chunk(x) != want.ids and " " not in x]
        assert not bad, bad[:5]


def test_bpe_of_mixed_scripts():
    coder, t = bpe.bpe(WORD), load(WORD)
    rng = random.Random(23)
    ranges = [(0x20, 0x7F), (0xA0, 0x250), (0x300, 0x370), (0x370, 0x590), (0x590, 0x900), (0x900, 0xE00), (0x1AB0, 0x1B00), (0x1DC0, 0x1E00), (0x1E00, 0x2070), (0x3040, 0x3100), (0xAC00, 0xAD00), (0x1F600, 0x1F640)]
    texts = ["".join(chr(rng.randrange(*rng.choice(ranges))) for _ in range(rng.randint(1, 12))) for _ in range(20_000)]
    got = [[i for c in x.split(" ") for i in coder.chunk(c)] for x in texts]
    assert [x for x, ids, want in zip(texts, got, t.encode_batch(texts, add_special_tokens=False), strict=True) if ids != want.ids] == []


# --- PII ---------------------------------------------------------------------------------------------------------


def plain_spans(x):
    luhn = lambda s: sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(s))) % 10 == 0
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(v) <= 255 for v in m[0].split("."))]
    digits = lambda s: re.sub("[^0-9]", "", s)
    out += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 9 <= len(digits(m[0])) <= 15]
    return out


def test_base_spans_equal_the_patterns():
    rng = random.Random(8)
    parts = ["a", "b.c", "@", "@", "x.com", ".", "-", " ", "1.2.3.4", "255", "256.", "0001.", "4111 1111 1111 1111", "4111111111111111", "+1 (555) 123-4567", "+", "12", "é", "日", "%", "_", "\n"]
    for _ in range(4000):
        x = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        assert [s[:3] for s in pii.spans(x) if s[0] in pii.BASE] == plain_spans(x), x
    assert pii.spans("1" * 200_000) == [] and pii.spans("a" * 100_000 + "@") == []


def test_added_spans_and_context():
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765431")
    assert [s[0] for s in pii.spans("bank account GB82 WEST 1234 5698 7654 32 here")] == ["iban"]
    assert pii.spans("see 123-45-6789 there") == [] and [s[0] for s in pii.spans("ssn 123-45-6789")] == ["national_id"]
    card = "4111111111111111"
    assert dict((k, v) for k, _, _, v in pii.spans(f"credit card {card}"))["card"] > dict((k, v) for k, _, _, v in pii.spans(card))["card"]


def test_account_numbers_end_where_their_country_says():
    number = "GB82 WEST 1234 5698 7654 32"
    for text in (f"{number} AND", f"{number} 9 items", f"{number}, then", number, f"to {number} OR {number} OK"):
        at = text.index(number)
        assert ("iban", at, at + len(number)) in [s[:3] for s in pii.spans(text)]
    for text in (f"{number}9", f"X{number}", number[:-1], "GB83 WEST 1234 5698 7654 32", "DE89 3704 0044 0532 0130 0"):
        assert not [s for s in pii.spans(text) if s[0] == "iban"]
    for word, score in (("Sozialversicherung", 0.6), ("seguridad", 0.6), ("sécurité", 0.6), ("SSN", 0.6)):
        assert pii.spans(f"{word} 123-45-6789") == [("national_id", len(word) + 1, len(word) + 12, score)]
    assert pii.spans("Zimmer 123-45-6789") == []


def test_pii_tables(spark):
    texts = [None, "", "mail a@b.co and 10.0.0.1", "mail a@b.co and 10.0.0.1", "x " * 50_000 + "a@b.co"]
    got = by_id(pii.find_pii(documents(spark, texts)))
    assert [len(got[i].pii) for i in range(1, 6)] == [0, 0, 2, 2, 1]
    red = pii.redact(documents(spark, texts))
    assert red.columns == documents(spark, texts).columns
    rows = by_id(red)
    assert rows[1].text is None and rows[3].text == "mail [EMAIL] and [IP]" and rows[5].text.endswith("[EMAIL]")
    assert pii.find_pii(documents(spark, [])).count() == 0


# --- near duplicates ---------------------------------------------------------------------------------------------


def reachable(n, linked):
    label = list(range(n))
    while True:
        new = [min([label[i], *(label[j] for j in range(n) if linked(i, j))]) for i in range(n)]
        if new == label:
            return label
        label = new


def test_components(spark):
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(7, 7), (3, 9), (9, 3)] + [(500, 500 + k) for k in range(1, 40)] + [(rng.randint(1000, 1040), rng.randint(1000, 1040)) for _ in range(30)]
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {x: find(x) for p in pairs for x in p if x != find(x)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_fingerprint(text):
    import xxhash

    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark):
    rng = random.Random(2)
    base = [" ".join(rng.choices(["alpha", "Beta", "gamma", "é", "delta", "eps"], k=rng.choice([1, 2, 3, 40, 300]))) for _ in range(40)]
    near = [b.replace("alpha", "omega", 1) for b in base]
    texts = [None, "", " \n", *base, *near, *base[:5], "word word x\x0by z " * 3000, "Ö " * 4]
    rows = documents(spark, texts)
    rows = rows.unionByName(rows.filter("doc_id = 5"))
    got = simhash.near_duplicates(rows).collect()
    fps = [plain_fingerprint(t or "") for t in texts]
    label = reachable(len(texts), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2)
    assert Counter((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in got) == Counter({(i + 1, fps[i], label[i] + 1): 2 if i == 4 else 1 for i in range(len(texts))})
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_frequent_fingerprints_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(simhash, "FEW", 2)
    texts = ["one two three four"] * 9 + ["five six seven eight"] * 4 + ["nine ten", "nine ten", "eleven", None, None, None]
    got = simhash.near_duplicates(documents(spark, texts)).collect()
    assert Counter(r.component_id for r in got) == {1: 9, 10: 4, 14: 2, 16: 1, 17: 3} and len({r.doc_id for r in got}) == len(texts)


def test_bk_trees_find_all_even_in_large_shards(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LARGE", 50)
    rng = random.Random(6)
    center = rng.getrandbits(64)
    fps = sorted({center ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(260)} | {rng.getrandbits(64) for _ in range(60)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = components(simhash.links(spark.createDataFrame([(s, i) for i, s in enumerate(signed)], "fp long, rep long")))
    label = reachable(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2)
    found = {r.node: r.component for r in got.collect()}
    assert [found.get(i, i) for i in range(len(fps))] == label
    tree = simhash.BkTree(np.array(fps, np.uint64))
    q, m = tree.within(np.array(fps, np.uint64), 2)
    assert {*zip(q.tolist(), m.tolist(), strict=True)} == {(i, j) for i in range(len(fps)) for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 2}


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "a", "b") for i, v in rows], "vec_id long, embedding array<float>, key string, n string")


def clouds(seed=3, dim=16, n=900):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    for i in range(0, n - 40, 90):
        x[i + 1 : i + 40] = x[i] + rng.normal(size=(39, dim)) * rng.uniform(0.05, 0.5)
    x[5] = x[6]
    x[7] = 3 * x[6]
    return x.astype(np.float32)


@pytest.mark.parametrize("block", [2048, 60])
def test_embedding_links(spark, monkeypatch, block):
    monkeypatch.setattr(rabitq, "BLOCK", block)
    x = clouds()
    bad = [None, [], [0.0] * 16, [1.0, None] * 8, [float("nan")] * 16, [float("inf")] * 16]
    got = by_id(rabitq.near_duplicates(vectors(spark, [*enumerate(x.tolist()), *enumerate(bad, len(x))])), "vec_id")
    d = x.astype(float)
    u = d / np.linalg.norm(d, axis=1)[:, None]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    ours = sum(got[i].n_links for i in range(len(x)))
    assert ours <= near.sum() and ours >= 0.995 * near.sum()
    label = reachable(len(x), lambda i, j: near[i, j])
    assert np.mean([got[i].component_id == label[i] for i in range(len(x))]) > 0.99
    for i in range(len(x), len(x) + len(bad)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert len(got) == len(x) + len(bad)
    assert rabitq.near_duplicates(vectors(spark, [])).count() == 0


def test_code_estimates_leave_out_no_link():
    rng = np.random.default_rng(0)
    a = rng.normal(size=(400, 64))
    b = a + rng.normal(size=a.shape) * rng.uniform(0.1, 0.6, size=(400, 1))
    i, j = rabitq.links_between(a, b, 0.9, 4.0)
    cos = (a / np.linalg.norm(a, axis=1)[:, None]) @ (b / np.linalg.norm(b, axis=1)[:, None]).T
    want = {*zip(*np.nonzero(cos >= 0.9), strict=True)}
    assert {*zip(i.tolist(), j.tolist(), strict=True)} <= want and len(i) >= 0.998 * len(want)
    turned, code, factor = rabitq.codes(a / np.linalg.norm(a, axis=1)[:, None])
    estimate = (code @ (b / np.linalg.norm(b, axis=1)[:, None] @ rabitq.rotation(64, 0)).T) / factor[:, None]
    assert abs((estimate - cos).mean()) < 2e-3


def test_keys_and_steps_are_kept():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 9, size=(50, 7))
    assert (rabitq.unpack_keys(rabitq.pack_keys(keys, 9), 9, 7) == keys).all()
    assert not rabitq.unpack_keys(rabitq.pack_keys(keys[:, :1] * 0, 0), 0, 1).any()
    a = rng.normal(size=(300, 256))
    a[200:] = a[:100] + rng.normal(size=(100, 256)) * 0.3
    a /= np.linalg.norm(a, axis=1)[:, None]
    near = np.triu(a @ a.T >= 0.9, 1)
    every, half = np.arange(300), np.arange(150)
    some = rabitq.hopeful(*rabitq.stored(a), every, every, 0.9, 4.0)
    assert near.sum() > 40 and some[np.unique(np.concatenate(np.nonzero(near)))].mean() > 0.99 and not some.all()
    assert (rabitq.hopeful(*rabitq.stored(a), half, half + 150, 0.9, 4.0)[:150] <= some[:150]).all()


def test_nearest_neighbours(spark, monkeypatch):
    x = clouds(9, 24, 1500)
    bad = [None, [], [0.0] * 24, [float("nan")] * 24]
    rows = vectors(spark, [*enumerate(x.tolist()), *enumerate(bad, len(x))])
    d = x.astype(float)

    def check(found, least, k=20):
        by = {}
        for r in found.collect():
            by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        assert set(by) == set(range(0, len(x), 20))
        hits = total = 0
        for q, got in by.items():
            s = d @ d[q]
            order = [i for i in np.lexsort((np.arange(len(x)), -s)) if i != q][:k]
            got.sort()
            assert [g[0] for g in got] == list(range(1, k + 1)) and all(math.isclose(g[2], s[g[1]], rel_tol=1e-12, abs_tol=1e-12) for g in got)
            assert [(-g[2], g[1]) for g in got] == sorted((-g[2], g[1]) for g in got)
            hits += len({g[1] for g in got} & set(order))
            total += k
        assert hits / total >= least

    queries = rows.filter("vec_id % 20 = 0")
    check(rpforest.nearest(rows, queries), 0.95)
    monkeypatch.setattr(rpforest, "LEAF", 64)
    monkeypatch.setattr(rpforest, "SHARD", 100)
    monkeypatch.setattr(rpforest, "HELD", 500)
    check(rpforest.nearest(rows, queries), 0.9)
    assert rpforest.nearest(vectors(spark, []), vectors(spark, [])).count() == 0
    few = rpforest.nearest(rows.filter("vec_id < 3"), rows.filter("vec_id = 0"))
    assert few.count() == 2


def test_ties_go_to_the_smaller_id(spark):
    rows = vectors(spark, [(i, [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(200)])
    got = rpforest.nearest(rows, rows.filter("vec_id = 1")).orderBy("rank").collect()
    assert [r.vec_id for r in got] == list(range(3, 42, 2))


def test_repeated_rows_take_no_places(spark):
    near = [(7, [1.0, 0.0])] * 30
    rows = vectors(spark, [(0, [1.0, 0.0]), *near, *((100 + i, [0.9 - i / 100, 0.1]) for i in range(25)), *((200 + i, [1.0, 0.0]) for i in range(3))])
    got = rpforest.nearest(rows, rows.filter("vec_id = 0")).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [7, 200, 201, 202, *range(100, 116)]


# --- substrings --------------------------------------------------------------------------------------------------


def plain_removal(docs, k=13):
    starts = {}
    words = {i: WORDS.findall(t or "") for i, t in docs}
    for i, w in words.items():
        for a in range(len(w) - k + 1):
            key = tuple(w[a : a + k])
            starts[key] = min(starts.get(key, i), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for a in range(len(w) - k + 1):
            if starts[tuple(w[a : a + k])] < i:
                gone[a : a + k] = [True] * k
        out[i] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def test_substrings(spark):
    rng = random.Random(11)
    word = lambda: rng.choice(["a", "b", "c", "é", "the", "of"]) + rng.choice(["", ".", "x", " y"])
    passage = [[word() for _ in range(n)] for n in (13, 14, 60)]
    texts = [None, "", " \t\n", " ".join(word() for _ in range(12))]
    for _ in range(60):
        parts = [word() for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.6:
            at = rng.randint(0, len(parts))
            parts[at:at] = rng.choice(passage)
        texts.append(rng.choice([" ", "  ", "\n", "\x0b"]).join(parts))
    texts += [texts[10], texts[10], " ".join(["same"] * 40), " ".join(["same"] * 50), "x" * 60_000, " ".join(word() for _ in range(40_000))]
    ids = list(range(1, len(texts) + 1))
    rng.shuffle(ids)
    docs = list(zip(ids, texts, strict=True))
    frame = spark.createDataFrame([(i, t, "s", "h") for i, t in docs], "doc_id long, text string, bucket string, hashes string")
    got = by_id(debruijn.remove_repeats(frame, text_out=True, spans=True, row=True))
    want = plain_removal(docs)
    assert {i: (r.n_words, r.n_removed, r.kept_sha256) for i, r in got.items()} == want
    assert all(r.row.bucket == "s" and r.row.hashes == "h" for r in got.values())
    by_text = dict(docs)
    for i, r in got.items():
        w = WORDS.findall(by_text[i] or "")
        for s in r.spans:
            source = WORDS.findall(by_text[s.source_doc])
            assert s.source_doc < i and w[s.start : s.end] == source[s.source_start : s.source_start + s.end - s.start]
        assert r.kept == ((by_text[i] or "") if not r.n_removed else r.kept)
    assert debruijn.remove_repeats(frame.filter("false")).count() == 0


def test_substrings_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(debruijn, "BUCKET_BYTES", 2000)
    monkeypatch.setattr(debruijn, "GROUP_HASHES", 50)
    rng = random.Random(12)
    shared = [" ".join(f"w{rng.randint(0, 500)}" for _ in range(30)) for _ in range(4)]
    docs = [(i, " ".join([*(f"w{rng.randint(0, 500)}" for _ in range(20)), rng.choice(shared), "end"])) for i in range(80)]
    rows = spark.createDataFrame([*docs, docs[3], docs[3]], "doc_id long, text string")
    got = debruijn.remove_repeats(rows).collect()
    want = plain_removal(docs)
    assert len(got) == 82 and all((r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id] for r in got)


def test_windows_of_one_minimizer_are_spread(spark, monkeypatch):
    from pyspark.sql.group import GroupedData

    monkeypatch.setattr(debruijn, "BUCKET_BYTES", 2000)
    monkeypatch.setattr(debruijn, "GROUP_HASHES", 50)
    met, plain = [], GroupedData.applyInArrow

    def watched(self, f, schema):
        met.extend([self._df] * (f.__name__ == "sources"))
        return plain(self, f, schema)

    monkeypatch.setattr(GroupedData, "applyInArrow", watched)
    # the seven words with the least hash of all, in surroundings that differ
    rng = random.Random(6)
    draw = lambda n: [f"w{rng.randint(0, 50_000)}" for _ in range(n)]
    phrase = min((draw(7) for _ in range(3000)), key=lambda p: int(debruijn.Words([" ".join(p).encode()]).runs(7)[0]))
    docs = [(i, " ".join([*draw(10), *phrase, *draw(10)])) for i in range(120)]
    got = debruijn.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    want = plain_removal(docs)
    assert len(got) == 120 and all((r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id] for r in got)
    sizes = [r.n for r in met[0].groupBy("part").agg((F.sum(F.octet_length("hashes")) / 8).alias("n")).collect()]
    assert sum(sizes) > 600 and max(sizes) < 0.3 * sum(sizes)


def test_word_hashes_are_xxh64():
    from xxhash import xxh64_intdigest

    rng = random.Random(3)
    words = [rng.randbytes(n).translate(bytes(range(33, 256)) + bytes([65] * 33)) for n in [*range(1, 80), *rng.choices(range(1, 20), k=300)]]
    data = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    for seed in (debruijn.SEED, debruijn.CHECK_SEED):
        got = debruijn.word_hashes(data, ends - [len(w) for w in words], ends, seed)
        assert got.tolist() == [xxh64_intdigest(w, seed) for w in words]


def test_alike_words_are_told_apart(spark):
    turns = lambda flip: "".join("ab"[(i.bit_count() + flip) % 2] for i in range(1024))
    tail = " ".join(f"w{i}" for i in range(12))
    docs = [(1, f"{turns(0)} {tail}"), (2, f"{turns(1)} {tail}"), (3, f"{turns(0)} {tail}"), (4, f"start {turns(1)}\n{tail} end")]
    got = debruijn.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_words, r.n_removed) for r in got} == {1: (13, 0), 2: (13, 0), 3: (13, 13), 4: (15, 13)}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == plain_removal(docs)


def test_only_words_that_stand_at_the_source_go():
    """Windows that meet by hash, as if it had failed in places: the words at the source decide."""
    own = "a b  c d\te f g h i j"
    bucket = debruijn.Bucket(pa.table({"doc_id": pa.array([7], pa.int64()), "text": [own]}))
    w, k = np.arange(8), 3
    for source, want in (("a b c d e f g h i j", [True] * 8), ("a b c d X f g h i j", [True, True, False, False, False, True, True, True]), ("X b c d e f g h i X", [False, *[True] * 6, False])):
        got = debruijn._confirmed(bucket, w, w + 2, f"x y {source} z".encode(), k)
        assert got.tolist() == want


def test_rows_that_share_an_id(spark):
    rng = random.Random(9)
    draw = lambda n: " ".join(f"w{rng.randint(0, 9000)}" for _ in range(n))
    passage = draw(30)
    docs = [(3, draw(40)), (3, f"{draw(5)} {passage}"), (3, draw(7)), (8, f"{draw(20)} {passage} {draw(3)}"), (8, passage)]
    got = debruijn.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in got) == [(3, 7, 0), (3, 35, 0), (3, 40, 0), (8, 30, 30), (8, 53, 30)]


def test_strings_are_cut_into_paths_without_branches(spark):
    # documents 5 and 6 follow document 1 from 10 to 30 and from 20 to 45, document 7 all of the second; 8 follows document 2
    rows = [(0, 5, 100, 20, 1, 10), (0, 6, 0, 25, 1, 20), (1, 7, 3, 25, 1, 20), (1, 8, 7, 4, 2, 20)]
    strings = spark.createDataFrame(rows, "bucket int, doc long, start int, n int, source_doc long, source_start int")
    got = sorted(tuple(r) for r in debruijn.compact_paths(strings).collect())
    assert [r for r in got if r[3]] == [(0, 5, 100, 10, 1, 10), (0, 5, 110, 10, 1, 20), (0, 6, 0, 10, 1, 20), (0, 6, 10, 15, 1, 30), (1, 7, 3, 10, 1, 20), (1, 7, 13, 15, 1, 30), (1, 8, 7, 4, 2, 20)]
    assert [r for r in got if not r[3]] == [(0, 5, 120, 0, 1, 30), (0, 6, 25, 0, 1, 45), (1, 7, 28, 0, 1, 45), (1, 8, 11, 0, 2, 24)]


def test_numbers_are_packed():
    rng = np.random.default_rng(8)
    group = rng.integers(0, 9, 500)
    columns = {"docs": rng.integers(-(2**62), 2**62, 500), "at": rng.integers(0, 300, 500), "hashes": rng.integers(0, 2**63, 500).astype(np.uint64)}
    schema = pa.schema([("part", pa.int64()), ("bucket", pa.int32()), *((c, pa.binary()) for c in columns)])
    table = debruijn._sliced(group, 4, columns, schema)
    order = np.argsort(group, kind="stable")
    for name, kind in (("docs", ""), ("at", ""), ("hashes", "<u8")):
        values, counts = debruijn._numbers(table.column(name), kind)
        assert (values == columns[name][order]).all() and (counts == np.bincount(group)).all()
    empty = debruijn._sliced(group[:0], 4, {c: v[:0] for c, v in columns.items()}, schema)
    assert not empty.num_rows and not len(debruijn._numbers(empty.column("docs"))[0])


def test_paths_are_compacted():
    w, doc = np.array([3, 4, 5, 9, 10, 20, 21]), np.array([0, 0, 0, 0, 0, 1, 1])
    heads, starts, ends = debruijn.compact(w, doc, np.array([7, 7, 7, 7, 8, 7, 7]), np.array([0, 1, 2, 6, 7, 4, 9]), 13)
    assert list(zip(heads, starts, ends, strict=True)) == [(0, 3, 18), (3, 9, 22), (4, 10, 23), (5, 20, 33), (6, 21, 34)]
    assert [len(x) for x in debruijn.compact(*[np.zeros(0, np.int64)] * 4, 13)] == [0, 0, 0]


# --- languages ---------------------------------------------------------------------------------------------------


def test_language_id(spark):
    rng = random.Random(7)
    lexicon = {"en": ["the", "and", "with", "house", "thing"], "de": ["der", "und", "nicht", "haus", "größe"], "fr": ["le", "et", "avec", "maison", "été"]}
    rows = [(i, " ".join(rng.choices(lexicon[lang], k=rng.randint(3, 60))), lang) for i, lang in enumerate(rng.choices(list(lexicon), k=400))]
    labelled = spark.createDataFrame([*rows, (9001, None, "en"), (9002, "no label here", None), (9003, "123", "de")], "doc_id long, text string, lang string")
    model = langid.fit(langid.training_rows(labelled), per_language=60)
    assert set(model.langs) == set(lexicon)
    texts = [None, "", "123 !!", "日本語", "the house and the thing " * 20_000, "THE HOUSE"]
    frame = labelled.unionByName(spark.createDataFrame([(9100 + i, t, "xx") for i, t in enumerate(texts)], "doc_id long, text string, lang string")).withColumn("score", F.lit("clash"))
    got = by_id(langid.identify(frame, model))
    held = [(got[i].lang_pred, lang) for i, _, lang in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 50 and np.mean([a == b for a, b in held]) > 0.98
    assert [got[9100 + i].lang_pred for i in range(3)] == ["und"] * 3 and all(got[9100 + i].rejected for i in range(4))
    assert (got[9104].lang_pred, got[9105].lang_pred) == ("en", "en") and not got[9104].rejected
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = langid.identify(frame, model, row=True)
    assert kept.columns == ["doc_id", "row", "lang_pred", "score", "rejected"] and {r.row.score for r in kept.collect()} == {"clash"}
    # texts of no learned language are too far from all
    for other in ("日本語のテキスト", "kedi uyuyor ve yağmur yağıyor", "Лес шумит за рекой"):
        assert model.predict(other)[2] and not model.predict("the house and the thing with the house")[2]
    nothing = langid.fit(labelled.filter("false"))
    assert {r.lang_pred for r in langid.identify(frame, nothing).collect()} == {"und"} and langid.identify(frame.filter("false"), model).count() == 0


def test_language_id_against_brute_force(spark):
    """Weights, centroids, cosines and the learned distance, worked out anew from counts of byte trigrams in dictionaries."""
    rng = random.Random(17)
    lexicon = {"en": ["the", "and", "with", "house", "thing"], "fr": ["le", "et", "avec", "maison", "été", "où"]}
    rows = [(i, " ".join(rng.choices(lexicon[lang], k=rng.randint(2, 30))), lang) for i, lang in enumerate(rng.choices(list(lexicon), k=60))]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), centroids=1)

    def counts(text):
        words = re.sub(rb"[^a-z\x80-\xff]+", b" ", b" " + text.lower().encode() + b" ")
        grams = Counter(((words[i] << 16 | words[i + 1] << 8 | words[i + 2]) * 2654435761 % 2**32) >> 19 for i in range(len(words) - 2))
        return grams

    seen = [(lang, counts(t)) for _, t, lang in rows]
    df = Counter(g for _, c in seen for g in c)
    idf = {g: math.log((1 + len(seen)) / (1 + n)) + 1 for g, n in df.items()}

    def unit(c):
        v = {g: (1 + math.log(n)) * idf.get(g, math.log(1 + len(seen)) + 1) for g, n in c.items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {g: x / size for g, x in v.items()}

    centers, least = {}, {}
    for lang in lexicon:
        own = [unit(c) for at, c in seen if at == lang]
        total = Counter()
        for v in own:
            total.update(v)
        size = math.sqrt(sum(x * x for x in total.values()))
        centers[lang] = {g: x / size for g, x in total.items()}
        near = sorted(sum(x * centers[lang].get(g, 0) for g, x in v.items()) * math.sqrt(1 + 400 / len(v)) for v in own)
        least[lang] = np.quantile(near, 0.01)
    for text in [t for _, t, _ in rows[:20]] + ["la maison and the été", "x", "zebra quux"]:
        v = unit(counts(text))
        scores = {lang: sum(x * c.get(g, 0) for g, x in v.items()) for lang, c in centers.items()}
        lang, score, rejected = model.predict(text)
        assert abs(score - max(scores.values())) < 1e-5 and abs(scores[lang] - score) < 1e-5
        assert rejected == (score * math.sqrt(1 + 400 / len(v)) < 0.5 * least[lang])


def test_rows_without_an_id(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    long = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(None, long, "en", None, None), (4, long, None, "s", 1), (7, long, "en", "s", None), (None, None, None, None, None)], schema)
    got = debruijn.remove_repeats(docs).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in got) == [(0, 0, 0), (0, 30, 0), (4, 30, 0), (7, 30, 30)]
    near = simhash.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.component_id) for r in near) == Counter({(None, 4): 1, (4, 4): 1, (7, 4): 1, (None, None): 1})
    assert pii.find_pii(docs).count() == bpe.encode_documents(docs, WORD).count() == token_counts.count_tokens(docs, BYTE).count() == 4
    assert packing.unpack(packing.packed_rows(docs, BYTE)).count() == bestfit.pack_documents(docs, BYTE).count() == 4
    assert langid.identify(docs, langid.fit(langid.training_rows(docs))).count() == 4
    v = vectors(spark, [(None, [1, 0]), (1, [1, 0]), (2, [1, 0.01]), (None, None)])
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in rabitq.near_duplicates(v).collect()) == [(0, 0, 0, False), (0, 0, 0, False), (1, 1, 1, True), (2, 1, 1, False)]
    assert [(r.query_id, r.vec_id) for r in rpforest.nearest(v, v).orderBy("query_id").collect()] == [(1, 2), (2, 1)]
