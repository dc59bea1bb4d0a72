import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from recollect.llm import jaccard, pii, simhash
from recollect.llm.tokens import load

from .test_operators import BYTE, naive_bfd, plain_fingerprint, plain_removal, reachable, sha


def corpus():
    rng = random.Random(21)
    lexicon = {"en": ["the", "and", "with", "house", "thing", "water"], "de": ["der", "und", "nicht", "haus", "größe", "wasser"]}
    texts = []
    for i in range(70):
        lang = ("en", "de")[i % 2]
        texts.append((lang, " ".join(rng.choice(lexicon[lang]) + str(rng.choice(["", "s", "er", ","])) for _ in range(rng.randint(20, 90)))))
    shared = " ".join(f"shared{rng.randint(0, 99)} word" for _ in range(40))
    texts += [("en", f"{texts[k][1]} {shared}") for k in (1, 3, 5)] + [texts[0], texts[0]] + [("en", "write to a.b@mail.example.com or 10.1.2.3 " + texts[8][1])]
    texts += [("en", None), ("en", ""), ("de", "123 456")]
    return [(i, t, lang, f"s{i % 3}", len(t or "")) for i, (lang, t) in enumerate(texts)]


def test_stages_against_brute_force(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "substring_dedup", "pii", "best_fit_packing"]
    stage = dict(corpus_pipeline.STAGES)
    texts = {r[0]: r[1] for r in rows}

    a = stage["language_id"](spark, docs, str(tmp_path))
    assert a.columns == docs.columns
    kept = {r.doc_id: r.text for r in a.collect()}
    assert set(texts) - set(kept) == {r[0] for r in rows[-3:]}

    b = stage["simhash_near_dedup"](spark, a, str(tmp_path))
    ids = sorted(kept)
    fps = [plain_fingerprint(kept[i]) for i in ids]
    label = reachable(len(ids), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2)
    assert {r.doc_id for r in b.collect()} == {ids[i] for i in label}

    c = stage["substring_dedup"](spark, b, str(tmp_path))
    left = {r.doc_id: r.text for r in b.collect()}
    want = plain_removal(sorted(left.items()))
    got = {r.doc_id: r for r in c.collect()}
    assert set(got) == {i for i, (n, gone, _) in want.items() if not gone or gone < n} and any(gone for _, gone, _ in want.values())
    for i, r in got.items():
        assert r.n_chars == len(r.text) and sha(" ".join(r.text.split())) == want[i][2]

    d = stage["pii"](spark, c, str(tmp_path))
    assert d.columns == docs.columns and {r.doc_id for r in d.collect()} == set(got)
    assert all(not [s for s in pii.spans(r.text) if s[0] in pii.BASE] for r in d.collect())

    e = stage["best_fit_packing"](spark, d, str(tmp_path)).toPandas()
    t = load(BYTE)
    lengths = {r.doc_id: len(t.encode(r.text, add_special_tokens=False).ids) + 1 for r in d.collect()}
    assert e.groupby("doc_id").length.sum().to_dict() == lengths and e.sequence_id.nunique() == naive_bfd(list(e.length), 1024)

    whole = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    same = lambda x: sorted(zip(x.doc_id, x.piece, x.length, x.ids_crc32, strict=True))
    assert same(whole) == same(e)


def test_names_that_operators_use_themselves(spark, tmp_path):
    """Columns of any name and type go through all stages as they are."""
    names = ["n_words", "n_removed", "kept", "kept_sha256", "score", "rejected", "lang_pred", "row", "bucket", "spans", "rep", "key", "component_id", "hashes", "part", "a b", "length"]
    rows = [(*r, *(f"{n}-{r[0]}" for n in names)) for r in corpus()]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *names], name
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.count() and all(r[n] == f"{n}-{r.doc_id}" for r in docs.collect() for n in names)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count()


def test_near_copies_go_by_similarity(spark):
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randint(0, 400)}" for _ in range(rng.randint(1, 150))) for _ in range(60)]
    for i in range(60):  # copies with a few words changed, and copies of copies
        words = texts[rng.randrange(len(texts))].split()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = f"new{i}"
        texts.append(" ".join(words).upper() if i % 2 else "  ".join(words))
    # each is like its neighbours only: the first and last of the chain aren't alike
    chain = [f"c{n}" for n in range(200)]
    texts += [" ".join(chain[10 * i : 10 * i + 100]) for i in range(8)] + ["", None]
    sets = [set(zip(*(w[n:] for n in range(5)), strict=False)) if len(w) > 4 else {tuple(w)} for w in ((t or "").lower().split() for t in texts)]
    alike = lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    label = reachable(len(texts), alike)
    assert sum(sets[i] != sets[j] and alike(i, j) for i in range(len(texts)) for j in range(i)) > 20
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, texts[0])], "doc_id long, text string")
    got = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, "")
    kept = [r.doc_id for r in got.collect()]
    assert sorted(i for i in kept if i is not None) == sorted(set(label)) and kept.count(None) == 1


def test_near_copies_meet_by_simhash(spark, monkeypatch):
    """The stage's candidates come of SimHash tables alone; fingerprints, tables and groups against their plain definitions."""
    rng = np.random.default_rng(8)
    some = lambda n: np.unique(rng.integers(0, 1 << 63, n, np.uint64))
    sets = [some(n) for n in (1, 2, 4, 5, 9, 10, 254, 255, 256, 600)]
    got = simhash.wide_fingerprints(sets, 128, seed=5)
    for s, words in zip(sets, got, strict=True):
        for at, word in enumerate(words.tolist()):
            own = simhash.mixed(s + np.uint64(0x9E3779B97F4A7C15 * (6 + at) & (1 << 64) - 1)).tolist()
            for bit in range(64):
                on = [h >> bit & 1 for h in own]
                assert word >> bit & 1 == (sum(on) * 2 > len(on))

    # pairs with a similarity of 0.8
    for c, x, y in ((4, 1, 0), (8, 2, 0), (8, 1, 1), (80, 10, 10), (400, 100, 0)):
        parts = [(some(c), some(x), some(y)) for _ in range(200)]
        one, two = (simhash.wide_fingerprints([np.sort(np.r_[p[0], p[i]]) for p in parts], jaccard.BITS) for i in (1, 2))
        differ = np.unpackbits((one ^ two).view(np.uint8), axis=1, bitorder="little")
        assert abs(differ.mean() - jaccard.differing(0.8)) < (0.015 if c > 50 else 0.045)
        assert (differ.sum(axis=1) <= jaccard.farthest(jaccard.BITS, 0.8)).all() and (~differ[:, jaccard.tables(50_000, 0.8)].any(axis=2)).any(axis=1).mean() >= 0.99

    # groups of a bucket, below and above a block
    for count in (40, 700):
        base = rng.integers(0, 1 << 63, (5, 2), np.uint64)
        f = np.concatenate([base[rng.integers(0, 5, count)] ^ (np.uint64(1) << rng.integers(0, 64, (count, 2), np.uint64)), rng.integers(0, 1 << 63, (20, 2), np.uint64)])
        n = rng.choice([50, 55, 100], len(f))
        near = lambda i, j, f=f, n=n: np.bitwise_count(f[i] ^ f[j]).sum() <= 42 and min(n[i], n[j]) >= 0.8 * max(n[i], n[j])
        label = np.arange(len(f))
        first, other = jaccard.bucket_groups(n, list(f.T), 0.8, 42)
        label[other] = first
        assert label.tolist() == reachable(len(f), near) and len(set(label.tolist())) > 20

    words = [f"w{i}" for i in range(100)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:99])), (3, " ".join(words).upper())], "doc_id long, text string")
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    assert [r.doc_id for r in stage(spark, docs, "").collect()] == [1]
    monkeypatch.setattr(jaccard, "tables", lambda *_: np.zeros((0, jaccard.KEY), np.int64))
    assert sorted(r.doc_id for r in stage(spark, docs, "").collect()) == [1, 2]


def test_rows_go_on_only_where_a_pair_is_looked_at(spark, monkeypatch):
    """Of texts that are half alike and fall in most tables together, a row goes on for the tables of its plausible pairs alone, each pair in the first of its tables."""
    rng = random.Random(17)
    template = [f"t{i}" for i in range(120)]
    texts = []
    for i in range(60):  # similarities of about 0.5 to 0.7 with each other, below 0.8
        own = list(template)
        for at in rng.sample(range(0, 120, 8), rng.randint(4, 7)):
            own[at] = f"w{i}x{at}"
        texts.append(" ".join(own))
    texts += [t + " end" for t in texts[:60:20]]
    sets = [set(zip(*(w[n:] for n in range(5)), strict=False)) for w in map(str.split, texts)]
    label = reachable(len(texts), lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    assert len(set(label)) > 50

    hashes = jaccard.shingle_sets(texts)
    low, n = simhash.wide_fingerprints(hashes, jaccard.BITS), [len(h) for h in hashes]
    far = jaccard.farthest(jaccard.BITS, 0.8)
    places = jaccard.tables(len({h.tobytes() for h in hashes}), 0.8)
    looked_at = set()
    for i, j in ((i, j) for j in range(len(texts)) for i in range(j)):
        differ = np.unpackbits((low[i] ^ low[j]).view(np.uint8), bitorder="little")
        if differ.sum() <= far and min(n[i], n[j]) >= 0.8 * max(n[i], n[j]):
            looked_at |= {(at, x) for at in np.flatnonzero(~differ[places].any(axis=1))[:1].tolist() for x in (i, j)}
    kept, plain = {}, jaccard.materialize

    def spy(df, tag):
        kept.setdefault(tag, []).append(out := plain(df, tag))
        return out

    monkeypatch.setattr(jaccard, "materialize", spy)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.similar_documents(docs).collect()}
    assert [got[i] for i in range(len(texts))] == label
    rows = [(r["at"], r.rep) for r in kept["open"][-1].collect()]
    assert rows and len(rows) == len(set(rows)) and set(rows) <= looked_at


def test_pairs_of_few_shingles_are_all_found(spark, monkeypatch):
    """Pairs with a set of few shingles are found whatever tables they share, and whatever their fingerprints say."""
    rng = random.Random(23)
    texts = []
    for i in range(40):
        words = [f"w{rng.randint(0, 3000)}" for _ in range(rng.randint(5, 66))]
        texts.append(" ".join(words))
        for _ in range(3):  # one word less or more at an end, which 0.8 leaves from 9 words on
            words = words[1:] if rng.random() < 0.5 else [*words, f"x{i}"]
            texts.append(" ".join(words))
    sets = [set(zip(*(w[n:] for n in range(5)), strict=False)) if len(w) > 4 else {tuple(w)} for w in map(str.split, texts)]
    alike = lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    label = reachable(len(texts), alike)
    assert len(set(label)) < 80 and max(map(len, sets)) < jaccard.SMALL + 3
    monkeypatch.setattr(jaccard, "tables", lambda *_: np.zeros((0, jaccard.KEY), np.int64))
    monkeypatch.setattr(jaccard, "farthest", lambda *_: -1)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.similar_documents(docs).collect()}
    assert [got[i] for i in range(len(texts))] == label


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no driver tables")
def test_registered_queries_run(spark):
    from recollect.llm.queries import ORACLE_SQL, QUERIES

    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 14)) and set(ORACLE_SQL) <= set(QUERIES)
    count = lambda t: spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").count()
    documents, vectors = count("documents"), count("embeddings")
    for name, query in QUERIES.items():
        got = query(spark, "/root/testdata/sf0.001")
        key = got.columns[0]
        assert got.filter(F.col(key).isNull()).count() == 0, name
        if name in ("op3_best_fit_packing", "op9_token_output", "op8_nearest_neighbours", "op5_token_counts", "op12_conversation_repair"):
            assert got.count() > 0, name
        else:
            assert got.count() == (vectors if key == "vec_id" else documents), name
