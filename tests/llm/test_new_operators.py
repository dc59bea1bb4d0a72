"""Periodic runs, conversation repair and line dedup against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.llm import lines, queries, repair, runs

SF = "/root/testdata/sf0.001"


def brute_runs(w: list, least: int = 12) -> list[tuple[int, int, int]]:
    found = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            n = i + q - start
            if n >= max(least, 2 * q) and not any(w[start : start + n - d] == w[start + d : start + n] for d in range(1, q)):
                found.append((start, n, q))
    return sorted(found)


def expected_runs(doc_id, text) -> tuple:
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return doc_id, len(found), *best, milli, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone))


def test_runs_of_random_sequences():
    rng = random.Random(5)
    for _ in range(400):
        k, n = rng.choice([1, 2, 3, 5, 30]), rng.randrange(0, 80)
        w = [rng.randrange(k) for _ in range(n)]
        if n and rng.random() < 0.6:
            a = rng.randrange(n)
            p = 1 + (n - a) // rng.randrange(2, 9)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        least = rng.choice([2, 4, 12])
        assert runs.runs_of(w, least) == brute_runs(w, least)
        parts = runs.stretches(np.array(w, np.int64), np.zeros(n, np.int64), least // 2)
        assert sorted((s + x, m, q) for x, y in parts for s, m, q in runs.runs_of(w[x:y], least)) == brute_runs(w, least)


def test_long_run_takes_linear_time():
    import time

    words = [i % 7 for i in range(200_000)]
    began = time.time()
    assert runs.runs_of(words) == [(0, 200_000, 7)]
    assert time.time() - began < 20


def _documents(spark):
    rng = random.Random(8)
    texts = [None, "", " \t\n", "a", "ab " * 500, "x y z " * 5 + "tail", "été\x0bnaïve ok nb " * 9]
    for _ in range(250):
        words = [rng.choice("the of a in to and it".split()) for _ in range(rng.randrange(1, 160))]
        texts.append(" ".join(words) + rng.choice(["", "\n", "  "]))
    rows = [(i, t, "src", 1) for i, t in enumerate(texts)] + [(3, "a", "src", 1), (None, "a b " * 9, None, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, runs string, n_words int"), rows


def test_op11_against_brute_force(spark, tmp_path):
    docs, rows = _documents(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted((expected_runs(i, t) for i, t, _, _ in rows), key=key)
    assert sum(r[1] for r in got) > 20
    text = {r.doc_id: r.collapsed for r in runs.periodic_runs(docs).collect()}
    assert text[4] == "ab" and text[5] == "x y z tail"
    assert runs.periodic_runs(docs.filter("false")).count() == 0


def test_op11_on_given_documents(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").filter("n_chars < 4000").collect()}
    got = {r[0]: tuple(r) for r in queries.op11_periodic_runs(spark, SF).collect()}
    assert len(got) == 200 and all(got[i] == expected_runs(i, t) for i, t in docs.items())


def expected_repair(rows: list[tuple]) -> dict:
    """rows: (conv_id, turn, role, text) before damage; all audits as whole strings."""
    held = defaultdict(list)
    for conv, turn, role, text in rows:
        held[conv]
        said = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text = said(role), said(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        held[conv] += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, mine in held.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in mine:
            bare = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        after = {0: 2, 1: 2, 2: 3, 3: 2}

        def insert(best):
            best, more = dict(best), True
            while more:
                more = False
                for p, (c, a) in list(best.items()):
                    if after[p] not in best or (c + 3, a + "I") < best[after[p]]:
                        best[after[p]], more = (c + 3, a + "I"), True
            return best

        best = insert({0: (0, "")})
        for (_, role, _), fault in zip(mine, faults):
            new = {}
            for p, (c, a) in best.items():
                offers = [(p, c + 4, "D")]
                if fault in ("", "truncated"):
                    c += 3 * (fault == "truncated")
                    offers.append((after[p], c + 3, "R"))
                    if role[:1] == ("a" if p == 2 else "u"):
                        offers.append((after[p], c, "K"))
                    if role[:1] == "s" and p == 0:
                        offers.append((1, c, "K"))
                for t, cost, e in offers:
                    new[t] = min(new.get(t, (1 << 60, "")), (cost, a + e))
            best = insert(new)
        cost, audit = min(best[p] for p in (0, 3) if p in best)
        said, p, i = [], 0, 0
        for e in audit:
            if e == "D":
                i += 1
                continue
            role, text = (None, "") if e == "I" else mine[i][1:]
            i += e != "I"
            p = 1 if e == "K" and role[:1] == "s" else after[p]
            said.append((role if e == "K" else {2: "user", 3: "assistant"}[p]) + ":" + text)
        turns = [t for t, _, _ in mine if t is not None]
        pairs = [x[1][:1] + y[1][:1] for x, y in zip(mine, mine[1:])]
        out[conv] = {
            "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
            "illegal": sum(x not in ("su", "ua", "au") for x in pairs),
            "cost": cost,
            "audit": audit,
            "repaired_sha256": hashlib.sha256("\n".join(said).encode()).hexdigest(),
        }
    return out


def _conversations() -> list[tuple]:
    rng = random.Random(11)
    rows = []
    for conv in [*range(120), None]:
        for turn in range(rng.randrange(0, 14)):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.3 else ("user", "assistant")[turn % 2]
            role = rng.choice(["system", "tool", None, ""]) if rng.random() < 0.1 else role
            rows.append((conv, rng.choice([turn, turn, turn, None, turn + 2]), role, rng.choice(["Yes.", "no", "é ok!", None, " \t", "Why?  ", "hm" + str(rng.randrange(99)) + "."])))
    rows += [(7, i, ("user", "assistant")[i % 2], f"line {i % 700}.") for i in range(2500)]
    return rows


def test_op12_against_brute_force(spark, tmp_path, monkeypatch):
    rows = _conversations()
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, audit string")
    table.write.parquet(f"{tmp_path}/conversations.parquet")
    want = expected_repair(rows)
    got = {r.conv_id: r.asDict() for r in queries.op12_conversation_repair(spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys()
    for conv, row in got.items():
        assert {c: row[c] for c in want[conv]} == want[conv], conv
    edits = repair.repair(repair.damaged(table), gone="gone", edits_out=True).orderBy("part", "chunk").collect()
    made = defaultdict(list)
    for r in edits:
        made[r.conv_id] += [(e.edit, e.role, e.text) for e in r.edits]
    assert all("".join(e for e, _, _ in made[c]) == want[c]["audit"] for c in want)
    assert all(hashlib.sha256("\n".join(f"{r}:{t}" for _, r, t in made[c] if r is not None).encode()).hexdigest() == want[c]["repaired_sha256"] for c in want)
    assert repair.repair(table.filter("false")).count() == 0


def test_op12_on_given_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = expected_repair(rows)
    got = {r.conv_id: {c: r[c] for c in want[r.conv_id]} for r in queries.op12_conversation_repair(spark, SF).collect()}
    assert got == want


def test_audits_survive_hash_collisions():
    rng, audits = random.Random(2), repair.Audits(base=0)
    for _ in range(500):
        x = y = 0
        for c in rng.choices("DIKR", k=rng.randrange(1, 12)):
            x = audits.extend(x, c)
        y = rng.choice([0, audits.up[x][0]])
        for c in rng.choices("DIKR", k=rng.randrange(1, 12)):
            y = audits.extend(y, c)
        assert audits.less(x, y) == (audits.text(x) < audits.text(y))


def expected_lines(rows: list[tuple]) -> list[tuple]:
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(table)
    held = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if doc is not None and len(key(line)) >= 10:
                held[key(line)].add(doc)
    out = []
    for doc, text in rows:
        own = (text or "").split("\n")
        kept = [x for x in own if doc is None or len(held[key(x)]) < 2 or min(held[key(x)]) == doc]
        out.append((doc, len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest(), "\n".join(kept)))
    return out


def test_op13_against_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    pool = ["All rights reserved", " all RIGHTS reserved\t", "Été NAÏVE çà là", "été naïve çà là", "short", "123456789", "1234567890", "", "\x0bVertical tab line\x0c", "nbsp line here "]
    rows = [(i, "\n".join(rng.choice([*pool, f"line number {rng.randrange(300)}"]) for _ in range(rng.randrange(1, 30)))) for i in range(300)]
    rows += [(None, "All rights reserved\nx"), (None, None), (900, None), (901, ""), (902, "\n\n"), (5, "All rights reserved"), (903, "All rights reserved\n" * 5000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, bucket int")
    monkeypatch.setattr(lines, "BUCKET_BYTES", 2000)
    monkeypatch.setattr(lines, "SHARD_LINES", 20)
    key = lambda r: tuple(str(x) for x in r)
    got = sorted((tuple(r) for r in lines.drop_repeated_lines(docs).collect()), key=key)
    assert got == sorted(expected_lines(rows), key=key)
    index = lines.line_index(docs)
    assert sorted((tuple(r) for r in lines.drop_repeated_lines(docs, index=index).collect()), key=key) == got
    assert lines.drop_repeated_lines(docs.filter("false")).count() == 0


def test_perfect_hash_is_minimal_and_finds_strangers_out():
    rng = np.random.default_rng(1)
    digests = rng.integers(0, 1 << 63, 20_002, dtype=np.uint64).view(lines._DIGEST)
    known, strange = digests[:7000], digests[7000:]
    hashed = lines.PerfectHash.of(known)
    assert sorted(hashed.numbers(known)) == list(range(7000))
    assert 64 * len(hashed.bits) < 5 * 7000
    counts, firsts = np.arange(7000) % 3 + 1, np.arange(7000) * 10
    shard = lines.Shard(lines.shard_row(0, known, counts, firsts))
    which, first = shard.repeated(known)
    assert (which == np.flatnonzero(counts > 1)).all() and (first == firsts[counts > 1]).all()
    assert len(shard.repeated(strange)[0]) == 0
    assert lines.PerfectHash.of(known[:0]).numbers(known).tolist() == [-1] * 7000


@pytest.mark.parametrize("name", ["op13_line_dedup"])
def test_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = con.execute(queries.ORACLE_SQL[name]).fetchall()
    names = [d[0] for d in con.description]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want)
    assert got.agg(F.sum("n_dropped")).first()[0] > 0


@pytest.mark.parametrize("piece", ["AB12 ", "DE12 ", "AB12", "ZZ99 A1"])
def test_long_upper_case_texts_are_read_once(piece):
    import time

    from recollect.llm import pii

    text = piece * (1_000_000 // len(piece)) + " DE44 5001 0517 5407 3249 31"
    began = time.time()
    found = pii.spans(text)
    assert time.time() - began < 3
    assert [k for k, *_ in found] == ["iban"] or piece == "AB12"


def test_account_numbers_end_where_they_may():
    from recollect.llm import pii

    made = lambda x: f"{x[:2]}{98 - int(''.join(str(int(c, 36)) for c in x[4:] + x[:2] + '00')) % 97:02}{x[4:]}"
    free = made("ZZ00" + "7" * 30)
    kinds = lambda t: [(s, e) for k, s, e, _ in pii.spans(t) if k == "iban"]
    assert kinds(free) == [(0, 34)] and kinds(free + "1") == [] and kinds(free + "A") == [] and kinds(free + " x") == [(0, 34)]


def test_strings_of_a_hot_source_meet_only_the_cuts_of_their_span(spark, monkeypatch):
    from recollect.llm import debruijn

    monkeypatch.setattr(debruijn, "SPAN", 16)
    rng = random.Random(1)
    rows = [(0, i, rng.randrange(50), rng.randrange(1, 60), rng.randrange(3), rng.randrange(300)) for i in range(300)]
    cuts = defaultdict(set)
    for *_, n, source, at in rows:
        cuts[source] |= {at, at + n}
    want = []
    for bucket, doc, start, n, source, at in rows:
        own = sorted(x for x in range(at, at + n + 1) if x in cuts[source] or x % 16 == 0)
        want += [(bucket, doc, start + x - at, y - x, source, x) for x, y in zip(own, own[1:])] + [(bucket, doc, start + n, 0, source, at + n)]
    strings = spark.createDataFrame(rows, "bucket int, doc long, start int, n int, source_doc long, source_start int")
    assert sorted(tuple(r) for r in debruijn.compact_paths(strings).collect()) == sorted(want)


def test_large_bands_meet_by_rare_shingles(spark, monkeypatch):
    from recollect.llm import jaccard

    monkeypatch.setattr(jaccard, "LARGE", 8)
    rng = random.Random(12)
    template = [f"t{i}" for i in range(90)]
    texts = []
    for i in range(40):  # similar, but not enough
        own = list(template)
        for at in rng.sample(range(0, 90, 9), 4):
            own[at] = f"w{i}x{at}"
        texts.append(" ".join(own))
    for i in range(0, 40, 7):  # and some that are
        w = texts[i].split()
        w[rng.randrange(90)] = f"z{i}"
        texts.append(" ".join(w))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    label = list(range(len(texts)))
    alike = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    for _ in texts:
        for i, j in alike:
            label[i] = label[j] = min(label[i], label[j])
    dealt = []
    plain = jaccard._by_rare_shingles
    monkeypatch.setattr(jaccard, "_by_rare_shingles", lambda rest, held, least: dealt.append((rest.count(), (out := plain(rest, held, least)).count(), out.groupBy("band").count().agg(F.max("count")).first()[0])) or out)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.similar_documents(docs).collect()}
    assert [got[i] for i in range(len(texts))] == label and len(alike) >= 5
    before, after, largest = dealt[0]
    assert before > 24 and after <= 25 * len(texts) and largest <= 46


def test_neighbours_where_vectors_crowd(spark, monkeypatch):
    from recollect.llm import rpforest

    monkeypatch.setattr(rpforest, "SHARD", 40)
    monkeypatch.setattr(rpforest, "LEAF", 16)
    rng = np.random.default_rng(3)
    base = rng.normal(size=16)
    rows = [(i, base.tolist()) for i in range(300)] + [(1000 + i, (base + rng.normal(scale=0.01, size=16)).tolist()) for i in range(300)] + [(5000 + i, rng.normal(size=16).tolist()) for i in range(300)]
    vectors = spark.createDataFrame(rows + rows[:5], "vec_id long, embedding array<double>")
    got = rpforest.nearest(vectors, vectors.filter("vec_id % 20 = 0"), k=5)
    found = defaultdict(list)
    for r in sorted(got.collect(), key=lambda r: r.rank):
        found[r.query_id].append(r.vec_id)
    held = dict(rows)
    hit = n = 0
    for q in (i for i in held if i % 20 == 0):
        want = sorted((x for x in held if x != q), key=lambda x: (-float(np.dot(held[q], held[x])), x))[:5]
        hit += len(set(want) & set(found[q]))
        n += 5
        assert len(found[q]) == 5 == len(set(found[q]))
    assert hit >= 0.9 * n
    copies = [x for x in held if x < 300]
    same = rpforest.nearest(vectors.filter("vec_id < 300"), vectors.filter("vec_id in (0, 280)"), k=5)
    assert {(r.query_id, r.vec_id) for r in same.collect()} == {(0, i) for i in range(1, 6)} | {(280, i) for i in range(5)} and copies
