"""Periodic runs of words: stretches that repeat with a period, found with a suffix automaton and link-cut access.

The suffix links of the automaton of a text form a tree; the path from the state of a prefix to the root holds all
suffixes of that prefix. Every state carries the place where its words occurred last. Appending a word means access to
the path of the new prefix: all of it now occurred last at the new place. Link-cut trees hold the path as segments of
states with one last place, so that access meets each segment once, and there are O(log n) of them for a word on average.

A segment whose longest state has `size` words and that occurred last `d` words ago says: the last `size` words equal
those that end d before. With d <= size that is a square, the stretch of the last size + d words has period d, and no
shorter one (the suffix would have occurred more recently). size is the longest such suffix, so the stretch can't be
extended to the left; the run goes on to the right as long as following words report the same start and period.

Work on a text is done within one row, so documents are never shuffled. A run holds words that stand under sequences of
REACH words which occur twice in the text; only the stretches under such sequences enter an automaton (no run is lost:
each of its sequences of REACH words comes again a period later or came a period before).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import long_texts, run_bounds, slices, texts_of

#: A run has at least so many words, and twice its period.
LEAST = 12
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(29)


class SuffixTree:
    """The suffix links of the automaton of a sequence: parent and length of each state, and the state of each prefix."""

    def __init__(self, words: list[int]) -> None:
        size, link, after, prefixes = [0], [-1], [{}], []
        last = 0
        for word in words:
            new = len(size)
            size.append(size[last] + 1)
            link.append(0)
            after.append({})
            p = last
            while p >= 0 and word not in after[p]:
                after[p][word] = new
                p = link[p]
            if p >= 0:
                q = after[p][word]
                if size[p] + 1 == size[q]:
                    link[new] = q
                else:
                    copy = len(size)
                    size.append(size[p] + 1)
                    link.append(link[q])
                    after.append(after[q].copy())
                    while p >= 0 and after[p].get(word) == q:
                        after[p][word] = copy
                        p = link[p]
                    link[q] = link[new] = copy
            prefixes.append(new)
            last = new
        self.size, self.link, self.prefixes = size, link, prefixes


class LastPlaces:
    """Link-cut trees over a rooted tree, whose preferred paths are the segments of states with one last place.

    Each preferred path is a splay tree by depth; `up` of a splay root points to the state above the path. The place of
    a path stands at its splay root (-1: none yet).
    """

    def __init__(self, parent: list[int]) -> None:
        n = len(parent)
        self.up, self.left, self.right, self.place = list(parent), [-1] * n, [-1] * n, [-1] * n

    def _splay(self, x: int) -> None:
        """Make x the root of its path's splay tree."""
        up, left, right, place = self.up, self.left, self.right, self.place
        while True:
            p = up[x]
            if p < 0 or left[p] != x and right[p] != x:
                return
            g = up[p]
            inner = g >= 0 and (left[g] == p or right[g] == p)
            if inner:
                self._rotate(p if (left[g] == p) == (left[p] == x) else x)
                self._rotate(x)
                place[x] = place[g]
            else:
                self._rotate(x)
                place[x] = place[p]

    def _rotate(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        p = up[x]
        g = up[p]
        if left[p] == x:
            child = left[p] = right[x]
            right[x] = p
        else:
            child = right[p] = left[x]
            left[x] = p
        if child >= 0:
            up[child] = p
        up[p] = x
        up[x] = g
        if g >= 0:
            if left[g] == p:
                left[g] = x
            elif right[g] == p:
                right[g] = x

    def access(self, state: int, at: int) -> list[tuple[int, int]]:
        """Recolour the path from the state to the root with the place `at`; (deepest state, place before) of each segment met, from the deepest."""
        up, right, place = self.up, self.right, self.place
        met, below, x = [], -1, state
        while x >= 0:
            self._splay(x)
            before = place[x]
            if before >= 0:
                met.append((x, before))
            deeper = right[x]
            if deeper >= 0:
                place[deeper] = before
            right[x] = below
            place[x] = at
            below, x = x, up[x]
        return met


def runs_of(words: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence: smallest period q, at least `least` words and 2 * q, not extendable."""
    tree = SuffixTree(words)
    size, access = tree.size, LastPlaces(tree.link).access
    ends: dict[tuple[int, int], int] = {}
    for end, state in enumerate(tree.prefixes):
        for deepest, before in access(state, end):
            d, n = end - before, size[deepest]
            if d <= n:
                ends[end - n - d + 1, d] = end
    return sorted((start, end - start + 1, d) for (start, d), end in ends.items() if end - start + 1 >= max(least, 2 * d))


def stretches(words: np.ndarray, doc: np.ndarray, reach: int) -> list[tuple[int, int]]:
    """(start, end) of the stretches, within one document each, under sequences of `reach` words that the document holds twice.

    words: a number for each word, equal for equal words; doc: ascending. Equal hashes of different sequences would only
    make stretches longer.
    """
    n = len(words) - reach + 1
    if n < 2:
        return []
    hashes = doc[:n].astype(np.uint64) * _STEP
    for j in range(reach):
        hashes = (hashes ^ words[j : j + n].astype(np.uint64)) * _STEP
        hashes ^= hashes >> _MIX
    at = np.flatnonzero(doc[:n] == doc[reach - 1 :])
    order = at[np.argsort(hashes[at], kind="stable")]
    same = hashes[order][1:] == hashes[order][:-1]
    often = np.sort(order[np.r_[same, False] | np.r_[False, same]]) if len(order) else order
    if not len(often):
        return []
    heads = np.flatnonzero(np.r_[True, (np.diff(often) > reach) | (doc[often[1:]] != doc[often[:-1]])])
    return list(zip(often[heads].tolist(), (often[np.r_[heads[1:], len(often)] - 1] + reach).tolist(), strict=True))


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words, joined by one space, without those that a run holds after its first period."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])


def periodic_runs(docs: DataFrame, column: str = "text", least: int = LEAST, rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None, text_out: bool = True) -> DataFrame:
    """Runs of words in each whole text: (doc_id, n_words, runs array<struct<start,length,period>>, collapsed_sha256, and with text_out `collapsed`).

    Words are separated by ASCII white space and numbered from 0. A run has at least `least` words and two periods; runs
    are listed by start, then period. `collapsed` is the text, words joined by one space, without the words that any run
    holds after its first period. rewrite(doc_id, words) may replace a document's words first.

    Null and empty texts have no words and no runs; rows that repeat or share an id come back each, rows without an id,
    too; an empty table gives no rows; other columns are ignored. Nothing is shuffled. A text's automaton takes memory in
    proportion to its repeated stretches and time of their length times its squared logarithm.
    """
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(run)), ("collapsed_sha256", pa.string())]
    schema = pa.schema([*fields, *([("collapsed", pa.string())] if text_out else [])])
    reach = max(least // 2, 1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids = batch.column("doc_id").cast(pa.int64()).to_pylist()
            words = [t.encode().split() for t in texts_of(batch, column)]
            if rewrite:
                words = [rewrite(i, w) for i, w in zip(ids, words, strict=True)]
            counts = np.fromiter(map(len, words), np.int64, len(words))
            first = np.cumsum(counts) - counts
            known: dict[bytes, int] = {}
            flat = np.fromiter((known.setdefault(w, len(known)) for ws in words for w in ws), np.int64, int(counts.sum()))
            doc = np.repeat(np.arange(len(words)), counts)
            found: list[list[tuple[int, int, int]]] = [[] for _ in words]
            for start, end in stretches(flat, doc, reach):
                if end - start >= least:
                    i = doc[start]
                    found[i] += [(int(start - first[i]) + s, n, q) for s, n, q in runs_of(flat[start:end].tolist(), least)]
            kept = [_collapsed(ws, rs) for ws, rs in zip(words, found, strict=True)]
            columns = [
                pa.array(ids, pa.int64()),
                pa.array(counts),
                pa.array([[{"start": s, "length": n, "period": q} for s, n, q in sorted(rs, key=lambda r: (r[0], r[2]))] for rs in found], pa.list_(run)),
                pa.array([hashlib.sha256(k).hexdigest() for k in kept]),
                *([pa.array([k.decode() for k in kept], pa.string())] if text_out else []),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    spark_schema = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed_sha256 string" + (", collapsed string" if text_out else "")
    return long_texts(docs).select("doc_id", column).mapInArrow(work, spark_schema)


def longest(runs: Column) -> Column:
    """The run with the greatest length, of equal ones the one that starts first, then the one with the smallest period; null if there is none."""
    ranked = F.transform(runs, lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period")))
    best = F.array_min(ranked)
    return F.when(best.isNotNull(), F.struct(best["start"].alias("start"), (-best["n"]).alias("length"), best["period"].alias("period")))


def listed(runs: Column) -> Column:
    """start,length,period of the runs, a line each."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
