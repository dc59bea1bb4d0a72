"""Token counts of document sections: whole documents are encoded once and their tokens attributed by offsets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import long_texts, slices, texts_of
from .tokens import encoder

#: Rules for a token that crosses a section boundary.
RULES = ("start", "end", "split")


def section_spans(text: str, separator: str = "\n") -> tuple[np.ndarray, np.ndarray]:
    """Start and end characters of the sections: each ends after a separator or with the text. Empty text: one empty section."""
    cuts = [0]
    at = text.find(separator)
    while at >= 0:
        cuts.append(at + len(separator))
        at = text.find(separator, at + len(separator))
    if cuts[-1] < len(text) or len(cuts) == 1:
        cuts.append(len(text))
    edges = np.array(cuts, np.int64)
    return edges[:-1], edges[1:]


def allot(token_first: np.ndarray, token_last: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section: an interval join of token spans with the sorted, adjoining section spans.

    A token lies in the sections that hold its first and its last character. Where these differ, "start" gives it to
    the first, "end" to the last, and "split" gives each section from the first to the last an equal share.
    """
    if not len(token_first):
        return np.zeros(len(starts))
    first = np.searchsorted(starts, token_first, "right") - 1
    if rule == "start":
        return np.bincount(first, minlength=len(starts)).astype(float)
    last = np.searchsorted(starts, token_last, "right") - 1
    if rule == "end":
        return np.bincount(last, minlength=len(starts)).astype(float)
    counts = np.zeros(len(starts) + 1)
    share = 1.0 / (last - first + 1)
    np.add.at(counts, first, share)
    np.subtract.at(counts, last + 1, share)
    return np.cumsum(counts)[:-1]


def count_tokens(docs: DataFrame, tokenizer: str, rule: str = "start", separator: str = "\n", column: str = "text") -> DataFrame:
    """One row for each section of each document: doc_id, section (from 0), start, end (characters), n_tokens (double).

    Each text is encoded once, whole; n_tokens of a document's sections sum to its number of tokens under every rule.
    A null text counts as empty: one section, no tokens. Repeated rows are counted each; an empty table gives no rows;
    other columns are ignored, whatever their names. There is no shuffle: sections and tokens meet in the scan's tasks,
    by a binary search of token starts in the section starts.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    schema = pa.schema([("doc_id", pa.int64()), ("section", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("n_tokens", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in slices(batches):
            found = []
            ids = batch.column("doc_id").to_pylist()
            for text in texts_of(batch, column):
                s, e = section_spans(text, separator)
                found.append((s, e, allot(*enc.spans(text), s, e, rule)))
            sizes = [len(s) for s, _, _ in found]
            keep = np.repeat(np.arange(len(ids)), sizes)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()).take(pa.array(keep)),
                    pa.array(np.concatenate([np.arange(n) for n in sizes]) if sizes else [], pa.int64()),
                    *(pa.array(np.concatenate([x[i] for x in found]) if found else [], f.type) for i, f in enumerate(list(schema)[2:])),
                ],
                schema=schema,
            )

    return long_texts(docs).select("doc_id", column).mapInArrow(run, "doc_id long, section long, start long, end long, n_tokens double")
