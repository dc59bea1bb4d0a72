"""Places where a model may be plugged in; each has a deterministic stand-in, so everything runs without one."""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.model import shared_folder, stored
from .text import Text, excerpt

#: Texts to answers (None where the model has none), called once for each batch of rows on the executors.
Model = Callable[[Sequence[str]], Sequence[str | None]]


#: Prompts of one call: so many, within these bounds.
BATCH, FEWEST, MOST = 50, 10, 200


def answers(prompts: DataFrame, folder: str, model: Model, batch: int = BATCH, retries: int = 3, wait: float = 1.0) -> DataFrame:
    """(digest, answer) for a table of prompts (prompt): the model is called with batches of prompts on the executors, each prompt once.

    Answers are kept in a folder that all tasks see, under the SHA-256 of their prompt, as soon as a batch is answered:
    a task that runs again, and every later run, reads them there and calls nobody. A call that fails is tried `retries`
    times with growing waits; then, as for empty answers, the prompt has no answer (null), which isn't kept, so that the
    next run asks again. batch is held within FEWEST and MOST. Null and empty prompts have no answer.
    """
    size = max(FEWEST, min(int(batch), MOST))
    wanted = prompts.select("prompt").filter("prompt <> ''").distinct().select(F.sha2("prompt", 256).alias("digest"), "prompt")
    # equal runs make equal batches: prompts are dealt and sorted by their digest
    dealt = wanted.repartition("digest").sortWithinPartitions("digest")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)

        def known(digest: str) -> str | None:
            try:
                with system.open_input_stream(f"{root}/{digest[:2]}/{digest}") as f:
                    return f.read().decode()
            except FileNotFoundError:
                return None

        def keep(digest: str, answer: str) -> None:
            system.create_dir(f"{root}/{digest[:2]}", recursive=True)
            aside = f"{root}/{digest[:2]}/.{digest}-{uuid.uuid4().hex}"
            with system.open_output_stream(aside) as f:
                f.write(answer.encode())
            system.move(aside, f"{root}/{digest[:2]}/{digest}")

        def asked(texts: list[str]) -> list[str | None]:
            for attempt in range(max(retries, 1)):
                try:
                    return list(model(texts))
                except Exception:  # what a model's client may raise isn't known here
                    time.sleep(wait * 2**attempt)
            return [None] * len(texts)

        for frame in frames:
            frame = frame.assign(answer=[known(d) for d in frame["digest"]])
            open_ = frame.index[frame["answer"].isna()]
            for at in range(0, len(open_), size):
                some = open_[at : at + size]
                for i, answer in zip(some, asked(frame.loc[some, "prompt"].tolist()), strict=True):
                    if answer and answer.strip():
                        keep(frame.at[i, "digest"], answer)
                        frame.at[i, "answer"] = answer
            yield frame[["digest", "answer"]]

    return dealt.mapInPandas(run, "digest string, answer string")


def answered(df: DataFrame, prompt: Column, name: str, fallback: Column, model: Model | None = None, folder: str | None = None, **calls) -> DataFrame:
    """df with a column `name`: the model's answer to the prompt, or the fallback where it gives none or there is none.

    folder: where answers are kept (see answers; `calls` are its options); a new shared folder unless it is given.
    """
    if model is None:
        return df.withColumn(name, fallback)
    kept = folder or shared_folder(df.sparkSession, "answers")
    rows = df.withColumn("_prompt", prompt.cast("string"))
    found = stored(answers(rows.select(F.col("_prompt").alias("prompt")), kept, model, **calls), "answered")
    given = found.select(F.col("digest").alias("_digest"), F.nullif(F.trim("answer"), F.lit("")).alias("_answer"))
    rows = rows.join(given, F.sha2("_prompt", 256) == F.col("_digest"), "left")
    return rows.withColumn(name, F.coalesce("_answer", fallback)).drop("_prompt", "_digest", "_answer")


def title(text: Text, fallback: Text, limit: int = 48) -> Column:
    """The stand-in for a model's title: the fallback, or an excerpt where that is empty."""
    given = excerpt(fallback, limit)
    return F.when(given != "", given).otherwise(excerpt(text, limit))


def keep_best(candidates: Text, most: int) -> Column:
    """The stand-in for a model's choice: the first of an array that aren't empty, each once."""
    c = F.col(candidates) if isinstance(candidates, str) else candidates
    return F.slice(F.array_distinct(F.filter(c, lambda x: F.trim(x) != "")), 1, most)


def json_in(text: Text) -> Column:
    """The outermost JSON object within a model's answer; null where there is none that parses."""
    found = F.regexp_extract(F.col(text) if isinstance(text, str) else text, r"(?s)(\{.*\})", 1)
    return F.when(F.get_json_object(found, "$").isNotNull(), found)


def embedded(df: DataFrame, text: Column, name: str = "embedding", dims: int = 64, model: Callable[[Sequence[str]], Sequence[Sequence[float]]] | None = None) -> DataFrame:
    """df with an embedding of the text: the model's, or signed counts of hashed words, scaled to length one."""
    rows = df.withColumn("_text", text)

    def hashed(texts: Sequence[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(dims)
            for w in re.findall(r"\w+", t.lower()):
                h = crc32(w.encode())
                v[h % dims] += 1 if h >> 31 else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return out

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series(list((model or hashed)(texts.fillna("").tolist())))

    return rows.withColumn(name, embed("_text")).drop("_text")
