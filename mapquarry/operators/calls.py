"""Calls of outside models: batches in flight side by side, retries with back-off, states of rows that wait for an answer.

A partition keeps a bounded number of batches in flight and gives rows back in their order. A batch that fails is tried
again after a growing pause; one that fails for good is halved until the rows that make it fail stand alone. The default
answers are deterministic and need no model.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import on_workers

#: Rows of a call, calls in flight in a partition, attempts, first pause in seconds, its growth and its bound, characters of an error that are kept.
BATCH, IN_FLIGHT, ATTEMPTS, PAUSE, GROWTH, LONGEST, ERROR = 96, 24, 6, 0.8, 1.8, 12.0, 1200

Provider = Callable[[list[str]], list]


def tried(provider: Provider, texts: list[str], attempts: int, pause: Callable[[float], None]) -> list[tuple]:
    """(answer, attempts, error) of each text: all of one call, or of its halves where it failed ``attempts`` times."""
    wait, error = PAUSE, None
    for n in range(1, attempts + 1):
        try:
            got = list(provider(texts))
            if len(got) != len(texts):
                raise ValueError(f"{len(got)} answers to {len(texts)} texts")
            return [(x, n, None) for x in got]
        except Exception as e:
            error = f"{type(e).__name__}: {e}"[:ERROR]
            if n < attempts:
                pause(wait)
                wait = min(wait * GROWTH, LONGEST)
    if len(texts) == 1:
        return [(None, attempts, error)]
    half = len(texts) // 2
    return [(x, attempts + n, e) for part in (texts[:half], texts[half:]) for x, n, e in tried(provider, part, 1, pause)]


def ask(
    rows: DataFrame, text: str, provider: Provider, answer: str = "string", batch: int = BATCH, in_flight: int = IN_FLIGHT, attempts: int = ATTEMPTS, pause: Callable[[float], None] = time.sleep
) -> DataFrame:
    """``rows`` with the provider's ``answer`` to ``text``, ``status`` (DONE, SKIPPED for blank texts, FAILED), ``attempts`` and ``error``.

    ``answer`` is the type of an answer. Columns of those names in ``rows`` are replaced.
    """
    on_workers(rows.sparkSession)
    kept = rows.drop("answer", "status", "attempts", "error")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: deque = deque()

        def done(frame: pd.DataFrame, asked: list[int], future) -> pd.DataFrame:
            out: list[tuple] = [(None, "SKIPPED", 0, None)] * len(frame)
            for k, (x, n, e) in zip(asked, future.result() if future else [], strict=True):
                out[k] = (x, "FAILED" if e else "DONE", n, e)
            cols = list(zip(*out, strict=True))
            return frame.assign(answer=list(cols[0]), status=list(cols[1]), attempts=list(cols[2]), error=list(cols[3]))

        with ThreadPoolExecutor(in_flight) as pool:
            for f in frames:
                for k in range(0, len(f), batch):
                    part = f.iloc[k : k + batch]
                    texts = [t if isinstance(t, str) and t.strip() else None for t in part[text].tolist()]
                    asked = [i for i, t in enumerate(texts) if t is not None]
                    future = pool.submit(tried, provider, [texts[i] for i in asked], attempts, pause) if asked else None
                    waiting.append((part, asked, future))
                    if len(waiting) >= in_flight:
                        yield done(*waiting.popleft())
            while waiting:
                yield done(*waiting.popleft())

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInPandas(run, f"{schema}{', ' if schema else ''}answer {answer}, status string, attempts int, error string")


def embedded(nodes: DataFrame, provider: Provider, now: Column, **how) -> DataFrame:
    """One round of ``nodes(id, text, embedding, embedding_status, embedding_at, embedding_error)``.

    Nodes without an embedding and a status, and those stuck IN_PROGRESS from an earlier round, are asked for; blank texts become SKIPPED,
    answers DONE without an error, the others FAILED with the last one. Nodes of other states stay as they are, so that a
    round over its own result asks for nothing.
    """
    status = F.coalesce("embedding_status", F.lit(""))
    open_ = F.col("embedding").isNull() & status.isin("", "IN_PROGRESS")
    asked = ask(nodes.where(open_).select("id", "text"), "text", provider, "array<double>", **how)
    state = ["embedding", "embedding_status", "embedding_at", "embedding_error"]
    new = asked.select("id", "text", F.col("answer").alias("embedding"), F.col("status").alias("embedding_status"), now.alias("embedding_at"), F.col("error").alias("embedding_error"))
    return nodes.where(~open_).select("id", "text", *state).unionByName(new)


def digest_embedding(size: int = 8) -> Provider:
    """The default: numbers between -1 and 1 from the text's SHA-256."""

    def embed(texts: list[str]) -> list[list[float]]:
        return [[b / 127.5 - 1 for b in hashlib.sha256(t.encode()).digest()[:size]] for t in texts]

    return embed


#: What each call answers when its model can't be asked or its answer can't be read.
DEFAULTS: dict[str, object] = {
    "topic_extraction": [], "topic_decision": "create", "merge_decision": [], "intent": {}, "discovery_related": True, "new_conversation": False,
    "question_type": {"type": "other", "confidence": 0.5}, "place": None, "time_range": None, "dataset_selection": None,
}


def default(call: str) -> Provider:
    """The provider that gives a call's default answer, as JSON."""
    text = json.dumps(DEFAULTS[call])
    return lambda texts: [text] * len(texts)


def synthesis(title: Column, rank: Column) -> Column:
    """Summary of ranked datasets without a model: the first five titles. For ``agg`` over one request's rows."""
    lines = F.sort_array(F.collect_list(F.when(rank <= 5, F.struct(rank.alias("rank"), title.alias("title")))))
    listed = F.array_join(F.transform(lines, lambda r: F.concat(r["rank"].cast("string"), F.lit(") "), r["title"])), "\n")
    return F.when(F.size(lines) > 0, F.concat(F.lit("Top datasets (preview):\n"), listed)).otherwise("")
