"""Seams to outside services: the engine calls a function over batches; offline stubs stand in for models."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame


def stub_answers(texts: list[str]) -> list[str]:
    """A fixed reply for each text: one question about its first words."""
    return [f'[{{"question": "What about {" ".join(t.split()[:3])}?", "answer": "{len(t)} characters", "keywords": []}}]' for t in texts]


def stub_vectors(texts: list[str], dimension: int = 1024) -> list[list[float]]:
    """Unit vectors from digests."""
    out = []
    for t in texts:
        raw = b"".join(hashlib.sha256(f"{k}|{t}".encode()).digest() for k in range(-(-dimension // 32)))
        v = [b / 127.5 - 1 for b in raw[:dimension]]
        n = sum(x * x for x in v) ** 0.5
        out.append([x / n for x in v])
    return out


def call_model(df: DataFrame, text: str, out: str, model: Callable[[list[str]], list] = stub_answers, kind: str = "string", attempts: int = 3, pause_s: float = 0.0) -> DataFrame:
    """df with the model's reply; after all attempts the reply is null and `failed` true."""
    columns = df.columns

    def run(batches: Iterable[pd.DataFrame]):
        for pdf in batches:
            replies, failed = [None] * len(pdf), True
            for k in range(attempts):
                try:
                    replies, failed = model(["" if t is None else t for t in pdf[text]]), False
                    break
                except Exception:
                    time.sleep(min(8.0, 0.5 * 2**k))
            time.sleep(pause_s)
            yield pdf.assign(**{out: replies, "failed": failed})[[*columns, out, "failed"]]

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{ddl}, `{out}` {kind}, failed boolean")


def embed(df: DataFrame, text: str, model: Callable[[list[str]], list] | None = None, dimension: int = 1024, most_chars: int = 8192, attempts: int = 3) -> DataFrame:
    """df with `embedding`: trimmed, cut texts, blank ones as one space; where all attempts fail a zero vector, flagged."""
    columns = df.columns
    call = model or (lambda texts: stub_vectors(texts, dimension))

    def run(batches: Iterable[pd.DataFrame]):
        for pdf in batches:
            texts = [(("" if t is None else t).strip()[:most_chars]) or " " for t in pdf[text]]
            vectors, failed = [[0.0] * dimension] * len(pdf), True
            for k in range(attempts):
                try:
                    vectors, failed = call(texts), False
                    break
                except Exception:
                    time.sleep(min(8.0, 0.5 * 2**k))
            yield pdf.assign(embedding=vectors, failed=failed)[[*columns, "embedding", "failed"]]

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{ddl}, embedding array<float>, failed boolean")


def partition_markdown(elements: DataFrame) -> DataFrame:
    """doc, markdown of parsed elements (doc, pos, type, text, depth)."""
    from pyspark.sql import functions as F

    line = (
        F.when(F.col("type") == "Title", F.concat(F.repeat(F.lit("#"), F.coalesce("depth", F.lit(1))), F.lit(" "), F.col("text")))
        .when(F.col("type") == "ListItem", F.concat(F.lit("- "), F.col("text")))
        .otherwise(F.col("text"))
    )
    lines = F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("l")))), lambda p: p["l"])
    return elements.groupBy("doc").agg(F.array_join(lines, "\n\n").alias("markdown"))
