"""Pluggable embedders: texts to vectors in Arrow batches. The default needs no network."""

from __future__ import annotations

import hashlib
import json
import re
import time
import urllib.request
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Takes a list of non-empty texts, returns as many vectors.
Embed = Callable[[Sequence[str]], Sequence[Sequence[float]]]


class HashEmbedder:
    """Deterministic default: signed hashing of words and word pairs, scaled to length 1."""

    def __init__(self, dim: int = 96):
        self.dim = dim

    def __call__(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for n, text in enumerate(texts):
            words = re.findall(r"[^\W_]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", text).lower())
            for w in words + [" ".join(p) for p in zip(words, words[1:])]:
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[n, h % self.dim] += 1.0 if h >> 63 else -1.0
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(length > 0, length, 1)


def _post(url: str, headers: dict, body: dict, timeout: float) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    with urllib.request.urlopen(request, timeout=timeout) as reply:  # noqa: S310  the address is the user's setting
        return json.load(reply)


@dataclass(frozen=True)
class HttpEmbedder:
    """Vectors from an embedding service. ``together`` sends many texts in one request and places the results by the index they return; else one text a request, whose reply holds one object or a list.

    ``post`` (url, headers, body, timeout) to the decoded reply can be replaced. Failed requests are tried ``tries``
    times in all; a reply without a vector for a text is an error.
    """

    url: str
    model: str
    key: str = ""
    dim: int | None = None
    together: bool = True
    tries: int = 3
    timeout: float = 60.0
    post: Callable[[str, dict, dict, float], dict] = _post

    def _ask(self, given) -> list:
        body = {"model": self.model, "input": given, "encoding_format": "float"} | ({"dimensions": self.dim} if self.dim else {})
        for n in range(self.tries):
            try:
                reply = self.post(self.url, {"Authorization": f"Bearer {self.key}"} if self.key else {}, body, self.timeout)
                break
            except OSError:
                if n + 1 == self.tries:
                    raise
                time.sleep(2**n)
        if "error" in reply:
            raise ValueError(f"the service answered: {reply['error']}")
        data = reply.get("data")
        return data if isinstance(data, list) else [data] if data else []

    def _vector(self, item) -> list[float]:
        vector = (item or {}).get("embedding")
        if not vector or (self.dim and len(vector) != self.dim):
            raise ValueError("the service returned no vector of the wanted length")
        return vector

    def __call__(self, texts: Sequence[str]) -> list[list[float]]:
        if not self.together:
            return [self._vector((self._ask([text]) or [None])[0]) for text in texts]
        out: list = [None] * len(texts)
        for place, item in enumerate(self._ask(list(texts))):
            at = item.get("index", place)
            if not 0 <= at < len(out):
                raise ValueError("the service returned an index beyond the texts")
            out[at] = self._vector(item)
        return [v if v is not None else self._vector(None) for v in out]


def _runner(embed: Embed, batch_size: int):
    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            at = [i for i, t in enumerate(texts) if t and t.strip()]
            vectors: list = [None] * len(texts)
            for k in range(0, len(at), batch_size):
                part = at[k : k + batch_size]
                found = embed([texts[i] for i in part])
                if len(found) != len(part):
                    raise ValueError("the embedder returned another number of vectors than texts")
                for i, v in zip(part, found):
                    vectors[i] = [float(x) for x in v]
            yield pa.RecordBatch.from_arrays([ids, pa.array(vectors, pa.list_(pa.float32()))], names=["symbol_id", "vector"])

    return run


def embed_texts(texts: DataFrame, embed: Embed | None = None, model: str = "hash", batch_size: int = 10) -> DataFrame:
    """(symbol_id, vector, dimension, model) of (symbol_id, text); blank texts get null vectors, results stay at their text's place."""
    rows = texts.select("symbol_id", "text").mapInArrow(_runner(embed or HashEmbedder(), batch_size), "symbol_id string, vector array<float>")
    return rows.withColumn("dimension", F.when(F.col("vector").isNotNull(), F.size("vector"))).withColumn("model", F.lit(model))


def input_text(symbols: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """(symbol_id, text): signature and comment of the symbols of the given kinds."""
    return symbols.where(F.col("kind").isin(*kinds)).select(F.col("id").alias("symbol_id"), F.concat_ws("\n", "signature", F.when(F.trim(F.coalesce("doc_comment", F.lit(""))) != "", F.col("doc_comment"))).alias("text"))
