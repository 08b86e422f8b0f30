"""Embedding of notes that lack one, through an embedder that is loaded once per task."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

from threadlode.operators.store import lacking_embeddings, set_embeddings

#: Texts in, vectors out. ``make()`` is called on the executors, so that a model is loaded where it runs.
Embedder = Callable[[list[str]], list[list[float]]]
BATCH, DIMS = 32, 384


def hash_embedder(dims: int = DIMS) -> Embedder:
    """The deterministic embedder of ``functions.vectors.hash_embedding``, as a seam for tests and offline runs."""

    def one(text: str) -> list[float]:
        raw = [int.from_bytes(hashlib.sha256(f"{j}:{text}".encode()).digest()[:4], "big") / 2**32 - 0.5 for j in range(dims)]
        size = math.sqrt(sum(x * x for x in raw)) or 1.0
        return [x / size for x in raw]

    return lambda texts: [one(t) for t in texts]


def embed(notes: DataFrame, make: Callable[[], Embedder] = hash_embedder, batch_rows: int = BATCH) -> DataFrame:
    """(note_id, vec) of ``notes(note_id, text)``; a null text counts as empty."""

    def run(batches):
        embedder = None
        for batch in batches:
            for at in range(0, batch.num_rows, batch_rows):
                part = batch.slice(at, batch_rows)
                embedder = embedder or make()
                vectors = embedder([t or "" for t in part.column("text").to_pylist()])
                yield pa.record_batch([part.column("note_id"), pa.array(vectors, pa.list_(pa.float32()))], ["note_id", "vec"])

    return notes.select("note_id", "text").mapInArrow(run, "note_id string, vec array<float>")


def embed_missing(notes: DataFrame, embeddings: DataFrame, make: Callable[[], Embedder] = hash_embedder) -> DataFrame:
    """``embeddings(note_id, dim, vec)`` with vectors for the notes that had none; those there are stay."""
    return set_embeddings(embeddings, embed(lacking_embeddings(notes, embeddings), make))
