"""Plug-in models. An embedder turns texts and images into vectors; `HashingEmbedder` needs no model and is
deterministic, so it serves tests and examples."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from sparkseek.errors import fail
from sparkseek.functions.text import query_vector, tokens
from sparkseek.nodes import Sparse


class Embedder:
    """Overrides are called on the driver for queries and upserts, and on the executors `rerank_pairs` and all that a dump's
    folder, when it is restored, asks for."""

    def dense(self, texts: Sequence[str], model: str | None, size: int) -> list[list[float]]:
        return fail("EMBEDDING", "this embedder makes no dense vectors")

    def sparse(self, texts: Sequence[str], model: str | None) -> list[Sparse | None]:
        """The language's own encoder; other models are for overrides."""
        if model and model.lower() != "default":
            fail("EMBEDDING-SPARSE-MODEL", f"the sparse model {model} is not known to this embedder")
        out = []
        for text in texts:
            indices, values = query_vector(text)
            out.append(Sparse(tuple(indices), tuple(values)) if indices else None)
        return out

    def multi(self, texts: Sequence[str], model: str | None, size: int) -> list[list[list[float]]]:
        return fail("EMBEDDING-MULTI", "this embedder makes no multi-vectors")

    def image(self, sources: Sequence[str], model: str | None, size: int) -> list[list[float]]:
        return fail("EMBEDDING-IMAGE", "this embedder reads no images")

    def joint(self, texts: Sequence[str], model: str | None, size: int, multi_size: int) -> tuple[list, list, list]:
        """Dense, sparse and multi-vectors; models that make them in one pass override it."""
        return self.dense(texts, model, size), self.sparse(texts, model), self.multi(texts, model, multi_size)

    def rerank_pairs(self, query: str, documents: Sequence[str], model: str) -> list[float]:
        return fail("EMBEDDING", "this embedder scores no pairs")


def _place(token: str, size: int) -> tuple[int, float]:
    h = int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "little")
    return h % size, 1.0 if h >> 63 else -1.0


class HashingEmbedder(Embedder):
    def dense(self, texts, model, size):
        out = []
        for text in texts:
            v = [0.0] * size
            for t in tokens(text):
                i, sign = _place(t, size)
                v[i] += sign
            out.append(v)
        return out

    def multi(self, texts, model, size):
        return [self.dense(tokens(t) or [""], model, size) for t in texts]

    def image(self, sources, model, size):
        return self.dense(sources, model, size)

    def rerank_pairs(self, query, documents, model):
        asked = set(tokens(query))
        return [len(asked & set(tokens(d))) / (1.0 + len(asked | set(tokens(d)))) for d in documents]
