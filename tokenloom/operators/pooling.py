"""Token pooling: Ward clusters of a document's tokens, each replaced by the mean of its vectors."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def ward_labels(x: np.ndarray, target: int) -> np.ndarray:
    """Labels of at most ``target`` clusters by Ward's criterion, from a chain of nearest neighbours."""
    n = len(x)
    if n <= target:
        return np.arange(n)
    # Squared Ward distances, updated in place; merges are cut off by height afterwards.
    d = np.concatenate([((x[i : i + 16, None, :] - x[None, :, :]) ** 2).sum(-1) for i in range(0, n, 16)])  # in blocks of rows: n x n, not n x n x dim
    np.fill_diagonal(d, np.inf)
    size, alive, merges, chain = np.ones(n), np.ones(n, bool), [], []
    while len(merges) < n - 1:
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        a = chain[-1]
        b = int(np.argmin(d[a]))
        if len(chain) > 1 and d[a, chain[-2]] <= d[a, b]:
            b = chain[-2]
            chain = chain[:-2]
            merges.append((float(d[a, b]), a, b))
            s = size[a] + size[b] + size
            new = ((size[a] + size) * d[a] + (size[b] + size) * d[b] - size * d[a, b]) / s
            keep, gone = min(a, b), max(a, b)
            size[keep], alive[gone] = size[a] + size[b], False
            new[~alive] = np.inf
            new[keep] = np.inf
            d[keep], d[:, keep] = new, new
            d[gone], d[:, gone] = np.inf, np.inf
        else:
            chain.append(b)
    up = np.arange(n)

    def root(i: int) -> int:
        while up[i] != i:
            i = up[i]
        return i

    heights = sorted(m[0] for m in merges)
    limit = heights[n - target - 1]
    # Equal heights join together, which may leave fewer clusters than asked for.
    for h, a, b in sorted(merges, key=lambda m: m[0]):
        if h <= limit:
            ra, rb = root(a), root(b)
            up[max(ra, rb)] = min(ra, rb)
    roots = np.array([root(i) for i in range(n)])
    return np.unique(roots, return_inverse=True)[1]


def pool_matrix(x: np.ndarray, factor: int) -> np.ndarray:
    target = math.ceil(len(x) / factor)
    if factor == 1 or len(x) <= target:
        return x
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    labels = ward_labels(unit, target)
    return np.stack([x[labels == c].mean(0, dtype=np.float64) for c in range(labels.max() + 1)]).astype(np.float32)


def pool(tokens: DataFrame, factor: int) -> DataFrame:
    """(doc_idx, token_pos, emb) with about a ``factor``-th of the tokens; a document is one group, and of bounded length."""
    if isinstance(factor, bool) or not isinstance(factor, int) or factor < 1:
        raise ValueError("pool_factor must be an integer of at least 1")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("token_pos")
        out = pool_matrix(np.stack(frame["emb"].to_numpy()).astype(np.float32), factor)
        return pd.DataFrame({"doc_idx": frame["doc_idx"].iloc[0], "token_pos": np.arange(len(out)), "emb": list(out)})

    return tokens.select("doc_idx", "token_pos", "emb").groupBy("doc_idx").applyInPandas(run, "doc_idx long, token_pos long, emb array<float>")
