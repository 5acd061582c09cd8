"""Similarity kernels of one vector against a matrix of vectors of its length, in numpy."""

from __future__ import annotations

import numpy as np


def pearson(model: np.ndarray, batch: np.ndarray) -> np.ndarray:
    """Correlation; of a constant vector 1 with a constant one of equal value, else 0."""
    if len(model) < 2:
        return np.zeros(len(batch))
    m = model - model.mean()
    b = batch - batch.mean(axis=1, keepdims=True)
    mm, bb = float(m @ m), (b * b).sum(axis=1)
    if mm < 1e-30:
        return ((bb < 1e-30) & (np.abs(batch[:, 0] - model[0]) < 1e-10)).astype(float)
    norm = np.sqrt(mm * bb)
    return np.where(norm > 1e-15, np.clip((b @ m) / np.where(norm > 1e-15, norm, 1.0), -1.0, 1.0), 0.0)


def cosine(model: np.ndarray, batch: np.ndarray) -> np.ndarray:
    norm = np.sqrt(float(model @ model) * (batch * batch).sum(axis=1))
    return np.where(norm > 1e-15, np.clip((batch @ model) / np.where(norm > 1e-15, norm, 1.0), -1.0, 1.0), 0.0)


def euclidean(model: np.ndarray, batch: np.ndarray, sigma: float) -> np.ndarray:
    """``1 / (1 + d / (sigma sqrt(L)))``; sigma is the spread of the model and all candidates."""
    d = np.sqrt(((batch - model) ** 2).sum(axis=1))
    return 1.0 / (1.0 + d / (max(sigma, 1e-15) * np.sqrt(len(model))))


def _pearson_table(models: np.ndarray, batch: np.ndarray) -> np.ndarray:
    if models.shape[1] < 2:
        return np.zeros((len(models), len(batch)))
    m, b = models - models.mean(axis=1, keepdims=True), batch - batch.mean(axis=1, keepdims=True)
    mm, bb = (m * m).sum(axis=1), (b * b).sum(axis=1)
    norm = np.sqrt(mm[:, None] * bb[None])
    out = np.where(norm > 1e-15, np.clip((m @ b.T) / np.where(norm > 1e-15, norm, 1.0), -1.0, 1.0), 0.0)
    flat = np.flatnonzero(mm < 1e-30)
    out[flat] = (bb[None] < 1e-30) & (np.abs(batch[None, :, 0] - models[flat, :1]) < 1e-10)
    return out


def _cosine_table(models: np.ndarray, batch: np.ndarray) -> np.ndarray:
    norm = np.sqrt((models * models).sum(axis=1)[:, None] * (batch * batch).sum(axis=1)[None])
    return np.where(norm > 1e-15, np.clip((models @ batch.T) / np.where(norm > 1e-15, norm, 1.0), -1.0, 1.0), 0.0)


KERNELS = {"pearson": pearson, "cosine": cosine, "euclidean": euclidean}
_TABLES = {pearson: _pearson_table, cosine: _cosine_table}


def table(kernel, models: np.ndarray, batch: np.ndarray, sigmas=None) -> np.ndarray:
    """The similarities of all models and all vectors of a batch: one matrix product where the
    kernel has that form, else a call for each model; ``sigmas`` has the spread for each model."""
    if kernel in _TABLES:
        return _TABLES[kernel](models, batch)
    return np.array([kernel(m, batch) if sigmas is None else kernel(m, batch, s) for m, s in zip(models, sigmas if sigmas is not None else models, strict=True)]).reshape(len(models), len(batch))
