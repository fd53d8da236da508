"""In-task helper of the Arrow-batched scorers (numpy only)."""

from __future__ import annotations

import numpy as np


def merge_topn(q: np.ndarray, pos: np.ndarray, sc: np.ndarray, n: int) -> np.ndarray:
    """Indices of the first n candidates per query under (score desc, pos asc)."""
    order = np.lexsort((pos, -sc, q))
    qs = q[order]
    starts = np.r_[0, np.flatnonzero(np.diff(qs)) + 1] if qs.size else np.empty(0, dtype=np.int64)
    within = np.arange(qs.size) - np.repeat(starts, np.diff(np.r_[starts, qs.size]))
    return order[within < n]
