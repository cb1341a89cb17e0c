"""Spanning links of a small graph inside one task."""

from __future__ import annotations

import numpy as np


def roots_of(count: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For nodes 0 .. count-1 with links left[i] - right[i]: the smallest node each one reaches."""
    label = np.arange(count)
    while True:
        low = np.minimum(label[left], label[right])
        following = label.copy()
        np.minimum.at(following, left, low)
        np.minimum.at(following, right, low)
        following = following[following]
        if np.array_equal(following, label):
            return label
        label = following
