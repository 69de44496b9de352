"""Cross-polytope codes of vectors after fast pseudo-random rotations."""

from __future__ import annotations

import numpy as np


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row, scaled to keep lengths; the width is a power of two."""
    n, d = x.shape
    h = 1
    x = x.copy()
    while h < d:
        v = x.reshape(n, d // (2 * h), 2, h)
        a, b = v[:, :, 0, :] + v[:, :, 1, :], v[:, :, 0, :] - v[:, :, 1, :]
        v[:, :, 0, :], v[:, :, 1, :] = a, b
        h *= 2
    return x / np.sqrt(d)


def signs(seed: int, rounds: int, width: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([seed, width])).integers(0, 2, (rounds, width)) * 2.0 - 1.0


def rotate(x: np.ndarray, seed: int, rounds: int = 3) -> np.ndarray:
    """Random signs and a Hadamard transform, in turns; rows are padded with zeros to a power of two."""
    width = 1 << max(1, (x.shape[1] - 1).bit_length())
    if width > x.shape[1]:
        x = np.concatenate([x, np.zeros((len(x), width - x.shape[1]))], axis=1)
    for s in signs(seed, rounds, width):
        x = hadamard(x * s)
    return x


def corner(x: np.ndarray) -> np.ndarray:
    """The nearest corner of the cross-polytope: twice the largest coordinate's place, plus 1 if it is negative."""
    i = np.abs(x).argmax(axis=1)
    return 2 * i + (x[np.arange(len(x)), i] < 0)


def probes(x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """Codes of two corners, the likeliest first: (rows, most).

    Column 0 is the row's own code.  The others replace a corner by that of one
    of the next largest coordinates, in the order of the loss in square.
    """
    def top(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = min(4, v.shape[1])
        at = np.argsort(-np.abs(v), axis=1, kind="stable")[:, :near]
        value = np.take_along_axis(v, at, axis=1)
        size = np.abs(value)
        return 2 * at + (value < 0), (size[:, :1] - size) ** 2

    (a, la), (b, lb) = top(x), top(y)
    code = (a[:, :, None] * (2 * y.shape[1]) + b[:, None, :]).reshape(len(x), -1)
    order = np.argsort((la[:, :, None] + lb[:, None, :]).reshape(len(x), -1), axis=1, kind="stable")[:, :most]
    return np.take_along_axis(code, order, axis=1)
