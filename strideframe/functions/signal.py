"""Kernels on one track's series: zero-phase low-pass, gap filling, running median, homography fit."""

from __future__ import annotations

import heapq
from itertools import combinations

import numpy as np

ORDER, PAD = 4, 15


def butterworth(cutoff_hz: float, fps: float, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (b, a) of a digital Butterworth low-pass by the bilinear transform."""
    warped = 4 * np.tan(np.pi * cutoff_hz / fps)
    poles = warped * -np.exp(1j * np.pi * np.arange(-order + 1, order, 2) / (2 * order))
    gain = np.real(warped**order / np.prod(4 - poles))
    return gain * np.poly(-np.ones(order)), np.real(np.poly((4 + poles) / (4 - poles)))


def _recursive(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Direct form II transposed along axis 0, started in the steady state of the first row."""
    n = len(a) - 1
    companion = np.zeros((n, n))
    companion[0], companion[1:, :-1] = -a[1:], np.eye(n - 1)
    state = np.linalg.solve(np.eye(n) - companion.T, b[1:] - a[1:] * b[0])[:, None] * x[0]
    out = np.empty_like(x)
    for i, row in enumerate(x):
        y = b[0] * row + state[0]
        state[:-1] = state[1:] + b[1:-1, None] * row - a[1:-1, None] * y
        state[-1] = b[-1] * row - a[-1] * y
        out[i] = y
    return out


def fill_gaps(x: np.ndarray) -> np.ndarray:
    """Columns with NaN filled linearly by position, flat at the ends; one value is held, none is 0."""
    x = x.copy()
    at = np.arange(len(x))
    for column in x.T:
        known = np.isfinite(column)
        if not known.all():
            column[:] = np.interp(at, at[known], column[known]) if known.any() else 0.0
    return x


def low_pass(x: np.ndarray, fps: float, cutoff_hz: float | None) -> np.ndarray:
    """Zero-phase low-pass of the columns; as it is if there is no cutoff, it is too high or the series too short."""
    if cutoff_hz is None or cutoff_hz >= fps / 2 or len(x) <= PAD:
        return x
    gone = ~np.isfinite(x)
    out = low_pass_piece(fill_gaps(x), fps, cutoff_hz, True, True)
    out[gone] = np.nan
    return out


def low_pass_piece(full: np.ndarray, fps: float, cutoff_hz: float, starts: bool, ends: bool) -> np.ndarray:
    """Both passes over a piece of a longer series without gaps.

    Where the series itself starts or ends it is continued by its mirrored
    rows; elsewhere the outer rows of the piece only bring the filter up to
    speed and are not to be used. A piece at an end of the series has over PAD rows.
    """
    b, a = butterworth(cutoff_hz, fps)
    before, after = [2 * full[0] - full[PAD:0:-1]] if starts else [], [2 * full[-1] - full[-2 : -PAD - 2 : -1]] if ends else []
    longer = np.concatenate([*before, full, *after])
    out = _recursive(b, a, _recursive(b, a, longer)[::-1])[::-1]
    return out[PAD * starts : len(out) - PAD * ends].copy()


def fit_homography(image: np.ndarray, pitch: np.ndarray) -> np.ndarray | None:
    """Normalised direct linear transform from image to pitch points; None if singular or under four."""
    if len(image) < 4 or image.shape != pitch.shape:
        return None

    def normal(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        middle = p.mean(axis=0)
        spread = np.linalg.norm(p - middle, axis=1).mean()
        s = np.sqrt(2) / spread if spread > 0 else 1.0
        return (p - middle) * s, np.array([[s, 0, -s * middle[0]], [0, s, -s * middle[1]], [0, 0, 1]])

    (u, tu), (v, tv) = normal(image), normal(pitch)
    one, zero = np.ones(len(u)), np.zeros((len(u), 3))
    homogeneous = np.column_stack([u, one])
    system = np.vstack([np.hstack([-homogeneous, zero, homogeneous * v[:, :1]]), np.hstack([zero, -homogeneous, homogeneous * v[:, 1:]])])
    h = np.linalg.inv(tv) @ np.linalg.svd(system)[2][-1].reshape(3, 3) @ tu
    if abs(h[2, 2]) < 1e-12 or abs(np.linalg.det(h)) < 1e-12:
        return None
    return h / h[2, 2]


def fit_robust_homography(image: np.ndarray, pitch: np.ndarray, limit_px: float, tries: int = 2000) -> tuple[np.ndarray, np.ndarray]:
    """The points that agree with the best fit through four of them, to ``limit_px`` in the image.

    All fours are tried, or ``tries`` seeded ones where there are more. Of
    fits that as many points agree with, the one with the smaller errors wins. With
    under five points, or if no four fit, all points come back.
    """
    n = len(image)
    if n < 5:
        return image, pitch
    fours = list(combinations(range(n), 4)) if n <= 15 else [tuple(c) for c in np.random.default_rng(0).permuted(np.tile(np.arange(n), (tries, 1)), axis=1)[:, :4]]
    best, kept = (0, 0.0), None
    for four in fours:
        h = fit_homography(image[list(four)], pitch[list(four)])
        if h is None:
            continue
        back = np.column_stack([pitch, np.ones(n)]) @ np.linalg.inv(h).T
        with np.errstate(all="ignore"):
            error = np.linalg.norm(back[:, :2] / back[:, 2:] - image, axis=1)
        near = error <= limit_px
        score = (int(near.sum()), -float(error[near].sum()))
        if kept is None or score > best:
            best, kept = score, near
    return (image, pitch) if kept is None or best[0] < 4 else (image[kept], pitch[kept])


class RunningMedian:
    """Median of the values so far: a heap of the lower half and one of the upper half."""

    def __init__(self) -> None:
        self.low: list[float] = []  # negated
        self.high: list[float] = []

    def add(self, value: float) -> None:
        if len(self.low) > len(self.high):
            heapq.heappush(self.high, -heapq.heappushpop(self.low, -value))
        else:
            heapq.heappush(self.low, -heapq.heappushpop(self.high, value))

    def value(self) -> float:
        """NaN if there was none."""
        if len(self.low) > len(self.high):
            return -self.low[0]
        return (self.high[0] - self.low[0]) / 2 if self.low else float("nan")
