"""Spectra of low resolution: filtering by local intensity, and the weighted sum of matched ions."""

from __future__ import annotations

from spectraloom.functions.scoring import PROTON, prefix_masses, residues, score_error


def local_filter(mz, intensity, reach: int = 50, top: int = 20):
    """Peaks no lower than the top-th highest unit of mass within ``reach`` of them, with intensities as
    shares of the highest there. A unit of mass is as high as its highest peak. Arrays by m/z."""
    import numpy as np

    if not len(mz):
        return mz, intensity
    order = np.argsort(mz, kind="stable")
    mz, height = mz[order], intensity[order] / intensity.max() * 100
    unit = mz.astype(int)
    units = np.zeros(int(unit.max()) + 1)
    np.maximum.at(units, unit, height)
    near = np.lib.stride_tricks.sliding_window_view(np.pad(units, (reach, reach)), 2 * reach)[: len(units)]
    keep = height >= np.partition(near, -top, axis=1)[unit, -top]
    return mz[keep], (height / near.max(axis=1)[unit])[keep]


def highest_near(mz, height, at: float, tol: float) -> int | None:
    """The highest peak within the tolerance, the first among equals."""
    import numpy as np

    lo, hi = np.searchsorted(mz, at - tol), np.searchsorted(mz, at + tol, "right")
    return int(lo + height[lo:hi].argmax()) if hi > lo else None


def doubled_side(peptide: str) -> list[bool]:
    """For each bond, from the right: whether the y ion gets the second charge of a triply charged
    peptide, as its residues are the more basic ones (R, K, H count 4, Q, N 2, others 1)."""
    base = [4 if r[0] in "RKH" else 2 if r[0] in "QN" else 1 for r in residues(peptide)]
    total, right, out = sum(base), 0, []
    for b in base[:0:-1]:
        right += b
        out.append(2 * right >= total)
    return out


def weighted_sum(peptide: str, z: int, mz, height, masses: dict[str, float], tol: float) -> float:
    """Sum over bonds of the weights of the b and y ions found there: closeness and height, twice where
    both are found; from charge 3 the more basic side also counts its doubly charged ion. An ion whose
    neighbour before it is found as well counts once more, and so does that neighbour, unless its own
    bond was complete and followed another."""
    b, y = prefix_masses(peptide, masses)
    bonds = len(b) - 1
    double = doubled_side(peptide) if z >= 3 else [None] * bonds

    def weight(mass: float, charge: int) -> float:
        at = mass / charge + PROTON
        i = highest_near(mz, height, at, tol)
        return 0.0 if i is None else score_error(mz[i] - at, tol) + float(height[i])

    total, before, full = 0.0, (0.0, 0.0), (False, False)
    for n in range(bonds):
        own = [weight(y[n], 1), weight(b[bonds - 1 - n], 1)]
        if double[n] is not None:
            side = 0 if double[n] else 1
            own[side] += weight((y[n], b[bonds - 1 - n])[side], 2)
        both = min(own) > 0
        total += sum(own) * (2 if both else 1)
        follows = tuple(p > 0 for p in before)
        for side in (0, 1):
            if follows[side]:
                total += own[side] + (0.0 if full[side] else before[side])
        full = tuple(both and f for f in follows)
        before = tuple(own)
    return total
