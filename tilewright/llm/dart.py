"""Weighted minwise signatures by thrown darts (DartMinHash).

An element of weight w owns, for each document that has it, the strip [0, w) x [0, inf) of
a plane (weight x rank). Darts fall on the plane as a Poisson process of one dart to a
unit cell, drawn from a hash of the element and the cell, so that every document sees the
same darts. Each dart has a coordinate, drawn likewise. A document keeps, for each
coordinate, the dart of least rank in its strips. Two documents keep the same dart with
a probability that is their weighted Jaccard similarity: sum of smaller over sum of
larger weights.

Slabs of the rank axis are taken until about k ln k + 5k darts are expected, which most
likely fills all coordinates, and doubled for the documents where they don't. So a
signature costs about the larger of the document's weight and k ln k. After six doublings a
coordinate is left empty, and beyond slab 4,095 ranks count as equal: a coordinate gets so far with
a chance of exp(-4095 / k) for one shingle, the least weight, 2e-14 for k = 130, and less for more.
"""

from __future__ import annotations

import numpy as np

from tilewright.llm.kernel import U, mix

#: Bits of a dart's place within its slab; its slab stands above them.
FINE = 28
#: Cells drawn at once.
CELLS = 1 << 20
_CDF = (np.cumsum(np.exp(-1.0) / np.cumprod(np.concatenate([[1.0], np.arange(1.0, 20.0)]))) * 2.0**64).clip(0, 2.0**64 * (1 - 2**-53)).astype(U)
_EMPTY = U(2**64 - 1)


def _throw(gram: np.ndarray, weight: np.ndarray, doc: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> np.ndarray:
    """Sorted (document, coordinate, rank) of the darts of elements in the slabs [low, high) of their documents, packed in 64 bits."""
    tall, deep = np.ceil(weight).astype(np.int64), (high - low)[doc]
    cells = tall * deep
    of = np.repeat(np.arange(len(gram)), cells)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(cells) - cells, cells)
    slab = low[doc[of]] + nth // tall[of]
    level = nth % tall[of]
    seed = mix(gram[of] ^ mix((slab.astype(U) << U(32)) + level.astype(U) + U(0xA0761D6478BD642F)))
    darts = np.searchsorted(_CDF, seed, side="right")
    cell = np.repeat(np.arange(len(of)), darts)
    which = np.arange(len(cell)) - np.repeat(np.cumsum(darts) - darts, darts)
    one = mix(seed[cell] + (which.astype(U) + U(1)) * U(0xE7037ED1A0B428DB))
    two = mix(one ^ U(0x8EBC6AF09C88C6E3))
    # where in its level the dart fell; only the topmost level of an uneven weight is cut
    above = level[cell] + (two >> U(11)).astype(np.float64) * 2.0**-53
    hit = above < weight[of[cell]]
    cell, one = cell[hit], one[hit]
    coordinate = (one >> U(40)) % U(k)
    rank = (np.minimum(slab[cell], (1 << 12) - 1).astype(U) << U(FINE)) | (one & U((1 << FINE) - 1))
    return np.sort(((doc[of[cell]].astype(U) * U(k) + coordinate) << U(40)) | rank)


def signatures(gram: np.ndarray, doc: np.ndarray, weight: np.ndarray, n_docs: int, k: int) -> np.ndarray:
    """Signatures (n_docs x k) of documents with elements ``gram`` of some weight, ordered by document. Documents without weight have none: all bits set."""
    out = np.full((n_docs, k), _EMPTY, U)
    total = np.bincount(doc, weight, n_docs)
    need = k * np.log(k) + 5 * k
    slabs = np.ceil(need / np.maximum(total, 1e-9)).astype(np.int64)
    slabs[total == 0] = 0
    first = np.searchsorted(doc, np.arange(n_docs + 1))
    up = np.bincount(doc, np.ceil(weight), n_docs)
    low, todo = np.zeros(n_docs, np.int64), np.flatnonzero(total > 0)
    high = slabs.copy()
    for _ in range(6):
        cost = np.cumsum(up[todo] * (high - low)[todo])
        a = 0
        while a < len(todo):
            b = max(a + 1, int(np.searchsorted(cost, (cost[a - 1] if a else 0) + CELLS, side="right")))
            some = todo[a:b]
            pick = np.concatenate([np.arange(first[d], first[d + 1]) for d in some]) if len(some) < n_docs else np.arange(len(gram))
            local = np.searchsorted(some, doc[pick])
            thrown = _throw(gram[pick], weight[pick], local, low[some], high[some], k)
            slot = thrown >> U(40)
            new = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]])) if len(slot) else np.zeros(0, np.int64)
            row, column = some[(slot[new] // U(k)).astype(np.int64)], (slot[new] % U(k)).astype(np.int64)
            out[row, column] = np.minimum(out[row, column], thrown[new] & U((1 << 40) - 1))
            a = b
        todo = todo[(out[todo] == _EMPTY).any(1)]
        if not len(todo):
            break
        low[todo] = high[todo]
        high[todo] *= 2
    return out


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key of each run of ``rows`` coordinates; different runs have different keys for equal values."""
    bands = signature.shape[1] // rows
    keys = np.empty((len(signature), bands), U)
    for b in range(bands):
        key = np.full(len(signature), U((b + 1) * 0x9E3779B97F4A7C15 % 2**64), U)
        for j in range(rows):
            key = mix(key ^ signature[:, b * rows + j])
        keys[:, b] = key
    return keys
