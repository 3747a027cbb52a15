"""Exchange of token hashes by ranges of hash space, in packed rows.

A mapper cuts the hashes of a batch into parts by their upper half; a row holds
what one batch has for one part: 32 lower bits for each token, with the owners
in runs. The number of parts follows the number of tokens (PART_TOKENS each),
so part and lower bits together tell tokens apart equally well at every size,
and a reducer's memory stays bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

from lithospark.llm.textkernel import U64

PART_TOKENS = 1 << 18


def part_count(tokens: int) -> int:
    return max(1, -(-tokens // PART_TOKENS))


def part_of(tokens: np.ndarray, parts: int) -> np.ndarray:
    return (((tokens >> U64(32)) * U64(parts)) >> U64(32)).astype(np.int64)


def low(tokens: np.ndarray) -> np.ndarray:
    return (tokens & U64(0xFFFFFFFF)).astype(np.uint32)


def cut_parts(tokens: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts tokens by part, stably, and where each part begins in it."""
    part = part_of(tokens, parts)
    order = np.argsort(part.astype(np.uint16) if parts < 1 << 16 else part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def owned_rows(owners: np.ndarray, tokens: np.ndarray, parts: int) -> Iterator[tuple[int, bytes, bytes, np.ndarray, np.ndarray]]:
    """(part, owners of runs, lengths of runs, order, slice) for each part that has tokens.

    owners: an int64 for each token, equal ones adjacent. The caller takes what
    it sends of each token through the returned positions.
    """
    order, begin = cut_parts(tokens, parts)
    own = owners[order]
    for p in np.flatnonzero(np.diff(begin)).tolist():
        a, b = begin[p], begin[p + 1]
        o = own[a:b]
        change = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]]))
        runs = np.diff(np.append(change, b - a)).astype(np.uint32)
        yield p, o[change].tobytes(), runs.tobytes(), order[a:b]


def steps(places: np.ndarray) -> tuple[bytes, bytes]:
    """Ascending places of less than 2^24, each as its distance from the one before: the lower 8 bits of all, and 16 more (none if all are 0)."""
    step = np.diff(places, prepend=0)
    high = (step >> 8).astype(np.uint16)
    return step.astype(np.uint8).tobytes(), high.tobytes() if high.any() else b""


def places(rows: pd.DataFrame) -> np.ndarray:
    """The places of all rows, from the columns low and high of steps()."""
    size = rows.low.str.len().to_numpy(np.int64)
    step = joined(rows.low, np.uint8).astype(np.int64)
    step[np.repeat(rows.high.str.len().to_numpy() > 0, size)] += joined(rows.high, np.uint16).astype(np.int64) << 8
    at = np.concatenate([[0], np.cumsum(step)])
    return at[1:] - np.repeat(at[np.cumsum(size) - size], size)


def joined(column, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind)
