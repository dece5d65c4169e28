"""Prediction by partial matching over bytes: a context trie as dense tables.

Contexts are the last 0 to `order` bytes. A symbol seen in the longest known context has (count - 1/2) / total;
otherwise the context escapes with distinct / (2 * total) (method D) to the next shorter one, where the symbols of the
context just left are excluded from both numbers, down to an even share of the symbols never seen. The model is trained
once and then fixed, so each (context, byte) has one code length and a text is scored by table lookups. Bytes that
training never met share a column.
Byte xFF, which UTF-8 never uses, stands before every text and ends it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

END = 0xFF


@dataclass(frozen=True)
class Model:
    """`step[k]` leads from a context of k bytes and a byte to the context of k+1 bytes (-1: not in the trie).

    Contexts of all orders are numbered on, the empty one is 0; `logs[context, column[byte]]` is the log10 probability.
    """

    order: int
    step: list[np.ndarray]
    first: list[int]
    column: np.ndarray
    logs: np.ndarray


def framed(raw: list[bytes], order: int) -> np.ndarray:
    """All texts in one array, each with `order` marks before it and one behind."""
    mark = bytes([END])
    return np.frombuffer(b"".join(mark * order + r + mark for r in raw), np.uint8)


def _own(raw: list[bytes], order: int) -> np.ndarray:
    """Which places of `framed` are symbols to predict."""
    own = np.ones(sum(len(r) + order + 1 for r in raw), bool)
    starts = np.cumsum([0, *(len(r) + order + 1 for r in raw)])[:-1]
    for j in range(order):
        own[starts + j] = False
    return own


def codes(raw: list[bytes], order: int) -> np.ndarray:
    """The runs of `order` bytes and a symbol, as big-endian numbers: one for each byte of a text and its end."""
    data, own = framed(raw, order).astype(np.uint64), _own(raw, order)
    out = np.zeros(max(0, len(data) - order), np.uint64)
    for j in range(order + 1):
        out = (out << np.uint64(8)) | data[j : len(data) - order + j]
    return out[own[order:]]


def grams(raw: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs with their counts."""
    return np.unique(codes(raw, order), return_counts=True)


def train(codes: np.ndarray, counts: np.ndarray, order: int, max_contexts: int = 65_536) -> Model:
    """The model of the counts that `grams` gives, summed over all training texts.

    At most `max_contexts` contexts are kept, by a threshold on their counts. Shorter contexts are at least as
    frequent as the longer ones that hold them, so the trie stays whole.
    """
    levels, sizes = [], []
    for k in range(order + 1):
        mask = np.uint64((1 << (8 * (k + 1))) - 1)
        part, at = np.unique(codes & mask, return_inverse=True)
        n = np.zeros(len(part))
        np.add.at(n, at, counts)
        context, where = np.unique(part >> np.uint64(8), return_inverse=True)
        total = np.bincount(where, n, len(context))
        levels.append((part, n, context, where, total))
        sizes.append(total)
    ranked = np.sort(np.concatenate(sizes))[::-1] if len(codes) else np.zeros(0)
    least = ranked[max_contexts] + 1 if len(ranked) > max_contexts else 1

    met = np.unique(codes & np.uint64(255)).astype(int)
    column = np.full(256, len(met))
    column[met] = np.arange(len(met))
    wide = len(met) + 1
    first, step, logs = [0], [], []
    known = np.zeros(1, np.uint64)
    seen_by = rest_by = None
    for k, (part, n, context, where, total) in enumerate(levels):
        keep = (total >= least) | (k == 0)
        names = context[keep] if len(context) else known
        number = np.cumsum(keep) - 1
        table = np.zeros((len(names), wide), np.float32)
        if len(part):
            mine = keep[where]
            table[number[where[mine]], column[(part[mine] & np.uint64(255)).astype(int)]] = n[mine]
        seen = table > 0
        t, q = table.sum(axis=1, keepdims=True), seen.sum(axis=1, keepdims=True, dtype=np.float32)
        if k == 0:
            rest = np.where(seen, np.float32(0), np.float32(1 / max(1, 256 - len(met))))
        else:
            # The suffix without the oldest byte; what was seen here was seen there.
            suffix = np.searchsorted(known, names & np.uint64((1 << (8 * (k - 1))) - 1))
            left = np.where(seen, np.float32(0), seen_by[suffix])
            t2, q2 = left.sum(axis=1, keepdims=True), (left > 0).sum(axis=1, keepdims=True, dtype=np.float32)
            rest = np.where(left > 0, (left - np.float32(0.5)) / np.maximum(t2, 1), np.where(q2 > 0, q2 / np.maximum(2 * t2, 1), 1) * rest_by[suffix])
            rest[seen] = 0
        chance = np.where(seen, (table - np.float32(0.5)) / np.maximum(t, 1), np.where(t > 0, q / np.maximum(2 * t, 1), 1) * rest)
        with np.errstate(divide="ignore"):
            logs.append(np.log10(chance))
        if k:
            lead = np.searchsorted(known, names >> np.uint64(8))
            move = np.full((len(known), 256), -1, np.int32)
            move[lead, (names & np.uint64(255)).astype(int)] = np.arange(len(names))
            step.append(move.reshape(-1))
            first.append(sum(map(len, logs)) - len(names))
        known = names
        seen_by, rest_by = table, rest
    return Model(order, step, first, column, np.concatenate(logs).astype(np.float32))


def score(model: Model, raw: list[bytes]) -> np.ndarray:
    """log10 probability of each text with its end."""
    data, own = framed(raw, model.order), _own(raw, model.order)
    state = np.zeros(len(data), np.int32)
    last = np.zeros(len(data), np.int32)
    for k in range(model.order):
        at = np.full(len(data), -1, np.int32)
        # The context of k+1 bytes before place i: that of k bytes before i-1, and byte i-1.
        fits = last[:-1] >= 0
        at[1:] = np.where(fits, model.step[k][np.where(fits, last[:-1], 0) * 256 + data[:-1]], -1)
        state = np.where(at >= 0, at + model.first[k + 1], state)
        last = at
    each = np.where(own, model.logs[state, model.column[data]], 0).astype(np.float64)
    ends = np.cumsum([len(r) + model.order + 1 for r in raw])
    total = np.concatenate([[0.0], np.cumsum(each)])
    return total[ends] - total[np.concatenate([[0], ends[:-1]])]
