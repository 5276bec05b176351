"""The run-length index of operator 9: a run-compressed Burrows-Wheeler transform of aligned strings, and matching statistics.

The strings of one anchor are aligned at it, so the transform is built column by column, right to left, as for a
collection of strings that all gain a byte at a time: the rows stand in the order of what follows, and the column's bytes
in that order are this column of the transform. What is kept of a column is its runs: where each begins, where it goes
when the column is sorted (the run's last-to-first step), and a sample at the run's end, the longest common prefix of the
row that the step puts at its head with the row above it. Orders and prefix lengths of single rows are working arrays of
the build and go with it.

``stream`` reads the index alone. A string starts at its row of the last column and takes a step a column: its place is
found among the run heads, and its match with the rows above and below grows by a byte unless it stands at its run's end,
where the sample tells it. The larger of the two is the matching statistic: how many bytes from here on, ``length`` at
most, stand at the same column of another row of the group.
"""

from __future__ import annotations

import numpy as np

PAD = 0xFF


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The length of the common prefix of rows."""
    differ = a != b
    return np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])


class RunIndex:
    """rows: bytes, of columns + length - 1 columns. group: ascending numbers; rows of different groups never match."""

    def __init__(self, rows: np.ndarray, group: np.ndarray, length: int, columns: int):
        m, last = len(rows), columns - 1
        self.size, self.length, self.columns = m, length, columns
        tail = np.ascontiguousarray(rows[:, last : last + length])
        order = np.lexsort((tail.view(f"V{length}").ravel().argsort(kind="stable").argsort(kind="stable"), group)) if m > 1 else np.arange(m)
        lcp = np.zeros(m + 1, np.int32)
        if m > 1:
            lcp[1:m] = np.where(group[order][1:] == group[order][:-1], _common(tail[order[1:]], tail[order[:-1]]), 0)
        #: Where each string enters, and the prefix lengths above each row, of the last column.
        self.entry = np.empty(m, np.int32)
        self.entry[order] = np.arange(m, dtype=np.int32)
        self.first_lcp = lcp.copy()
        #: Of each column before, last to first: the runs' heads, where they go, and the samples, by run and by order of arrival.
        self.runs: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        base = group.astype(np.int64) << 8
        for column in range(last - 1, -1, -1):
            keys = (base + rows[:, column])[order]
            heads = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
            ends = np.concatenate([heads[1:], [m]])
            by = np.argsort(keys[heads], kind="stable")
            grown = np.minimum(lcp + 1, length)
            heads_to, ends_to, run_keys = heads[by], ends[by], keys[heads][by]
            joins = np.concatenate([[False], run_keys[1:] == run_keys[:-1]])
            sample = np.zeros(len(by), np.int32)
            if joins.any():  # the rows that become neighbours agree for as long as all between them did
                at = np.flatnonzero(joins)
                bounds = np.stack([ends_to[at - 1], heads_to[at] + 1], axis=1).ravel()
                sample[at] = np.minimum(np.minimum.reduceat(np.concatenate([lcp, [0]]), bounds)[::2] + 1, length)
            sizes = ends_to - heads_to
            starts = np.cumsum(sizes) - sizes
            above, below, to = np.empty(len(by), np.int32), np.empty(len(by), np.int32), np.empty(len(by), np.int32)
            above[by], below[by], to[by] = sample, np.append(sample[1:], 0), starts
            self.runs.append((heads.astype(np.int32), to, above, below))
            move = np.repeat(heads_to - starts, sizes) + np.arange(m)
            order, lcp = order[move], np.append(grown[move], 0)
            lcp[starts] = sample
            lcp[m] = 0

    @property
    def run_count(self) -> int:
        return sum(len(heads) for heads, *_ in self.runs)

    def stream(self):
        """(column, matching statistic of each string there), last column to first."""
        at, m, length = self.entry.copy(), self.size, self.length
        above, below = self.first_lcp[:m][at], self.first_lcp[1:][at]
        yield self.columns - 1, np.maximum(above, below)
        for column, (heads, to, head_sample, end_sample) in zip(range(self.columns - 2, -1, -1), self.runs, strict=True):
            run = np.searchsorted(heads, at, side="right") - 1
            ends = np.append(heads[1:], m)
            above = np.where(at == heads[run], head_sample[run], np.minimum(above + 1, length))
            below = np.where(at == ends[run] - 1, end_sample[run], np.minimum(below + 1, length))
            at = to[run] + (at - heads[run])
            yield column, np.maximum(above, below)


def matching_columns(rows: np.ndarray, group: np.ndarray, length: int, columns: int, valid: np.ndarray) -> np.ndarray:
    """For each row and start column below ``columns``, whether its ``length`` bytes also stand at that column in another row of its group.

    valid: (rows, columns) starts that count. Outside the strings rows are padded with ``PAD``, which no UTF-8 text has, so
    a start that is not valid is never matched; that it matches does not count.
    """
    out = np.zeros((len(rows), columns), bool)
    for column, statistic in RunIndex(rows, group, length, columns).stream():
        out[:, column] = statistic >= length
    return out & valid
