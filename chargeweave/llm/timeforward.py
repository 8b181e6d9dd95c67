"""Subtree totals of a forest by time-forward processing.

Nodes come deepest level first. A node takes the messages addressed to it from a priority queue, adds
its own values and sends the totals to its parent through the same queue. The queue keeps at most
``HELD`` messages in memory; what is more goes to sorted runs in the task's own anonymous files,
which no other task reads and which a repeated task writes anew.
"""

from __future__ import annotations

import heapq
import pickle
import tempfile
from collections.abc import Iterable, Iterator

HELD = 200_000
_BLOCK = 4096


def _run(messages: list) -> Iterator:
    """Messages in order, read back from a file block by block."""
    with tempfile.TemporaryFile() as file:
        for k in range(0, len(messages), _BLOCK):
            pickle.dump(messages[k : k + _BLOCK], file)
        messages.clear()
        file.seek(0)
        yield  # written; what follows is read on demand
        while True:
            try:
                block = pickle.load(file)
            except EOFError:
                return
            yield from block


class SpillingQueue:
    """A priority queue of comparable messages that come out in ascending order."""

    def __init__(self, held: int = HELD):
        self.held = held
        self.heap: list = []
        self.runs: list = []  # heap of (next message, number, rest of the run)
        self.spilled = 0

    def push(self, message) -> None:
        heapq.heappush(self.heap, message)
        if len(self.heap) > self.held:
            self._spill()

    def _spill(self) -> None:
        """The later half goes to a file: it is needed last."""
        self.heap.sort()
        half = len(self.heap) // 2
        run = _run(self.heap[half:])
        del self.heap[half:]
        next(run)
        self.spilled += 1
        heapq.heappush(self.runs, (next(run), self.spilled, run))

    def least(self):
        """The first message, None if there is none."""
        tops = [x[0] for x in (self.heap[:1], [r[0] for r in self.runs[:1]]) if x]
        return min(tops, default=None)

    def pop(self):
        if not self.runs or self.heap and self.heap[0] <= self.runs[0][0]:
            return heapq.heappop(self.heap)
        first, number, run = self.runs[0]
        following = next(run, None)
        if following is None:
            heapq.heappop(self.runs)
        else:
            heapq.heapreplace(self.runs, (following, number, run))
        return first


def subtree_totals(nodes: Iterable[tuple], held: int = HELD) -> Iterator[tuple]:
    """(depth, key, children, totals) of each node, in the order given.

    ``nodes`` are (depth, key, parent key or None, own values, children counted already), ordered by
    depth descending, then key. The first value counts leaves: a childless node adds one to it. A
    node without parent here sends nothing. A message is (-depth, key of the receiver, values).
    """
    queue = SpillingQueue(held)
    for depth, key, parent, own, children in nodes:
        totals = list(own)
        while (message := queue.least()) is not None and message[:2] <= (-depth, key):
            queue.pop()
            if message[:2] != (-depth, key):
                raise ValueError(f"a message for {message[:2]} came after its node")
            children += 1
            totals = [a + b for a, b in zip(totals, message[2], strict=True)]
        if not children:
            totals[0] += 1
        yield depth, key, children, totals
        if parent is not None:
            queue.push((1 - depth, parent, totals))
    if queue.least() is not None:
        raise ValueError("a message has no receiver")
