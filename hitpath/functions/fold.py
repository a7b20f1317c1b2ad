"""Folding one user's request sequence into a loop pattern.

A pattern is a word (the leaves) plus a set of *loops*, closed intervals of
leaf positions that repeat. Loops are nested or apart, never partly
overlapping, so word and loops together describe a tree.

When a request is added, the fold looks for the shortest repetition that now
ends the word: a copy ``w[s..p]`` directly followed by ``w[p+1..]`` with the
same leaves. It qualifies if

* the cut behind ``p`` lies between two top-level parts of the pattern,
* no loop of the first copy straddles its start ``s``, and
* the loops of both copies, laid over each other, still nest.

The second copy is then dropped from the word, its loops move to the first
one, and ``[s, p]`` becomes a loop. A user's state is the folded pattern, not
the sequence.
"""

from __future__ import annotations

from collections import defaultdict

# Copies of at least this many leaves are looked up by their last leaves.
_GRAM = 8


def nests(loops) -> bool:
    """Whether no two of the intervals partly overlap."""
    open_ends: list[int] = []
    for lo, hi in sorted(loops, key=lambda loop: (loop[0], -loop[1])):
        while open_ends and open_ends[-1] < lo:
            open_ends.pop()
        if open_ends and open_ends[-1] < hi:
            return False
        open_ends.append(hi)
    return True


class Folder:
    """Incremental fold of one sequence."""

    def __init__(self):
        self.leaves: list[str] = []
        # Starts of the loops that end at each position.
        self._starts: list[set[int]] = []
        # Whether a top-level part of the pattern ends at each position.
        self._part_end: list[bool] = []
        # Positions by the _GRAM leaves that end there, in ascending order.
        self._grams: defaultdict[tuple, list[int]] = defaultdict(list)

    @classmethod
    def resume(cls, leaves, loops) -> Folder:
        """A folder in the state that had these ``leaves`` and ``loops``.

        They are the whole state: a top-level part ends wherever no loop goes
        on, and the gram table follows from the word. So a sequence may be
        folded in several goes.
        """
        folder = cls()
        folder.leaves = list(leaves)
        folder._starts = [set() for _ in folder.leaves]
        folder._part_end = [True] * len(folder.leaves)
        for lo, hi in loops:
            folder._starts[hi].add(lo)
            folder._part_end[lo:hi] = [False] * (hi - lo)
        for last in range(_GRAM - 1, len(folder.leaves)):
            folder._grams[tuple(folder.leaves[last + 1 - _GRAM : last + 1])].append(last)
        return folder

    def add(self, leaf: str) -> None:
        word = self.leaves
        word.append(leaf)
        self._starts.append(set())
        self._part_end.append(True)
        last = len(word) - 1
        for size in self._copy_sizes():
            if self._part_end[last - size] and self._collapse(size):
                return
        if last + 1 >= _GRAM:
            self._grams[tuple(word[-_GRAM:])].append(last)

    def _copy_sizes(self):
        """Sizes of the repetitions that end the word, shortest first."""
        word = self.leaves
        n = len(word)
        for size in range(1, min(_GRAM - 1, n // 2) + 1):
            if word[n - 1 - size] == word[-1] and word[n - 2 * size : n - size] == word[n - size :]:
                yield size
        if n >= 2 * _GRAM:
            for p in reversed(self._grams.get(tuple(word[-_GRAM:]), ())):
                size = n - 1 - p
                if 2 * size > n:
                    return
                s = p - size + 1
                # Compare the heads first: a copy is as long as the word allows.
                if size >= _GRAM and word[s : s + _GRAM] == word[p + 1 : p + 1 + _GRAM] and word[s : p + 1] == word[p + 1 :]:
                    yield size

    def _collapse(self, size: int) -> bool:
        p = len(self.leaves) - 1 - size
        s = p - size + 1
        merged = {(s, p)}
        for at in range(s, p + 1):
            merged.update((lo, at) for lo in self._starts[at] if lo >= s)
            if at < p and any(lo < s for lo in self._starts[at]):
                return False
            merged.update((lo - size, at) for lo in self._starts[at + size])
        if not nests(merged):
            return False

        self._truncate(p)
        for lo, hi in merged:
            self._starts[hi].add(lo)
        for at in range(s, p):
            self._part_end[at] = False
        return True

    def _truncate(self, p: int) -> None:
        word = self.leaves
        # The newest leaf has not been entered into the gram table yet.
        for at in range(len(word) - 2, p, -1):
            if at + 1 >= _GRAM:
                gram = tuple(word[at + 1 - _GRAM : at + 1])
                positions = self._grams[gram]
                positions.pop()
                if not positions:
                    del self._grams[gram]
        del word[p + 1 :], self._starts[p + 1 :], self._part_end[p + 1 :]

    @property
    def loops(self) -> list[tuple[int, int]]:
        return sorted((lo, hi) for hi, starts in enumerate(self._starts) for lo in starts)


def fold(sequence) -> tuple[list[str], list[tuple[int, int]]]:
    """Leaves and loops of a whole sequence."""
    folder = Folder()
    for leaf in sequence:
        folder.add(leaf)
    return folder.leaves, folder.loops


def pattern_text(leaves, loops) -> str:
    """``A -> (B -> C)*``: leaves joined by arrows, loops in brackets."""
    opened: defaultdict[int, int] = defaultdict(int)
    closed: defaultdict[int, int] = defaultdict(int)
    for lo, hi in loops:
        opened[lo] += 1
        closed[hi] += 1
    return " -> ".join("(" * opened[i] + leaf + ")*" * closed[i] for i, leaf in enumerate(leaves))
