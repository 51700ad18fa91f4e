"""A minimal acyclic transducer from words to rows of token ids, kept in one file that tasks map into memory."""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Callable, Sequence
from pathlib import Path

import numpy as np



def compile_lexicon(words: Sequence[bytes], encode: Callable[[bytes], Sequence[int]]) -> bytes:
    """The file for distinct ``words`` in ascending order, ``encode`` giving each word's ids.

    States with the same continuations are one state, so that suffixes are shared; words come sorted, so that
    the states of a word's tail are final as soon as the next word leaves its path. A transition's output is the
    number of words that sort before those through it; the outputs along a word's path add up to the word's row
    in the table of ids. Transitions lie sorted by (state, byte).
    """
    registry: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []

    def settle(node: list) -> int:
        key = (node[0], tuple(node[1].items()))
        if (state := registry.get(key)) is None:
            state = registry[key] = len(states)
            states.append(key)
        return state

    path: list[list] = [[False, {}]]  # of the word before: whether a word ends here, target by byte
    before = b""
    for word in [*words, None]:
        shared = 0
        if word is not None:
            while shared < min(len(before), len(word)) and before[shared] == word[shared]:
                shared += 1
        for depth in range(len(before), shared, -1):
            node = path.pop()
            path[-1][1][before[depth - 1]] = settle(node)
        if word is None:
            break
        path.extend([False, {}] for _ in word[shared:])
        path[-1][0] = True
        before = word
    root = settle(path[0])
    below = np.zeros(len(states), np.int64)
    for state, (ends, edges) in enumerate(states):  # a state's targets come before it
        below[state] = ends + sum(below[target] for _, target in edges)
    keys, targets, outputs = [], [], []
    for state, (ends, edges) in enumerate(states):
        passed = int(ends)
        for byte, target in edges:
            keys.append(state * 256 + byte)
            targets.append(target)
            outputs.append(passed)
            passed += int(below[target])
    order = np.argsort(np.array(keys, np.int64)) if keys else np.zeros(0, np.int64)
    rows = [encode(word) for word in words]
    starts = np.zeros(len(rows) + 1, np.int64)
    np.cumsum([len(row) for row in rows], out=starts[1:])
    ids = np.fromiter((i for row in rows for i in row), np.int64, int(starts[-1]))
    final = np.array([ends for ends, _ in states], np.int64)
    parts = [np.array([len(keys), len(states), len(rows), len(ids), root], np.int64)]
    parts += [np.array(x, np.int64)[order] for x in (keys, targets, outputs)] + [final, starts, ids]
    return b"".join(x.tobytes() for x in parts)


class Lexicon:
    """A compiled file, mapped into memory."""

    def __init__(self, path: str) -> None:
        data = np.memmap(path, np.int64, "r")
        edges, states, rows, ids, self.root = (int(x) for x in data[:5])
        cuts = np.cumsum([5, edges, edges, edges, states, rows + 1, ids])
        self.keys, self.targets, self.outputs, self.final, self.starts, self.ids = (data[a:b] for a, b in zip(cuts, cuts[1:], strict=False))

    def rows(self, words: Sequence[bytes]) -> np.ndarray:
        """Each word's row, or -1; all words walk a byte at a time together."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        at = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(words) else lengths
        found, state = np.zeros(len(words), np.int64), np.full(len(words), self.root, np.int64)
        alive, step = np.arange(len(words)), 0
        while len(alive) and len(self.keys):
            ended = lengths[alive] == step
            done = alive[ended]
            found[done[self.final[state[done]] == 0]] = -1
            alive = alive[~ended]
            if not len(alive):
                return found
            key = state[alive] * 256 + flat[at[alive] + step]
            edge = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            there = self.keys[edge] == key
            found[alive[~there]] = -1
            alive, edge = alive[there], edge[there]
            found[alive] += self.outputs[edge]
            state[alive] = self.targets[edge]
            step += 1
        found[alive] = -1
        return found


#: By Spark application, the driver's folder of files that it carries.
_FOLDERS: dict[str, str] = {}


def ship(spark, data: bytes) -> str:
    """Have Spark carry the file to every executor, also to those that come later; gives its name there."""
    name = f"lexicon-{hashlib.sha256(data).hexdigest()[:24]}.bin"
    context = spark.sparkContext
    if context.applicationId not in _FOLDERS:
        _FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="bidlake-lexicon-")
    path = Path(_FOLDERS[context.applicationId], name)
    if not path.exists():
        partial = Path(f"{path}.{os.getpid()}")
        partial.write_bytes(data)
        partial.rename(path)
        context.addFile(str(path))
    return name
