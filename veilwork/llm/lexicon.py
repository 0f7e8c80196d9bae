"""A minimal acyclic transducer: words to id lists, with shared suffixes.

States that accept the same endings are one state.  Walking a word adds up how
many words come before it, which is its number in sorted order; a flat table
has the ids of each number.  Everything lies in one file that workers map.
"""

from __future__ import annotations

import numpy as np

_HEAD = 6  # counts of the parts, as int64


def compile_words(entries: dict[bytes, list[int]]) -> bytes:
    """Build by adding sorted words and merging each finished branch with an equal one."""
    words = sorted(entries)
    register: dict[tuple, int] = {}
    arcs_of: list[list[tuple[int, int]]] = []
    final: list[bool] = []

    def settle(node: dict) -> int:
        """The number of a state equal to this finished one."""
        form = (node["final"], tuple(node["arcs"]))
        if form not in register:
            register[form] = len(arcs_of)
            arcs_of.append(list(form[1]))
            final.append(form[0])
        return register[form]

    root = {"final": False, "arcs": []}
    path = [root]  # open states along the last word
    labels: list[int] = []
    last = b""

    def close(depth: int) -> None:
        while len(path) - 1 > depth:
            done = path.pop()
            path[-1]["arcs"].append((labels.pop(), settle(done)))

    for word in words:
        same = 0
        while same < min(len(word), len(last)) and word[same] == last[same]:
            same += 1
        close(same)
        for byte in word[same:]:
            path.append({"final": False, "arcs": []})
            labels.append(byte)
        path[-1]["final"] = True
        last = word
    close(0)
    start = settle(root)

    # states are registered behind all they lead to, so one pass counts the words below
    below = np.zeros(len(arcs_of), np.int64)
    keys, targets, skips = [], [], []
    for state, arcs in enumerate(arcs_of):
        seen = int(final[state])
        for byte, target in arcs:
            keys.append(state << 8 | byte)
            targets.append(target)
            skips.append(seen)
            seen += int(below[target])
        below[state] = seen
    ids = [entries[w] for w in words]
    ends = np.cumsum([len(i) for i in ids], dtype=np.int64)
    flat = np.array([x for i in ids for x in i], np.int64)
    head = np.array([start, len(keys), len(arcs_of), len(words), len(flat), max(map(len, words), default=0)], np.int64)
    parts = [head, np.array(keys, np.int64), np.array(targets, np.int64), np.array(skips, np.int64),
             np.array(final, np.int64), ends, flat]
    return b"".join(p.astype("<i8").tobytes() for p in parts)


class Lexicon:
    """The mapped automaton; looks up many words in one vectorised walk."""

    def __init__(self, source: str | bytes):
        """From a file, which is mapped, or from its content."""
        if isinstance(source, bytes):
            data = np.frombuffer(source, "<i8")
        else:
            data = np.asarray(np.memmap(source, dtype="<i8", mode="r"))  # a plain view, still mapped
        self.start, n_arcs, n_states, n_words, n_ids, self.longest = (int(x) for x in data[:_HEAD])
        at = _HEAD

        def take(n: int):
            nonlocal at
            at += n
            return data[at - n:at]

        self.keys, self.targets, self.skips = take(n_arcs), take(n_arcs), take(n_arcs)
        self.final, self.ends, self.ids = take(n_states), take(n_words), take(n_ids)

    def find(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, or -1."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        number = np.full(len(words), -1, np.int64)
        if not len(words) or not len(self.keys):
            return number
        live = np.flatnonzero(size <= self.longest)
        text = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(size) - size
        state = np.full(len(live), self.start, np.int64)
        count = np.zeros(len(live), np.int64)
        for depth in range(self.longest + 1):
            ended = size[live] == depth
            if ended.any():
                hit = ended & (self.final[state] == 1)
                number[live[hit]] = count[hit]
                live, state, count = live[~ended], state[~ended], count[~ended]
            if not len(live):
                break
            key = state << 8 | text[begin[live] + depth]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[arc] == key
            arc, live = arc[ok], live[ok]
            state, count = np.asarray(self.targets[arc]), count[ok] + self.skips[arc]
        return number

    def output(self, number: int) -> list[int]:
        first = int(self.ends[number - 1]) if number else 0
        return self.ids[first:int(self.ends[number])].tolist()
