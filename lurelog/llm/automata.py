"""Probabilistic automata inferred from example strings by merging compatible prefix-tree states.

The examples form a prefix tree with counts.  In breadth-first order each state
is compared with the states already kept at its depth: two are compatible when
their relative frequencies of ending and of every symbol differ by no more than
chance allows, and so do the states they lead to.  A compatible state is folded
into the kept one, any other is kept.  States of different depths stay apart, so
an automaton has no loops and knows no length that the examples do not have.

Behind the common beginning of the examples, small letters, capitals and digits
are a symbol each, so that states stand for places in a format and not for
random characters.  Where every place has these classes in proportion to the
characters that the examples use, they tell nothing and are one symbol.  Any
other character is a symbol of its own.

A ``Chain`` is the automaton of everything else: its states are the last two
characters, counted over all text that is no example.
"""

from __future__ import annotations

import math
import os
from collections import Counter
from collections.abc import Iterable

import numpy as np

#: Chance of telling two equal frequencies apart.
ALPHA = 0.05
IMPOSSIBLE = -math.inf


class Automaton:
    """States are numbers from 0, the start; ``moves[state][symbol]`` is ``[count, target]``."""

    def __init__(self, examples: Iterable[str], alpha: float = ALPHA):
        examples = list(examples)
        self.alpha = alpha
        self.prefix = os.path.commonprefix(examples)
        self.shortest, self.longest = min(map(len, examples)), max(map(len, examples))
        self.used = frozenset(c for x in examples for c in x[len(self.prefix) :] if c.isalnum())
        self.pooled = self._proportional(examples)
        self.ends: list[int] = []
        self.total: list[int] = []
        self.moves: list[dict[str, list[int]]] = []
        self.depth: list[int] = []
        self._new(0)
        for example in examples:
            self._grow(self._symbols(example))
        self._merge_states()
        self._tabulate()

    def _symbols(self, text: str) -> str:
        rest = text[len(self.prefix) :]
        return "".join(map(self._symbol, rest))

    def _symbol(self, c: str) -> str:
        if c not in self.used:
            return "?" if c.isalnum() else c
        return "x" if self.pooled else _class(c)

    def _proportional(self, examples: list[str]) -> bool:
        """Whether each place has the classes as often as their shares of the used characters say."""
        shares = {k: n / len(self.used) for k, n in Counter(map(_class, self.used)).items()}
        places: list[Counter] = [Counter() for _ in range(self.longest - len(self.prefix))]
        for example in examples:
            for place, c in zip(places, example[len(self.prefix) :], strict=False):
                if c in self.used:
                    place[_class(c)] += 1
        for place in places:
            bound = math.sqrt(0.5 * math.log(2 * len(places) / self.alpha) / max(1, place.total()))
            if any(abs(place[k] / max(1, place.total()) - share) > bound for k, share in shares.items()):
                return False
        return True

    def _new(self, depth: int) -> int:
        self.ends.append(0)
        self.total.append(0)
        self.moves.append({})
        self.depth.append(depth)
        return len(self.ends) - 1

    def _grow(self, symbols: str) -> None:
        """Add one example to the prefix tree."""
        state = 0
        self.total[0] += 1
        for symbol in symbols:
            move = self.moves[state].get(symbol)
            if move is None:
                move = self.moves[state][symbol] = [0, self._new(self.depth[state] + 1)]
            move[0] += 1
            state = move[1]
            self.total[state] += 1
        self.ends[state] += 1

    def _merge_states(self) -> None:
        layer = [0]
        while layer:
            kept: list[int] = []
            for parent in layer:
                for symbol in sorted(self.moves[parent]):
                    move = self.moves[parent][symbol]
                    if move[1] in kept:
                        continue
                    home = next((k for k in kept if self._compatible(k, move[1])), None)
                    if home is None:
                        kept.append(move[1])
                    else:
                        self._fold(home, move[1])
                        move[1] = home
            layer = kept

    def _compatible(self, kept: int, new: int) -> bool:
        """Compare the subtree below ``new`` with what ``kept`` says of the same strings."""
        todo = [(kept, new)]
        while todo:
            a, b = todo.pop()
            if self._differ(self.ends[a], self.total[a], self.ends[b], self.total[b]):
                return False
            for symbol in self.moves[a].keys() | self.moves[b].keys():
                x, y = self.moves[a].get(symbol), self.moves[b].get(symbol)
                if self._differ(x[0] if x else 0, self.total[a], y[0] if y else 0, self.total[b]):
                    return False
                if x and y:
                    todo.append((x[1], y[1]))
        return True

    def _differ(self, part: int, whole: int, other: int, other_whole: int) -> bool:
        """Whether two relative frequencies differ by more than the Hoeffding bound."""
        bound = math.sqrt(0.5 * math.log(2 / self.alpha)) * (1 / math.sqrt(whole) + 1 / math.sqrt(other_whole))
        return abs(part / whole - other / other_whole) > bound

    def _fold(self, home: int, state: int) -> None:
        """Add the subtree of ``state``, still a tree, to ``home`` and what follows it."""
        todo = [(home, state)]
        while todo:
            a, b = todo.pop()
            self.ends[a] += self.ends[b]
            self.total[a] += self.total[b]
            for symbol, (count, target) in self.moves[b].items():
                move = self.moves[a].get(symbol)
                if move is None:
                    self.moves[a][symbol] = [count, target]
                else:
                    move[0] += count
                    todo.append((move[1], target))

    def states(self) -> int:
        """States that the start reaches."""
        seen, todo = {0}, [0]
        while todo:
            for _, target in self.moves[todo.pop()].values():
                if target not in seen:
                    seen.add(target)
                    todo.append(target)
        return len(seen)

    def likelihood(self, text: str) -> float:
        """Bits of log-likelihood for each character, its end included; minus infinity for another format."""
        found = self.prefix_likelihoods(text)
        return found[-1] if len(found) == len(text) + 1 else IMPOSSIBLE

    def _tabulate(self) -> None:
        """For each state the bits and the target of every character, and the bits of ending."""
        letters: dict[str, list[str]] = {}
        for c in sorted(self.used):
            letters.setdefault(self._symbol(c), []).append(c)
        self.steps: list[dict[str, tuple[float, int]]] = []
        self.ending = [math.log2(n / whole) if n else IMPOSSIBLE for n, whole in zip(self.ends, self.total, strict=True)]
        for state, moves in enumerate(self.moves):
            step = {}
            for symbol, (count, target) in moves.items():
                among = letters.get(symbol, [symbol])
                bits = math.log2(count / self.total[state]) - math.log2(len(among))
                step.update(dict.fromkeys(among, (bits, target)))
            self.steps.append(step)

    def prefix_likelihoods(self, text: str) -> list[float]:
        """The likelihood of the first 0, 1, 2, ... characters of the text, as far as a format goes on."""
        if not text.startswith(self.prefix):
            return []
        state, bits, length = 0, 0.0, len(self.prefix)
        steps, ending = self.steps, self.ending
        found = [IMPOSSIBLE] * length + [ending[0] / (length + 1)]
        for c in text[length:]:
            step = steps[state].get(c)
            if step is None:
                break
            bits += step[0]
            state = step[1]
            length += 1
            found.append((bits + ending[state]) / (length + 1))
        return found


def _class(c: str) -> str:
    return "0" if c.isdigit() else "A" if c.isupper() else "a"


class Chain:
    """What follows two characters; ``counts[a, b, c]`` over places in ``alphabet`` from 1, 0 for outside of it."""

    #: Weight of what a shorter context says, as a number of observations.
    TRUST = 4.0

    def __init__(self, alphabet: bytes, counts: np.ndarray):
        self.size = len(alphabet) + 1
        self.place = {chr(c): k + 1 for k, c in enumerate(alphabet)}
        behind_two = counts.reshape(self.size, self.size, self.size).astype(float)
        behind_one = behind_two.sum(0)
        share = np.full(self.size, 1 / self.size)
        for seen in (behind_one.sum(0), behind_one, behind_two):
            whole = seen.sum(-1, keepdims=True)
            share = (np.maximum(seen - 1, 0) + self.TRUST * share) / (np.maximum(whole - 1, 0) + self.TRUST)
        #: Bits of the last of three places by all that was counted but one occurrence of them.
        self.bits = np.log2(share)

    def likelihood(self, run: str, begin: int, end: int) -> float:
        """Bits of ``run[begin:end]`` between its neighbours in the run, by all that was counted but this occurrence."""
        around = [0, 0, *map(self.place.__getitem__, run[max(0, begin - 2) : end + 1]), 0]
        at = 2 + min(begin, 2)
        places = np.array(around[at - 2 : at + end - begin + 1])
        return float(self.bits[places[:-2], places[1:-1], places[2:]].sum())
