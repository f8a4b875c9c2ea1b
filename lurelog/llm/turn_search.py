"""Cheapest repair of a sequence of turns by depth-first branch and bound.

A turn is one symbol: the initial of its role (``s``, ``u``, ``a`` or other) and
its fault.  A repaired sequence spells ``(s?(ua)+)?``, which four states follow:
nothing yet, after ``s``, after ``u``, after ``a``.  Roles that are given anew or
inserted are those that the state asks for, so a string of edits has one outcome.

The search works on a piece of a sequence, from an entry state and with the
least costs that the rest of the sequence needs from each state behind it.
"""

from __future__ import annotations

from itertools import product

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
CHANGE_COST, DELETE_COST, TRUNCATED_COST = 3, 4, 3
START, SYSTEM, USER, ASSISTANT = range(4)
NEVER = 1 << 60
OK, DROP, CUT = range(3)
#: The state after a role's initial, where the grammar allows it.
AFTER = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The state after the role that the grammar asks for, among user and assistant.
ASKED = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: What a finished sequence still costs in each state, insertions aside.
FINISHED = (0, NEVER, NEVER, 0)
#: One letter for an initial and a fault.
SYMBOL = {pair: chr(65 + n) for n, pair in enumerate(product("sua ", (OK, DROP, CUT)))}
MEANING = {letter: pair for pair, letter in SYMBOL.items()}


def _edits(symbol: str, state: int) -> list[tuple[str, int, int]]:
    """(edit, cost, next state) that take one turn, in ASCII order of the edits."""
    initial, fault = MEANING[symbol]
    found = [(DELETE, DELETE_COST, state)]
    if fault != DROP:
        extra = TRUNCATED_COST if fault == CUT else 0
        if (state, initial) in AFTER:
            found.append((KEEP, extra, AFTER[state, initial]))
        found.append((REROLE, CHANGE_COST + extra, ASKED[state]))
    return found


EDITS = {(symbol, state): _edits(symbol, state) for symbol in MEANING for state in range(4)}


def _with_inserts(costs: list[int]) -> list[int]:
    """Least costs where turns may be inserted first."""
    best = list(costs)
    for _ in range(3):
        best = [min(best[p], CHANGE_COST + best[ASKED[p]]) for p in range(4)]
    return best


def suffix_bounds(symbols: str, behind: list[int] | tuple[int, ...]) -> list[list[int]]:
    """For every place and state a cost that no completion undercuts.

    ``behind`` has it for the states at the end; the relaxed problem leaves the audit's order out.
    """
    bounds = [list(behind)]
    for symbol in reversed(symbols):
        after = bounds[-1]
        taken = [min(cost + after[q] for _, cost, q in EDITS[symbol, p]) for p in range(4)]
        bounds.append(_with_inserts(taken))
    return bounds[::-1]


def crossing(symbols: str) -> list[int]:
    """Sixteen costs: the least from each state before the piece to each state behind it."""
    columns = [suffix_bounds(symbols, [0 if p == q else NEVER for p in range(4)])[0] for q in range(4)]
    return [min(columns[q][p], NEVER) for p in range(4) for q in range(4)]


def through(costs: list[int], behind: list[int]) -> list[int]:
    """The least costs before a piece, from those behind it."""
    return [min(min(costs[4 * p + q] + behind[q] for q in range(4)), NEVER) for p in range(4)]


#: The least costs behind the last turn, where turns may still be inserted.
END = _with_inserts(list(FINISHED))


def search(symbols: str, entry: int, behind: list[int] | None = None) -> tuple[int, str, int]:
    """(cost within the piece, audit, state behind it): cheapest as a whole, then ASCII-least.

    ``behind`` None means that the sequence ends here, so turns may be inserted at its end.
    """
    last, n = behind is None, len(symbols)
    bounds = suffix_bounds(symbols, END if last else behind)
    incumbent, found = NEVER, None
    seen = [[NEVER] * 4 for _ in range(n + 1)]  # the dominance table of each node: its cheapest prefix so far
    nodes: list[tuple[int, str]] = [(-1, "")]  # (node before, edit), so that a prefix is never copied
    stack = [(0, entry, 0, 0)]  # place, state, cost, node
    while stack:
        place, state, cost, node = stack.pop()
        # Prefixes that lead to the same node come in ASCII order where they cost the same,
        # so an equal cost already seen belongs to a better audit.
        if cost >= seen[place][state] or cost + bounds[place][state] >= incumbent:
            continue
        seen[place][state] = cost
        if place == n and (not last or FINISHED[state] == 0):
            incumbent, found = cost + (0 if last else behind[state]), (cost, node, state)
            continue
        branches = [] if place == n else [(e, c, place + 1, q) for e, c, q in EDITS[symbols[place], state]]
        if place < n or last:
            branches.append((INSERT, CHANGE_COST, place, ASKED[state]))
        # The most promising branch is taken first, among equals the ASCII-least edit.
        branches.sort(key=lambda b: (b[1] + bounds[b[2]][b[3]], b[0]), reverse=True)
        for edit, more, at, then in branches:
            total = cost + more
            if total < seen[at][then] and total + bounds[at][then] < incumbent:
                nodes.append((node, edit))
                stack.append((at, then, total, len(nodes) - 1))
    if found is None:
        raise ValueError(f"no repair of a piece of {n} turns from state {entry}")
    cost, node, state = found
    audit = []
    while node:
        node, edit = nodes[node]
        audit.append(edit)
    return cost, "".join(reversed(audit)), state
