"""The cheapest edits of a list of turns: depth-first branch-and-bound.

A node is a place in the list and a state of the role grammar ``(s?(ua)+)?``; its children
are the edits that may come next.  Nodes wait on an explicit stack.  A lower bound of every
suffix, the cheapest completion by cost alone, orders the children and prunes nodes that
cannot beat the incumbent ``(cost, audit)``; a dominance table keeps for every place and
state the best prefix so far and drops those that are no better.  When the stack is empty,
the incumbent is proved to be the cheapest, and of the cheapest the ASCII-least.

Equal costs never meet in one place as a prefix of one another, because every edit that
consumes no row costs something; so a smaller prefix stays smaller however it is completed.
"""

from __future__ import annotations

from collections.abc import Collection, Sequence

KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 3, 4, 3, 3
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
# States of the grammar: nothing yet, after a system turn, after a user's, after an answer.
START, SYSTEM, USER, ANSWER = range(4)
STATES = (START, SYSTEM, USER, ANSWER)
ACCEPTED = (START, ANSWER)
SPOKEN = {START: USER, SYSTEM: USER, USER: ANSWER, ANSWER: USER}
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ANSWER, "u"): USER,
        (USER, "a"): ANSWER}
NEVER = float("inf")

Way = tuple[int, str]


def _edits(initial: str, fault: int, state: int) -> list[tuple[str, int, int]]:
    """``(letter, cost, next state)`` of the edits that consume a row, in ASCII order."""
    options = [("D", DELETE, state)]
    if fault not in (BLANK, DUPLICATE):
        extra = UNFINISHED if fault == TRUNCATED else 0
        kept = KEPT.get((state, initial))
        if kept is not None:
            options.append(("K", KEEP + extra, kept))
        options.append(("R", REROLE + extra, SPOKEN[state]))
    return options


def suffix_bounds(rows: Sequence[tuple[str, int]], accepted: Collection[int]) -> list[list[float]]:
    """For every place and state no more than any completion from there costs."""
    bounds = [[NEVER] * len(STATES) for _ in range(len(rows) + 1)]
    for i in range(len(rows), -1, -1):
        here = bounds[i]
        for state in STATES:
            if i == len(rows):
                here[state] = 0 if state in accepted else NEVER
            else:
                here[state] = min(
                    cost + bounds[i + 1][to] for _, cost, to in _edits(*rows[i], state))
        for _ in range(2):  # inserted turns alternate, two lead back
            for state in STATES:
                here[state] = min(here[state], INSERT + here[SPOKEN[state]])
    return bounds


def search(
    rows: Sequence[tuple[str, int]], start: int = START, accepted: Collection[int] = ACCEPTED
) -> Way | None:
    """``(cost, audit)`` of the cheapest edits from ``start`` to one of ``accepted``.

    ``rows`` are ``(initial of the role, fault)``.  None if no edits lead there.
    """
    bounds = suffix_bounds(rows, accepted)
    best: Way | None = None
    table: dict[tuple[int, int], Way] = {}
    stack = [(0, start, 0, "")]
    while stack:
        i, state, cost, audit = stack.pop()
        bound = cost + bounds[i][state]
        if bound == NEVER or best and (bound, audit) > (best[0], best[1][: len(audit)]):
            continue
        way = (cost, audit)
        if (i, state) in table and table[i, state] <= way:
            continue
        table[i, state] = way
        if i == len(rows) and state in accepted and (best is None or way < best):
            best = way
        children = [(cost + INSERT, "I", i, SPOKEN[state])]
        if i < len(rows):
            children += [(cost + c, letter, i + 1, to) for letter, c, to in _edits(*rows[i], state)]
        children.sort(key=lambda c: (c[0] + bounds[c[2]][c[3]], c[1]), reverse=True)
        stack += [(j, to, c, audit + letter) for c, letter, j, to in children]
    return best


def ways(rows: Sequence[tuple[str, int]], whole: bool) -> list[tuple[int, int, int, str]]:
    """``(entry, exit, cost, audit)`` of a block of rows.

    A ``whole`` conversation is entered at the start and left where it may end; a part of one
    is solved between all states, so that parts can be chained.
    """
    pairs = [(START, e) for e in ACCEPTED] if whole else [(a, b) for a in STATES for b in STATES]
    found = [(a, b, search(rows, a, (b,))) for a, b in pairs]
    return [(a, b, *way) for a, b, way in found if way is not None]


class Chain:
    """Cheapest ways through blocks that come one after the other.

    The letters on which all open ways agree are put aside, so what is copied for each block
    does not grow with the number of blocks.
    """

    def __init__(self):
        self.settled: list[str] = []
        self.open: dict[int, Way] = {START: (0, "")}

    def add(self, block: Sequence[tuple[int, int, int, str]]) -> None:
        reached: dict[int, Way] = {}
        for entry, leave, cost, audit in block:
            if entry in self.open:
                before = self.open[entry]
                way = (before[0] + cost, before[1] + audit)
                reached[leave] = min(reached.get(leave, way), way)
        texts = [a for _, a in reached.values()]
        low, high = min(texts), max(texts)
        same = 0
        while same < min(len(low), len(high)) and low[same] == high[same]:
            same += 1
        self.settled.append(low[:same])
        self.open = {s: (c, a[same:]) for s, (c, a) in reached.items()}

    def best(self) -> Way:
        cost, rest = min(self.open[s] for s in ACCEPTED if s in self.open)
        return cost, "".join(self.settled) + rest
