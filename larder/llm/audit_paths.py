"""Cheapest edits that give a conversation the order (system? (user assistant)+)?, as an audit.

Rows come as signs: what a row may become and what it costs. A dynamic programme over rows
and places in the order keeps one cheapest audit per place. Audits share their prefixes: an
audit is a node with its last edit, a link to the node before, ancestors 1, 2, 4 ... edits up,
and a rolling hash of all edits. Of two equally dear audits the lesser stays: their longest
common prefix is found by jumping up from equal depth while hashes differ; equal hashes are
checked edit by edit. Of equal cost at one place, no audit is a prefix of another, since
more edits behind it would cost more, so the lesser prefix stays the lesser whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

# A sign is KIND * 4 + role: the role's initial, then what is wrong with the row.
ROLES = "?sua"
FINE, TRUNCATED, BLANK, DUPLICATE = range(4)
KEEP, REROLE, DELETE, INSERT = "KRDI"
COSTS = {KEEP: 0, REROLE: 3, DELETE: 4, INSERT: 3}
LEFT_TRUNCATED = 3
# Places in the order: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: Where a row of the wanted role (user, but assistant after user) leads.
WANTED = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
FINAL = (START, ASSISTANT)

_BASE, _MODULUS = 1_000_003, (1 << 61) - 1
# Nodes at which what all audits share is first looked for.
SETTLE = 32_768


class Audits:
    """Audits as linked nodes; node 0 is the empty one."""

    def __init__(self, modulus: int = _MODULUS) -> None:
        self.modulus = modulus
        self.edit, self.depth, self.hash = [""], [0], [0]
        self.up: list[list[int]] = [[0]]  # per node: ancestors 1, 2, 4 ... edits up
        self.agreed: dict[tuple[int, int], bool] = {}

    def add(self, node: int, edit: str) -> int:
        up, step = [node], 0
        while (1 << step + 1) <= self.depth[node] + 1:
            up.append(self.up[up[step]][step])
            step += 1
        self.edit.append(edit)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * _BASE + ord(edit)) % self.modulus)
        self.up.append(up)
        return len(self.edit) - 1

    def above(self, node: int, depth: int) -> int:
        """The ancestor at a depth."""
        rise = self.depth[node] - depth
        while rise:
            step = rise.bit_length() - 1
            node = self.up[node][step]
            rise -= 1 << step
        return node

    def same(self, a: int, b: int) -> bool:
        """Whether two nodes of one depth have the same edits: by hash, then edit by edit."""
        if a == b:
            return True
        if self.hash[a] != self.hash[b]:
            return False
        key = (a, b) if a < b else (b, a)
        if key not in self.agreed:
            x, y = a, b
            while x != y and self.edit[x] == self.edit[y]:
                x, y = self.up[x][0], self.up[y][0]
            self.agreed[key] = x == y
        return self.agreed[key]

    def less(self, a: int, b: int) -> bool:
        """Whether a's edits come before b's."""
        depth = min(self.depth[a], self.depth[b])
        x, y = self.above(a, depth), self.above(b, depth)
        if self.same(x, y):
            return self.depth[a] < self.depth[b]
        # Jump up while the ancestors still differ; their parents are then the common prefix.
        for step in range(depth.bit_length() - 1, -1, -1):
            if step < len(self.up[x]) and self.depth[x] >= 1 << step:
                p, q = self.up[x][step], self.up[y][step]
                if not self.same(p, q):
                    x, y = p, q
        return self.edit[x] < self.edit[y]

    def text(self, node: int, above: int = 0) -> str:
        edits = []
        while node != above:
            edits.append(self.edit[node])
            node = self.up[node][0]
        return "".join(reversed(edits))

    def shared(self, nodes: list[int]) -> int:
        """The deepest node that all of these stand on."""
        depth = min(self.depth[n] for n in nodes)
        lows = {self.above(n, depth) for n in nodes}
        while len(lows) > 1:
            lows = {self.up[n][0] for n in lows}
        return lows.pop()


def _better(audits: Audits, best: dict[int, tuple[int, int]], place: int, cost: int, node: int, edit: str) -> None:
    """Keeps the cheaper, then lesser, audit of a place."""
    held = best.get(place)
    if held and held[0] < cost:
        return
    grown = audits.add(node, edit)
    if not held or cost < held[0] or audits.less(grown, held[1]):
        best[place] = (cost, grown)


def _inserted(audits: Audits, best: dict[int, tuple[int, int]]) -> dict[int, tuple[int, int]]:
    """Rows put in between; the cheapest place first, as every one of them costs."""
    left = set(best)
    while left:
        place = min(left, key=lambda p: best[p][0])
        left.discard(place)
        cost, node = best[place]
        to = WANTED[place]
        if to not in best or cost + COSTS[INSERT] <= best[to][0]:
            if to not in best:
                left.add(to)
            _better(audits, best, to, cost + COSTS[INSERT], node, INSERT)
    return best


def _worthwhile(best: dict[int, tuple[int, int]]) -> dict[int, tuple[int, int]]:
    """Places from which a cheapest audit may still come.

    After an assistant all goes on as from the start or after system, but that the start can
    keep one system row, which costs at most a deletion.
    """
    cost = best[ASSISTANT][0]
    slack = {START: COSTS[DELETE], SYSTEM: 0}
    return {place: held for place, held in best.items() if held[0] <= cost + slack.get(place, held[0])}


class Cheapest:
    """The cheapest audit of rows that are given one after another as signs."""

    def __init__(self, modulus: int = _MODULUS, settle: int = SETTLE) -> None:
        self.modulus, self.settle, self.limit = modulus, settle, settle
        self.audits, self.done = Audits(modulus), []
        self.best = _inserted(self.audits, {START: (0, 0)})

    def push(self, sign: int) -> None:
        kind, role = divmod(sign, 4)
        extra = LEFT_TRUNCATED if kind == TRUNCATED else 0
        after: dict[int, tuple[int, int]] = {}
        for place, (cost, node) in self.best.items():
            _better(self.audits, after, place, cost + COSTS[DELETE], node, DELETE)
            if kind in (BLANK, DUPLICATE):
                continue
            kept = KEPT.get((place, ROLES[role]))
            if kept is not None:
                _better(self.audits, after, kept, cost + COSTS[KEEP] + extra, node, KEEP)
            _better(self.audits, after, WANTED[place], cost + COSTS[REROLE] + extra, node, REROLE)
        self.best = _worthwhile(_inserted(self.audits, after))
        if len(self.audits.edit) > self.limit:
            self._settle()

    def _settle(self) -> None:
        """What all audits share becomes text; of the rest only nodes that they stand on are kept."""
        old = self.audits
        root = old.shared([node for _, node in self.best.values()])
        self.done.append(old.text(root))
        fresh, moved = Audits(self.modulus), {root: 0}
        best = {}
        for place, (cost, node) in self.best.items():
            path = []
            while node not in moved:
                path.append(node)
                node = old.up[node][0]
            at = moved[node]
            for n in reversed(path):
                at = moved[n] = fresh.add(at, old.edit[n])
            best[place] = (cost, at)
        self.audits, self.best = fresh, best
        self.limit = max(self.settle, 2 * len(fresh.edit))

    def result(self) -> tuple[int, str]:
        """The least cost and, of the audits that have it, the first one in ASCII order."""
        ends = [self.best[place] for place in FINAL if place in self.best]
        cost, node = ends[0]
        for other in ends[1:]:
            if other[0] < cost or other[0] == cost and self.audits.less(other[1], node):
                cost, node = other
        return cost, "".join(self.done) + self.audits.text(node)


def cheapest(signs: Iterable[int], modulus: int = _MODULUS, settle: int = SETTLE) -> tuple[int, str]:
    rows = Cheapest(modulus, settle)
    for sign in signs:
        rows.push(sign)
    return rows.result()


class Rewriter:
    """An audit applied to rows that are given one after another."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.place = audit, 0, START

    def _wanted(self) -> str:
        self.place = WANTED[self.place]
        return "user" if self.place == USER else "assistant"

    def inserted(self) -> Iterator[tuple[str, str]]:
        """(role, text) of the rows put in before the next one."""
        while self.audit[self.at : self.at + 1] == INSERT:
            self.at += 1
            yield self._wanted(), ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == KEEP:
            self.place = KEPT[self.place, role[:1]]
            yield role, text
        elif edit == REROLE:
            yield self._wanted(), text
