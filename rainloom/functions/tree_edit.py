"""Edit scripts between nested schemas by tree edit distance.

Schemas are unordered trees of named fields.  A script maps nodes to nodes one to one: what isn't mapped is
removed or added, what is mapped may be renamed, retyped and moved, and each of these has a cost.  Whether a node
has moved depends on where its parent went, so structs and plain fields are assigned in turn, each as cheaply as
the other's last assignment allows, until the cost no longer falls; without moves the first turn is the cheapest.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np


@dataclass
class Node:
    """A field: its name, its type (None: unknown) and the fields below it."""

    name: str
    type: str | None = None
    children: list["Node"] = field(default_factory=list)

@dataclass(frozen=True)
class Edit:
    """kind is added, removed, renamed, retyped or moved; paths are dotted, None where there is none."""

    kind: str
    old: str | None
    new: str | None
    detail: str = ""


def assignment(cost: np.ndarray) -> list[int]:
    """Column of each row in a cheapest assignment of a square cost matrix (shortest augmenting paths)."""
    n = len(cost)
    row_dual, col_dual = np.zeros(n + 1), np.zeros(n + 1)
    owner = np.zeros(n + 1, int)  # row of each column, 1-based; 0: free
    for r in range(1, n + 1):
        owner[0], at = r, 0
        best, back, used = np.full(n + 1, np.inf), np.zeros(n + 1, int), np.zeros(n + 1, bool)
        while owner[at]:
            used[at] = True
            row = owner[at]
            reduced = cost[row - 1] - row_dual[row] - col_dual[1:]
            better = ~used[1:] & (reduced < best[1:])
            best[1:][better], back[1:][better] = reduced[better], at
            nxt = 1 + int(np.argmin(np.where(used[1:], np.inf, best[1:])))
            step = best[nxt]
            row_dual[owner[used]] += step
            col_dual[used] -= step
            best[~used] -= step
            at = nxt
        while at:
            owner[at], at = owner[back[at]], back[at]
    out = [0] * n
    for c in range(1, n + 1):
        out[owner[c] - 1] = c - 1
    return out


#: Costs of an edit; a rename costs up to twice as much the less alike the fields are.
ADD, REMOVE, RETYPE, MOVE, RENAME, TINY = 1.0, 1.0, 0.5, 0.9, 2.0, 0.01
_NEVER = 1e6


def schema_tree(types: dict[str, str | None]) -> Node:
    """Tree of dotted names and their types; a name that others go on from is a struct."""
    root = Node("")
    for name, kind in types.items():
        at = root
        steps = name.split(".")
        for i, step in enumerate(steps):
            child = next((c for c in at.children if c.name == step and (i < len(steps) - 1) == bool(c.children or c.type == "struct")), None)
            if child is None or i == len(steps) - 1:
                child = Node(step, kind if i == len(steps) - 1 else "struct")
                at.children.append(child)
            at = child
    return root


@dataclass
class _Place:
    node: Node
    path: str
    parent: str

    @property
    def struct(self) -> bool:
        return bool(self.node.children) or self.node.type == "struct"


def _places(root: Node) -> list[_Place]:
    out: list[_Place] = []
    stack = [(root, "")]
    while stack:
        node, path = stack.pop()
        for c in node.children:
            p = f"{path}.{c.name}" if path else c.name
            out.append(_Place(c, p, path))
            stack.append((c, p))
    return out


def edit_script(old: Node, new: Node, likeness: Callable[[str, str], float], threshold: float = 0.5) -> tuple[float, list[Edit]]:
    """Cost and edits that turn the schema below ``old`` into that below ``new``; the roots' names don't count.

    ``likeness(old path, new path)`` in [0, 1] says how surely two fields of different names are the same
    quantity; renaming is open only from ``threshold`` on, and structs are also alike by the names they hold.
    Fields of the same name under the same parent are the same field.  A field that is found under a parent
    which its own parent didn't become has moved.
    """
    left, right = _places(old), _places(new)
    memo: dict[tuple[str, str], float] = {}

    def alike(x: _Place, y: _Place) -> float:
        if x.node.name == y.node.name:
            return 1.0
        if (x.path, y.path) not in memo:
            like = likeness(x.path, y.path)
            if x.struct:
                a, b = {c.name for c in x.node.children}, {c.name for c in y.node.children}
                like = max(like, len(a & b) / max(1, len(a | b)))
            memo[x.path, y.path] = like
        return memo[x.path, y.path]

    def price(x: _Place, y: _Place, parents: dict[str, str]) -> float:
        like = alike(x, y)
        if like < threshold:
            return _NEVER
        cost = 0.0 if x.node.name == y.node.name else RENAME * (1 - like) + TINY
        if x.node.type is not None and y.node.type is not None and x.node.type != y.node.type:
            cost += RETYPE
        return cost + (MOVE if parents.get(x.parent) != y.parent else 0.0)

    def assign(xs: list[_Place], ys: list[_Place], parents: dict[str, str], gain: dict[tuple[str, str], int]) -> list[tuple[_Place, _Place]]:
        pairs, rest_x, rest_y = [], [], list(ys)
        for x in xs:
            twin = next((y for y in rest_y if y.node.name == x.node.name and parents.get(x.parent) == y.parent), None)
            if twin is None:
                rest_x.append(x)
            else:
                rest_y.remove(twin)
                pairs.append((x, twin))
        if rest_x and rest_y:
            size = len(rest_x) + len(rest_y)
            grid = np.zeros((size, size))
            for i, x in enumerate(rest_x):
                for j, y in enumerate(rest_y):
                    grid[i, j] = price(x, y, parents) - MOVE * gain.get((x.path, y.path), 0)
                grid[i, len(rest_y) :] = REMOVE
            grid[len(rest_x) :, : len(rest_y)] = ADD
            pairs += [(rest_x[i], rest_y[j]) for i, j in enumerate(assignment(grid)) if i < len(rest_x) and j < len(rest_y) and grid[i, j] < _NEVER / 2]
        return pairs

    halves = [[p for p in side if p.struct] for side in (left, right)], [[p for p in side if not p.struct] for side in (left, right)]
    best_cost, best = np.inf, []
    gain: dict[tuple[str, str], int] = {}
    for _ in range(1 + 4 * bool(halves[0][0] or halves[0][1])):
        parents = {"": ""}
        structs: list[tuple[_Place, _Place]] = []
        for depth in range(max((p.path.count(".") for p in halves[0][0]), default=-1) + 1):  # parents before their children
            structs = assign(*halves[0], parents, gain)
            parents = {"": ""} | {x.path: y.path for x, y in structs}
        pairs = structs + assign(*halves[1], parents, {})
        cost = sum(price(x, y, parents) for x, y in pairs) + REMOVE * (len(left) - len(pairs)) + ADD * (len(right) - len(pairs))
        if cost >= best_cost - 1e-9:
            break
        best_cost, best = cost, [(x, y, parents.get(x.parent) != y.parent) for x, y in pairs]
        gain = {}
        for x, y in pairs:  # fields that went together speak for their parents
            if x.parent and y.parent:
                gain[x.parent, y.parent] = gain.get((x.parent, y.parent), 0) + 1
    edits = []
    gone, come = {x.path for x, _, _ in best}, {y.path for _, y, _ in best}
    edits += [Edit("removed", x.path, None, x.node.type or "") for x in left if x.path not in gone]
    edits += [Edit("added", None, y.path, y.node.type or "") for y in right if y.path not in come]
    for x, y, moved in best:
        if moved:
            edits.append(Edit("moved", x.path, y.path))
        if x.node.name != y.node.name:
            edits.append(Edit("renamed", x.path, y.path))
        if x.node.type is not None and y.node.type is not None and x.node.type != y.node.type:
            edits.append(Edit("retyped", x.path, y.path, f"{x.node.type} -> {y.node.type}"))
    return float(best_cost) if left or right else 0.0, edits
