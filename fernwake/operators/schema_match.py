"""Similarity flooding between two column lists."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np

ROUNDS, SETTLED = 60, 1e-4
SIMILAR = 0.5  # least score that is reported of a match that fails the exact test
LEAST = 0.3  # score of a candidate; pairs whose first score is 1 keep a third in every round (see flood)


@dataclass(frozen=True)
class Column:
    name: str
    type: str | None
    field_id: int | None


def canonical(name: str | None) -> str:
    """The letters a-z and digits of a name, without case."""
    return re.sub(r"[^a-z0-9]", "", (name or "").lower())


def same_column(a: Column, b: Column) -> bool:
    """The exact test of a rename: equal ids where both have one, else equal canonical names."""
    if a.field_id is not None and b.field_id is not None:
        return a.field_id == b.field_id
    return canonical(a.name) == canonical(b.name)


def _grams(name: str) -> frozenset[str]:
    c = f"^{canonical(name)}$"
    return frozenset(c[i : i + 3] for i in range(max(1, len(c) - 2)))


def _spread(links_a: np.ndarray, links_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the pair graph for one edge label: 1 / number of such pairs at a pair, each way.

    A pair (x, y) has deg(x) * deg(y) such edges, so the weights are products of the two graphs'
    and the pair graph itself is never built.
    """
    down = lambda m: m / np.maximum(m.sum(1, keepdims=True), 1)
    return down(links_a), down(links_b)


def flood(old: list[Column], new: list[Column], old_groups: list[str], new_groups: list[str]) -> np.ndarray:
    """Match scores in 0..1 of every old column with every new one, by similarity flooding.

    The two schema graphs have the columns, and as their neighbours over labelled edges the types
    and the nesting groups (the part of a name before its last capitalised or separated suffix).
    First scores are the trigram likeness of bare names, 1 for equal ids and 0 for different ones.
    Each round adds to a pair's first and present score what its neighbour pairs hold, shared out by
    the edges' weights, and divides by the largest, until the change is below 1e-4. Pairs whose
    writers gave them different ids stay 0.

    A column has one edge of each label, so at most 1 flows in over each and no sum is above 4.
    Hence a pair whose first score is 1 (equal ids, or equal bare names) never falls below 1/3:
    (1 + 1/3) / 4 = 1/3. Every pair of the exact test is such a pair.
    """
    if not old or not new:
        return np.zeros((len(old), len(new)))
    ga, gb = [_grams(c.name) for c in old], [_grams(c.name) for c in new]
    words = {g: i for i, g in enumerate(sorted(set().union(*ga, *gb)))}
    bags = [np.zeros((len(x), len(words))) for x in (ga, gb)]
    for bag, grams in zip(bags, (ga, gb)):
        for i, gs in enumerate(grams):
            bag[i, [words[g] for g in gs]] = 1
    start = 2 * (bags[0] @ bags[1].T) / (bags[0].sum(1)[:, None] + bags[1].sum(1)[None])
    with_ids, same_id = _ids(old, new)
    start = np.where(with_ids, same_id, start)
    labels = []
    for xa, xb in (([c.type or "" for c in old], [c.type or "" for c in new]), (old_groups, new_groups)):
        ua, ub = sorted(set(xa)), sorted(set(xb))
        la = np.array([[x == u for u in ua] for x in xa], float)
        lb = np.array([[x == u for u in ub] for x in xb], float)
        near = np.array([[1.0 if canonical(p) == canonical(q) else 0.0 for q in ub] for p in ua])
        labels.append([near.copy(), near, *_spread(la, lb), *_spread(la.T, lb.T)])
    s = start.copy()
    for _ in range(ROUNDS):
        flow = sum(ca @ n @ cb.T for n, _, ca, cb, _, _ in labels)
        for x in labels:
            n, first, _, _, na, nb = x
            grown = first + n + na @ s @ nb.T
            x[0] = grown / max(grown.max(), 1e-12)
        t = (start + s + flow) * ~(with_ids & ~same_id)
        t /= max(t.max(), 1e-12)
        settled = np.abs(t - s).max() < SETTLED
        s = t
        if settled:
            break
    return s


def _ids(old: list[Column], new: list[Column]) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs both have an id, and which of them the same."""
    a, b = (np.array([c.field_id is not None for c in x], bool) for x in (old, new))
    va, vb = (np.array([c.field_id or 0 for c in x], np.int64) for x in (old, new))
    both = a[:, None] & b[None]
    return both, both & (va[:, None] == vb[None])


def exact_pairs(old: list[Column], new: list[Column]) -> np.ndarray:
    """``same_column`` of every pair."""
    both, same = _ids(old, new)
    names = {c: i for i, c in enumerate({canonical(c.name) for c in [*old, *new]})}
    a, b = (np.array([names[canonical(c.name)] for c in x], np.int64) for x in (old, new))
    return np.where(both, same, a[:, None] == b[None])


def group_of(name: str) -> str:
    """The nesting group of a column name: what stands before its last capitalised or separated part."""
    parts = re.split(r"(?<=[^A-Z])(?=[A-Z][a-z])|[\s._/]+", name.strip(" .")) if name else [""]
    return "".join(parts[:-1]) or name


def correspondences(old: list[Column], new: list[Column], least: float = LEAST) -> list[tuple[int, int, float]]:
    """A one-to-one choice of matching columns: (old place, new place, score).

    Columns of equal name correspond. The others are flooded; the candidates are the pairs whose
    settled score reaches ``least``. They are taken while both columns are free: first those that
    pass the exact test, by equal ids, then falling score and place, then the others in the same
    order. The test orders candidates, it adds none and changes no score. A repeated name counts
    once, at its first place.
    """
    at_old: dict[str, int] = {}
    at_new: dict[str, int] = {}
    for at, cols in ((at_old, old), (at_new, new)):
        for i, c in enumerate(cols):
            at.setdefault(c.name, i)
    kept = [(at_old[n], at_new[n], 1.0) for n in at_old if n in at_new]
    lost, gained = [i for n, i in at_old.items() if n not in at_new], [j for n, j in at_new.items() if n not in at_old]
    if not lost or not gained:
        return kept
    a, b = [old[i] for i in lost], [new[j] for j in gained]
    scores = flood(a, b, [group_of(c.name) for c in a], [group_of(c.name) for c in b])
    ii, jj = np.nonzero(scores >= least)
    exact, same_id = exact_pairs(a, b)[ii, jj], _ids(a, b)[1][ii, jj]
    used_i, used_j, out = set(), set(), kept
    for k in np.lexsort((jj, ii, -scores[ii, jj], ~same_id, ~exact)):
        i, j = int(ii[k]), int(jj[k])
        if i not in used_i and j not in used_j:
            used_i.add(i)
            used_j.add(j)
            out.append((lost[i], gained[j], float(scores[i, j])))
    return out


def changes(old: list[Column], new: list[Column]) -> list[tuple[str, str, str | None, float]]:
    """(column, change, other name, score) between two lists.

    ``renamed``, ``retyped``, ``added`` and ``removed`` follow the exact test; a flooded
    correspondence that fails it is reported as ``similar`` (at a score of 0.5 or more) beside its
    added and removed rows.
    """
    out: list[tuple[str, str, str | None, float]] = []
    pairs = correspondences(old, new)
    old_met, new_met = {old[i].name for i, _, _ in pairs}, {new[j].name for _, j, _ in pairs}
    for i, j, score in pairs:
        a, b = old[i], new[j]
        if a.name != b.name and not same_column(a, b):
            if score >= SIMILAR:
                out.append((b.name, "similar", a.name, score))
            old_met.discard(a.name)
            new_met.discard(b.name)
            continue
        if a.name != b.name:
            out.append((b.name, "renamed", a.name, score))
        if a.type != b.type:
            out.append((b.name, "retyped", a.name, score))
    seen: set[str] = set()
    for met, change, cols in ((old_met, "removed", old), (new_met, "added", new)):
        seen.clear()
        for c in cols:
            if c.name not in met and c.name not in seen:
                seen.add(c.name)
                out.append((c.name, change, None, 1.0))
    return out
