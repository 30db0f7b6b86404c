"""Groups of similar sets in the memory of one task."""

from __future__ import annotations

import numpy as np


def search(sets: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """Links (reached, from) that span the components of all pairs of sets whose Jaccard similarity is ``threshold`` or more.

    Breadth first: what has been reached leaves the index, so that a family is not compared pair by pair.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    names, ids = np.unique(np.concatenate(sets), return_inverse=True)
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    waiting = np.ones(len(sets), bool)
    alive = starts = owners = None

    def index() -> None:
        nonlocal alive, starts, owners
        alive = np.flatnonzero(waiting)
        local = np.repeat(np.cumsum(waiting) - 1, sizes)
        kept = np.repeat(waiting, sizes)
        order = np.argsort(ids[kept], kind="stable")
        owners = local[kept][order]
        starts = np.concatenate(([0], np.cumsum(np.bincount(ids[kept], minlength=len(names)))))

    index()
    links, left = [], len(sets)
    for seed in range(len(sets)):
        if not waiting[seed]:
            continue
        waiting[seed] = False
        left -= 1
        frontier = [seed]
        while frontier and left:
            if left * 2 < len(alive):
                index()
            at = frontier.pop()
            mine = ids[offsets[at] : offsets[at + 1]]
            lengths = starts[mine + 1] - starts[mine]
            steps = np.arange(lengths.sum()) + np.repeat(starts[mine] - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
            shared = np.bincount(owners[steps], minlength=len(alive))
            near = alive[(shared > 0) & (shared / np.maximum(1, sizes[at] + sizes[alive] - shared) >= threshold)]
            near = near[waiting[near]]
            waiting[near] = False
            left -= len(near)
            links += [(int(x), at) for x in near]
            frontier += near.tolist()
    return links
