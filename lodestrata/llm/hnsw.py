"""Hierarchical navigable small-world graphs (Malkov and Yashunin, 2016) in numpy, searched many queries at a time.

A graph holds unit vectors. Every node has a random level; each level's graph holds the nodes of that level and above.
Levels are built from the top, each starting from the nodes of the one above; nodes join in batches: a beam search over
what is there, and the batch itself, name candidates, of which the diversity rule keeps up to ``m``; links are mutual,
and a full list is thinned by the same rule. All queries of a batch advance together, one expansion each a step.
"""

from __future__ import annotations

import io

import numpy as np

M, BUILD_BEAM, BATCH = 16, 48, 256


def _diverse(base: np.ndarray, ids: np.ndarray, sims: np.ndarray, vectors: np.ndarray, m: int) -> np.ndarray:
    """Of each row's candidates (by falling similarity, -1 for none) up to m that are nearer to the row than to any
    candidate kept before; places left go to the nearest of the others."""
    n, c = ids.shape
    v = vectors[ids]
    among = np.matmul(v, v.transpose(0, 2, 1))
    worst = np.full((n, c), -np.inf, np.float32)
    chosen = np.zeros((n, c), bool)
    count = np.zeros(n, np.int64)
    for j in range(c):
        ok = (ids[:, j] >= 0) & (sims[:, j] > worst[:, j]) & (count < m)
        chosen[ok, j] = True
        count += ok
        worst = np.where(ok[:, None], np.maximum(worst, among[:, :, j]), worst)
    order = np.argsort(np.where(ids < 0, 2, np.where(chosen, 0, 1)), axis=1, kind="stable")[:, :m]
    return np.take_along_axis(ids, order, 1)


class Graph:
    """vectors: unit rows (float32). levels: for each level from the lowest its links, -1 for none; entry: top nodes."""

    def __init__(self, vectors: np.ndarray, links: list[np.ndarray], entry: np.ndarray) -> None:
        self.vectors, self.links, self.entry = vectors, links, entry

    @classmethod
    def build(cls, vectors: np.ndarray, seed: int = 1, m: int = M, beam: int = BUILD_BEAM) -> Graph:
        n = len(vectors)
        level = np.minimum((-np.log(1.0 - np.random.default_rng(seed).random(n)) / np.log(m)).astype(np.int64), 8)
        top = int(level.max()) if n else 0
        while top > 0 and (level >= top).sum() < 4:
            top -= 1
        self = cls(vectors, [np.full((n, 2 * m if l == 0 else m), -1, np.int32) for l in range(top + 1)], np.flatnonzero(level >= top)[:64])
        for l in range(top, -1, -1):
            self._fill(l, np.flatnonzero(level >= l), np.flatnonzero(level >= l + 1) if l < top else np.empty(0, np.int64), top, m, beam)
        return self

    def _fill(self, l: int, nodes: np.ndarray, above: np.ndarray, top: int, m: int, beam: int) -> None:
        fresh = np.setdiff1d(nodes, above, assume_unique=True)
        inside: list[np.ndarray] = []
        there, queue = 0, [above, fresh] if len(above) else [fresh]
        for part in queue:
            low = 0
            while low < len(part):
                high = min(len(part), low + min(BATCH, max(32, there)))
                new = part[low:high]
                self._join(l, new, there, inside, top, m, beam)
                inside.append(new)
                there += len(new)
                low = high

    def _join(self, l: int, new: np.ndarray, there: int, inside: list[np.ndarray], top: int, m: int, beam: int) -> None:
        q = self.vectors[new]
        own = q @ q.T
        np.fill_diagonal(own, -np.inf)
        ids, sims = np.broadcast_to(new, own.shape), own
        if there:
            if there <= 2 * BATCH:
                old = np.concatenate(inside)
                far, far_ids = q @ self.vectors[old].T, np.broadcast_to(old, (len(new), len(old)))
            else:
                old = np.concatenate(inside)
                start = old[(q @ self.vectors[old[:64]].T).argmax(axis=1)][:, None]
                if l < top:  # nodes of the level above that have not joined this level yet have no links here
                    near = self._descend(q, l + 1)
                    start = np.where(np.isin(near, old), near, start)
                far_ids, far = self._beam(l, q, start, beam)
            ids, sims = np.concatenate((far_ids, ids), 1), np.concatenate((far, sims), 1)
        keep = min(beam, ids.shape[1])
        at = np.argpartition(-sims, keep - 1, axis=1)[:, :keep] if keep < ids.shape[1] else np.broadcast_to(np.arange(keep), (len(new), keep))
        sims, ids = np.take_along_axis(sims, at, 1), np.take_along_axis(ids, at, 1)
        order = np.argsort(-sims, axis=1, kind="stable")
        sims, ids = np.take_along_axis(sims, order, 1), np.take_along_axis(ids, order, 1)
        ids = np.where(np.isfinite(sims), ids, -1)
        picked = _diverse(q, ids, sims, self.vectors, m)
        table = self.links[l]
        table[new, : picked.shape[1]] = picked
        self._back(table, new, picked)

    def _back(self, table: np.ndarray, new: np.ndarray, picked: np.ndarray) -> None:
        """Links back from the picked nodes; lists that would overflow are thinned."""
        width = table.shape[1]
        from_, to = np.repeat(new, picked.shape[1]), picked.ravel()
        from_, to = from_[to >= 0], to[to >= 0]
        order = np.argsort(to, kind="stable")
        from_, to = from_[order], to[order]
        nodes, first, number = np.unique(to, return_index=True, return_counts=True)
        more = int(number.max()) if len(number) else 0
        if not more:
            return
        extra = np.full((len(nodes), more), -1, table.dtype)
        extra[np.repeat(np.arange(len(nodes)), number), np.arange(len(to)) - np.repeat(first, number)] = from_
        joint = np.concatenate((table[nodes], extra), 1)
        joint.sort(axis=1)
        joint[:, 1:][joint[:, 1:] == joint[:, :-1]] = -1
        full = (joint >= 0).sum(axis=1)
        fits = full <= width
        packed = -np.sort(-joint, axis=1)
        table[nodes[fits]] = packed[fits][:, :width]
        over = np.flatnonzero(~fits)
        for low in range(0, len(over), 512):
            some = over[low : low + 512]
            ids = packed[some][:, : int(full[some].max())]
            base = self.vectors[nodes[some]]
            sims = np.einsum("nd,ncd->nc", base, self.vectors[ids])
            sims[ids < 0] = -np.inf
            order = np.argsort(-sims, axis=1, kind="stable")
            ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
            table[nodes[some]] = _diverse(base, ids, sims, self.vectors, width)

    def _descend(self, q: np.ndarray, to: int) -> np.ndarray:
        """Nearest node found on level ``to``, from the entry nodes through the levels above, for each query."""
        start = self.entry[(q @ self.vectors[self.entry].T).argmax(axis=1)][:, None]
        for l in range(len(self.links) - 1, to - 1, -1):
            start = self._beam(l, q, start, 4)[0][:, :1]
        return start

    def _beam(self, l: int, q: np.ndarray, start: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Nodes by falling similarity and the similarities (-inf for none), ``beam`` for each query."""
        n, links = len(q), self.links[l]
        ids = np.full((n, beam), -1, np.int64)
        sims = np.full((n, beam), -np.inf, np.float32)
        width = min(beam, start.shape[1])
        ids[:, :width] = start[:, :width]
        sims[:, :width] = np.einsum("nd,nwd->nw", q, self.vectors[ids[:, :width]])
        done = ids < 0
        seen = np.zeros((n, len(self.vectors)), bool)
        seen[np.arange(n)[:, None], ids[:, :width]] = True
        live = np.arange(n)
        while len(live):
            open_ = np.where(done[live], -np.inf, sims[live])
            at = open_.argmax(axis=1)
            going = open_[np.arange(len(live)), at] > -np.inf
            live, at = live[going], at[going]
            if not len(live):
                break
            done[live, at] = True
            next_ = links[ids[live, at]]
            ok = next_ >= 0
            rows = np.broadcast_to(live[:, None], next_.shape)
            ok &= ~seen[rows, next_]
            seen[rows[ok], next_[ok]] = True
            r, c = np.nonzero(ok)
            found = np.full(next_.shape, -np.inf, np.float32)
            target = next_[r, c]
            found[r, c] = np.einsum("nd,nd->n", q[live[r]], self.vectors[target])
            better = (found > sims[live, -1][:, None]).any(axis=1)
            if not better.any():
                continue
            who = live[better]
            all_sims = np.concatenate((sims[who], found[better]), 1)
            all_ids = np.concatenate((ids[who], next_[better]), 1)
            all_done = np.concatenate((done[who], ~ok[better]), 1)
            order = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
            sims[who], ids[who], done[who] = (np.take_along_axis(x, order, 1) for x in (all_sims, all_ids, all_done))
            gone = ~np.isfinite(sims[who])
            done[who] |= gone
        return np.where(np.isfinite(sims), ids, -1), sims

    def search(self, q: np.ndarray, beam: int, batch: int = 512) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.vectors):
            return np.full((len(q), beam), -1, np.int64), np.full((len(q), beam), -np.inf, np.float32)
        parts = [self._beam(0, x, self._descend(x, 1) if len(self.links) > 1 else np.broadcast_to(self.entry[:1], (len(x), 1)), beam) for x in (q[i : i + batch] for i in range(0, len(q), batch))]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def dump(self, vectors: bool = True) -> bytes:
        """The graph as bytes, without its vectors if ``load`` is given them; of upper levels the nodes with links."""
        out = io.BytesIO()
        upper = {}
        for i, x in enumerate(self.links[1:], 1):
            upper[f"n{i}"] = np.flatnonzero((x >= 0).any(axis=1))
            upper[f"l{i}"] = x[upper[f"n{i}"]]
        np.savez(out, **({"vectors": self.vectors} if vectors else {}), entry=self.entry, l0=self.links[0], **upper)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes, vectors: np.ndarray | None = None) -> Graph:
        with np.load(io.BytesIO(data)) as z:
            links = [z["l0"]]
            for i in range(1, sum(name.startswith("l") for name in z.files)):
                links.append(np.full((len(links[0]), z[f"l{i}"].shape[1]), -1, np.int32))
                links[i][z[f"n{i}"]] = z[f"l{i}"]
            return cls(z["vectors"] if vectors is None else vectors, links, z["entry"])
