"""A hierarchical navigable small-world graph in numpy, built and searched for many queries at a time."""

from __future__ import annotations

import io

import numpy as np

#: Links of a node on an upper layer; the bottom layer has twice as many.
DEGREE, BUILD_BEAM, BATCH, EXPAND = 12, 48, 512, 4


class Graph:
    """Unit vectors (float32) and, per layer, a table of neighbours padded with -1."""

    def __init__(self, unit: np.ndarray, seed: int = 5):
        self.x = np.ascontiguousarray(unit, np.float32)
        n = len(self.x)
        rng = np.random.default_rng(seed)
        level = np.minimum((-np.log(rng.random(n)) / np.log(DEGREE)).astype(int), 6) if n else np.empty(0, int)
        # nodes come layer by layer, so that a layer's nodes are a prefix of the insertion order
        self.order = np.argsort(-level, kind="stable")
        self.x = self.x[self.order]
        level = level[self.order]
        self.sizes = [int((level >= k).sum()) for k in range(int(level.max(initial=0)) + 1)]
        self.links = [np.full((m, DEGREE * (2 if k == 0 else 1)), -1, np.int32) for k, m in enumerate(self.sizes)]
        for k in range(len(self.sizes) - 1, -1, -1):
            self._build(k)

    def _build(self, layer: int) -> None:
        m, width = self.sizes[layer], self.links[layer].shape[1]
        done = 0
        while done < m:
            new = np.arange(done, min(m, done + min(BATCH, max(done, 64))))
            near_id, near_sim = self._inside(new)
            if done:
                got_id, got_sim = self.search(self.x[new], BUILD_BEAM, layer, limit=done)
                near_id, near_sim = np.hstack([near_id, got_id]), np.hstack([near_sim, got_sim])
            chosen = self._diverse(self.x[new], near_id, near_sim, width)
            self.links[layer][new] = chosen
            self._back(layer, new, chosen)
            done = int(new[-1]) + 1

    def _inside(self, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest nodes within a batch that is inserted together."""
        sim = self.x[new] @ self.x[new].T
        np.fill_diagonal(sim, -2)
        k = min(len(new), 24)
        top = np.argpartition(-sim, k - 1, axis=1)[:, :k]
        got = np.take_along_axis(sim, top, 1)
        return np.where(got > -2, new[top], -1).astype(np.int64), got

    def _diverse(self, q: np.ndarray, ids: np.ndarray, sims: np.ndarray, width: int) -> np.ndarray:
        """Of the candidates, nearest first, those nearer to the query than to any chosen one; then the nearest rest."""
        sims = np.where(ids < 0, -3, sims)
        order = np.argsort(-sims, axis=1, kind="stable")[:, : 2 * width]
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        c = ids.shape[1]
        v = self.x[np.maximum(ids, 0)]
        between = v @ v.transpose(0, 2, 1)
        taken = np.zeros(ids.shape, bool)
        for k in range(c):
            clash = (taken & (between[:, k, :] > sims[:, k : k + 1])).any(1)
            taken[:, k] = (ids[:, k] >= 0) & ~clash & (taken.sum(1) < width)
        rank = np.argsort(np.where(ids < 0, 2, np.where(taken, 0, 1)), axis=1, kind="stable")[:, :width]
        out = np.full((len(ids), width), -1, np.int32)
        got = np.take_along_axis(ids, rank, 1)
        out[:, : got.shape[1]] = got
        return out

    def _back(self, layer: int, new: np.ndarray, chosen: np.ndarray) -> None:
        """Adds the reverse links; full nodes choose anew among old and new neighbours."""
        links = self.links[layer]
        width = links.shape[1]
        a, b = np.repeat(new, chosen.shape[1]), chosen.ravel().astype(np.int64)
        a, b = a[b >= 0], b[b >= 0]
        if not len(a):
            return
        sim = np.einsum("ij,ij->i", self.x[a], self.x[b])
        order = np.lexsort((-sim, b))
        a, b = a[order], b[order]
        node, start, count = np.unique(b, return_index=True, return_counts=True)
        cap = 2 * width
        rank = np.arange(len(b)) - np.repeat(start, count)
        keep = rank < cap
        extra = np.full((len(node), min(cap, int(count.max()))), -1, np.int64)
        extra[np.repeat(np.arange(len(node)), count)[keep], rank[keep]] = a[keep]
        for at in range(0, len(node), 2048):
            n = node[at : at + 2048]
            ids = np.hstack([links[n].astype(np.int64), extra[at : at + 2048]])
            ids = np.sort(ids, axis=1)[:, ::-1]
            ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
            sims = (self.x[np.maximum(ids, 0)] @ self.x[n][:, :, None])[:, :, 0]
            links[n] = self._diverse(self.x[n], ids, sims, width)

    def search(self, q: np.ndarray, beam: int, layer: int = 0, limit: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities) of the best ``beam`` nodes found for each query, best first; -1 pads.

        Layers above ``layer`` are descended greedily from the first node; ids are positions in ``order``.
        """
        at = np.zeros((len(q), 1), np.int64)
        for k in range(len(self.sizes) - 1, layer, -1):
            if limit is None or limit > 0:
                at = self._beam(q, at, 4, k, None)[0]
        return self._beam(q, at, beam, layer, limit)

    def _beam(self, q: np.ndarray, entry: np.ndarray, beam: int, layer: int, limit: int | None) -> tuple[np.ndarray, np.ndarray]:
        links = self.links[layer]
        n = len(links) if limit is None else limit
        rows = np.arange(len(q))[:, None]
        entry = np.where((entry >= 0) & (entry < n), entry, 0)
        entry = np.sort(entry, axis=1)
        entry[:, 1:][entry[:, 1:] == entry[:, :-1]] = -1
        seen = np.zeros((len(q), n + 1), bool)
        seen[rows, entry] = True
        seen[:, n] = True
        ids = np.full((len(q), beam), -1, np.int64)
        sims = np.full((len(q), beam), -3, np.float32)
        open_ = np.zeros((len(q), beam), bool)
        k = min(entry.shape[1], beam)
        ids[:, :k] = entry[:, :k]
        sims[:, :k] = np.where(ids[:, :k] >= 0, np.einsum("qkd,qd->qk", self.x[np.maximum(ids[:, :k], 0)], q), -3)
        open_[:, :k] = ids[:, :k] >= 0
        live = np.arange(len(q))
        while len(live):
            here = np.where(open_[live], sims[live], -9)
            e = min(EXPAND, beam)
            top = np.argpartition(-here, e - 1, axis=1)[:, :e]
            ok = np.take_along_axis(here, top, 1) > -9
            node = np.where(ok, np.take_along_axis(ids[live], top, 1), -1)
            open_[live[:, None], top] = False
            near = np.where((node >= 0)[:, :, None], links[np.maximum(node, 0)], -1).reshape(len(live), -1).astype(np.int64)
            near[(near < 0) | (near >= n)] = n
            near = np.sort(near, axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = n
            near[seen[live[:, None], near]] = n
            seen[live[:, None], near] = True
            got = np.where(near < n, (self.x[np.minimum(near, len(self.x) - 1)] @ q[live][:, :, None])[:, :, 0], -3)
            all_ids, all_sims = np.hstack([ids[live], np.where(near < n, near, -1)]), np.hstack([sims[live], got])
            all_open = np.hstack([open_[live], near < n])
            best = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
            ids[live], sims[live] = np.take_along_axis(all_ids, best, 1), np.take_along_axis(all_sims, best, 1)
            open_[live] = np.take_along_axis(all_open, best, 1) & (ids[live] >= 0)
            live = live[open_[live].any(1)]
        return ids, sims

    def dumps(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, x=self.x, order=self.order, sizes=np.array(self.sizes), **{f"l{k}": v for k, v in enumerate(self.links)})
        return out.getvalue()

    @classmethod
    def loads(cls, data: bytes) -> "Graph":
        got, self = np.load(io.BytesIO(data)), cls.__new__(cls)
        self.x, self.order, self.sizes = got["x"], got["order"], got["sizes"].tolist()
        self.links = [got[f"l{k}"] for k in range(len(self.sizes))]
        return self
