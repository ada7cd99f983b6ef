"""Jaro-Winkler similarity of many pairs at once: one step for each letter of the first texts, over all pairs of a batch."""

from __future__ import annotations

import numpy as np

#: Letters of the head, the weight of each, the similarity above which it counts; pairs and letters of a batch, cells of letter counts.
HEAD, WEIGHT, BOOST, PAIRS, LETTERS, CELLS = 4, 0.1, 0.7, 4096, 1 << 22, 64
#: Letters of the heads that ``ordered`` compares at once, and that it keeps of all texts.
PREFIXES, TABLE = 1 << 17, 1 << 22
#: How much longer, as a logarithm, the heads of a batch are than others need.
STEP = 0.06
#: After the last place of a letter.
NONE = np.int32(1 << 30)


class Letters:
    """The letters of some texts, none of them empty, and where each letter stands in each text."""

    def __init__(self, texts: list[str]):
        self.n = np.array([len(t) for t in texts], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.n)[:-1]])
        names, flat = np.unique(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4"), return_inverse=True)
        self.flat, self.kinds = flat.astype(np.int32), len(names)
        text = np.repeat(np.arange(len(texts)), self.n)
        group = text * self.kinds + flat
        counts = np.bincount(group, minlength=len(texts) * self.kinds)
        # the places of each letter in order, an end after each letter
        order = np.argsort(group, kind="stable")
        self.places = np.full(len(group) + len(counts), NONE)
        self.places[np.arange(len(group)) + group[order]] = (np.arange(len(group)) - np.repeat(self.start, self.n))[order]
        self.first = (np.cumsum(counts) - counts + np.arange(len(counts))).astype(np.int32).reshape(len(texts), self.kinds)
        self.keys = None
        # how often its letter stands before each place
        self.before = np.empty(len(group), np.int32)
        self.before[order] = np.arange(len(group)) - (np.cumsum(counts) - counts)[group[order]]
        self.cells = np.bincount(text * CELLS + flat % CELLS, minlength=len(texts) * CELLS).reshape(len(texts), CELLS)[:, : self.kinds].astype(np.int32)
        self.cells = self.cells.astype(np.int16) if self.n.max() < 1 << 15 else self.cells
        at = np.arange(HEAD)
        inside = at < self.n[:, None]
        self.heads = np.where(inside, self.flat[np.minimum(self.start[:, None] + at, len(self.flat) - 1)], -1)

    def head(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many first letters two texts have in common, four at most."""
        return np.cumprod((self.heads[a] == self.heads[b]) & (self.heads[a] >= 0), axis=-1).sum(-1)

    def possible(self, one: int, others: np.ndarray, least: float) -> np.ndarray:
        """Those of the others that lengths, heads and letter counts let reach the similarity; none that reaches it is left out."""
        return Others(self, others, least).possible(one, 0, len(others))

    def ordered(self, a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
        """Whether the heads of the texts a and b leave few enough swaps to reach the similarity, pair by pair; false only where they do not.

        Matched letters are at most the common ones, which bounds the swaps, two unlike letters each. Of each letter the
        places meet in order, so that which letters of a head are matched, and which is the k-th of them, is known without
        the rest of the text. Heads are as long as texts without any likeness need to be told apart.
        """
        x, y = self.n[a], self.n[b]
        common = np.minimum(self.cells[a], self.cells[b]).sum(1, dtype=np.int64)
        head = self.head(a, b)
        jaro = (least - WEIGHT * head) / (1 - WEIGHT * head)
        most = 2 * np.floor(common * (common / x + common / y + 1 - 3 * jaro + 1e-6) + 1e-6).astype(np.int64) + 1
        out = most > 0
        order = np.flatnonzero(out & (most < np.minimum(x, y)))
        # like lengths together, and pairs of one text as they come
        step = np.ceil(np.log(np.maximum(1, most + most // 5 + 16)) / STEP)
        wide = np.minimum(np.maximum(x, y), np.ceil(np.exp(step * STEP)).astype(np.int64))
        order = order[np.argsort(step[order], kind="stable")]
        if len(order) and self.keys is None:
            self._table()
        done = 0
        while done < len(order):
            batch = order[done : done + max(1, PREFIXES // int(wide[order[done]]))]
            batch = batch[step[batch] == step[batch[0]]]
            out[batch] = self._unlike(a[batch], b[batch], int(wide[batch].max())) <= most[batch]
            done += len(batch)
        return out

    def _table(self) -> None:
        """Letters of the heads as a matrix, what their place is under, and the places of each text under the same."""
        texts = len(self.n)
        wide = min(int(self.n.max()), max(1, TABLE // texts))
        text = np.repeat(np.arange(texts), self.n)
        at = np.arange(len(self.flat)) - self.start[text]
        inside = at < wide
        most = np.zeros(self.kinds, np.int64)
        np.maximum.at(most, self.flat[inside], self.before[inside] + 1)
        under = np.cumsum(most) - most
        self.row = int(most.sum()) + 1  # the last one: no letter
        known = self.before < most[self.flat]
        key = under[self.flat] + self.before
        small = self.n.max() < 1 << 14  # so that places and NONE, and their distance, are small too
        self.placed = np.full(texts * self.row, np.iinfo(np.int16).max if small else NONE)
        self.placed = self.placed.astype(np.int16) if small else self.placed
        self.placed[(text * self.row + key)[known]] = at[known]
        self.keys = np.full((texts, wide), self.row - 1, np.int32)
        self.keys[text[inside], at[inside]] = key[inside]
        self.letters = np.zeros((texts, wide), np.uint8 if self.kinds <= 256 else np.int32)
        self.letters[text[inside], at[inside]] = self.flat[inside]

    def _unlike(self, a: np.ndarray, b: np.ndarray, wide: int) -> np.ndarray:
        """How many of the matched letters in the first ``wide`` ones differ, taken one by one."""
        reach = np.maximum(0, np.maximum(self.n[a], self.n[b]) // 2 - 1).astype(self.placed.dtype)
        wide = min(wide, self.keys.shape[1])
        letters, keys, at = self.letters[:, :wide], self.keys[:, :wide], np.arange(wide, dtype=self.placed.dtype)
        none = self.placed[self.row - 1]
        sides, apart = [], []
        for own, other in ((a, b), (b, a)):
            there = self.placed.take(keys[own] + (other * self.row)[:, None])
            near = np.abs(there - at) <= reach[:, None]
            far = np.flatnonzero((there != none) != near)
            apart.append(far // wide * self.kinds + letters[own[far // wide], far % wide])
            sides.append((letters[own], near))
        apart = np.unique(np.concatenate(apart))
        if len(apart):  # letters of which some are out of reach meet one by one: of two places too far apart the earlier one goes
            p, c = apart // self.kinds, apart % self.kinds
            u, v = self.first[a[p], c], self.first[b[p], c]
            while len(p):
                i, j = self.places[u], self.places[v]
                on = np.minimum(i, j) < wide
                p, u, v, i, j = p[on], u[on], v[on], i[on], j[on]
                met = np.abs(i - j) <= reach[p]
                one, other = met | (i < j), met | (j < i)
                for (_, near), k, goes in zip(sides, (i, j), (one, other), strict=True):
                    inside = goes & (k < wide)
                    near[p[inside], k[inside]] = met[inside]
                u, v = u + one, v + other
        counts = [np.count_nonzero(near, axis=1) for _, near in sides]
        both = np.minimum(*counts)
        begin = np.cumsum(both) - both
        step = np.arange(both.sum())
        left, right = (mine[near].take(step + np.repeat(np.cumsum(n) - n - begin, both)) for (mine, near), n in zip(sides, counts, strict=True))
        unlike = np.concatenate([[0], np.cumsum(left != right)])
        return unlike[begin + both] - unlike[begin]

    def similarity(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The similarity of the texts a and b, pair by pair, in batches of like length."""
        out = np.zeros(len(a))
        order = np.argsort(-self.n[a], kind="stable")
        done = 0
        while done < len(a):
            most = max(1, min(PAIRS, LETTERS // int(max(self.n[a[order[done]]], 1))))
            batch = order[done : done + most]
            while len(batch) > 1 and len(batch) * int(self.n[b[batch]].max()) > 2 * LETTERS:
                batch = batch[: len(batch) // 2]
            out[batch] = self._batch(a[batch], b[batch])
            done += len(batch)
        return out

    def _batch(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """a by falling length. The next free place of each letter of b moves on as it is taken or left behind."""
        x, y, begin, pairs = self.n[a], self.n[b], self.start[a], np.arange(len(a), dtype=np.int32)
        reach = np.maximum(0, np.maximum(x, y) // 2 - 1).astype(np.int32)
        wide = int(y.max()) + 1
        found, taken = np.zeros((int(x[0]), len(a)), bool), np.zeros(len(a) * wide, bool)
        nexts, offset, row = self.first[b].ravel(), pairs * self.kinds, pairs * wide
        last = np.int32(wide - 1)
        active = np.searchsorted(-x, -np.arange(int(x[0])), side="left")  # pairs whose first text goes on at this letter
        for i in range(int(x[0])):
            k = active[i]
            slot = offset[:k] + self.flat.take(begin[:k] + i)
            at = nexts.take(slot)
            place = self.places.take(at)
            late = np.flatnonzero(place < i - reach[:k])
            while late.size:
                at[late] += 1
                place[late] = self.places[at[late]]
                late = late[place[late] < i - reach[late]]
            hit = place <= i + reach[:k]
            nexts[slot] = at + hit
            found[i, :k] = hit
            taken[row[:k] + np.where(hit, place, last)] = True
        taken = taken.reshape(len(a), wide)[:, :-1]
        p, i = np.nonzero(found.T)
        q, j = np.nonzero(taken)
        swaps = np.bincount(p[self.flat[begin[p] + i] != self.flat[self.start[b][q] + j]], minlength=len(a)) // 2
        m = found.sum(0)
        with np.errstate(invalid="ignore", divide="ignore"):
            jaro = np.where(m > 0, (m / x + m / y + (m - swaps) / m) / 3, 0.0)
        return np.where(jaro > BOOST, jaro + self.head(a, b) * WEIGHT * (1 - jaro), jaro)


class Others:
    """Texts laid out for one text to be held against many of them at once."""

    def __init__(self, known: Letters, others: np.ndarray, least: float):
        self.known, self.others = known, others
        self.n = known.n[others].astype(float)
        self.heads = np.ascontiguousarray(known.heads[others].T)
        self.cells = np.ascontiguousarray(known.cells[others].T)
        # no sum of a text's cells is above its length
        self.sums = np.int16 if self.cells.dtype == np.int16 else np.int64
        head = np.arange(HEAD + 1)
        self.need = 3 * (least - WEIGHT * head) / (1 - WEIGHT * head) - 1

    def possible(self, one: int, low: int, high: int) -> np.ndarray:
        """Those of the others from low to high that lengths, heads and letter counts let reach the similarity."""
        x, y = float(self.known.n[one]), self.n[low:high]
        same = (self.heads[0, low:high] == self.known.heads[one, 0]) & (self.heads[0, low:high] >= 0)
        head = same.astype(np.int8)
        for k in range(1, HEAD):
            letter = self.known.heads[one, k]
            if letter < 0 or not same.any():
                break
            same &= self.heads[k, low:high] == letter
            head += same
        need = self.need.take(head) * (x * y / (x + y)) - 1e-6
        common = np.minimum(self.cells[:, low:high], self.known.cells[one][:, None]).sum(0, dtype=self.sums)
        return self.others[low:high][(common >= need) & (np.minimum(x, y) >= need)]
