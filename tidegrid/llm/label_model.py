"""A generative model of overlapping voters, fitted by expectation-maximisation, and a sparse linear classifier.

Both work on the driver on inputs of bounded size: the model on counts of vote patterns (as many as
patterns exist, whatever the number of documents), the classifier on a bounded sample of rows.
"""

from __future__ import annotations

import numpy as np


class LabelModel:
    """P(z) and P(vote i | its parent's vote, z) for a hidden kind z; the parents form a forest over correlated voters.

    Votes are small integers; sizes[i] says how many values voter i has. There may be several kinds of
    either answer: faults that exclude each other are one kind each, or the silence of all other
    voters would outvote the one that found something. Accuracies are the vote probabilities given z.
    Correlations beyond z are found by mutual information given z: the strongest become edges of a
    forest (a maximum spanning one), so that voters which copy each other do not count twice. With
    find_copies, pairs are looked for first without z as well, as a pair of copies can draw z to itself
    before information given z shows it: were all voters independent given one binary z, covariances
    would be products of one number a voter, c_ij = a_i a_j. Pairs far above that are edges from the
    start. prior, if given, is kept. annotator names a voter that says 0 (nothing), 1 (no) or 2 (yes),
    and which kinds are a yes: it is silent at random, and its two error rates are the same for all kinds
    of one answer. They are estimated where other voters fire: elsewhere an error and a text that all
    voters miss look alike.
    """

    #: Errors and annotations that the annotator's rates begin with: few errors until the counts say otherwise.
    ERRORS, ANNOTATED = 0.5, 100.0

    def __init__(self, sizes: list[int], least_information: float = 2e-3, find_copies: bool = False, prior: np.ndarray | None = None, annotator: tuple[int, np.ndarray] | None = None):
        self.sizes, self.least, self.find_copies, self.given = list(sizes), least_information, find_copies, prior
        self.annotator, self.yes = (annotator[0], np.asarray(annotator[1], bool)) if annotator else (None, None)
        self.prior, self.parents, self.tables, self.copies = np.array([0.5, 0.5]), [-1] * len(sizes), [], set()

    def _pair(self, v: np.ndarray, w: np.ndarray, i: int, j: int) -> np.ndarray:
        """Weighted counts by kind, vote i and vote j; smoothed."""
        a, b = self.sizes[i], self.sizes[j]
        return np.stack([np.bincount(v[:, i] * b + v[:, j], weights=x, minlength=a * b).reshape(a, b) for x in w.T]) + 0.05

    def _copies(self, v: np.ndarray, counts: np.ndarray, start: np.ndarray) -> set[tuple[int, int]]:
        """Pairs whose covariance is far above the product that fits the other pairs."""
        n, total = len(self.sizes), max(counts.sum(), 1.0)
        coded = np.zeros(v.shape)
        for i, size in enumerate(self.sizes):  # a vote counts as the mean first guess of the texts that got it
            weight = np.bincount(v[:, i], weights=counts, minlength=size)
            coded[:, i] = (np.bincount(v[:, i], weights=counts * start, minlength=size) / np.maximum(weight, 1e-9))[v[:, i]]
        coded -= (counts @ coded) / total
        c = (coded * counts[:, None]).T @ coded / total
        scale = np.sqrt(np.maximum(np.diag(c), 1e-12))
        c = c / scale / scale[:, None]
        pairs = [(i, j) for i in range(n) for j in range(i + 1, n) if c[i, j] > 0.03]
        found: set[tuple[int, int]] = set()

        def fit(kept: list[tuple[int, int]]) -> tuple[float, np.ndarray]:
            x = np.zeros((len(kept), n))
            for line, pair in enumerate(kept):
                x[line, list(pair)] = 1
            y = np.log([c[p] for p in kept])
            a, *_ = np.linalg.lstsq(x, y, rcond=None)
            return float(((y - x @ a) ** 2).sum()), a

        while len(pairs) > n:  # the pair without which the others fit best, as long as that helps and it stands above the fit
            now, _ = fit(pairs)
            trials = [(fit([p for p in pairs if p != q]), q) for q in pairs]
            (least, a), (i, j) = min(trials, key=lambda x: x[0][0])
            if now - least < 0.05 or np.log(c[i, j]) - a[i] - a[j] < 0.25:
                break
            pairs.remove((i, j))
            found.add((i, j))
        return found

    def _structure(self, v: np.ndarray, w: np.ndarray, first: bool = False) -> None:
        n, edges = len(self.sizes), []
        total = w.sum()
        for i in range(n):
            for j in range(i + 1, n):
                p = self._pair(v, w, i, j) / total
                z = p.sum(axis=(1, 2), keepdims=True)
                info = float((p * np.log(p * z / (p.sum(axis=2, keepdims=True) * p.sum(axis=1, keepdims=True)))).sum())
                edges.append((info + 1 if (i, j) in self.copies else 0.0 if first else info, i, j))
        self.parents, group = [-1] * n, list(range(n))
        links: dict[int, list[int]] = {i: [] for i in range(n)}
        for info, i, j in sorted(edges, reverse=True):
            if info >= self.least and group[i] != group[j] and self.annotator not in (i, j):
                links[i].append(j)
                links[j].append(i)
                old = group[j]
                group = [group[i] if g == old else g for g in group]
        seen: set[int] = set()
        for root in range(n):
            stack = [root] if root not in seen else []
            seen.update(stack)
            while stack:
                i = stack.pop()
                for j in links[i]:
                    if j not in seen:
                        seen.add(j)
                        self.parents[j] = i
                        stack.append(j)

    def _estimate(self, v: np.ndarray, w: np.ndarray) -> None:
        self.prior = (w.sum(axis=0) + 1) / (w.sum() + w.shape[1]) if self.given is None else np.asarray(self.given, float)
        self.tables = []
        for i, parent in enumerate(self.parents):
            if i == self.annotator:
                heard = np.delete(v, i, axis=1).any(axis=1)
                said = np.stack([np.bincount(v[heard, i], weights=x, minlength=3) for x in w[heard].T])
                table = np.ones((w.shape[1], 3))
                for kinds, right in ((self.yes, 2), (~self.yes, 1)):
                    wrong = (said[kinds, 3 - right].sum() + self.ERRORS) / (said[kinds, 1:].sum() + self.ANNOTATED)
                    table[kinds, right], table[kinds, 3 - right] = 1 - wrong, wrong
                self.tables.append(table[:, None, :])
                continue
            t = self._pair(v, w, parent, i) if parent >= 0 else np.stack([np.bincount(v[:, i], weights=x, minlength=self.sizes[i]) for x in w.T])[:, None, :] + 0.05
            self.tables.append(t / t.sum(axis=2, keepdims=True))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(z | votes), a line for each line of votes."""
        log = np.tile(np.log(self.prior), (len(votes), 1))
        for i, parent in enumerate(self.parents):
            log += np.log(self.tables[i][:, votes[:, parent] if parent >= 0 else np.zeros(len(votes), int), votes[:, i]]).T
        p = np.exp(log - log.max(axis=1, keepdims=True, initial=-1e300))
        return p / p.sum(axis=1, keepdims=True)

    def fit(self, votes: np.ndarray, counts: np.ndarray, start: np.ndarray, rounds: int = 40) -> "LabelModel":
        """votes: distinct patterns; counts: how often each occurs; start: a first guess of P(z) for each, a column a kind, which also tells the kinds apart."""
        q = np.clip(start, 1e-3, None)
        q = q / q.sum(axis=1, keepdims=True)
        self.copies = self._copies(votes, counts, q[:, -1]) if self.find_copies else set()
        for k in range(rounds):
            w = counts[:, None] * q
            if k in (5, 15) or k == 0 and self.copies:
                self._structure(votes, w, k == 0)
            self._estimate(votes, w)
            new = self.posterior(votes)
            done = k > 16 and np.abs(new - q).max(initial=0) < 1e-6
            q = new
            if done:
                break
        return self

    def accuracies(self) -> list[list[list[float]]]:
        """For each voter, the vote probabilities given each kind (averaged over the parent's votes)."""
        return [t.mean(axis=1).tolist() for t in self.tables]


def sparse_logistic(at: np.ndarray, columns: np.ndarray, target: np.ndarray, dims: int, l1: float, free: int = 0, weight: np.ndarray | None = None, rounds: int = 1000, more: int = 500) -> tuple[np.ndarray, float]:
    """Weights and intercept of an L1 logistic regression over presence features.

    Row i has the columns[at[i]:at[i + 1]] and counts weight[i] <= 1; the last `free` columns are hardly penalised. Only columns
    that are active are fitted: those whose gradient breaks the condition of the optimum join, the worst `more` at a time.
    """
    n = len(at) - 1
    row = np.repeat(np.arange(n), np.diff(at))
    sure = np.ones(n) if weight is None else weight
    soft = np.full(dims, l1)
    if free:
        soft[-free:] = l1 / 50
    mean = float(np.clip((target * sure).sum() / max(sure.sum(), 1e-9), 1e-3, 1 - 1e-3))
    w, b, active = np.zeros(dims), float(np.log(mean / (1 - mean))), np.zeros(dims, bool)
    for _ in range(50):
        s = np.bincount(row, weights=w[columns], minlength=n) + b
        g = (1 / (1 + np.exp(-np.clip(s, -30, 30))) - target) * sure
        over = np.abs(np.bincount(columns, weights=g[row], minlength=dims) / max(1, n)) - 1.05 * soft
        over[active] = 0
        new = np.argsort(-over)[:more]
        new = new[over[new] > 0]
        if not len(new):
            break
        active[new] = True
        place = np.cumsum(active) - 1
        used = active[columns]
        w[active], b = _proximal(row[used], place[columns[used]], target, sure, soft[active], w[active], b, rounds)
    return w, b


def _proximal(row, columns, target, sure, soft, w, b, rounds) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient from w and b; it ends when fifty rounds move no weight by more than 0.02."""
    n, dims = len(target), len(w)
    size = np.bincount(row, minlength=n)
    # (sum of d over a row's columns)^2 <= size * sum of d^2 bounds the curvature by a diagonal, so that rare columns take long steps
    step = 4.0 / np.maximum(np.bincount(columns, weights=size[row] + 1.0, minlength=dims) / max(1, n), 1e-9)
    step_b = 4.0 / (float(size.mean()) + 1.0 if n else 1.0)
    z, zb, momentum, mark = w.copy(), b, 1.0, w
    for k in range(rounds):
        if k % 50 == 49:
            if np.abs(w - mark).max(initial=0) < 0.02:
                break
            mark = w
        s = np.bincount(row, weights=z[columns], minlength=n) + zb
        g = (1 / (1 + np.exp(-np.clip(s, -30, 30))) - target) * sure
        new = z - step * np.bincount(columns, weights=g[row], minlength=dims) / n
        new = np.sign(new) * np.maximum(0, np.abs(new) - step * soft)
        new_b = zb - step_b * g.mean()
        more = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        z, zb = new + (momentum - 1) / more * (new - w), new_b + (momentum - 1) / more * (new_b - b)
        w, b, momentum = new, new_b, more
    return w, float(b)


def dense_logistic(x: np.ndarray, target: np.ndarray, l2: float = 1e-5, rounds: int = 800) -> tuple[np.ndarray, float]:
    """Weights and intercept of an L2 logistic regression with soft targets (accelerated gradient on scaled columns)."""
    scale = np.sqrt((x.astype(np.float64) ** 2).mean(axis=0)) + 1e-6
    x = (x / scale).astype(np.float32)
    step = 4.0 / max(1.0, float((x**2).sum(axis=1).mean()))
    w, b = np.zeros(x.shape[1]), 0.0
    z, zb, momentum = w.copy(), b, 1.0
    for _ in range(rounds):
        g = 1 / (1 + np.exp(-np.clip(x @ z.astype(np.float32) + zb, -30, 30))) - target
        new, new_b = z - step * (x.T @ g.astype(np.float32) / len(x) + l2 * z), zb - step * g.mean()
        more = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        z, zb = new + (momentum - 1) / more * (new - w), new_b + (momentum - 1) / more * (new_b - b)
        w, b, momentum = new, new_b, more
    return w / scale, float(b)
