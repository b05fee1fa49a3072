"""Substring dedup over bytes: a logarithmic family of sparse suffix indexes.

Only suffixes that can start a long match are compared. Every window of `length` bytes has one
canonical anchor, the smallest k-gram hash among its first `reach` positions, so equal windows share
it whatever stands around them. Neighbouring windows with one anchor form a run.

First exchange: each run sends a fingerprint of what follows its anchor (its class) and one of the
whole run. Runs that are equal as a whole are repeats at once; one of them stands for all. Only
classes with different runs go on. Second exchange: the suffixes of those runs, as fingerprints of
their first `length` bytes. In each hash bucket every arriving batch becomes a sorted suffix array,
is merge-scanned against the levels there are for matches, and equal-sized levels merge, so a bucket
holds logarithmically many arrays. Suffixes are ordered by the fingerprint of their first `length`
bytes instead of by the bytes: only equality up to that depth matters here.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidegrid.llm import shared as sh
from tidegrid.llm import textvec as tv

U64 = np.uint64
GRAM = 16
WHOLE, GO_ON, MATCH = 1, 2, 3
OUT = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"


class SuffixLevels:
    """Sorted suffix arrays of geometrically growing sizes. add() takes a batch and finds its matches with all before it."""

    def __init__(self) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.matched = np.zeros(0, bool)

    def add(self, keys: np.ndarray, own: np.ndarray | None = None) -> None:
        """keys: fingerprints of suffixes; own: those known to match within their batch. Numbers of suffixes go on from batch to batch."""
        base = len(self.matched)
        self.matched = np.concatenate([self.matched, np.zeros(len(keys), bool) if own is None else own])
        order = np.argsort(keys, kind="stable")
        array, number = keys[order], order + base
        same = array[1:] == array[:-1]
        self.matched[number[1:][same]] = True
        self.matched[number[:-1][same]] = True
        for have, who in self.levels:
            lo, hi = np.searchsorted(have, array, "left"), np.searchsorted(have, array, "right")
            hit = hi > lo
            if hit.any():
                self.matched[number[hit]] = True
                edge = np.bincount(lo[hit], minlength=len(have) + 1) - np.bincount(hi[hit], minlength=len(have) + 1)
                self.matched[who[np.cumsum(edge[:-1]) > 0]] = True
        while self.levels and len(self.levels[-1][0]) <= len(array):
            have, who = self.levels.pop()
            both, numbers = np.concatenate([have, array]), np.concatenate([who, number])
            order = np.argsort(both, kind="stable")
            array, number = both[order], numbers[order]
        self.levels.append((array, number))


class _Part:
    def __init__(self, table: pa.Table, length: int, reach: int):
        self.ids, self.text = sh.in_order(table)
        self.length, self.reach = length, reach

    def blocks(self):
        """Per block of texts: rows, bytes, offsets, and the runs: first and last window start and the anchor of each."""
        n, r = self.length, self.reach
        for lo, hi, b, offs in tv.blocks(self.text):
            none = np.zeros(0, np.int64)
            size = np.diff(offs)
            if not (size >= n).any():
                yield lo, hi, b, offs, none, none, none
                continue
            g = tv.byte_window_hashes(b, GRAM)
            low = (g & U64(0xFFFFFFFF00000000)) | (U64(0xFFFFFFFF) - np.arange(len(g), dtype=U64))
            step = 1
            while step < r:  # the minimum over r positions, by doubling
                more = min(step, r - step)
                low = np.minimum(low[: len(low) - more], low[more:])
                step += more
            ok = np.zeros(len(b) + 1, np.int64)
            fits = size >= n
            ok[offs[:-1][fits]] += 1
            np.add.at(ok, offs[1:][fits] - n + 1, -1)
            s = np.flatnonzero(np.cumsum(ok[:-1]) > 0)
            q = (U64(0xFFFFFFFF) - (low[s] & U64(0xFFFFFFFF))).astype(np.int64)
            new = np.flatnonzero(np.concatenate([[True], (q[1:] != q[:-1]) | (s[1:] != s[:-1] + 1)]))
            yield lo, hi, b, offs, s[new], s[np.append(new[1:], len(s)) - 1], q[new]

    def runs(self):
        """Class and whole fingerprint of every run, and how many each block of texts has."""
        c, f, counts = [np.zeros(0, U64)], [np.zeros(0, U64)], []
        ahead = self.length - self.reach + 1
        for _lo, _hi, b, _offs, s0, s1, q in self.blocks():
            counts.append(len(q))
            if not len(q):
                continue
            up, down = tv.powers(len(b) + 1)
            total = np.empty(len(b) + 1, U64)
            total[0] = 0
            np.cumsum(tv.BYTE_VALUES[b] * up[: len(b)], out=total[1:])
            part = lambda x, y: (total[y] - total[x]) * down[x]  # noqa: E731, B023
            c.append(tv.mix(part(q, q + ahead)))
            f.append(tv.mix(part(s0, s1 + self.length) + tv.mix(((q - s0) << 20 | (q - s1)).astype(U64))))
        return np.concatenate(c), np.concatenate(f), counts

    def fine(self, go_on: np.ndarray):
        """Fingerprints of all windows of the runs that go on, and their positions by block of texts; go_on: the flag of each run."""
        done = 0
        for _lo, _hi, b, _offs, s0, s1, _q in self.blocks():
            on = np.flatnonzero(go_on[done : done + len(s0)])
            done += len(s0)
            if not len(on):
                yield np.zeros(0, U64), np.zeros(0, np.int64)
                continue
            size = s1[on] - s0[on] + 1
            p = np.repeat(s0[on] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            up, down = tv.powers(len(b) + 1, tv._BASE2)
            total = np.empty(len(b) + 1, U64)
            total[0] = 0
            np.cumsum(tv.BYTE_VALUES[b] * up[: len(b)], out=total[1:])
            yield tv.mix((total[p + self.length] - total[p]) * down[p]), p


def _distinct(*keys: np.ndarray):
    """Order by the keys (the last first, as lexsort), positions of each distinct tuple in it, counts and the tuple of each item."""
    order = np.lexsort(keys) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    n = len(order)
    if n == 0:
        return order, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.concatenate([[True], np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])])
    at = np.flatnonzero(new)
    inverse = np.empty(n, np.int64)
    inverse[order] = np.cumsum(new) - 1
    return order, at, np.diff(np.append(at, n)), inverse


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 400, reach: int = 128, part_bytes: int = sh.PART_BYTES) -> DataFrame:
    """Every text without the bytes that a string of `length` bytes covers which also starts anywhere else, in the same text or another.

    Returns doc_id, n_bytes, n_removed, spans (maximal removed runs of bytes, end exclusive) and kept
    (the remaining bytes), a row for each row of docs. All copies go, the first as well; strings are
    judged on the input. A null text is empty. Rows with equal or null doc_id are different texts.
    Further columns of docs are ignored. An empty table gives no rows.
    """
    if not GRAM < length - reach + 1:
        raise ValueError("reach must leave room for an anchor's k-gram")
    parts, n = sh.parted(docs, doc_id, text, part_bytes)
    bits = sh.bucket_bits(n)

    def ask_runs(key, table):
        c, f, _ = _Part(table, length, reach).runs()
        order, at, n, _inv = _distinct(f, c)
        one = order[at]
        return sh.ask(key[0].as_py(), c[one], bits, 8, None, (f[one] & ~U64(1)) | (n > 1).astype(U64))

    def sort_runs(key, table):
        table, c, _ = sh.gathered(table, 8)
        f = np.frombuffer(b"".join(table["more"].to_pylist()), U64)
        several, f = (f & U64(1)) > 0, f >> U64(1)
        order, at, n, inverse = _distinct(f, c)  # lexsort is stable: the first of a tuple is that of the first part
        whole, go_on = np.zeros(len(c), bool), np.zeros(len(c), bool)
        if len(c):
            whole = ((n > 1) | np.logical_or.reduceat(several[order], at))[inverse]
            classes = np.cumsum(np.concatenate([[True], c[order[at]][1:] != c[order[at]][:-1]])) - 1
            mixed = np.bincount(classes) > 1
            go_on[order[at]] = mixed[classes]
        return pa.concat_tables([sh.reply(table, whole, WHOLE), sh.reply(table, go_on, GO_ON)])

    def state_of(part, answers):
        """For each run: repeated as a whole; goes on. And the second exchange's hashes."""
        c, f, counts = part.runs()
        order, at, _n, inverse = _distinct(f, c)
        one = order[at]
        whole = sh.answered(answers, WHOLE, c[one], bits)
        first = np.zeros(len(c), bool)
        first[one] = sh.answered(answers, GO_ON, c[one], bits)
        found = list(part.fine(first))
        return (whole[inverse] if len(c) else whole), np.concatenate([x[0] for x in found] or [np.zeros(0, U64)]), [x[1] for x in found], counts

    def ask_suffixes(key, table, answers):
        _w, h, _p, _c = state_of(_Part(table, length, reach), answers)
        order, at, n, _inv = _distinct(h)
        one = h[order[at]]
        return sh.ask(key[0].as_py(), one, bits, 8, (one & ~U64(1)) | (n > 1).astype(U64))

    def scan_levels(key, table):
        table, keys, row = sh.gathered(table, 8)
        edges, family = np.searchsorted(row, np.arange(len(table) + 1)), SuffixLevels()
        for a, b in zip(edges, edges[1:]):
            family.add(keys[a:b] >> U64(1), (keys[a:b] & U64(1)) > 0)
        return sh.reply(table, family.matched, MATCH)

    def without(key, table, answers):
        part = _Part(table, length, reach)
        whole, h, at, counts = state_of(part, answers)
        order, one, _n, inverse = _distinct(h)
        match = sh.answered(answers, MATCH, h[order[one]], bits)[inverse] if len(h) else np.zeros(0, bool)
        run, fine, n_bytes, n_removed, spans, kept = 0, 0, [], [], [], []
        for (lo, hi, b, offs, s0, s1, _q), p, k in zip(part.blocks(), at, counts):
            w = np.flatnonzero(whole[run : run + k])
            f = p[match[fine : fine + len(p)]]
            run, fine = run + k, fine + len(p)
            gone = None
            if len(w) or len(f):
                d = np.bincount(s0[w], minlength=len(b) + 1) - np.bincount(s1[w] + length, minlength=len(b) + 1)
                d += np.bincount(f, minlength=len(b) + 1) - np.bincount(f + length, minlength=len(b) + 1)
                gone = np.cumsum(d[:-1]) > 0
            for i in range(hi - lo):
                own = b[offs[i] : offs[i + 1]]
                here = None if gone is None else gone[offs[i] : offs[i + 1]]
                n_bytes.append(len(own))
                if here is None or not here.any():
                    n_removed.append(0)
                    spans.append([])
                else:
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], here.view(np.int8), [0]])))
                    n_removed.append(int(here.sum()))
                    spans.append([{"start": int(x), "end": int(y)} for x, y in edge.reshape(-1, 2)])
                    own = own[~here]
                kept.append(own.tobytes())
        return pa.table(
            {
                "doc_id": sh.null_ids(part.ids),
                "n_bytes": pa.array(n_bytes, pa.int64()),
                "n_removed": pa.array(n_removed, pa.int64()),
                "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                "kept": pa.array(kept, pa.binary()),
            }
        )

    by_part = parts.groupBy("part")
    first = by_part.applyInArrow(ask_runs, sh.ASKED).groupBy("bucket").applyInArrow(sort_runs, sh.ANSWERS)
    second = by_part.cogroup(first.groupBy("part")).applyInArrow(ask_suffixes, sh.ASKED).groupBy("bucket").applyInArrow(scan_levels, sh.ANSWERS)
    return by_part.cogroup(first.unionByName(second).groupBy("part")).applyInArrow(without, OUT)
