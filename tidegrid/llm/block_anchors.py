"""Substring dedup over words: fixed-block anchors.

The corpus' non-overlapping blocks of `block` words are the index; every rolling window of `block`
words of every text probes it. A window of `window` >= 2 * block - 1 words always holds a whole
aligned block, so wherever a passage repeats, a probe hits. Hits are extended to windows of `window`
words, which are compared exactly (64-bit fingerprints), and overlapping windows join to maximal
repeats.

Plan: texts are dealt into parts once; a part sends its distinct window hashes to hash buckets, and
bits come back. What travels is 5 bytes for each distinct window of a part and 16 bytes for each
window next to a hit. A passage that millions of texts hold costs a part one key, so no bucket
gathers a hot key, and nothing is paired up.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidegrid.llm import shared as sh
from tidegrid.llm import textvec as tv

U64 = np.uint64
LOW = U64((1 << 38) - 1)
ROLL, WIDE = 1, 2
OUT = "doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept string"


class _Part:
    """The windows of one part, block of texts by block of texts."""

    def __init__(self, table: pa.Table, window: int, block: int):
        self.ids, self.text = sh.in_order(table)
        self.window, self.block = window, block

    def blocks(self):
        for lo, hi, b, offs in tv.blocks(self.text):
            starts, ends, first = tv.words(b, offs)
            yield lo, hi, b, offs, first, tv.word_hashes(b, starts, ends)

    def rolling(self):
        """Hash, row and whether it is an aligned block, of each rolling window; positions as lists by block of texts."""
        h, row, aligned, at = [], [], [], []
        for lo, _hi, _b, _o, first, w in self.blocks():
            ok = np.flatnonzero(tv.inside(first, self.block, len(w)))
            r = tv.row_of(first, len(w))[ok]
            h.append(tv.window_hashes(w, self.block)[ok])
            row.append(r + lo)
            aligned.append((ok - first[r]) % self.block == 0)
            at.append(ok)
        return np.concatenate(h or [np.zeros(0, U64)]), np.concatenate(row or [np.zeros(0, np.int64)]), np.concatenate(aligned or [np.zeros(0, bool)]), at

    def wide(self, hit: np.ndarray, at: list[np.ndarray]):
        """The hashes, rows and positions of the windows that hold a rolling window that was hit, by block of texts."""
        done = 0
        for (lo, _hi, _b, _o, first, w), ok in zip(self.blocks(), at):
            flags = np.zeros(len(w) + 1, np.int64)
            j = ok[hit[done : done + len(ok)]]
            done += len(ok)
            np.add.at(flags, np.maximum(0, j - (self.window - self.block)), 1)
            np.add.at(flags, j + 1, -1)
            p = np.flatnonzero((np.cumsum(flags[: len(w)]) > 0)[: max(0, len(w) - self.window + 1)] & tv.inside(first, self.window, len(w))) if len(w) >= self.window else np.zeros(0, np.int64)
            yield tv.window_hashes(w, self.window)[p], tv.row_of(first, len(w))[p] + lo, p


def _distinct(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order, first position of each distinct hash in it, the hashes, and the index of its hash for each item."""
    order = np.argsort(h, kind="stable")
    at, n = sh.groups_of(h[order])
    inverse = np.empty(len(h), np.int64)
    inverse[order] = np.repeat(np.arange(len(at)), n)
    return order, at, h[order][at], inverse


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 50, block: int | None = None, part_bytes: int = sh.PART_BYTES) -> DataFrame:
    """Every text without the words that a window of `window` words covers which also starts in a text with a smaller doc_id.

    Returns doc_id, n_words, n_removed, spans (removed runs of words, end exclusive) and kept (the
    remaining words joined by a space), a row for each row of docs. Words are [^\\x20\\x09-\\x0D]+.
    A null text has no words and keeps the empty text. Rows with a null doc_id come after all others:
    they remove nothing from others. Rows with the same doc_id do not remove each other's words, and
    a text's own repeats stay. Further columns of docs are ignored. An empty table gives no rows.
    """
    block = block or (window + 1) // 2
    if not 1 <= block <= (window + 1) // 2:
        raise ValueError("a window must hold a whole aligned block: block <= (window + 1) / 2")
    parts, n = sh.parted(docs, doc_id, text, part_bytes)
    bits = sh.bucket_bits(n)

    def ask_rolling(key, table):
        h, row, aligned, _ = _Part(table, window, block).rolling()
        order, at, distinct, _inv = _distinct(h, row)
        if not len(at):
            return sh.ask(0, np.zeros(0, U64), bits, 5)
        several = np.minimum.reduceat(row[order], at) != np.maximum.reduceat(row[order], at)
        indexed = np.logical_or.reduceat(aligned[order], at)
        keys = (distinct & LOW) | (indexed.astype(U64) << U64(38)) | (several.astype(U64) << U64(39))
        return sh.ask(key[0].as_py(), distinct, bits, 5, keys)

    def hit_rolling(key, table):
        table, keys, _ = sh.gathered(table, 5)
        k = keys & LOW
        order = np.argsort(k, kind="stable")
        at, n = sh.groups_of(k[order])
        flags = np.zeros(len(k), bool)
        if len(at):
            up = np.bitwise_or.reduceat(keys[order] >> U64(38), at)
            flags[order] = np.repeat(((up & U64(1)) > 0) & ((n > 1) | (up > U64(1))), n)
        return sh.reply(table, flags, ROLL)

    def wide_of(part, answers):
        """The candidate windows of a part: hashes, rows, and the lists by block of texts."""
        h, row, _aligned, at = part.rolling()
        _order, _at, distinct, inverse = _distinct(h, row)
        hit = sh.answered(answers, ROLL, distinct, bits)[inverse] if len(h) else np.zeros(0, bool)
        del h, row, inverse, distinct
        found = list(part.wide(hit, at))
        return np.concatenate([x[0] for x in found] or [np.zeros(0, U64)]), np.concatenate([x[1] for x in found] or [np.zeros(0, np.int64)]), [x[2] for x in found]

    def ask_wide(key, table, answers):
        part = _Part(table, window, block)
        h, row, _ = wide_of(part, answers)
        order, at, distinct, _inv = _distinct(h, row)
        return sh.ask(key[0].as_py(), distinct, bits, 8, None, part.ids[np.minimum.reduceat(row[order], at)] if len(at) else np.zeros(0, np.int64))

    def earlier(key, table):
        table, keys, _ = sh.gathered(table, 8)
        least = np.frombuffer(b"".join(table["more"].to_pylist()), np.int64)
        order = np.argsort(keys, kind="stable")
        at, n = sh.groups_of(keys[order])
        flags = np.zeros(len(keys), bool)
        if len(at):
            flags[order] = np.repeat(np.minimum.reduceat(least[order], at), n) < least[order]
        return sh.reply(table, flags, WIDE)

    def without(key, table, answers):
        part = _Part(table, window, block)
        h, row, at = wide_of(part, answers)
        order, first, distinct, inverse = _distinct(h, row)
        flags = np.zeros(len(h), bool)
        if len(h):
            own = part.ids[np.minimum.reduceat(row[order], first)]
            flags = sh.answered(answers, WIDE, distinct, bits)[inverse] | (part.ids[row] > own[inverse])
        done, n_words, n_removed, spans, kept = 0, [], [], [], []
        for (lo, hi, b, offs, first, w), p in zip(part.blocks(), at):
            start = np.zeros(len(w), bool)
            start[p[flags[done : done + len(p)]]] = True
            done += len(p)
            gone = tv.spread(start, window, len(w)) if start.any() else None
            for i in range(hi - lo):
                own = b[offs[i] : offs[i + 1]].tobytes().split()
                here = None if gone is None else gone[first[i] : first[i + 1]]
                n_words.append(len(own))
                if here is None or not here.any():
                    n_removed.append(0)
                    spans.append([])
                else:
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], here.view(np.int8), [0]])))
                    n_removed.append(int(here.sum()))
                    spans.append([{"start": int(x), "end": int(y)} for x, y in edge.reshape(-1, 2)])
                    own = compress(own, ~here)
                kept.append(b" ".join(own))
        return pa.table(
            {
                "doc_id": sh.null_ids(part.ids),
                "n_words": pa.array(n_words, pa.int64()),
                "n_removed": pa.array(n_removed, pa.int64()),
                "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                "kept": pa.array(kept, pa.binary()).cast(pa.string()),
            }
        )

    by_part = parts.groupBy("part")
    first = by_part.applyInArrow(ask_rolling, sh.ASKED).groupBy("bucket").applyInArrow(hit_rolling, sh.ANSWERS)
    second = by_part.cogroup(first.groupBy("part")).applyInArrow(ask_wide, sh.ASKED).groupBy("bucket").applyInArrow(earlier, sh.ANSWERS)
    return by_part.cogroup(first.unionByName(second).groupBy("part")).applyInArrow(without, OUT)
