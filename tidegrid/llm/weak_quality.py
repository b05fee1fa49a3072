"""Quality classifier from weak labels.

Overlapping heuristic labellers vote on each text: eight watch for a fault each, two for plain prose.
Expectation-maximisation over the counts of vote patterns of all texts estimates how accurate each
labeller is, without annotations. Faults exclude each other, so each begins as a kind of its own.
The posterior labels of a bounded sample of texts train a linear scorer over hashed features: the
word-final n-grams of the text by share, and the ranges of its statistics. Every text is then scored
in one map pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm import shared as sh
from tidegrid.llm import textvec as tv
from tidegrid.llm.label_model import LabelModel, dense_logistic

U64 = np.uint64
GRAMS = 1 << 10
RANGES = 8
SAMPLE_ROWS = 6_000
#: (statistic, bad beyond): shares by word, by letter, by window or by line. Below, these labellers say nothing.
FAULTS = (
    ("symbols", 0.15),
    ("pipes", 0.12),
    ("adjacent", 0.20),
    ("capitals", 0.50),
    ("exclaims", 0.25),
    ("windows", 0.20),
    ("lines", 0.30),
    ("marked", 0.40),
)
#: (statistics that must all stay within): these labellers vote good or nothing.
PROSE = ({"marked": 0.10, "symbols": 0.02, "capitals": 0.25}, {"windows": 0.05, "adjacent": 0.03, "lines": 0.05})
NAMES = [name for name, _ in FAULTS]
VOTERS = len(FAULTS) + len(PROSE)
#: Beyond these the ranges of a statistic end; fixed, so that a range means the same at every size.
EDGES = np.array([0.005, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7])

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&<>@^~=_\\{}[]"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True


def _per_row(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return (total[edges[1:]] - total[edges[:-1]]).astype(np.float64)


def _again(keys: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """How many items of each row equal an earlier item of it."""
    order = np.argsort(tv.mix(keys + row.astype(U64) * U64(0x9E3779B97F4A7C15)), kind="stable")
    k, r = keys[order], row[order]
    same = np.flatnonzero((k[1:] == k[:-1]) & (r[1:] == r[:-1]))
    return np.bincount(r[same], minlength=n).astype(np.float64)


def statistics(b: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A line of shares (as FAULTS) and the number of words of each row; also start and end of words and each row's first."""
    n = len(offs) - 1
    starts, ends, first = tv.words(b, offs)
    count = np.diff(first).astype(np.float64)
    by = np.maximum(count, 1)
    out = np.zeros((n, len(FAULTS)))
    if not len(starts):
        return out, count, starts, ends, first
    w = tv.word_hashes(b, starts, ends)
    row = tv.row_of(first, len(w))
    out[:, 0] = _per_row(_SYMBOL[b], offs) / by
    out[:, 1] = _per_row((b[starts] == 0x7C) & (ends - starts == 1), first) / by
    out[:, 2] = _per_row(np.concatenate([[False], (w[1:] == w[:-1]) & (row[1:] == row[:-1])]), first) / by
    letters = _per_row(_LETTER[b], offs)
    out[:, 3] = np.where(letters >= 20, _per_row(_UPPER[b], offs) / np.maximum(letters, 1), 0)
    out[:, 4] = _per_row(b == 0x21, offs) / by
    if len(w) >= 5:
        ok = np.flatnonzero(tv.inside(first, 5, len(w)))
        out[:, 5] = _again(tv.window_hashes(w, 5)[ok], row[ok], n) / np.maximum(count - 4, 1)
    stops = np.flatnonzero(b == 0x0A)
    begin = np.unique(np.concatenate([offs[:-1][np.diff(offs) > 0], stops[stops + 1 < len(b)] + 1]))
    end = np.minimum(np.append(begin[1:], len(b)), offs[np.searchsorted(offs, begin, "right")])
    line_row = np.searchsorted(offs, begin, "right") - 1
    out[:, 6] = _again(tv.word_hashes(b, begin, end), line_row, n) / np.maximum(np.bincount(line_row, minlength=n), 1)
    tail = b[ends - 1]
    plain = _LETTER[tail] | (tail >= 0x80) | (tail == 0x2E) | (tail == 0x2C)
    out[:, 7] = _per_row(~plain, first) / by
    return out, count, starts, ends, first


def votes_of(stats: np.ndarray, count: np.ndarray) -> np.ndarray:
    """0 says nothing, 1 bad, 2 good; texts without words get no good votes."""
    out = np.zeros((len(stats), VOTERS), np.int64)
    out[:, : len(FAULTS)] = stats > np.array([most for _, most in FAULTS])
    for i, within in enumerate(PROSE, len(FAULTS)):
        ok = count > 0
        for name, most in within.items():
            ok = ok & (stats[:, NAMES.index(name)] <= most)
        out[:, i] = 2 * ok
    return out


POWERS = 3 ** np.arange(VOTERS)


def unpacked(code: np.ndarray) -> np.ndarray:
    return code[:, None] // POWERS % 3


def features(b: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features of each row (shares of word-final trigrams, then ranges), the vote code and the number of words."""
    stats, count, starts, ends, first = statistics(b, offs)
    n = len(count)
    x = np.zeros((n, GRAMS + RANGES * len(FAULTS)), np.float32)
    if len(starts):
        code = b[ends - 1].astype(np.int64)
        for back in (2, 3):
            code = code * 257 + np.where(ends - back >= starts, b[np.maximum(ends - back, 0)], 0)
        column = (tv.mix(code.astype(U64)) >> U64(54)).astype(np.int64)
        x[:, :GRAMS] = np.bincount(tv.row_of(first, len(starts)) * GRAMS + column, minlength=n * GRAMS).reshape(n, GRAMS) / np.maximum(count, 1)[:, None]
    ranges = np.searchsorted(EDGES, stats)
    x[np.arange(n)[:, None], GRAMS + np.arange(len(FAULTS)) * RANGES + ranges] = 1
    return x, votes_of(stats, count) @ POWERS, count


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, float]:
    """Weights and intercept of the scorer. Labellers' accuracies come from all texts, the scorer from about 0.9 * sample_rows texts with the smallest hashes."""
    texts = sh.id_text(docs, doc_id, text)

    def patterns(batches):
        seen = np.zeros(3**VOTERS, np.int64)
        for batch in batches:
            for _lo, _hi, b, offs in tv.blocks(batch["text"]):
                stats, count, *_ = statistics(b, offs)
                seen += np.bincount(votes_of(stats, count) @ POWERS, minlength=len(seen))
        code = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"code": pa.array(code), "n": pa.array(seen[code])})

    table = texts.mapInArrow(patterns, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).orderBy("code").collect()
    code, counts = np.array([r["code"] for r in table], np.int64), np.array([r["n"] for r in table], np.float64)
    dims = GRAMS + RANGES * len(FAULTS)
    if not len(code):
        return np.zeros(dims), 0.0
    votes = unpacked(code)
    bad = (votes == 1).sum(axis=1)
    # kind 0 is good; each fault begins as a kind of its own, shared by the texts where several fire
    start = np.concatenate([np.where(bad > 0, 0.02, 1.0)[:, None], (votes[:, : len(FAULTS)] == 1) / np.maximum(bad, 1)[:, None]], 1)
    model = LabelModel([3] * VOTERS).fit(votes, counts, start)

    share = min(1.0, 0.9 * sample_rows / max(1.0, float(counts.sum())))
    picked = texts.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20)) < int(share * (1 << 20)) + (share == 1.0))

    def sample(batch: pa.RecordBatch) -> pa.Table:
        raw, codes = [], []
        for _lo, _hi, b, offs in tv.blocks(batch["text"], 1 << 18):
            x, c, _ = features(b, offs)
            raw += [line.tobytes() for line in x.astype(np.float16)]
            codes.append(c)
        return pa.table({"doc_id": batch["doc_id"], "x": pa.array(raw, pa.binary()), "code": pa.array(np.concatenate(codes or [np.zeros(0, np.int64)]))})

    got = sh.map_batches(picked, sample, "doc_id long, x binary, code long").toArrow().sort_by([("doc_id", "ascending"), ("code", "ascending")])
    if not len(got):
        return np.zeros(dims), 0.0
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.float16).reshape(len(got), dims).astype(np.float32)
    return dense_logistic(x, model.posterior(unpacked(got["code"].to_numpy()))[:, 0])


def quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS, threshold: float = 0.5) -> DataFrame:
    """doc_id, n_words, score (0 to 1, higher: better) and kept (score >= threshold, with words) for each row of docs.

    A null or empty text has no words, is scored as such and is not kept. A null doc_id stays null;
    equal rows get equal scores. Further columns are ignored. An empty table gives no rows.
    """
    weights, intercept = fit(docs, doc_id, text, sample_rows)
    weights = weights.astype(np.float32)

    def work(batch: pa.RecordBatch) -> pa.Table:
        scores, words = [], []
        for _lo, _hi, b, offs in tv.blocks(batch["text"], 1 << 19):
            x, _code, count = features(b, offs)
            scores.append(1 / (1 + np.exp(-np.clip((x @ weights).astype(np.float64) + intercept, -40, 40))))
            words.append(count.astype(np.int64))
        score = np.concatenate(scores or [np.zeros(0)])
        n = np.concatenate(words or [np.zeros(0, np.int64)])
        return pa.table({"doc_id": batch["doc_id"], "n_words": pa.array(n), "score": pa.array(score), "kept": pa.array((score >= threshold) & (n > 0))})

    return sh.map_batches(sh.id_text(docs, doc_id, text), work, "doc_id long, n_words long, score double, kept boolean")
