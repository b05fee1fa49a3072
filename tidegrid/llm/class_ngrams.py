"""LM scoring with a Brown class-based bigram model.

P(text) is the product over its tokens of P(class | previous class) * P(word | class). All counts come
from every training text:

1. Word counts, by hash bucket. The HEAD * types^(1/3) most frequent words are the head: it grows with
   the vocabulary, and its bigram matrix stays below the vocabulary's size.
2. Bigram counts among the head. Exchange clustering moves head words between classes until no move
   raises the class bigram likelihood; these classes are the start of step 3.
3. Distributed exchange steps for all words, head and others: the classes of all neighbours (ends
   too), summed over the corpus, choose the class under which they are likeliest. After the first, each
   step moves a random half of the words, or rare neighbours would swap classes for ever. Steps go on
   until they have converged: fewer than FEW of the words move, a step moves no fewer than the one
   before, or the information that a class has on the next rises by less than GAIN of itself.
4. Class transitions over all training tokens. Words never seen are one type in a class of its own,
   whose probabilities are those of words seen once.

Texts are tokenised once, where they are read: about part_bytes of them become one row of their distinct
hashes and the sequence of their numbers, in a table in the shared folder that is bucketed by part, so
that no step deals it again. Parts meet their words' counts and classes again through an exchange; the
word table is neither broadcast nor collected.
"""

from __future__ import annotations

import gc
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm import shared as sh
from tidegrid.llm import textvec as tv

U64 = np.uint64
CLASSES = 48
HEAD = 12
FEW = 0.01
GAIN = 0.01
CHUNK = 1 << 21  # tokens that are counted at once
SIDE = 64  # codes of right neighbours begin here
ONCE = 128  # set in a token's class byte if its word was seen once
END = U64(0x0DEAD0E0D0C0FFEE)
COUNTS = "bucket int, keys binary, counts binary"
SENT = "part long, bucket int, n int, keys binary, more binary"
REPLIED = "part long, bucket int, classes binary, counts binary, steps binary, moved long"
ENCODED = "part long, ids binary, first binary, keys binary, seq binary"
CODED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, log_counts double, classes binary"


def train_fold(ids: np.ndarray, held_out: int) -> np.ndarray:
    """Which ids are trained on: CRC-32 of the id as text, modulo 5, is not held_out. Null ids are trained on."""
    import zlib

    return np.array([i == sh.NO_ID or zlib.crc32(str(i).encode()) % 5 != held_out for i in ids.tolist()], bool)


def tokens(b: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words, an end token after each row, and the first token of each row."""
    b = tv.LOWER[b]
    starts, ends, first = tv.words(b, offs)
    w = tv.word_hashes(b, starts, ends)
    n = len(offs) - 1
    return np.insert(w, first[1:], END), first + np.arange(n + 1)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    at, _ = sh.groups_of(keys[order])
    return keys[order][at], (np.add.reduceat(counts[order], at) if len(at) else counts[:0])


def encoded(texts: DataFrame, part_bytes: int = sh.PART_BYTES) -> DataFrame:
    """A row for each part: doc_ids, the first token of each text, the distinct hashes, most frequent first, and their numbers in the order of the tokens (compressed by byte)."""

    def encode(batches):
        context = TaskContext.get()
        part = (context.partitionId() if context else 0) << 32
        ids, w, first, done, size = [], [], [np.zeros(1, np.int64)], 0, 0

        def row():
            keys, seq, often = np.unique(np.concatenate([np.zeros(0, U64), *w]), return_inverse=True, return_counts=True)
            order = np.argsort(-often, kind="stable")
            rank = np.empty(len(keys), np.uint32)
            rank[order] = np.arange(len(keys), dtype=np.uint32)
            planes = np.ascontiguousarray(rank[seq].astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
            raw = lambda x, kind: pa.array([x.astype(kind).tobytes()], pa.binary())
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "ids": raw(np.concatenate(ids), "<i8"), "first": raw(np.concatenate(first), "<i8"), "keys": raw(keys[order], "<u8"), "seq": pa.array([pa.compress(planes, codec="zstd", asbytes=True)], pa.binary())})

        for batch in batches:
            own = batch["doc_id"].fill_null(sh.NO_ID).to_numpy()
            for lo, hi, b, offs in tv.blocks(batch["text"]):
                h, at = tokens(b, offs)
                ids.append(own[lo:hi])
                w.append(h)
                first.append(at[1:] + done)
                done, size = done + len(h), size + len(b)
                if size >= part_bytes:
                    yield row()
                    part += 1
                    ids, w, first, done, size = [], [], [np.zeros(1, np.int64)], 0, 0
        if ids:
            yield row()

    spark = texts.sparkSession
    path, name = sh.shared_dir(spark), f"tidegrid_{uuid.uuid4().hex}"
    rows = texts.select("doc_id", "text").mapInArrow(encode, ENCODED)
    rows.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "part").option("path", path).format("parquet").saveAsTable(name)
    return spark.table(name)


def _as_encoded(rows: DataFrame) -> DataFrame:
    """rows, if they are encoded parts; else those of doc_id and text."""
    return rows if "seq" in rows.columns else encoded(rows)


class _Encoded:
    """One such row."""

    def __init__(self, row: dict, held_out: int):
        self.ids, self.first, keys = (np.frombuffer(row[n], k) for n, k in (("ids", "<i8"), ("first", "<i8"), ("keys", "<u8")))
        n = int(self.first[-1])
        planes = np.frombuffer(pa.decompress(row["seq"], decompressed_size=4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n) if n else np.zeros((4, 0), np.uint8)
        order = np.argsort(keys)
        place = np.empty(len(keys), np.uint32)
        place[order] = np.arange(len(keys), dtype=np.uint32)
        self.keys, self.seq, self.train = keys[order], place[np.ascontiguousarray(planes.T).view("<u4").reshape(-1)], train_fold(self.ids, held_out)

    def chunks(self):
        """Numbers of the tokens, of those before and after them (-1 beyond a text's ends), and whether they are trained on; CHUNK tokens at once."""
        n = len(self.seq)
        for a in range(0, n, CHUNK):
            b = min(n, a + CHUNK)
            own = self.seq[max(0, a - 1) : b + 1].astype(np.int64)
            here = own[a - max(0, a - 1) : len(own) - (min(n, b + 1) - b)]
            before = own[: len(here)] if a else np.concatenate([[-1], own[: len(here) - 1]])
            after = own[-len(here) :] if b < n else np.concatenate([own[len(own) - len(here) + 1 :], [-1]])
            lo, hi = np.searchsorted(self.first, [a, b], "left")
            begin = self.first[lo:hi]
            before, after = before.copy(), after.copy()
            before[begin[begin < b] - a] = -1
            ends = self.first[1:] - 1
            lo, hi = np.searchsorted(ends, [a, b], "left")
            after[ends[lo:hi] - a] = -1
            train = self.train[np.searchsorted(self.first, np.arange(a, b), "right") - 1] if self.train.any() and not self.train.all() else np.full(b - a, bool(self.train.all()))
            yield here, before, after, train


def _rows(batches, held_out: int):
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch[name][i].as_py() for name in batch.schema.names}
            yield row["part"], _Encoded(row, held_out)


def count_words(rows: DataFrame, bits: int, held_out: int) -> DataFrame:
    """bucket, keys (sorted hashes) and counts of the tokens of training texts, stored."""

    def count(batches):
        for _part, own in _rows(batches, held_out):
            n = np.zeros(len(own.keys), np.int64)
            for here, _before, _after, train in own.chunks():
                n += np.bincount(here[train], minlength=len(n))
            some = n > 0
            yield from sh.ask(0, own.keys[some], bits, 8, None, n[some]).select(["bucket", "keys", "more"]).rename_columns(["bucket", "keys", "counts"]).to_batches()

    def total(key, table):
        k, n = _summed(sh.unpack_keys(b"".join(table["keys"].to_pylist()), 8), np.frombuffer(b"".join(table["counts"].to_pylist()), np.int64))
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "keys": pa.array([k.tobytes()], pa.binary()), "counts": pa.array([n.tobytes()], pa.binary())})

    return sh.stored(rows.mapInArrow(count, COUNTS).groupBy("bucket").applyInArrow(total, COUNTS))


def exchange(n: np.ndarray, k: int, fixed: int) -> np.ndarray:
    """A class below k for each head word: n is their bigram count matrix, its last `fixed` lines and columns have classes of their own after k.

    Words start dealt by frequency; each then moves to the class that raises the sum of x log x over class
    bigrams most, less that over class totals, until nobody moves. A move must raise the sum by more than
    rounding can, so no state comes twice and this ends.
    """
    m = len(n) - fixed
    own = np.concatenate([np.arange(m) % k, k + np.arange(fixed)])
    size = k + fixed
    f = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0)
    hot = np.zeros((len(n), size))
    hot[np.arange(len(n)), own] = 1
    n = n.astype(np.float64)
    c = hot.T @ n @ hot
    rounding = 8 * size * np.finfo(np.float64).eps * float(f(c.sum()))
    while True:
        moved = 0
        for w in range(m):
            a = own[w]
            right, left, self_ = n[w] @ hot, n[:, w] @ hot, n[w, w]
            right[a] -= self_
            left[a] -= self_
            # take w out of its class
            c[a] -= right
            c[:, a] -= left
            c[a, a] -= self_
            # what w has beside the other classes stays in their totals, whichever class takes w
            rows, columns = c.sum(axis=1) + left, c.sum(axis=0) + right
            # put it into each class in turn: only that class' line, column and diagonal change
            gain = (f(c[:k] + right[None, :]) - f(c[:k])).sum(axis=1) + (f(c[:, :k] + left[:, None]) - f(c[:, :k])).sum(axis=0)
            i = np.arange(k)
            d = c[i, i]
            gain += f(d + right[:k] + left[:k] + self_) - f(d + right[:k]) - f(d + left[:k]) + f(d)
            gain -= f(rows[:k] + right.sum() + self_) - f(rows[:k]) + f(columns[:k] + left.sum() + self_) - f(columns[:k])
            new = int(np.argmax(gain))
            if gain[new] <= gain[a] + 1e-6 * (1 + abs(gain[a])) + rounding:
                new = int(a)
            c[new] += right
            c[:, new] += left
            c[new, new] += self_
            if new != a:
                hot[w, a], hot[w, new], own[w] = 0, 1, new
                moved += 1
        if not moved:
            break
    return own[:m]


class ClassModel:
    """Classes: 0 .. k-1 of words, k of words without a trained neighbour, k + 1 of the end, k + 2 of unseen words, k + 3 the start."""

    def __init__(self, rows: DataFrame, n_parts: int, held_out: int, classes: int, head: float):
        rows = _as_encoded(rows)
        self.bits, self.held_out, self.k = sh.bucket_bits(n_parts), held_out, classes
        self.counts = count_words(rows, self.bits, held_out)
        read = lambda name: lambda batch: pa.table({name: pa.array([int(np.frombuffer(x, np.int64).sum()) for x in batch["counts"].to_pylist()], pa.int64()), "types": pa.array([len(x) // 8 for x in batch["counts"].to_pylist()], pa.int64())})
        sums = sh.map_batches(self.counts, read("tokens"), "tokens long, types long").agg(F.sum("tokens").alias("n"), F.sum("types").alias("v")).first()
        self.total, self.types = int(sums["n"] or 0), int(sums["v"] or 0)
        size = int(np.ceil(head * self.types ** (1 / 3)))

        def frequent(batches):
            keys, counts = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
            for batch in batches:
                for x, y in zip(batch["keys"].to_pylist(), batch["counts"].to_pylist()):
                    keys.append(np.frombuffer(x, U64))
                    counts.append(np.frombuffer(y, np.int64))
                k, n = np.concatenate(keys), np.concatenate(counts)
                top = np.lexsort((k, -n))[: size + 1]
                keys, counts = [k[top]], [n[top]]
            yield pa.RecordBatch.from_pydict({"word": pa.array(np.concatenate(keys).view(np.int64)), "n": pa.array(np.concatenate(counts))})

        got = self.counts.mapInArrow(frequent, "word long, n long").orderBy(F.desc("n"), "word").limit(size + 1).toArrow()
        words, often = got["word"].to_numpy().view(U64), got["n"].to_numpy()
        order = np.lexsort((words, -often))
        words = words[order]
        words = words[words != END][:size]
        self.words = np.sort(words)
        rank = np.argsort(np.argsort(words))  # position in self.words of the word of each frequency rank
        n = self._bigrams(rows)
        places = np.concatenate([rank, [len(words), len(words) + 1]]).astype(np.int64)
        by_rank = exchange(n[np.ix_(places, places)], classes, 2)
        self.word_class = np.empty(len(words), np.int64)
        self.word_class[rank] = by_rank
        slots = np.concatenate([self.word_class, [classes, classes + 1]])
        steps = np.zeros((SIDE, SIDE))
        np.add.at(steps, (slots[:, None], slots[None, :]), n)
        self.learn(steps)

    def learn(self, steps: np.ndarray) -> None:
        """How likely each neighbour's class is on the left and on the right of each class, from counts of class bigrams."""
        k, places = self.k, [*range(self.k), self.k + 1]
        c = steps + 0.5
        self.log_likely = np.zeros((2 * SIDE, k))
        self.log_likely[places] = np.log(c[places, :k] / c[places, :k].sum(axis=0))
        self.log_likely[[SIDE + x for x in places]] = np.log(c[:k, places] / c[:k, places].sum(axis=1, keepdims=True)).T

    def _bigrams(self, rows: DataFrame) -> np.ndarray:
        words, held_out, m = self.words, self.held_out, len(self.words)

        def count(batches):
            n = np.zeros((m + 2) * (m + 2), np.int64)
            for _part, own in _rows(batches, held_out):
                place = np.append(_head_index(words, own.keys), m + 1)  # before a text's first token stands an end
                for here, before, _after, ok in own.chunks():
                    pair, times = np.unique(place[before[ok]] * (m + 2) + place[here[ok]], return_counts=True)
                    n[pair] += times
            at = np.flatnonzero(n)
            for a in range(0, len(at), 1 << 16):
                yield pa.RecordBatch.from_pydict({"pair": pa.array(at[a : a + (1 << 16)]), "n": pa.array(n[at[a : a + (1 << 16)]])})

        rows = rows.mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
        out = np.zeros((m + 2) * (m + 2))
        out[rows["pair"].to_numpy()] = rows["n"].to_numpy()
        return out.reshape(m + 2, m + 2)


def information(steps: np.ndarray) -> float:
    """The mutual information of neighbouring classes, in nats a token, from their bigram counts."""
    p = steps / max(1.0, steps.sum())
    q = p.sum(axis=1, keepdims=True) * p.sum(axis=0, keepdims=True)
    return float((p[p > 0] * np.log(p[p > 0] / q[p > 0])).sum())


def coded(rows: DataFrame, model: ClassModel) -> DataFrame:
    """Each text as the classes of its tokens, with its base score, through the exchange."""
    rows = _as_encoded(rows)
    bits, k, held_out, total, types = model.bits, model.k, model.held_out, model.total, model.types
    head, head_class, counts = model.words, model.word_class, model.counts
    known_class = np.concatenate([head_class, [k, k + 1]])  # k: none yet
    index = lambda w: _head_index(head, w)

    def send(table, replies=None):
        row = table.to_pylist()[0]
        part = _Encoded(row, held_out)
        keys = part.keys
        own = known_class[index(keys)].astype(np.uint8) if replies is None else np.frombuffer(b"".join(replies.sort_by("bucket")["classes"].to_pylist()), np.uint8)
        class_of = np.append(own, k + 1).astype(np.int64)  # beyond a text's ends stands an end
        codes, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        is_end = np.append(keys == END, False)
        for here, before, after, ok in part.chunks():
            left, right = class_of[before], class_of[after]
            x, y = ok & (left != k), ok & (right != k) & ~is_end[here]
            got = np.unique(np.concatenate([here[x] * 2 * SIDE + left[x], here[y] * 2 * SIDE + SIDE + right[y]]), return_counts=True)
            codes, n = _summed(np.concatenate([codes, got[0]]), np.concatenate([n, got[1]])) if len(codes) else got
        sizes = np.bincount(codes // (2 * SIDE), minlength=len(keys))
        bucket = (keys >> U64(64 - bits)).astype(np.int64)
        which = np.unique(bucket)
        lo, hi = np.searchsorted(bucket, which, "left"), np.searchsorted(bucket, which, "right")
        at = np.concatenate([[0], np.cumsum(sizes)])
        blob = lambda a, b: own[a:b].tobytes() + sizes[a:b].astype("<u2").tobytes() + (codes[at[a] : at[b]] % (2 * SIDE)).astype(np.uint8).tobytes() + n[at[a] : at[b]].astype("<u4").tobytes()
        return pa.table(
            {
                "part": pa.array(np.full(len(which), row["part"], np.int64)),
                "bucket": pa.array(which.astype(np.int32)),
                "n": pa.array((hi - lo).astype(np.int32)),
                "keys": pa.array([keys[a:b].tobytes() for a, b in zip(lo, hi)], pa.binary()),
                "more": pa.array([blob(a, b) for a, b in zip(lo, hi)], pa.binary()),
            }
        )

    def choose(asked, table, log_likely, turn):
        """The exchange step: every word of the bucket gets the class under which its neighbours are likeliest."""
        keys = np.frombuffer(b"".join(table["keys"].to_pylist()), U64)
        often = np.frombuffer(b"".join(table["counts"].to_pylist()), np.int64)
        seen, old = np.zeros((len(keys), 2 * SIDE)), np.full(len(keys), k)
        asked = asked.sort_by("part")
        words, raws = asked["keys"].to_pylist(), asked["more"].to_pylist()
        for word, raw in zip(words, raws):
            w = np.frombuffer(word, U64)
            if not len(keys):
                break
            at = np.minimum(np.searchsorted(keys, w), len(keys) - 1)
            ok = keys[at] == w
            old[at[ok]] = np.frombuffer(raw, np.uint8, len(w))[ok]
            sizes = np.frombuffer(raw, "<u2", len(w), len(w)).astype(np.int64)
            m = int(sizes.sum())
            if m:
                code = np.frombuffer(raw, np.uint8, m, 3 * len(w))  # words with neighbours were trained on, so they are among the keys
                np.add.at(seen.reshape(-1), np.repeat(at, sizes) * 2 * SIDE + code, np.frombuffer(raw, "<u4", m, 3 * len(w) + m).astype(np.float64))
        likely = seen @ log_likely
        best = np.argmax(likely, axis=1) if len(keys) else np.zeros(0, np.int64)
        stays = (old < k) & (likely[np.arange(len(keys)), np.minimum(old, k - 1)] >= likely.max(axis=1, initial=-np.inf))
        waits = (old < k) & ((keys >> U64(turn % 32)) & U64(1) == 1) if turn else np.zeros(len(keys), bool)
        best = np.where(stays | waits, old, np.where(seen.any(axis=1), best, k))
        best = np.where(keys == END, k + 1, best)
        moved = int(((best != old) & (keys != END)).sum())
        steps = np.zeros((SIDE, SIDE))
        np.add.at(steps.T, best, seen[:, :SIDE])
        classes, counts = [], []
        for word in words:
            w = np.frombuffer(word, U64)
            at = np.minimum(np.searchsorted(keys, w), max(0, len(keys) - 1))
            ok = (keys[at] == w) if len(keys) else np.zeros(len(w), bool)
            classes.append(np.where(ok, best[at], k + 2).astype(np.uint8).tobytes() if len(keys) else np.full(len(w), k + 2, np.uint8).tobytes())
            # counts do not change: they go back once
            counts.append(None if turn else (np.where(ok, often[at], 0) if len(keys) else np.zeros(len(w))).astype("<u4" if total < 1 << 32 else "<i8").tobytes())
        return pa.table({"part": asked["part"].cast(pa.int64()), "bucket": asked["bucket"].cast(pa.int32()), "classes": pa.array(classes, pa.binary()), "counts": pa.array(counts, pa.binary()), "steps": pa.array([steps.tobytes()] + [None] * (len(asked) - 1) if len(asked) else [], pa.binary()), "moved": pa.array([moved] + [0] * (len(asked) - 1) if len(asked) else [], pa.int64())})

    def code(key, table, replies):
        part = _Encoded(table.to_pylist()[0], held_out)
        ids, train, first = part.ids, part.train, part.first
        replies = replies.sort_by("bucket")  # buckets follow the order of the keys
        joined = lambda name: b"".join(x for x in replies[name].to_pylist() if x is not None)
        cls = np.frombuffer(joined("classes"), np.uint8)
        often = np.frombuffer(joined("counts"), "<u4" if total < 1 << 32 else "<i8").astype(np.int64)
        base = np.log10(often + 0.5) - np.log10(total + 0.5 * (types + 1))
        logs = np.where(often > 0, np.log10(np.maximum(often, 1)), 0.0)
        mark = np.where(often == 1, cls | ONCE, cls).astype(np.uint8)
        out = {n: [] for n in ("n_tokens", "n_known", "base_score", "log_counts", "classes")}
        step = max(1, len(ids) // (1 + len(part.seq) // CHUNK))
        for lo in range(0, len(ids), step):
            hi = min(len(ids), lo + step)
            at = first[lo : hi + 1] - first[lo]
            i = part.seq[first[lo] : first[hi]]
            out["n_tokens"].append(np.diff(at))
            out["n_known"].append(np.add.reduceat(often[i] > 0, at[:-1], dtype=np.int64))
            out["base_score"].append(np.add.reduceat(base[i], at[:-1]))
            out["log_counts"].append(np.add.reduceat(logs[i], at[:-1]))
            raw = memoryview(mark[i].tobytes())
            out["classes"] += [raw[x:y].tobytes() for x, y in zip(at.tolist(), at[1:].tolist())]
        flat = lambda n, kind: pa.array(np.concatenate(out[n] or [np.zeros(0)]).astype(kind))
        return pa.table({"doc_id": sh.null_ids(ids), "held_out": pa.array(~train), "n_tokens": flat("n_tokens", np.int64), "n_known": flat("n_known", np.int64), "base_score": flat("base_score", np.float64), "log_counts": flat("log_counts", np.float64), "classes": pa.array(out["classes"], pa.binary())})

    def chooser(log_likely, turn):
        return lambda key, asked, table: choose(asked, table, log_likely, turn)

    def summed(batches):
        steps, moved = np.zeros((SIDE, SIDE)), 0
        for batch in batches:
            steps = sum((np.frombuffer(x, np.float64).reshape(SIDE, SIDE) for x in batch["steps"].to_pylist() if x), steps)
            moved += sum(batch["moved"].to_pylist())
        yield pa.RecordBatch.from_pydict({"steps": pa.array([steps.tobytes()], pa.binary()), "moved": pa.array([moved], pa.int64())})

    by_part, replies, counted, last, known = rows.groupBy("part"), None, None, None, 0.0
    model.moved, model.information = [], []
    while True:
        sent = by_part.applyInArrow(lambda key, table: send(table), SENT) if replies is None else by_part.cogroup(replies.select("part", "bucket", "classes").groupBy("part")).applyInArrow(lambda key, table, replies: send(table, replies), SENT)
        replies = sh.stored(sent.groupBy("bucket").cogroup(counts.groupBy("bucket")).applyInArrow(chooser(model.log_likely, len(model.moved)), REPLIED))
        counted = counted or replies.select("part", "bucket", F.lit(None).cast("binary").alias("classes"), "counts")
        got = replies.select("steps", "moved").mapInArrow(summed, "steps binary, moved long").toArrow().to_pylist()
        moved = sum(r["moved"] for r in got)
        model.steps = sum((np.frombuffer(r["steps"], np.float64).reshape(SIDE, SIDE) for r in got), np.zeros((SIDE, SIDE)))
        model.moved.append(moved)
        model.information.append(information(model.steps))
        settled = len(model.moved) > 3 and (moved >= last or model.information[-1] < (1 + GAIN) * known)
        if moved <= FEW * types or settled:
            break
        model.learn(model.steps)
        last, known = moved, model.information[-1]
        gc.collect()
        rows.sparkSession._jvm.System.gc()  # lets Spark drop the shuffle files of finished steps
    both = replies.select("part", "bucket", "classes", F.lit(None).cast("binary").alias("counts")).unionByName(counted)
    return by_part.cogroup(both.groupBy("part")).applyInArrow(code, CODED)


def _head_index(words: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The number of each head word; the number of head words for others, and one more for ends."""
    m = len(words)
    out = np.full(len(w), m, np.int64)
    if m:
        at = np.minimum(np.searchsorted(words, w), m - 1)
        out = np.where(words[at] == w, at, m)
    out[w == END] = m + 1
    return out


def _steps(raw: list[bytes], start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class bytes of all tokens, those before them (the start's at each text's beginning), and where each text begins."""
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    first = np.cumsum(size) - size
    c = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
    before = np.concatenate([[start], c[:-1]]) if len(c) else c
    before[first] = start
    return c, before, first


def transitions(texts: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """log10 P(class | previous class) over all classes, and the tokens of each class, from the training texts."""
    size, start, unseen = k + 4, k + 3, k + 2

    def count(batches):
        n = np.zeros(256 * 256, np.int64)
        for batch in batches:
            raw = [x for x, held in zip(batch["classes"].to_pylist(), batch["held_out"].to_pylist()) if not held]
            if raw:
                c, before, _ = _steps(raw, start)
                n += np.bincount(before * 256 + c, minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"step": pa.array(at), "n": pa.array(n[at])})

    rows = texts.select("held_out", "classes").mapInArrow(count, "step long, n long").groupBy("step").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(256 * 256)
    n[rows["step"].to_numpy()] = rows["n"].to_numpy()
    n = n.reshape(256, 256)
    real = np.zeros((size, size))
    once_after, after_once = np.zeros(size), np.zeros(size)
    for a in range(256):
        for b in np.flatnonzero(n[a]):
            x, y = a & (ONCE - 1), int(b) & (ONCE - 1)
            real[x, y] += n[a, b]
            once_after[x] += n[a, b] * (int(b) >= ONCE)
            after_once[y] += n[a, b] * (a >= ONCE)
    # an unseen word stands where words seen once stand, and is followed by what follows those
    real[unseen] = after_once
    once_after[unseen] = n[ONCE:, ONCE:].sum()
    of_class = real.sum(axis=0) - real[unseen]
    share = (of_class + 1e-9) / (of_class.sum() + 1e-9 * size)
    row = real.sum(axis=1, keepdims=True)
    kinds = (real > 0).sum(axis=1, keepdims=True)
    p = (real + np.maximum(kinds, 1) * share) / (row + np.maximum(kinds, 1))
    overall = (once_after.sum() + 0.5) / (of_class.sum() + 1)
    unknown = np.clip((once_after + 10 * overall) / (row[:, 0] + 10), 1e-9, 0.9)
    p = p * (1 - unknown)[:, None]
    p[:, unseen] = unknown
    return np.log10(np.maximum(p, 1e-300)), of_class


def scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", held_out: int = 1, classes: int = CLASSES, head: float = HEAD, part_bytes: int = sh.PART_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity for each row of docs.

    Trained on the rows whose CRC-32 of doc_id as text, modulo 5, is not held_out (null ids are trained on). Tokens are
    the lower-cased (A-Z) words [^\\x20\\x09-\\x0D]+ and one end. score is the model's log10 probability
    of the text, base_score that of smoothed single words. A null text is its end. Equal rows count
    each. Further columns are ignored. An empty table gives no rows.
    """
    n = -(-sh.text_bytes(docs, text) // part_bytes)
    rows = encoded(sh.id_text(docs, doc_id, text), part_bytes)
    model = ClassModel(rows, n, held_out, classes, head)
    texts = sh.stored(coded(rows, model))
    log_p, of_class = transitions(texts, classes)
    k, start = classes, classes + 3
    emit = np.where(np.arange(classes + 4) == classes + 2, 0.0, -np.log10(np.maximum(of_class, 1)))
    step = log_p + emit[None, :]

    def score(batch: pa.RecordBatch) -> pa.Table:
        c, before, first = _steps(batch["classes"].to_pylist(), start)
        c, before = c & (ONCE - 1), before & (ONCE - 1)
        total = np.add.reduceat(step[before, c], first) + batch["log_counts"].to_numpy()
        n = batch["n_tokens"].to_numpy()
        out = {x: batch[x] for x in ("doc_id", "held_out", "n_tokens", "n_known")}
        return pa.table(out | {"train_tokens": pa.array(np.full(len(n), train, np.int64)), "base_score": batch["base_score"], "score": pa.array(total), "perplexity": pa.array(10 ** np.minimum(300, -total / n))})

    train = model.total
    assert k + 4 <= SIDE
    return sh.map_batches(texts, score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
