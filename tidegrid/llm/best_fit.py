"""Bound-certified best-fit packing of tokenised documents.

Documents become token ids (tokenizers, each distinct word of a block once, through a cache) and an end
id; only longer ones are cut. Full pieces stand alone. The others are dealt into partitions of bounded size, each packed
by best-fit decreasing. Dual-feasible functions give each partition a lower bound of its bin count:
where the packing meets it, it is certified as optimal and closed. Partitions with a gap give up
their worst-filled bins' documents, which are dealt anew across partitions and packed again, for a
few rounds or until no gap is left.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm import shared as sh
from tidegrid.llm import textvec as tv

VOCABULARY = "word_bpe_49k.json"
SIZE = 2048
END_ID = 0
#: About 45 MB of a Python worker, which keeps it between tasks.
CACHE_WORDS = 300_000
#: Texts are encoded in blocks of about so many bytes: larger ones look up fewer distinct words in all.
BLOCK_BYTES = 2 << 20
PIECES = "doc_id long, row long, piece int, start long, length long, ids_crc32 long"
PACKED = "doc_id long, row long, piece int, start long, length long, ids_crc32 long, part long, bin long, offset long, fill long, gap long"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: ASCII letters, digits, other visible signs, and Latin-1 letters (two bytes: 0xC3 and one but those of the signs for times and division).
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = 3
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = 1
_KIND[0x30:0x3A] = 2
_SECOND = np.zeros(256, bool)
_SECOND[0x80:0xC0] = True
_SECOND[[0x97, 0xB7]] = False
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\xa0-\xb6\xb8-\xbe])+")


def cuts(b: np.ndarray) -> np.ndarray:
    """Positions where the pre-tokenizer surely ends a token although no white space stands there.

    They are those between a letter and a sign, between a sign that is no apostrophe and a letter (an
    apostrophe may begin a contraction), and on both sides of a digit, among ASCII and Latin-1 letters.
    """
    if len(b) < 2:
        return np.zeros(0, np.int64)
    left, right = _KIND[b[:-1]].copy(), _KIND[b[1:]].copy()
    second = np.flatnonzero((b[:-1] == 0xC3) & _SECOND[b[1:]]) + 1  # last bytes of Latin-1 letters
    left[second[second < len(left)]] = 1
    right[second[second >= 2] - 2] = 1  # as seen from before their first bytes
    sign = (left == 1) & (right == 3) | (left == 3) & (right == 1) & (b[:-1] != 0x27)
    digit = (left == 2) & (right > 0) | (right == 2) & (left > 0)
    return np.flatnonzero(sign | digit) + 1


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... of sizes[0] numbers, and so on for each."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class WordTokenizer:
    """Token ids of whole texts. White space ends every token of this vocabulary's pre-tokenizer, so words are encoded once and remembered.

    Letter case and the signs around words multiply the words to remember, so ASCII is lowered first
    and words are cut where the pre-tokenizer cuts them anyway. Texts that hold "<|" are encoded as
    they are, as special tokens are told apart by case.
    """

    _kept: dict[str, "WordTokenizer"] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        words = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(words.values()) + 1, bool)
        self.ends_word[[i for w, i in words.items() if w.endswith("</w>")]] = True
        self.clear()

    @classmethod
    def of(cls, path: str) -> "WordTokenizer":
        """One for each Python worker."""
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.flat = np.array([END_ID], np.uint32)  # number 0 is the end of a document
        self.at = np.array([0, 1], np.int64)
        self.again = np.zeros(1, bool)  # whether a later block had the word as well

    def forget(self) -> None:
        """Keeps the words that a later block had as well, or none if they are more than half of the cache."""
        words, again = list(self.number), self.again
        numbers = np.fromiter(self.number.values(), np.int64, len(words))
        on = np.flatnonzero(again[numbers])
        flat, at = self.flat, self.at
        self.clear()
        if 0 < len(on) <= CACHE_WORDS // 2:
            sizes = at[numbers[on] + 1] - at[numbers[on]]
            self._add([words[i] for i in on.tolist()], [flat[_runs(at[numbers[on]], sizes)]], [sizes])

    def _add(self, words: list[bytes], flat: list[np.ndarray], sizes: list[np.ndarray]) -> None:
        base, n = len(self.at) - 1, np.concatenate(sizes)
        assert len(n) == len(words)
        self.number.update(zip(words, range(base, base + len(words))))
        self.flat = np.concatenate([self.flat, *flat])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(n)])
        self.again = np.concatenate([self.again, np.zeros(len(words), bool)])

    def learn(self, new: list[bytes]) -> None:
        plain, other = [], []
        for w in new:
            (plain if _LETTERS.fullmatch(w) else other).append(w)
        flat, sizes = [], []
        for k in range(0, len(plain), 20_000):  # words of letters are one pre-token each, whose last id ends a word
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(plain[k : k + 20_000]).decode()], add_special_tokens=False)[0].ids, np.uint32)
            flat.append(ids)
            sizes.append(np.diff(np.flatnonzero(self.ends_word[ids]), prepend=-1))
        if other:
            ids = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w in other], add_special_tokens=False)]
            flat.append(np.array([x for i in ids for x in i], np.uint32))
            sizes.append(np.fromiter(map(len, ids), np.int64, len(ids)))
        self._add([*plain, *other], flat, sizes)

    def encode(self, b: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block of texts, each text with its end id, and where each text starts (and the last ends)."""
        cut = cuts(b)
        low = np.insert(tv.LOWER[b], cut, 0x20)
        rows = offs + np.searchsorted(cut, offs, "left")
        special = {i: t for i, t in enumerate(b[x:y].tobytes() for x, y in zip(offs, offs[1:])) if b"<|" in t} if b"<|" in b.tobytes() else {}
        for i in special:
            low[rows[i] : rows[i + 1]] = 0x20
        starts, ends, first = tv.words(low, rows)
        place = np.concatenate([[0], np.cumsum(ends - starts)])
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(place), pa.py_buffer(low[tv.NON_SPACE[low]])]).dictionary_encode()
        distinct = words.dictionary.to_pylist()
        if len(self.number) > CACHE_WORDS:
            self.forget()
        number = np.array([self.number.get(w, -1) for w in distinct], np.int64)
        self.again[number[number >= 0]] = True
        new = np.flatnonzero(number < 0)
        if len(new):
            unknown = [distinct[i] for i in new.tolist()]
            self.learn(unknown)
            number[new] = [self.number[w] for w in unknown]
        which = np.insert(number[words.indices.to_numpy()], first[1:], 0)
        sizes = self.at[which + 1] - self.at[which]
        ids = self.flat[_runs(self.at[which], sizes)]
        at = np.concatenate([[0], np.cumsum(sizes)[which == 0]])
        if special:
            runs = [ids[x:y] for x, y in zip(at, at[1:])]
            for i, t in special.items():
                runs[i] = np.array([*self.tokenizer.encode(t.decode(), add_special_tokens=False).ids, END_ID], np.uint32)
            ids, at = np.concatenate(runs), np.concatenate([[0], np.cumsum([len(r) for r in runs])])
        return ids, at


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, path: str | None = None, ids: bool = False) -> DataFrame:
    """doc_id, row (numbers the rows, so that equal rows stay apart), piece, start, length and ids_crc32 of each piece; with ids, the ids as well.

    A null or empty text is its end id alone.
    """
    path = path or vocabulary_path()
    schema = PIECES + (", ids array<long>" if ids else "")

    def run(batches):
        coder = WordTokenizer.of(path)
        for batch in batches:
            for lo, hi, b, offs in tv.blocks(batch["text"], BLOCK_BYTES):
                flat, at = coder.encode(b, offs)
                flat = flat.astype("<u4")
                n = np.diff(at)
                count = -(-n // size)
                row = np.repeat(np.arange(hi - lo), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * size
                length = np.minimum(size, n[row] - start)
                begin = at[row] + start
                raw = memoryview(flat.tobytes())
                crc = [zlib.crc32(raw[4 * x : 4 * (x + m)]) for x, m in zip(begin.tolist(), length.tolist())]
                columns = {
                    "doc_id": batch["doc_id"].slice(lo, hi - lo).take(pa.array(row)),
                    "row": batch["row"].slice(lo, hi - lo).take(pa.array(row)),
                    "piece": pa.array(piece.astype(np.int32)),
                    "start": pa.array(start),
                    "length": pa.array(length),
                    "ids_crc32": pa.array(crc, pa.int64()),
                }
                if ids:
                    columns["ids"] = pa.array([flat[x : x + m].astype(np.int64) for x, m in zip(begin, length)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(columns)
        sh.give_back()

    return sh.id_text(docs, doc_id, text).withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, schema)


def lower_bound(lengths: np.ndarray, size: int = SIZE) -> int:
    """The best of three families of dual-feasible functions over all thresholds: none of them can exceed the optimal bin count.

    For a threshold t: sizes above size - t count as a whole bin and sizes below t as nothing (Martello
    and Toth); the rounding function of u(k), which maps x to floor((k + 1) x / size) / k unless that is
    whole; and plain volume.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=size + 1).astype(np.int64)
    x = np.arange(size + 1)
    volume = np.cumsum(count * x)
    best = -(-int(volume[size]) // size)
    above = np.concatenate([np.cumsum(count[::-1])[::-1], [0]])
    for t in range(1, size // 2 + 1):
        whole = int(above[size - t + 1])
        middle = int(volume[size - t] - volume[t - 1])
        best = max(best, whole + -(-middle // size))
    for k in range(1, 33):
        top = (k + 1) * x
        value = np.where(top % size == 0, x * k, top // size * size)  # times k * size
        best = max(best, -(-int((count * value).sum()) // (k * size)))
    return best


def best_fit_decreasing(lengths: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, longest first into the fullest bin that takes it, and the fill of each bin."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    room_bins: list[list[int]] = [[] for _ in range(size + 1)]
    rooms = 0  # bit r: some open bin has room r
    fill: list[int] = []
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        fits = rooms >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            k = room_bins[r].pop()
            if not room_bins[r]:
                rooms ^= 1 << r
        else:
            r, k = size, len(fill)
            fill.append(0)
        bins[i], offsets[i] = k, fill[k]
        fill[k] += n
        r -= n
        if r:
            if not room_bins[r]:
                rooms |= 1 << r
            room_bins[r].append(k)
    return bins, offsets, np.array(fill, np.int64)


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, path: str | None = None, part_items: int = 20_000, rounds: int = 3) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of each piece; sequences hold `size` tokens at most.

    Every row of docs is packed, a null or empty text as its end id. Rows with the same doc_id, or a
    null one, are packed each. Further columns are ignored. An empty table gives no rows.
    """
    rows = sh.stored(pieces(docs, doc_id, text, size, path))
    whole = rows.where(F.col("length") == size)
    open_ = rows.where(F.col("length") < size)
    n = open_.count()

    def packed(items: DataFrame, first: int) -> DataFrame:
        def run(key, table):
            table = table.sort_by([("row", "ascending"), ("piece", "ascending")])
            lengths = table["length"].to_numpy()
            bins, offsets, fill = best_fit_decreasing(lengths, size)
            gap = len(fill) - lower_bound(lengths, size)
            out = table.drop_columns(["part"])
            for name, values in (("part", np.full(len(table), key[0].as_py() + first)), ("bin", bins), ("offset", offsets), ("fill", fill[bins]), ("gap", np.full(len(table), gap))):
                out = out.append_column(name, pa.array(values.astype(np.int64)))
            return out

        return items.groupBy("part").applyInArrow(run, PACKED)

    deal = lambda items, k, seed: items.withColumn("part", F.pmod(F.xxhash64("row", "piece", F.lit(seed)), F.lit(k)).cast("long"))
    parts = max(1, min(32, n // 1000), -(-n // part_items))
    now = sh.stored(packed(deal(open_, parts, 0), 0))
    done: list[DataFrame] = []
    first = parts
    for turn in range(rounds):
        # a certified partition is closed; of the others, bins that waste over a sixty-fourth are opened
        loose = (F.col("gap") > 0) & (F.col("fill") < size - size // 64)
        bins = lambda df: df.where(F.col("offset") == 0).count()
        before = bins(now.where(loose))
        if before < 2:
            break
        again = max(1, -(-before // (part_items // 4)))
        new = sh.stored(packed(deal(now.where(loose).select(rows.columns), again, turn + 1), first))
        if bins(new) >= before:
            break
        done.append(now.where(~loose))
        now, first = new, first + again
    out = now
    for part in done:
        out = out.unionByName(part)
    sequence = lambda df: df.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    alone = whole.select("doc_id", "piece", "start", "length", "ids_crc32", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return sequence(out.withColumn("sequence_id", F.shiftleft(F.col("part"), 32) + F.col("bin"))).unionByName(sequence(alone))


