"""Benchmark decontamination by a stored positional inverted index.

The index is partitioned by document. Each shard (a block of texts of about 1 MB) is one row of a
table in the shared folder: its documents, its distinct terms, and for each term the sorted list of
the positions where it stands. The table is written once and answers any number of test sets; the
texts are not read again, and the corpus is never shuffled.

A test window is looked up in every shard. The postings of its rarest term there give candidate
starts; the offset-adjusted postings of the other terms, by growing length, are intersected with
them by binary search, so a common term's long list is never walked. Test items travel to the shards
in blocks of bounded size (block_bytes), one pass over the index for each block.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm import shared as sh
from tidegrid.llm import textvec as tv

U64 = np.uint64
BLOCK_BYTES = 8 << 20
INDEX = "shard long, ids array<long>, first binary, terms binary, sizes binary, positions binary"
HITS = "shard long, row int, hits binary, items array<string>"
OUT = "doc_id long, n_words long, spans array<struct<start:long,end:long>>, items array<string>"
POSTINGS = "shard long, term long, doc_id long, positions array<int>"


def tokens(b: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words and the first word of each row."""
    b = tv.LOWER[b]
    starts, ends, first = tv.words(b, offs, tv.ALNUM)
    return tv.word_hashes(b, starts, ends), first


class Postings:
    """The positional index of one shard: the list of term t is positions[edges[t] : edges[t + 1]]."""

    def __init__(self, terms: np.ndarray, edges: np.ndarray, positions: np.ndarray, first: np.ndarray):
        self.terms, self.edges, self.positions, self.first = terms, edges, positions, first
        self.row = tv.row_of(first, len(positions))
        # a posting as one number, in the order of the lists
        self.keys = np.repeat(np.arange(len(terms)) * len(positions), np.diff(edges)) + positions

    @classmethod
    def of(cls, w: np.ndarray, first: np.ndarray) -> Postings:
        """From the words of some rows."""
        positions = np.argsort(w, kind="stable")
        at, n = sh.groups_of(w[positions])
        return cls(w[positions[at]], np.append(at, len(w)).astype(np.int64), positions, first)

    @classmethod
    def stored(cls, shard: dict) -> Postings:
        """From a row of the table of index()."""
        edges = np.concatenate([[0], np.cumsum(np.frombuffer(shard["sizes"], np.int32), dtype=np.int64)])
        return cls(np.frombuffer(shard["terms"], U64), edges, np.frombuffer(shard["positions"], np.int32).astype(np.int64), np.frombuffer(shard["first"], np.int32).astype(np.int64))

    def lists(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The number of each term here, and where in `positions` its list starts and ends; an absent term's is empty."""
        t = np.searchsorted(self.terms, terms)
        t[t == len(self.terms)] = 0
        here = self.terms[t] == terms
        return t, np.where(here, self.edges[t], 0), np.where(here, self.edges[t + 1], 0)

    def candidates(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The positions of some lists, and the number of the list of each."""
        n = hi - lo
        which = np.repeat(np.arange(len(n)), n)
        return self.positions[np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())], which

    def holds(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Whether the list of each term has the position."""
        key = term * len(self.positions) + position
        at = np.searchsorted(self.keys, key)
        return self.keys[np.minimum(at, len(self.keys) - 1)] == key

    def rarest(self, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order of each window's cells by growing length of list, and the windows all of whose terms are here."""
        return np.argsort(often, axis=1, kind="stable"), np.flatnonzero(often.min(axis=1) > 0)

    def phrase(self, terms: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and numbers of the windows that occur within a row. cells: a window a line, as numbers into terms."""
        k = cells.shape[1]
        here, lo, hi = self.lists(terms)
        by, live = self.rarest((hi - lo)[cells])
        if not len(live):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        first = cells[live, by[live, 0]]
        start, which = self.candidates(lo[first], hi[first])
        which = live[which]
        start = start - by[which, 0]
        ok = (start >= 0) & (start + k <= len(self.positions))
        start, which = start[ok], which[ok]
        ok = self.row[start] == self.row[start + k - 1]
        start, which = start[ok], which[ok]
        for i in range(1, k):
            at = by[which, i]
            ok = self.holds(here[cells[which, at]], start + at)
            start, which = start[ok], which[ok]
        return start, which

    def near(self, terms: np.ndarray, cells: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and number of the windows all of whose terms stand, in any order, within `span` words of a row.

        For each place of a term of the window: the shortest run of words that ends there and holds all
        terms, if it has at most span words. Which term is the rarest decides only what is looked at first.
        """
        _here, lo, hi = self.lists(terms)
        by, live = self.rarest((hi - lo)[cells])
        out = [(np.zeros(0, np.int64),) * 3]
        first = cells[live, by[live, 0]]
        at, which = self.candidates(lo[first], hi[first])
        which = live[which]
        low, high = np.maximum(self.first[self.row[at]], at - span + 1), np.minimum(self.first[self.row[at] + 1], at + span)
        for i in range(1, cells.shape[1]):
            t = cells[which, by[which, i]]
            ok = np.zeros(len(at), bool)
            for one in np.unique(t):
                mine = np.flatnonzero(t == one)
                own = self.positions[lo[one] : hi[one]]
                ok[mine] = np.searchsorted(own, low[mine], "left") < np.searchsorted(own, high[mine], "left")
            at, which, low, high = at[ok], which[ok], low[ok], high[ok]
        for window in np.unique(which):
            lists = [self.positions[lo[t] : hi[t]] for t in np.unique(cells[window])]
            end = np.sort(np.concatenate(lists))
            start = end.copy()
            for own in lists:  # the last place of each term up to there
                last = np.searchsorted(own, end, "right") - 1
                start = np.minimum(start, np.where(last >= 0, own[np.maximum(last, 0)], -1))
            ok = (start >= 0) & (end - start < span)
            start, end = start[ok], end[ok]
            ok = self.row[start] == self.row[end]
            out.append((start[ok], end[ok] + 1, np.full(ok.sum(), window)))
        return tuple(np.concatenate(x) for x in zip(*out))


class Queries:
    """The windows of a block of test items, by length, and the items of each distinct window."""

    def __init__(self, ids: list[str], texts: list[str | None], size: int):
        data, offs = tv.buffers(pa.array(texts, pa.large_string()))
        w, first = tokens(data[offs[0] : offs[-1]], offs - offs[0])
        self.ids = ids
        found: dict[int, tuple[list[np.ndarray], list[np.ndarray]]] = {}
        for i in range(len(ids)):
            own = w[first[i] : first[i + 1]]
            if len(own):
                k = min(size, len(own))
                lines, who = found.setdefault(k, ([], []))
                lines.append(np.lib.stride_tricks.sliding_window_view(own, k))
                who.append(np.full(len(own) - k + 1, i))
        self.sets = []
        for k, (lines, who) in sorted(found.items()):
            windows, inverse = np.unique(np.concatenate(lines), axis=0, return_inverse=True)
            order = np.argsort(inverse.reshape(-1), kind="stable")
            terms, cells = np.unique(windows, return_inverse=True)
            edges = np.searchsorted(inverse.reshape(-1)[order], np.arange(len(windows) + 1))
            self.sets.append((k, terms, cells.reshape(windows.shape), np.concatenate(who)[order], edges))

    def asked(self, index: Postings, span: int | None = None):
        """For each row with a match: its number, the pairs of start and end in its words, and the items."""
        first, found = index.first, []
        for k, terms, cells, who, edges in self.sets:
            s, number = index.phrase(terms, cells)
            e = s + k
            if span is not None:
                more = index.near(terms, cells, span)
                s, e, number = (np.concatenate([x, y]) for x, y in zip((s, e, number), more))
            row = index.row[s]
            order = np.argsort(row, kind="stable")
            pairs = np.stack([s - first[row], e - first[row]], 1).astype(np.int32)
            for a, m in zip(*sh.groups_of(row[order])):
                mine = order[a : a + m]
                items = {self.ids[i] for x in np.unique(number[mine]) for i in who[edges[x] : edges[x + 1]] if self.ids[i] is not None}
                found.append((int(row[order[a]]), pairs[mine], items))
        return found


def item_blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int):
    """Whether it is the last, ids and texts of blocks of test items, each of about block_bytes at most, one after another on the driver."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).cast("string").alias("text"))
    n = max(1, -(-sh.text_bytes(items) // block_bytes))
    for k in range(n):
        rows = (items if n == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)).collect()
        yield k == n - 1, [r["item"] for r in rows], [r["text"] for r in rows]


def _spans(n_words: int, raw: bytes) -> list[dict]:
    """The maximal runs that some pairs of start and end cover."""
    if not raw:
        return []
    p = np.frombuffer(raw, np.int32).reshape(-1, 2)
    d = np.bincount(p[:, 0], minlength=n_words + 1) - np.bincount(p[:, 1], minlength=n_words + 1)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (np.cumsum(d) > 0)[:n_words].astype(np.int8), [0]])))
    return [{"start": int(x), "end": int(y)} for x, y in edge.reshape(-1, 2)]


def index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The index, written as a table in the shared folder: a row for each shard, with its number, its doc_ids, the first word of each
    document, the distinct terms (64-bit hashes of lower-cased words), the size of each one's list and all positions, list after list."""

    def run(batches):
        shard = TaskContext.get().partitionId() << 32
        for batch in batches:
            for lo, hi, b, offs in tv.blocks(batch["text"]):
                w, first = tokens(b, offs)
                one = Postings.of(w, first)
                yield pa.RecordBatch.from_pydict(
                    {
                        "shard": pa.array([shard], pa.int64()),
                        "ids": pa.array([batch["doc_id"][lo:hi].to_pylist()], pa.list_(pa.int64())),
                        "first": pa.array([first.astype(np.int32).tobytes()], pa.binary()),
                        "terms": pa.array([one.terms.tobytes()], pa.binary()),
                        "sizes": pa.array([np.diff(one.edges).astype(np.int32).tobytes()], pa.binary()),
                        "positions": pa.array([one.positions.astype(np.int32).tobytes()], pa.binary()),
                    }
                )
                shard += 1
        sh.give_back()

    return sh.stored(sh.id_text(docs, doc_id, text).mapInArrow(run, INDEX))


def _shards(table: DataFrame, work, schema: str) -> DataFrame:
    """One pass over the index: work gives the columns of a table from a shard's number, doc_ids and postings."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                shard = {name: batch[name][i].as_py() for name in batch.schema.names}
                out = work(shard["shard"], shard["ids"], Postings.stored(shard))
                if out.num_rows:
                    yield from out.to_batches()
        sh.give_back()

    return table.mapInArrow(run, schema)


def _found(asked: Queries, postings: Postings, n: int, span: int | None) -> tuple[list[bytes], list[set]]:
    """The hits and items of each of a shard's n documents."""
    hits, items = [b""] * n, [set() for _ in range(n)]
    if len(postings.positions):
        for row, pairs, who in asked.asked(postings, span):
            hits[row] += pairs.tobytes()
            items[row] |= who
    return hits, items


def matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 10, span: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, spans (runs of hit words, end exclusive) and items (ids as strings, sorted) for each row of docs.

    A window is `size` consecutive words of an item; a shorter item that has words is one window. A
    word inside any occurrence of a window is hit. With span, a window also matches in proximity:
    where all its terms, in any order, stand within span words of a text; then the words from the
    first of them to the last are hit. Words: lower-cased (A-Z), [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+. Null texts, of
    either table, have no words; a null item_id matches but is not listed; equal items count each;
    rows of docs with equal or null doc_id stay rows of their own. A very long text is a shard of its
    own. Other columns are ignored. The index is written when this is called, see index(); with test
    items beyond block_bytes, so are the hits of each pass, joined by shard and row in the end.
    """
    table = index(docs, doc_id, text)
    context = docs.sparkSession.sparkContext
    passes = []
    for last, ids, texts in item_blocks(benchmark, item_id, item_text, block_bytes):
        shared = context.broadcast(Queries(ids, texts, size))
        if last and not passes:

            def whole(_shard, ids, postings, shared=shared) -> pa.Table:
                return _rows(ids, postings, *_found(shared.value, postings, len(ids), span))

            return _shards(table, whole, OUT)

        def some(shard, ids, postings, shared=shared) -> pa.Table:
            hits, items = _found(shared.value, postings, len(ids), span)
            at = [i for i, x in enumerate(hits) if x]
            return pa.table({"shard": pa.array([shard] * len(at), pa.int64()), "row": pa.array(at, pa.int32()), "hits": pa.array([hits[i] for i in at], pa.binary()), "items": pa.array([sorted(items[i]) for i in at], pa.list_(pa.string()))})

        passes.append(sh.stored(_shards(table, some, HITS)))
        shared.destroy()
    found = reduce(DataFrame.unionByName, passes).groupBy("shard").agg(F.collect_list(F.struct("row", "hits", "items")).alias("found"))

    def together(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                shard = {name: batch[name][i].as_py() for name in batch.schema.names}
                hits, items = [b""] * len(shard["ids"]), [set() for _ in shard["ids"]]
                for x in shard["found"] or ():
                    hits[x["row"]] += x["hits"]
                    items[x["row"]].update(x["items"])
                yield from _rows(shard["ids"], np.frombuffer(shard["first"], np.int32), hits, items).to_batches()

    return table.select("shard", "ids", "first").join(found, "shard", "left").mapInArrow(together, OUT)


def _rows(ids: list, index: Postings | np.ndarray, hits: list[bytes], items: list[set]) -> pa.Table:
    n = np.diff(index if isinstance(index, np.ndarray) else index.first)
    spans = pa.array([_spans(int(k), raw) for k, raw in zip(n, hits)], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(n, pa.int64()), "spans": spans, "items": pa.array([sorted(x) for x in items], pa.list_(pa.string()))})


def without_matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, with all their columns, in which no window of an item occurs; see matches().

    A filter of each row alone: nothing is joined by id or shuffled. So the postings of a shard are
    built, intersected and dropped where its rows are, and no index is written.
    """
    schema = docs.schema
    place = [f.name for f in schema.fields].index(text)
    context = docs.sparkSession.sparkContext
    for _last, ids, texts in item_blocks(benchmark, item_id, item_text, block_bytes):
        shared = context.broadcast(Queries(ids, texts, size))

        def work(batch: pa.RecordBatch, shared=shared) -> pa.Table:
            hit = np.zeros(batch.num_rows, bool)
            for lo, _hi, b, offs in tv.blocks(batch.column(place)):
                w, first = tokens(b, offs)
                if len(w):
                    one = Postings.of(w, first)
                    for _k, terms, cells, _who, _edges in shared.value.sets:
                        hit[lo + one.row[one.phrase(terms, cells)[0]]] = True
            return pa.Table.from_batches([batch]).filter(pa.array(~hit))

        docs = sh.map_batches(docs, work, schema)
    return docs


def postings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The lists of index() one by one: shard, term, doc_id and the positions of the term in that document, sorted."""

    def run(shard, ids, one) -> pa.Table:
        term, row = np.repeat(np.arange(len(one.terms)), np.diff(one.edges)), one.row[one.positions]
        at = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (row[1:] != row[:-1])])[: len(term)])
        lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(term)).astype(np.int32)), pa.array((one.positions - one.first[row]).astype(np.int32)))
        return pa.table({"shard": pa.array([shard] * len(at), pa.int64()), "term": pa.array(one.terms[term[at]].view(np.int64)), "doc_id": pa.array(ids, pa.int64()).take(pa.array(row[at])), "positions": lists})

    return _shards(index(docs, doc_id, text), run, POSTINGS)
