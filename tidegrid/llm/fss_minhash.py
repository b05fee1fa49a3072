"""MinHash near-dedup with fast similarity sketching.

A sketch of t coordinates is filled in rounds. In round i < t every element is thrown into a random
bin; in round t + j every element goes into bin j, so that no coordinate stays empty. A bin keeps the
least value of the first round that reached it, which costs O(n + t log t) a set and keeps the
concentration bounds of independent MinHashes. Rounds stop as soon as all bins of a set are full.

Texts with equal shingle sets become one representative first, so groups of copies weigh as one row.
Bands of sketches give buckets; each bucket's smallest representative is its centre, and all that
share a bucket meet under their centre, once. There the links are confirmed on whole shingle sets.
Only a spanning forest of the links leaves the task. A centre with many members is split into
blocks, and every pair of blocks is a task of bounded size. Components come from alternating
large-star and small-star steps over the links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm import shared as sh
from tidegrid.llm import textvec as tv

U64 = np.uint64
BANDS, ROWS = 32, 5
MEMBERS = 2048
COLUMNS = 8192
SKETCHED = "doc_id long, n_shingles long, key1 long, key2 long, bands array<long>"


def shingle_sets(b: np.ndarray, offs: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each row, sorted, and where each row's begin (and the last end). Fewer than k words are one shingle."""
    b = tv.LOWER[b]
    starts, ends, first = tv.words(b, offs)
    w = tv.word_hashes(b, starts, ends)
    n = np.diff(first)
    ok = np.flatnonzero(tv.inside(first, k, len(w))) if len(w) >= k else np.zeros(0, np.int64)
    h, row = [tv.window_hashes(w, k)[ok]], [tv.row_of(first, len(w))[ok]]
    for short in range(1, k):
        rows = np.flatnonzero(n == short)
        if len(rows):
            h.append(tv.mix(tv.window_hashes(w, short)[first[rows]] + U64(short)))
            row.append(rows)
    h, row = np.concatenate(h), np.concatenate(row)
    order = np.argsort(h, kind="stable")
    order = order[np.argsort(row[order], kind="stable")]
    h, row = h[order], row[order]
    if len(h):
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])
        h, row = h[new], row[new]
    return h, np.searchsorted(row, np.arange(len(offs)), "left")


def sketches(h: np.ndarray, at: np.ndarray, t: int) -> np.ndarray:
    """The fast similarity sketch of each set, a line of t coordinates; `at` as from shingle_sets(). Empty sets have none: zeros."""
    n = len(at) - 1
    out = np.full(n * t, np.iinfo(np.uint64).max, U64)
    row = np.repeat(np.arange(n), np.diff(at))
    for i in range(2 * t):
        if not len(h):
            break
        v = tv.mix(h + U64((i + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        place = (v % U64(t)).astype(np.int64) if i < t else np.full(len(v), i - t)
        np.minimum.at(out, row * t + place, (v >> U64(9)) | (U64(i) << U64(55)))
        if i % 2 or i < 4:
            open_ = (out.reshape(n, t) == np.iinfo(np.uint64).max).any(axis=1)
            go = open_[row]
            h, row = h[go], row[go]
    out = out.reshape(n, t)
    out[at[1:] == at[:-1]] = 0
    return out


def band_hashes(s: np.ndarray, bands: int, rows: int) -> np.ndarray:
    odd = tv.mix(np.arange(1, rows + 1, dtype=U64)) | U64(1)
    return tv.mix((tv.mix(s).reshape(len(s), bands, rows) * odd).sum(axis=2, dtype=U64) + np.arange(bands, dtype=U64) * U64(0xD1342543DE82EF95))


def sketch(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, two hashes that stand for the whole set, and its band hashes."""

    def work(batch: pa.RecordBatch) -> pa.Table:
        n, one, two, bh = [], [], [], []
        for lo, hi, b, offs in tv.blocks(batch["text"]):
            h, at = shingle_sets(b, offs, shingle)
            size = np.diff(at)
            total = [np.zeros(hi - lo, U64), np.zeros(hi - lo, U64)]
            full = np.flatnonzero(size)
            if len(full):
                for k, x in enumerate((tv.mix(h), tv.mix(h ^ U64(0xA5A5A5A5A5A5A5A5)))):
                    total[k][full] = np.add.reduceat(x, at[full])
            n.append(size)
            one.append(total[0].view(np.int64))
            two.append(total[1].view(np.int64))
            bh.append(band_hashes(sketches(h, at, bands * rows), bands, rows).view(np.int64))
        if not n:
            return None
        flat = np.concatenate(bh).reshape(-1)
        return pa.table(
            {
                "doc_id": batch["doc_id"],
                "n_shingles": pa.array(np.concatenate(n).astype(np.int64)),
                "key1": pa.array(np.concatenate(one)),
                "key2": pa.array(np.concatenate(two)),
                "bands": pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, bands, dtype=np.int32)), pa.array(flat)),
            }
        )

    return sh.map_batches(sh.id_text(docs, doc_id, text), work, SKETCHED)


def _linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs (a line of left, a column of right; numbers of sets) reach the similarity, on whole sets."""
    size = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    own = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(flat, kind="stable")
    at, n = sh.groups_of(flat[order])
    column = np.empty(len(flat), np.int64)
    shared = n > 1
    column[order] = np.repeat(np.where(shared, np.cumsum(shared) - 1, -1), n)
    own, column = own[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    own, column = own[order], column[order]
    both = np.zeros((len(left), len(right)), np.float32)
    total = int(shared.sum())
    for a in range(0, total, COLUMNS):
        lo, hi = np.searchsorted(column, [a, a + COLUMNS])
        m = np.zeros((len(sets), min(COLUMNS, total - a)), np.float32)
        m[own[lo:hi], column[lo:hi] - a] = 1
        both += m[left] @ m[right].T
    both = both.astype(np.int64)
    return 100 * both >= percent * (size[left][:, None] + size[right][None, :] - both)


def _forest(link: np.ndarray) -> np.ndarray:
    """The smallest member of the component of each member; link: a symmetric matrix."""
    label = np.arange(len(link))
    while True:
        new = np.minimum(label, np.where(link, label[None, :], len(link)).min(axis=1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def links(docs: DataFrame, representatives: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 85, members: int = MEMBERS) -> DataFrame:
    """a, b: a spanning forest of the confirmed links between the representatives (rep, bands) under each centre."""
    probes = representatives.select("rep", F.explode("bands").alias("bucket"))
    centres = probes.groupBy("bucket").agg(F.min("rep").alias("centre"), F.count("*").alias("n")).where("n > 1").select("bucket", "centre")
    pairs = sh.stored(probes.join(centres, "bucket").where("rep <> centre").select("centre", F.col("rep").alias("member")).distinct())
    wanted = pairs.select("member").unionByName(pairs.select(F.col("centre").alias("member"))).distinct()

    def set_of(batch: pa.RecordBatch) -> pa.Table:
        sets = []
        for lo, hi, b, offs in tv.blocks(batch["text"]):
            h, at = shingle_sets(b, offs, shingle)
            sets += [h[x:y].tobytes() for x, y in zip(at, at[1:])]
        return pa.table({"member": batch["doc_id"], "shingles": pa.array(sets, pa.binary())})

    texts = sh.id_text(docs, doc_id, text)
    # the ids wanted grow with the corpus, so they are hashed where their texts are shuffled to, at every size alike
    found = texts.join(wanted.hint("shuffle_hash"), texts["doc_id"] == wanted["member"], "left_semi")
    sets = sh.map_batches(found, set_of, "member long, shingles binary")
    split = pairs.groupBy("centre").agg(F.ceil((F.count("*") + 1) / F.lit(members)).cast("int").alias("blocks"))
    everyone = pairs.unionByName(pairs.select("centre", F.col("centre").alias("member")).distinct()).join(split, "centre")
    own = F.pmod(F.xxhash64("member"), F.col("blocks")).cast("int")
    dealt = everyone.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("centre", "member", "own", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"))

    def confirm(key, table):
        ids = table["member"].to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, block = ids[order], table["own"].to_numpy()[order]
        raw = table["shingles"].to_pylist()
        sets = [np.frombuffer(raw[i], U64) for i in order]
        one, two = key[1].as_py(), key[2].as_py()
        n = len(ids)
        link = np.zeros((n, n), bool)
        left, right = np.flatnonzero(block == one), np.flatnonzero(block == two)
        if len(left) and len(right):
            link[np.ix_(left, right)] = _linked(sets, left, right, percent)
        link |= link.T
        root = _forest(link)
        x = np.flatnonzero(root != np.arange(n))
        return pa.table({"a": pa.array(ids[root[x]]), "b": pa.array(ids[x])})

    return dealt.join(sets, "member").groupBy("centre", "one", "two").applyInArrow(confirm, "a long, b long").where("a <> b")


def components(edges: DataFrame) -> DataFrame:
    """node, root: each node of the edges (a, b) with the smallest node of its component, roots themselves left out. Stars alternate until nothing moves."""
    edges = sh.stored(edges.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).where("u <> v").distinct())
    state = None
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        edges = sh.stored(small)
        new = edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first()
        if new == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = new


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 85, bands: int = BANDS, rows: int = ROWS, members: int = MEMBERS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs.

    A text's set holds the distinct shingles of `shingle` lower-cased (A-Z) words [^\\x20\\x09-\\x0D]+; fewer
    words are one shingle. Texts are linked where 100 * intersection >= percent * union, confirmed on
    whole sets; component_id is the smallest doc_id that links reach, kept says that it is the row's
    own. Texts without words, null texts and rows with a null doc_id are linked with nothing (their
    own doc_id, null included, is their component; they are kept). Rows that share a doc_id are one
    document: the links of any of their texts count for it. Further columns of docs are ignored. An
    empty table gives no rows.
    """
    rows_ = sh.stored(sketch(docs, doc_id, text, shingle, bands, rows))
    full = rows_.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    same = ["key1", "key2", "n_shingles"]
    representatives = sh.stored(full.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")))
    stars = components(links(docs, representatives, doc_id, text, shingle, percent, members))
    roots = representatives.drop("bands").join(stars, F.col("rep") == F.col("node"), "left").select(*same, F.coalesce("root", "rep").alias("component_id"))
    found = full.drop("bands").join(roots, same).select("doc_id", "n_shingles", "component_id")
    alone = rows_.where((F.col("n_shingles") == 0) | F.col("doc_id").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
