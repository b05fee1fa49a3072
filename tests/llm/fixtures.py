"""Small corpora with every awkward case, and plain brute-force forms of the operators' results."""

import random
import re
from collections import Counter

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}
#: Columns beside doc_id and text, with names that operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part int, bucket int, row long, n long, rep long, kept boolean, mark int, stage int"


def corpus(seed=0, n=40, words=120, vocabulary=400):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeéßñ") for _ in range(rng.randint(1, 6))) for _ in range(vocabulary)]
    make = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    passage = make(70)
    texts = [make(rng.randint(1, words)) for _ in range(n)]
    texts += [texts[0]] * 3  # copies
    long = make(200)
    for k in range(6):  # near copies
        w = long.split()
        for _ in range(k):
            w[rng.randrange(len(w))] = "changed" + str(k)
        texts.append(" ".join(w))
    texts += [make(30) + " " + passage + " " + make(20), passage + "\n" + make(5), make(9) + "\t" + passage]
    texts += ["", " \n ", None, "one", "a b c d", "A B C D", "same " * 90, "x" * 1000, "é" * 450, make(3000), "    wide space", "tab\x0bsep\x0cform\r\nline"]
    rows = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "xx", "s", None, 1, 2, 3, 4, 5, True, 6, 7) for i, t in rows], SCHEMA)


def word_repeats(rows, window=50):
    seen, out = {}, {}
    for i, t in sorted(rows):
        w = SPACE_WORD.findall(t or "")
        gone = [False] * len(w)
        keys = [tuple(w[p : p + window]) for p in range(len(w) - window + 1)]
        for p, k in enumerate(keys):
            if seen.get(k, i) < i:
                gone[p : p + window] = [True] * window
        for k in keys:
            seen.setdefault(k, i)
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


def byte_repeats(rows, length=400):
    raw = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(x[p : p + length] for _, x in raw for p in range(len(x) - length + 1))
    out = {}
    for i, x in raw:
        gone = bytearray(len(x))
        for p in range(len(x) - length + 1):
            if count[x[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        out[i] = (len(x), sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(a for a, g in zip(x, gone) if not g))
    return out


def shingles(text, k=5):
    w = SPACE_WORD.findall((text or "").translate(LOWER))
    return {tuple(w[p : p + k]) for p in range(max(1, len(w) - k + 1))} if w else set()


def components(rows, percent=85):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}
    find = lambda a: a if root[a] == a else find(root[a])
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def phrase_hits(rows, items, size=10):
    windows = {}
    for item, t in items:
        w = TERM.findall((t or "").translate(LOWER))
        k = min(size, len(w))
        for p in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[p : p + k]), set()).add(item)
    sizes = {len(k) for k in windows}
    out = {}
    for i, t in rows:
        w = TERM.findall((t or "").translate(LOWER))
        hit, found = [0] * len(w), set()
        for k in sizes:
            for p in range(len(w) - k + 1):
                if tuple(w[p : p + k]) in windows:
                    found |= windows[tuple(w[p : p + k])]
                    hit[p : p + k] = [1] * k
        out[i] = (len(w), sum(hit), sorted(str(x) for x in found if x is not None))
    return out
