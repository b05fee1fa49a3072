"""Dedup, decontamination, near-dedup, packing and scoring against brute force on small corpora."""

import json
import base64
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import fixtures as X
from tidegrid.llm import best_fit, block_anchors, class_ngrams, fss_minhash, positional_index, secret_scan, suffix_levels

ROWS = X.corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return X.frame(spark, ROWS).cache()


@pytest.mark.parametrize("window,part_bytes", [(50, 1 << 22), (20, 2000)])
def test_block_anchors(docs, window, part_bytes):
    want = X.word_repeats(ROWS, window)
    got = block_anchors.repeats(docs, window=window, part_bytes=part_bytes).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in got} == want
    assert all(r["n_removed"] == sum(s["end"] - s["start"] for s in r["spans"]) for r in got)
    assert sum(v[1] for v in want.values()) > 0


def test_block_anchors_repeated_rows_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    got = block_anchors.repeats(X.frame(spark, [(1, text), (1, text), (None, text), (5, text)])).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_removed"]) for r in got) == [(False, 1, 0), (False, 1, 0), (False, 5, 60), (True, 0, 60)]
    with pytest.raises(ValueError):
        block_anchors.repeats(X.frame(spark, [(1, text)]), window=50, block=26)


@pytest.mark.parametrize("length,reach,part_bytes", [(400, 128, 1 << 22), (60, 16, 2000)])
def test_suffix_levels(docs, length, reach, part_bytes):
    want = X.byte_repeats(ROWS, length)
    got = suffix_levels.repeats(docs, length=length, reach=reach, part_bytes=part_bytes).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) for r in got} == want
    assert sum(v[1] for v in want.values()) > 0


def test_suffix_family_matches_pairs():
    rng = np.random.default_rng(0)
    batches = [rng.integers(0, 4000, n).astype(np.uint64) for n in (5, 300, 300, 1, 64, 900)]
    family = suffix_levels.SuffixLevels()
    for b in batches:
        family.add(b)
    flat = np.concatenate(batches)
    count = Counter(flat.tolist())
    assert family.matched.tolist() == [count[x] > 1 for x in flat.tolist()]
    sizes = [len(k) for k, _ in family.levels]
    assert all(a > b for a, b in zip(sizes, sizes[1:]))


@pytest.mark.parametrize("members", [2048, 3])
def test_near_duplicates(docs, members):
    want = X.components(ROWS)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in fss_minhash.near_duplicates(docs, members=members).collect()}
    assert got == want
    assert len({v[1] for v in want.values()}) < len(want) - 5


def test_near_duplicates_of_nothing(spark):
    got = fss_minhash.near_duplicates(X.frame(spark, [(1, None), (2, ""), (None, "a b"), (3, "a b"), (4, "A  b")])).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in got) == [("1", "1", True), ("2", "2", True), ("3", "3", True), ("4", "3", False), ("None", "None", True)]
    assert fss_minhash.near_duplicates(X.frame(spark, [])).count() == 0


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 62, 3000).astype(np.uint64)
    sets = [base[:1000], base[100:1100], base[:1], base[:0]]
    s = fss_minhash.sketches(np.concatenate([np.sort(x) for x in sets]), np.cumsum([0, *map(len, sets)]), 160)
    assert (s[:3] != np.iinfo(np.uint64).max).all()
    assert abs((s[0] == s[1]).mean() - 900 / 1100) < 0.15


def test_chain_of_links(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in fss_minhash.components(edges).collect()}
    assert got == {i: 0 for i in (*range(1, 41), 100, 101)}


ITEMS = [(1, None), (2, ""), (3, ROWS[0][1]), (4, "one"), (5, "a b c"), (None, "changed1"), (6, "changed1")]


def test_positional_index(spark, docs):
    text = next(t for i, t in ROWS if i == 49)  # holds the passage
    items = [*ITEMS, (7, text), (8, " ".join(text.split()[35:60]))]
    bench = spark.createDataFrame([(i, t, 0, "x") for i, t in items], "item_id long, text string, n_words int, hits string")
    want = X.phrase_hits(ROWS, items)
    for block_bytes in (8 << 20, 300):
        got = positional_index.matches(docs, bench, block_bytes=block_bytes).collect()
        assert {r["doc_id"]: (r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), r["items"]) for r in got} == want
        left = positional_index.without_matches(docs, bench, block_bytes=block_bytes)
        assert left.columns == docs.columns
        assert {r["doc_id"] for r in left.collect()} == {i for i, v in want.items() if not v[1]}
    assert positional_index.matches(docs, bench.limit(0)).where(F.size("spans") > 0).count() == 0
    assert positional_index.matches(docs.limit(0), bench).count() == 0


def test_proximity(spark):
    docs = X.frame(spark, [(1, "p q alpha x x beta y gamma z"), (2, "alpha " + "x " * 30 + "beta gamma"), (3, "gamma beta alpha")])
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    got = {r["doc_id"]: r["items"] for r in positional_index.matches(docs, bench, size=3, span=6).collect()}
    assert got == {1: ["1"], 2: [], 3: ["1"]}
    rows = positional_index.postings(docs).collect()
    assert sum(len(r["positions"]) for r in rows) == 9 + 33 + 3 and all(r["positions"] == sorted(r["positions"]) for r in rows)


@pytest.mark.parametrize("span", [4, 12, 40])
def test_proximity_against_brute_force(spark, span):
    import random

    rng = random.Random(span)
    rows = [(i, " ".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(0, 80)))) for i in range(60)] + [(60, None), (None, "a b c"), (7, "c b a")]
    items = [(1, "a b c"), (2, "t a t s"), (3, "q r s t a"), (4, "zz a"), (5, "k")]
    want = []
    for i, t in rows:
        w, hit, found = (t or "").split(), set(), set()
        for item, x in items:
            terms = set(x.split())
            ends = [e for e in range(len(w)) if w[e] in terms]
            for e in ends:
                starts = [s for s in range(max(0, e - span + 1), e + 1) if terms <= set(w[s : e + 1])]
                if starts:
                    hit |= set(range(max(starts), e + 1))
                    found.add(str(item))
        want.append((str(i), len(w), len(hit), sorted(found)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block_bytes in (8 << 20, 4):
        got = positional_index.matches(X.frame(spark, rows), bench, size=5, span=span, block_bytes=block_bytes).collect()
        assert sorted((str(r["doc_id"]), r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), r["items"]) for r in got) == sorted(want)


def test_stored_index(spark, docs):
    rows = positional_index.index(docs).collect()
    text = dict(ROWS)
    for r in rows:
        one = positional_index.Postings.stored(r.asDict())
        assert [len(X.TERM.findall((text[i] or "").translate(X.LOWER))) for i in r["ids"]] == np.diff(one.first).tolist()
        assert sorted(one.positions.tolist()) == list(range(int(one.first[-1])))
        assert all((np.diff(one.positions[a:b]) > 0).all() for a, b in zip(one.edges, one.edges[1:])) and (np.diff(one.terms.astype(object)) > 0).all()
    assert sorted(i for r in rows for i in r["ids"]) == sorted(text)


def plain_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(best_fit.vocabulary_path())
    return [e.ids + [0] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_packing_round_trip(docs):
    ids = dict(zip([i for i, _ in ROWS], plain_ids([t for _, t in ROWS])))
    for size, part_items in ((2048, 20_000), (128, 20)):
        got = best_fit.pack(docs, size=size, part_items=part_items).collect()
        for doc, own in ids.items():
            pieces = sorted((r for r in got if r["doc_id"] == doc), key=lambda r: r["piece"])
            assert [r["piece"] for r in pieces] == list(range(-(-len(own) // size)))
            for r in pieces:
                cut = own[r["start"] : r["start"] + r["length"]]
                assert len(cut) == r["length"] and zlib.crc32(np.array(cut, "<u4").tobytes()) == r["ids_crc32"]
                assert r["length"] == size or r is pieces[-1]
        sequences = {}
        for r in got:
            sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for rows in sequences.values():
            at = 0
            for offset, length in sorted(rows):
                assert offset == at
                at += length
            assert at <= size
        bound = best_fit.lower_bound(np.array([r["length"] for r in got]), size)
        assert bound <= len(sequences) <= bound * 1.1 + 1


def test_words_that_come_again_outlast_a_full_cache(monkeypatch):
    coder = best_fit.WordTokenizer(best_fit.vocabulary_path())
    learn, learned = coder.learn, []
    monkeypatch.setattr(coder, "learn", lambda new: (learned.extend(new), learn(new))[1])
    monkeypatch.setattr(best_fit, "CACHE_WORDS", 40)
    name = lambda k: "".join(chr(97 + int(d)) for d in str(k))
    for k in range(30):
        texts = ["Common words, they're often: " + " ".join(name(1000 + 20 * k + i) for i in range(15)), "", "a <|endoftext|> common", f"{k}", "çà « Été »"]
        raw = [t.encode() for t in texts]
        ids, at = coder.encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))
        assert [ids[x:y].tolist() for x, y in zip(at, at[1:])] == [[*coder.tokenizer.encode(t, add_special_tokens=False).ids, 0] for t in texts]
    assert learned.count(b"common") == learned.count(b"words") == 1
    assert len(coder.number) < 80


def test_pieces_can_carry_ids(spark):
    rows = best_fit.pieces(X.frame(spark, [(1, "Hello  World <|endoftext|> it's"), (2, None)]), ids=True).collect()
    assert {r["doc_id"]: r["ids"] for r in rows} == dict(zip((1, 2), plain_ids(["Hello  World <|endoftext|> it's", ""])))


def test_best_fit_and_bounds():
    rng = np.random.default_rng(2)
    for _ in range(40):
        lengths = rng.integers(1, 101, rng.integers(1, 60))
        bins, offsets, fill = best_fit.best_fit_decreasing(lengths, 100)
        assert fill.max() <= 100 and fill.sum() == lengths.sum()
        assert best_fit.lower_bound(lengths, 100) <= len(fill)
    assert best_fit.lower_bound(np.array([51] * 7), 100) == 7
    assert best_fit.lower_bound(np.array([34] * 6), 100) == 3


def der(tag, *parts):
    body = b"".join(parts)
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x81, n]) if n < 256 else bytes([0x82, n >> 8, n & 255])
    return bytes([tag]) + size + body


def test_secrets():
    key = der(0x30, der(0x02, b"\0"), der(0x02, bytes(range(1, 65))), der(0x02, b"\1\0\1"))
    ssh = b"".join(len(x).to_bytes(4, "big") + x for x in (b"ssh-ed25519", bytes(range(32))))
    url = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    jwt = f"{url({'alg': 'HS256', 'typ': 'JWT'})}.{url({'sub': 'somebody'})}.c2lnbmF0dXJl"
    pem = "-----BEGIN PRIVATE KEY-----\n" + base64.encodebytes(key).decode() + "-----END PRIVATE KEY-----"
    kinds = lambda t: [s["kind"] for s in secret_scan.scan_text(t)]
    assert kinds(f"see {jwt} here") == ["jwt"]
    assert kinds(f"see {jwt.replace('eyJhbGciOi', 'eyJhbGciOz')} here") == []
    assert kinds(pem) == ["der"]
    assert kinds("k " + base64.b64encode(key).decode() + " k") == ["der"]
    assert kinds("k " + base64.b64encode(key[:-1]).decode() + " k") == []
    assert kinds("k " + key.hex() + " k") == ["hex", "der"]
    assert kinds("k " + base64.b64encode(ssh).decode() + " k") == ["sshkey"]
    assert kinds("Token: secret=abcdef AKIA" + "A" * 16 + " " + "0a" * 12) == ["assign", "access", "hex"]
    assert kinds("secret:token:'abcdefgh'") == []  # the first match is too short and takes the second's beginning
    assert kinds("paſſword=abcdefgh AKIAshort " + "ab" * 11) == []
    assert secret_scan.scan_text(None) == [] == secret_scan.scan_text("")
    s = secret_scan.scan_text("éé api_key = \"abcdef\"")[0]
    assert (s["start"], s["end"]) == (3, 20)


def test_secret_structures():
    blob = lambda n, k=0: bytes((i * 37 + k) % 251 + 1 for i in range(n))
    number = lambda n, k=0: der(0x02, blob(n, k))
    algorithm = der(0x30, der(0x06, b"\x2a\x86\x48\x86\xf7\x0d\x01\x01\x01"), der(0x05, b""))
    rsa = der(0x30, der(0x02, b"\0"), number(128), der(0x02, b"\1\0\1"), number(128, 3), number(64, 5), number(64, 7), number(64, 9), number(64, 11), number(64, 13))
    pkcs8 = der(0x30, der(0x02, b"\0"), algorithm, der(0x04, rsa))
    curve = der(0x30, der(0x02, b"\1"), der(0x04, blob(32)))
    sealed = der(0x30, algorithm, der(0x04, blob(64)))
    public = der(0x30, algorithm, der(0x03, b"\0" + der(0x30, number(128), der(0x02, b"\1\0\1"))))
    two = der(0x30, number(128), der(0x02, b"\1\0\1"))
    certificate = der(0x30, der(0x30, der(0x02, b"\5"), algorithm, public), algorithm, der(0x03, b"\0" + blob(64)))
    for raw in (rsa, pkcs8, curve, sealed):
        assert secret_scan.is_der_key(raw)
        assert not secret_scan.is_der_key(raw + b"\0") and not secret_scan.is_der_key(raw[:-1])
    for raw in (public, two, certificate, der(0x30, der(0x30))):
        assert not secret_scan.is_der_key(raw)
    spans = lambda t: [(s["kind"], t[s["start"] : s["end"]]) for s in secret_scan.scan_text(t)]
    code = base64.b64encode(pkcs8).decode()
    for width in (64, 76):
        for br in ("\n", "\r\n", "\\n", "\n  "):
            lines = br.join(code[i : i + width] for i in range(0, len(code), width))
            assert spans(f"key: {lines}\nand so on") == [("der", lines)]
            assert spans(f"-----BEGIN X-----{br}Comment: a-b{br}{br}{lines}{br}-----END X-----")[0][0] == "der"
    full = next(x for x in (der(0x30, number(n), number(64), number(64)) for n in range(40, 200)) if len(x) % 48 == 0)
    code = base64.b64encode(full).decode()  # full lines only, then a word that is no part of it
    lines = "\n".join(code[i : i + 64] for i in range(0, len(code), 64))
    assert spans(lines + "\nword") == [("der", lines)]
    locked = "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00\n\n{}\n-----END RSA PRIVATE KEY-----"
    assert [k for k, _ in spans(locked.format(base64.b64encode(blob(64)).decode()))] == ["der"]
    assert spans(locked.format(base64.b64encode(blob(61)).decode())) == []
    assert spans("-----BEGIN CERTIFICATE-----\n" + base64.encodebytes(certificate).decode() + "-----END CERTIFICATE-----") == []
    raw64 = lambda x: base64.urlsafe_b64encode(x).decode().rstrip("=")
    for head in (b'{ "alg": "HS256" }', b'{\n"alg": "HS256"}', b'{\t"alg": "HS256"}', b'{\r\n"alg":"HS256"}'):
        token = f"{raw64(head)}.{raw64(b'{}')}.c2ln"
        assert spans(f"see {token} here") == [("jwt", token)]
    # very long texts: runs, lines and openings without an end take time in proportion
    for t in ("A" * 2_000_000, ("A" * 64 + "\n") * 30_000, "-----BEGIN A-----\n" * 60_000, "eyA" * 500_000, "0a" * 1_000_000):
        assert len(secret_scan.scan_text(t)) <= 1


def test_scan_edges(spark):
    rows = [(1, "secret=abcdefg", 5), (1, "secret=abcdefg", 5), (None, "secret=abcdefg", 6), (2, None, None), (3, "", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    got = secret_scan.scan(docs)
    assert got.columns == ["doc_id", "spans"]
    assert sorted((str(r["doc_id"]), len(r["spans"])) for r in got.collect()) == [("1", 1), ("1", 1), ("2", 0), ("3", 0), ("None", 1)]
    assert secret_scan.scan(docs.limit(0)).count() == 0
    assert secret_scan.redact(docs.limit(0)).count() == 0


def test_redaction(spark):
    docs = X.frame(spark, [(1, "my token = abcdefgh ok"), (2, None), (None, "")])
    got = secret_scan.redact(docs)
    assert got.columns == docs.columns
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in got.collect()) == [("1", "my [SECRET] ok"), ("2", "None"), ("None", "")]
    assert secret_scan.scan(docs).count() == 3


def test_class_scores(spark):
    rows = X.corpus(4, 150, 60, 60)
    got = {r["doc_id"]: r for r in class_ngrams.scores(X.frame(spark, rows)).collect()}
    tokens = {i: X.SPACE_WORD.findall((t or "").translate(X.LOWER)) + [None] for i, t in rows}
    train = {i for i in tokens if zlib.crc32(str(i).encode()) % 5 != 1}
    count = Counter(w for i in train for w in tokens[i])
    n, v = sum(count.values()), len(count)
    for i, w in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i not in train, len(w), sum(x in count for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
        assert math.isfinite(r["score"]) and r["score"] < 0
    assert class_ngrams.scores(X.frame(spark, [])).count() == 0
    assert class_ngrams.scores(X.frame(spark, [(1, None), (None, "a b"), (1, None)])).count() == 3


def test_class_model_beats_single_words(spark):
    import random

    rng = random.Random(1)
    kinds = [[f"{k}{i}" for i in range(30)] for k in "abc"]
    rows = [(i, " ".join(rng.choice(kinds[(i + j) % 3]) for j in range(60))) for i in range(200)]
    got = class_ngrams.scores(X.frame(spark, rows), classes=6).where("held_out").agg(F.sum("base_score").alias("b"), F.sum("score").alias("s")).first()
    assert got["s"] > got["b"] * 0.85  # the order of the kinds is learnt


def test_exchange_ends_where_no_move_raises_the_likelihood():
    xlogx = lambda x: float((x[x > 0] * np.log(x[x > 0])).sum())

    def likelihood(n, own):
        hot = np.eye(own.max() + 1)[own]
        c = hot.T @ n @ hot
        return xlogx(c) - xlogx(c.sum(axis=0)) - xlogx(c.sum(axis=1))

    for seed in range(20):
        rng = np.random.default_rng(seed)
        n = rng.poisson(rng.gamma(0.3, 20, (17, 17)))
        own = np.concatenate([class_ngrams.exchange(n, 4, 2), [4, 5]])
        most = likelihood(n, own)
        for w in range(15):
            for k in range(4):
                other = own.copy()
                other[w] = k
                assert likelihood(n, other) <= most + 1e-4 * (1 + n[w].sum() + n[:, w].sum()), (seed, w, k)


def test_rare_words_get_classes_from_rare_neighbours(spark):
    # a pair of words seen nowhere else follows two frequent words: the second of them has rare neighbours alone
    rows = [(i, f"aa bb r{i} s{i} t{i}") for i in range(400)]
    docs = X.frame(spark, rows)
    parts, n = class_ngrams.sh.parted(docs)
    model = class_ngrams.ClassModel(class_ngrams.sh.id_text(docs), n, 1, 4, 0.2)
    coded = [r["classes"] for r in class_ngrams.coded(parts, model).collect() if not r["held_out"]]
    assert len(model.words) < 10 and len(model.moved) > 1
    assert all(x & 127 != 4 for c in coded for x in c)


def test_neighbour_counts_of_a_long_text_are_exact(spark):
    docs = X.frame(spark, [(0, "aa bb " * 70_000), (2, "aa bb")])
    parts, n = class_ngrams.sh.parted(docs)
    model = class_ngrams.ClassModel(class_ngrams.sh.id_text(docs), n, 9, 4, 12)
    class_ngrams.coded(parts, model)
    assert model.steps.sum() == model.total == 140_004


def test_transitions_are_probabilities(spark):
    rows = [(False, bytes([0, 1, 0 | class_ngrams.ONCE, 3])), (False, bytes([1, 0, 3])), (True, bytes([4, 3]))]
    texts = spark.createDataFrame(rows, "held_out boolean, classes binary")
    log_p, of_class = class_ngrams.transitions(texts, 2)
    assert (10**log_p).sum(axis=1) == pytest.approx(np.ones(6))
    assert of_class[:2].tolist() == [3, 2]
