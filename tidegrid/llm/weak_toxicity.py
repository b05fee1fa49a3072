"""Toxicity by weak supervision.

Many lexicon and pattern voters look at each text. A generative label model estimates their accuracies
and correlations from counts of vote patterns over all texts; the annotations of all training rows
that have one are one more voter, whose error rates are estimated too. Each voter begins as a kind of
toxic text of its own; texts that annotators call toxic though no voter fires are one more kind.
Posterior labels of a bounded sample of annotated training rows (of all, where none is annotated) train a sparse
linear classifier over hashed words, hashed character n-grams and the voters, so that abuse that no
lexicon names is learnt from its spelling. The score of a text comes from that classifier alone:
annotations, language and source are no inputs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm import shared as sh
from tidegrid.llm import textvec as tv
from tidegrid.llm.label_model import LabelModel, sparse_logistic

U64 = np.uint64
#: The classifier's rows, and how many features are kept of those whose log-likelihood ratio against chance is EVIDENCE or more.
SAMPLE_ROWS = 24_000
FEATURES = 20_000
EVIDENCE = 12.0
#: Bytes of a character n-gram; the first may be the sign before a word.
GRAMS = (5, 6)
FILTER_BITS = 22
#: A block of about 1 MB of texts has fewer rows than 2**ROW_BITS; features keep the other bits of their hash.
ROW_BITS = 20

#: Words that abuse a person, by theme; general vocabulary of four languages.
LEXICONS: dict[str, str] = {
    "mind": "idiot idiots idiotic moron morons moronic stupid stupidity dumb dumbass imbecile imbeciles retard retarded fool fools clown clowns dimwit halfwit brainless",
    "worth": "worthless loser losers scum scumbag trash garbage pathetic useless vermin parasite parasites lowlife failure nobody filth subhuman",
    "disgust": "disgusting repulsive revolting vile filthy gross nasty ugly hideous disgrace despicable sickening creep pervert pig swine",
    "profanity": "fuck fucking fucked fucker motherfucker shit shitty bullshit bitch bitches bastard bastards asshole assholes cunt dick dickhead prick whore slut crap damn",
    "hate": "hate hatred despise loathe detest bigot racist nazi infidel savages degenerate degenerates",
    "german": "idiotin vollidiot dummkopf trottel arschloch scheiße scheiss wichser hurensohn schlampe abschaum versager missgeburt dreckig widerlich erbärmlich nutzlos wertlos",
    "french": "idiote imbécile connard connasse salaud salope putain merde crétin débile minable pathétique dégoûtant ordure raclure abruti",
    "spanish": "imbécil estúpido estúpida gilipollas cabrón puta mierda pendejo basura asqueroso asquerosa inútil patético escoria idiotas maldito",
}
#: Two-word phrases that threaten or dismiss, and second-person openings that make an insult direct.
THREATS = "shut up|kill yourself|kill you|hurt you|hate you|go die|screw you|fuck you|fuck off|get lost|beat you|destroy you|halt maul|verpiss dich|ferme la|ta gueule|te odio|cállate ya"
ADDRESS = "you are|you re|you fucking|you stupid|such a|du bist|ihr seid|tu es|vous êtes|eres un|eres una|tú eres"
VOTERS = [*LEXICONS, "threat", "address"]


def _hashes(texts: list[str]) -> np.ndarray:
    b, offs = tv.buffers(pa.array(texts))
    starts, ends, _ = tv.words(b[: offs[-1]], offs, tv.ALNUM)
    return tv.word_hashes(b[: offs[-1]], starts, ends)


class Voters:
    """The voters as sorted hash tables."""

    def __init__(self) -> None:
        bits: dict[int, int] = {}
        for i, words in enumerate(LEXICONS.values()):
            for h in _hashes(words.split()).tolist():
                bits[h] = bits.get(h, 0) | 1 << i
        self.words = np.array(sorted(bits), U64)
        self.bits = np.array([bits[h] for h in sorted(bits)], np.int64)
        pair = lambda text: np.sort(np.concatenate([tv.window_hashes(_hashes(p.split()), 2) for p in text.split("|")]))
        self.threats, self.address = pair(THREATS), pair(ADDRESS)

    def votes(self, w: np.ndarray, first: np.ndarray) -> np.ndarray:
        """A bit for each voter of VOTERS that fires, for each row."""
        n = len(first) - 1
        out = np.zeros(n, np.int64)
        if not len(w):
            return out
        k = len(LEXICONS)
        row = tv.row_of(first, len(w))
        at = np.minimum(np.searchsorted(self.words, w), len(self.words) - 1)
        hit = np.flatnonzero(self.words[at] == w)
        np.bitwise_or.at(out, row[hit], self.bits[at[hit]])
        two = tv.window_hashes(w, 2)
        inside = tv.inside(first, 2, len(w)) if len(w) > 1 else np.zeros(0, bool)
        found = np.flatnonzero(inside & (self.threats[np.minimum(np.searchsorted(self.threats, two), len(self.threats) - 1)] == two)) if len(two) else np.zeros(0, np.int64)
        out[row[found]] |= 1 << k
        spot = np.flatnonzero(inside & (self.address[np.minimum(np.searchsorted(self.address, two), len(self.address) - 1)] == two)) if len(two) else np.zeros(0, np.int64)
        if len(spot) and len(hit):  # an insult among the next four words of the text
            nxt = np.searchsorted(hit, spot + 1)
            ok = nxt < len(hit)
            near = spot[ok][(hit[nxt[ok]] <= spot[ok] + 5) & (row[hit[nxt[ok]]] == row[spot[ok]])]
            out[row[near]] |= 1 << (k + 1)
        return out


def _tokens(b: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    b = tv.LOWER[b]
    starts, ends, first = tv.words(b, offs, tv.ALNUM)
    return tv.word_hashes(b, starts, ends), first


def _unpacked(bits: np.ndarray) -> np.ndarray:
    return (bits[:, None] >> np.arange(len(VOTERS))) & 1


def features(b: np.ndarray, offs: np.ndarray, w: np.ndarray, first: np.ndarray, live: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows and features of 64 - ROW_BITS bits: each word's hash, and each n-gram of GRAMS bytes that lies in a word or begins just before one.

    With live (a filter on the top FILTER_BITS bits), only features that may be wanted.
    """
    n = len(offs) - 1
    rows, found = [], []
    top = U64(64 - ROW_BITS - FILTER_BITS)

    def add(row, feature):
        if live is not None:
            some = np.flatnonzero(live[feature >> top])
            row, feature = row[some] if isinstance(row, np.ndarray) else row(some), feature[some]
        elif not isinstance(row, np.ndarray):
            row = row(slice(None))
        rows.append(row)
        found.append(feature)

    add(tv.row_of(first, len(w)), w >> U64(ROW_BITS))
    # a sign after every text, and one before the first, so that no n-gram crosses texts; the sign before a text counts as its own
    b = np.concatenate([[0x20], np.insert(tv.LOWER[b], offs[1:], 0x20)]).astype(np.uint8)
    ends = offs[1:] + np.arange(1, n + 1)
    inner = tv.ALNUM[b]
    b = np.where(inner, b, 0).astype(U64)
    run = np.cumsum(~inner)
    packed, k = b.copy(), 1
    for size in sorted(GRAMS):
        if len(b) < size:
            break
        while k < size:
            packed = packed[:-1] | b[k:] << U64(8 * k)
            k += 1
        at = np.flatnonzero(run[size - 1 :] == run[: len(packed)])  # no sign but at the first place
        feature = tv.mix(packed[at] + U64(size << 56))
        add(lambda some, at=at: np.searchsorted(ends, at[some] + 1, side="left"), feature >> U64(ROW_BITS))
    return np.concatenate(rows), np.concatenate(found)


def distinct_pairs(rows: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pair of row and feature once, by feature and row; fewer than 2**ROW_BITS rows."""
    key = np.sort(found << U64(ROW_BITS) | rows.astype(U64))
    key = key[np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]]
    return (key & U64((1 << ROW_BITS) - 1)).astype(np.int64), key >> U64(ROW_BITS)


class Scorer:
    """The classifier: the features with a weight, sorted, their weights, those of the voters, and the intercept."""

    def __init__(self, known: np.ndarray, weights: np.ndarray, voters: np.ndarray, intercept: float):
        order = np.argsort(known)
        self.known, self.weights, self.voters, self.intercept = known[order], weights[order], voters, intercept

    def live(self) -> np.ndarray:
        out = np.zeros(1 << FILTER_BITS, bool)
        out[self.known >> U64(64 - ROW_BITS - FILTER_BITS)] = True
        return out

    def find(self, b: np.ndarray, offs: np.ndarray, w: np.ndarray, first: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and numbers of the known features, each once a row."""
        rows, found = features(b, offs, w, first, live)
        if not len(self.known) or not len(found):
            return rows[:0], np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.known, found), len(self.known) - 1)
        ok = self.known[at] == found
        key = np.unique(rows[ok] * len(self.known) + at[ok])
        return key // len(self.known), key % len(self.known)

    def score(self, b: np.ndarray, offs: np.ndarray, voters: Voters, live: np.ndarray) -> np.ndarray:
        w, first = _tokens(b, offs)
        total = self.intercept + _unpacked(voters.votes(w, first)) @ self.voters
        rows, at = self.find(b, offs, w, first, live)
        total = total + np.bincount(rows, weights=self.weights[at], minlength=len(total))
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def fold(doc_id) -> F.Column:
    """The remainder modulo 5 of the CRC-32 of a doc_id as text; null ids are in fold 1."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)), F.lit(1)).cast("int")


def counted(texts: DataFrame, labels: DataFrame | None, label: str = "toxic", held_out: int = 0) -> DataFrame:
    """doc_id, bits (vote pattern), train and said (annotation: 0 none, 1 not toxic, 2 toxic) of every text; annotations of the held-out fold are not read."""
    voters = Voters()

    def work(batch: pa.RecordBatch) -> pa.Table:
        votes = [voters.votes(*_tokens(b, offs)) for _lo, _hi, b, offs in tv.blocks(batch["text"])]
        return pa.table({"doc_id": batch["doc_id"], "bits": pa.array(np.concatenate(votes or [np.zeros(0, np.int64)]))})

    votes = sh.map_batches(texts, work, "doc_id long, bits long").withColumn("train", fold("doc_id") != held_out)
    if labels is None:
        return votes.withColumn("said", F.lit(0))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("mark")).where("mark in (0, 1)").groupBy("doc_id").agg(F.max("mark").alias("mark"))
    return votes.join(marks, "doc_id", "left").select("doc_id", "bits", "train", F.when(F.col("train"), F.coalesce(F.col("mark") + 1, F.lit(0))).otherwise(0).alias("said"))


def label_model(bits: np.ndarray, said: np.ndarray, counts: np.ndarray) -> LabelModel:
    """The generative model of how often each vote pattern occurs with each annotation."""
    votes = np.concatenate([_unpacked(bits), said[:, None]], 1).astype(np.int64)
    fired = votes[:, : len(VOTERS)].sum(axis=1)
    # how toxic a pattern is at first: what annotators say of it, where nobody does what voters say
    _, pattern = np.unique(bits, return_inverse=True)
    yes, told = np.bincount(pattern, counts * (said == 2)), np.bincount(pattern, counts * (said > 0))
    silent = fired == 0
    rate = ((counts * (said == 2))[silent].sum() + 0.01) / ((counts * (said > 0))[silent].sum() + 1)
    guess = (yes[pattern] + np.where(silent, rate, 0.95)) / (told[pattern] + 1)
    guess = np.choose(said, [guess, 0.01, 0.99])
    # kind 0 is not toxic; each voter is a kind of toxic text, shared by the texts where several fire; the last is that of annotators alone
    alone = np.where(silent, 1.0, 0.02)[:, None]
    share = votes[:, : len(VOTERS)] / np.maximum(fired, 1)[:, None] * (1 - alone)
    start = np.concatenate([1 - guess[:, None], guess[:, None] * share, guess[:, None] * alone], 1)
    return LabelModel([2] * len(VOTERS) + [3], annotator=(len(VOTERS), np.arange(len(VOTERS) + 2) > 0)).fit(votes, counts, start)


def wanted(seen: DataFrame, labelled: int, others: int, sample_rows: int) -> DataFrame:
    """doc_id and said of the classifier's rows: those of training rows with the smallest hashes, annotated ones first, others only where room is left."""
    room = 0.9 * sample_rows
    shares = [min(1.0, max(0.0, room - labelled) / max(1, others)), min(1.0, room / max(1, labelled))]
    limit = [int(x * (1 << 20)) + (x == 1.0) for x in shares]
    return seen.where(F.col("train") & F.col("doc_id").isNotNull() & (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) < F.when(F.col("said") > 0, limit[1]).otherwise(limit[0]))).select("doc_id", "said").distinct()


def fit(docs: DataFrame, labels: DataFrame | None, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", held_out: int = 0, sample_rows: int = SAMPLE_ROWS) -> Scorer:
    """The scorer. Pattern counts come from all texts, with the annotations of all rows outside the held-out fold; the classifier's rows are a sample of these.

    The classifier sees sample_rows rows at most, about 0.9 of that: the annotated ones with the smallest hashes of doc_id, or,
    where no row is annotated, such rows of all. Rows of labels that are null, neither 0 nor 1, or repeated for a doc_id (then the largest counts) are allowed.
    """
    texts = sh.id_text(docs, doc_id, text).where(F.col("text").isNotNull())
    voters = Voters()
    seen = sh.stored(counted(texts, labels, label, held_out))
    table = seen.groupBy("bits", "train", "said").agg(F.count("*").alias("n")).toArrow().sort_by([("bits", "ascending"), ("said", "ascending"), ("train", "ascending")])
    bits, said, counts = (table[x].to_numpy() for x in ("bits", "said", "n"))
    if not len(bits):
        return Scorer(np.zeros(0, U64), np.zeros(0), np.ones(len(VOTERS)), -2.0)
    model = label_model(bits, said, counts.astype(np.float64))
    target_of = lambda bits, said: 1 - model.posterior(np.concatenate([_unpacked(bits), said[:, None]], 1).astype(np.int64))[:, 0]

    trained = table["train"].to_numpy()
    labelled = int(counts[trained & (said > 0)].sum())
    # a row without annotation holds what voters miss as often as other rows do, so it would teach that this is harmless; and
    # to add only those where a voter fires would teach that the voters' languages are toxic
    others = 0 if labelled else int(counts[trained & (said == 0)].sum())
    picked = wanted(seen.where("said > 0") if labelled else seen, labelled, others, sample_rows)
    ids = picked.withColumnRenamed("doc_id", "picked")  # a bounded number of ids: no text is shuffled
    chosen = sh.stored(texts.join(F.broadcast(ids), F.col("doc_id") == F.col("picked")).select("doc_id", "text", "said"))

    def count(batches):
        """How many rows of the sample hold each feature, and how toxic they are in all."""
        found, n, t, rows, toxic = [np.zeros(0, U64)], [np.zeros(0, np.int64)], [np.zeros(0)], 0, 0.0
        for batch in batches:
            told = batch["said"].to_numpy()
            for lo, hi, b, offs in tv.blocks(batch["text"]):
                w, first = _tokens(b, offs)
                target = target_of(voters.votes(w, first), told[lo:hi])
                row, feature = distinct_pairs(*features(b, offs, w, first))
                at, size = sh.groups_of(feature)
                found.append(feature[at])
                n.append(size)
                t.append(np.add.reduceat(target[row], at) if len(at) else np.zeros(0))
                rows, toxic = rows + hi - lo, toxic + float(target.sum())
                if sum(map(len, found)) > 3 * len(found[0]) + (1 << 20):
                    found, n, t = _merged(found, n, t)
        found, n, t = _merged(found, n, t)
        table = pa.table({"feature": pa.array(np.append(found[0].view(np.int64), 0)), "n": pa.array(np.append(n[0], rows)), "t": pa.array(np.append(t[0], toxic)), "all": pa.array(np.append(np.zeros(len(n[0]), bool), True))})
        yield from table.to_batches(1 << 16)

    sums = chosen.select("text", "said").mapInArrow(count, "feature long, n long, t double, all boolean").groupBy("all", "feature").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    sums = sh.stored(sums.where("n >= 3 or all"))
    every = sums.where("all").first()
    mean = min(1 - 1e-6, max(1e-6, every["t"] / max(1, every["n"]))) if every else 0.5
    part = lambda x, share: F.when(x > 1e-9, x * F.log(x / (F.col("n") * share))).otherwise(0.0)
    evidence = 2 * (part(F.col("t"), mean) + part(F.col("n") - F.col("t"), 1 - mean))
    kept = sums.where(~F.col("all")).select("feature", evidence.alias("evidence")).where(F.col("evidence") >= EVIDENCE).orderBy(F.desc("evidence"), "feature").limit(FEATURES).toArrow()
    plain = Scorer(kept["feature"].to_numpy().view(U64), np.zeros(len(kept)), np.zeros(len(VOTERS)), 0.0)

    def present(batch: pa.RecordBatch) -> pa.Table:
        live, votes, columns = plain.live(), [], []
        for lo, hi, b, offs in tv.blocks(batch["text"]):
            w, first = _tokens(b, offs)
            votes.append(voters.votes(w, first))
            rows, at = plain.find(b, offs, w, first, live)
            edge = np.searchsorted(rows, np.arange(hi - lo + 1))
            columns += [at[x:y].astype(np.uint32).tobytes() for x, y in zip(edge, edge[1:])]
        return pa.table({"doc_id": batch["doc_id"], "said": batch["said"], "bits": pa.array(np.concatenate(votes or [np.zeros(0, np.int64)])), "columns": pa.array(columns, pa.binary())})

    # rows that repeat a doc_id are chosen together, so the limit keeps what comes to the driver bounded
    sample = sh.map_batches(chosen, present, "doc_id long, said int, bits long, columns binary").orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id", "bits", "columns").limit(sample_rows).toArrow()
    told, own = sample["said"].to_numpy(), sample["bits"].to_numpy().astype(np.int64)
    target = target_of(own, told)
    at, lines = [0], []
    for c, v in zip(sample["columns"].to_pylist(), own):
        lines.append(np.concatenate([np.frombuffer(c, np.uint32).astype(np.int64), len(plain.known) + np.flatnonzero((v >> np.arange(len(VOTERS))) & 1)]))
        at.append(at[-1] + len(lines[-1]))
    # each row counts for its likelier answer as much as that is sure; a feature needs the evidence of a few rows, however many there are
    w, b = sparse_logistic(np.array(at), np.concatenate(lines or [np.zeros(0, np.int64)]).astype(np.int64), np.round(target), len(plain.known) + len(VOTERS), 1.0 / max(1, len(own)), len(VOTERS), weight=np.abs(2 * target - 1))
    used = np.flatnonzero(w[: len(plain.known)])
    return Scorer(plain.known[used], w[used], w[len(plain.known) :], b)


def _merged(found: list, n: list, t: list) -> tuple[list, list, list]:
    """Sums by feature."""
    keys, n, t = np.concatenate(found), np.concatenate(n), np.concatenate(t)
    order = np.argsort(keys, kind="stable")
    at, _ = sh.groups_of(keys[order])
    return [keys[order][at]], [np.add.reduceat(n[order], at) if len(at) else n], [np.add.reduceat(t[order], at) if len(at) else t]


def score(docs: DataFrame, scorer: Scorer, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) for each row of docs; a null text scores as an empty one, a null doc_id stays null."""
    voters = Voters()

    def work(batch: pa.RecordBatch) -> pa.Table:
        live = scorer.live()
        out = [scorer.score(b, offs, voters, live) for _lo, _hi, b, offs in tv.blocks(batch["text"])]
        return pa.table({"doc_id": batch["doc_id"], "score": pa.array(np.concatenate(out or [np.zeros(0)]))})

    return sh.map_batches(sh.id_text(docs, doc_id, text), work, "doc_id long, score double")


def accepted(docs: DataFrame, scorer: Scorer, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose score stays under the threshold; a null text scores as an empty one."""
    voters, schema = Voters(), docs.schema
    place = [f.name for f in schema.fields].index(text)

    def work(batch: pa.RecordBatch) -> pa.Table:
        live = scorer.live()
        keep = [np.zeros(0, bool), *(scorer.score(b, offs, voters, live) < threshold for _lo, _hi, b, offs in tv.blocks(batch.column(place)))]
        return pa.Table.from_batches([batch]).filter(pa.array(np.concatenate(keep)))

    return sh.map_batches(docs, work, schema)


def toxicity(docs: DataFrame, labels: DataFrame | None, doc_id: str = "doc_id", text: str = "text", held_out: int = 0, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= 0.5) for each row of docs; see fit() and score().

    Empty and null texts get the score of a text on which nothing fires. Equal rows get equal scores. Further columns of docs
    and labels are ignored. An empty table gives no rows; without usable labels the voters alone decide.
    """
    scored = score(docs, fit(docs, labels, doc_id, text, held_out=held_out, sample_rows=sample_rows), doc_id, text)
    return scored.select("doc_id", (fold("doc_id") == held_out).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


