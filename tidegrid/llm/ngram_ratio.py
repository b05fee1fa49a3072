"""Quality rules: a hashed n-gram log-likelihood ratio, in DataFrame operations only.

The n-grams are all whole words and all pairs of neighbouring words, hashed into `buckets`. Two
multinomials over the buckets are counted: one over the trusted texts, one over the whole raw corpus.
A text's score is the mean over its n-grams of log p_trusted - log p_raw, so it does not depend on
length; texts under a fixed threshold are rejected. Beside it stand the base rules: counts of symbols,
repeated lines and repeated five-word windows.

N-grams are exploded as numbers and reduced within the scan's stage: the corpus counts leave a task as
one row a bucket, the scores as one row a text. Only texts with a repeated window sort their windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[^#*$%&|<>]+"
BUCKETS = 1 << 20
PAIR = 1000003
#: Added to both counts of a bucket, at the trusted texts' scale: an n-gram too rare to tell weighs about nothing.
PRIOR = 1.0
#: Nats an n-gram. Texts of the trusted kind score about 0, also in a minority language and unseen ones; see the README for figures.
THRESHOLD = -0.5
WINDOW = 5
TRUSTED_BROADCAST_ROWS = 250_000


def words_of(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text that is not null."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once for a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def grams(text: Column, buckets: int = BUCKETS) -> Column:
    """The bucket of each word and of each pair of neighbouring words of a text that is not null."""

    def both(h: Column) -> Column:
        pairs = F.zip_with(F.slice(h, F.lit(1), F.size(h) - 1), F.slice(h, F.lit(2), F.size(h) - 1), lambda x, y: F.pmod(x * PAIR + y, F.lit(buckets)))
        words = F.transform(h, lambda x: F.pmod(x, F.lit(buckets)))
        return F.when(F.size(h) < 2, words).otherwise(F.concat(words, pairs))

    return _let(F.transform(words_of(text), lambda w: F.crc32(w)), both)


def _repeated(hashes: Column, k: int) -> Column:
    """How many words stand in windows of k words whose hash occurs twice or more; hashes: of all windows, in order."""

    def covered(pairs: Column) -> Column:
        size = F.size(pairs)
        at = lambda i: F.get(pairs, i)["h"]
        twice = F.filter(pairs, lambda p, i: ((i > 0) & (at(i - 1) == p["h"])) | ((i < size - 1) & (at(i + 1) == p["h"])))
        places = F.sort_array(F.transform(twice, lambda p: p["i"]))
        return _let(places, lambda q: F.aggregate(F.transform(q, lambda x, i: F.when(i == 0, k).otherwise(F.least(F.lit(k), x - F.get(q, i - 1)))), F.lit(0), lambda a, x: a + x))

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_let(pairs, covered))


def base_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, mark (a hash of the text) and the base counts of each row; a null text has no words."""
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("mark"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    window = lambda w: F.when(F.size(w) < WINDOW, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(WINDOW)])))
    return plain.select(
        "doc_id",
        "mark",
        _let(
            words_of(F.col("text")),
            lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _let(window(w), lambda h: _repeated(h, WINDOW)).cast("long").alias("n_repeat_words")),
        ).alias("w"),
        F.length(F.regexp_replace("text", SYMBOLS, "")).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    ).select("doc_id", "mark", "w.n_words", "w.word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words")


def weights(docs: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """bucket and weight, one row for each bucket that the corpus has. trusted: the doc_ids of the trusted texts.

    The trusted ids are broadcast only if they are TRUSTED_BROADCAST_ROWS at most, else joined by a shuffle.
    """
    ids = trusted.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(1).alias("good")).distinct()
    ids = F.broadcast(ids) if ids.count() <= TRUSTED_BROADCAST_ROWS else ids
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where(F.col("text").isNotNull())
    counts = texts.join(ids, "doc_id", "left").select("good", F.explode(grams(F.col("text"), buckets)).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("raw"), F.count("good").alias("good"))
    every = Window.partitionBy()  # over a row a bucket, so `buckets` at most
    scale = F.sum("good").over(every) / F.sum("raw").over(every)
    return counts.select("bucket", (F.log(F.col("good") + PRIOR) - F.log(F.col("raw") * scale + PRIOR)).alias("weight"))


def quality(docs: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score and kept for each row of docs.

    base_failed: fewer than 10 words, or over a fifth of the words in repeated windows. score: the
    mean log-likelihood ratio, 0 for texts without words. kept: not base_failed and score >=
    threshold. Null texts have no words; a null doc_id stays null and is not trusted; equal rows are
    judged each. Without trusted texts every weight is 0, and the base rules decide. A very long text
    is an array of numbers in its row, and leaves the row one by one. Further columns are ignored. An empty table gives no rows.
    """
    rules = base_rules(docs, doc_id, text)
    table = weights(docs, trusted, doc_id, text, buckets)
    # by doc_id and a hash of the text: rows that agree in both have the same score, however often they occur
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    # mark and n-grams once for a text, before they leave it; explode_outer, as a filter for explode would make the n-grams again
    marked = texts.where(F.col("text").isNotNull()).select("id", F.xxhash64("text").alias("of"), grams(F.col("text"), buckets).alias("grams"))
    places = marked.select("id", "of", F.explode_outer("grams").alias("bucket"))
    # a row a bucket at most, so its size is bounded by `buckets`
    scores = places.join(F.broadcast(table), "bucket").groupBy("id", "of").agg(F.avg("weight").alias("score"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return (
        rules.join(scores, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("of")), "left")
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), F.coalesce("score", F.lit(0.0)).alias("score"))
        .withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
    )
