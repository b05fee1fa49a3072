"""The registered queries of this subpackage, one for each operator: each applies it to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm import best_fit, block_anchors, class_ngrams, fss_minhash, ngram_ratio, positional_index, secret_scan, suffix_levels, weak_quality, weak_toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_quality.quality(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = block_anchors.repeats(table(spark, sf_dir, "documents"), window=50)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"), F.size("spans").cast("long").alias("n_spans"))


def span_text(spans) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.scan(table(spark, sf_dir, "documents"))
    kind = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return out.select(
        "doc_id", kind("assign").alias("n_assign"), kind("access").alias("n_access"), kind("hex").alias("n_hex"), F.sha2(span_text(base).cast("binary"), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans")
    )


def op4_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_ngrams.scores(table(spark, sf_dir, "documents"), held_out=1)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = positional_index.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=10)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fss_minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=5, percent=85)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out=0)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_levels.repeats(table(spark, sf_dir, "documents"), length=400)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return ngram_ratio.quality(table(spark, sf_dir, "documents"), trusted).drop("score")


def queries() -> dict:
    found = {name: f for name, f in globals().items() if name.startswith("op")}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))



_WORDS = r"list_filter(string_split_regex({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = r"regexp_extract_all({text}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_SQL2 = f"""
WITH docs AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
places AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM docs WHERE len(w) >= 50),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS k FROM places),
hits AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS least FROM windows) WHERE least < doc_id),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM hits CROSS JOIN range(0, 50) AS r(j)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS i FROM docs),
marked AS (SELECT w.*, g.i IS NOT NULL AS gone FROM words w LEFT JOIN gone g ON w.doc_id = g.doc_id AND w.i = g.i),
runs AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), FALSE) AS begins FROM marked),
kept AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE begins) AS n_spans, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS text FROM runs GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256, coalesce(n_spans, 0) AS n_spans FROM docs d LEFT JOIN kept k ON d.doc_id = k.doc_id"""

_SQL5 = f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_TERMS.format(text=_LOWER)} AS w FROM benchmark),
wanted AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS key FROM (SELECT item, w, least(10, len(w)) AS k, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i FROM items WHERE len(w) > 0)),
docs AS (SELECT doc_id, {_TERMS.format(text=_LOWER)} AS w FROM documents),
found AS (SELECT doc_id, i, p.k, item FROM (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS key FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM docs CROSS JOIN (SELECT DISTINCT k FROM wanted) WHERE len(w) >= k)) p JOIN wanted x ON p.k = x.k AND p.key = x.key),
hit AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS place FROM found) GROUP BY doc_id),
who AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN who ON d.doc_id = who.doc_id"""

_SQL6 = f"""
WITH RECURSIVE docs AS (SELECT doc_id, {_WORDS.format(text=_LOWER)} AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM docs WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT c.a, c.b FROM common c JOIN sizes x ON x.doc_id = c.a JOIN sizes y ON y.doc_id = c.b WHERE 100 * c.n >= 85 * (x.n + y.n - c.n)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM docs UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, r.c AS component_id, r.c = d.doc_id AS kept FROM docs d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = d.doc_id"""

#: crc32 by its table, which its rule gives; the bytes of a word are read from its hex form.
_CRC_TABLE = "SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) AS x(i)"
_NIBBLE = "(instr('0123456789ABCDEF', substr(hex(word), {at}, 1)) - 1)"
_BYTES = f"list_transform(range(strlen(word)), lambda k: CAST({_NIBBLE.format(at='CAST(2 * k + 1 AS INT)')} * 16 + {_NIBBLE.format(at='CAST(2 * k + 2 AS INT)')} AS BIGINT))"
_CRC = f"xor(4294967295, list_reduce(list_prepend(4294967295, {_BYTES}), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])))"
_SQL10 = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS.format(text="coalesce(text, '')")} AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
words AS (SELECT r, doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS i FROM docs),
windows AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT r, w, unnest(generate_series(1, len(w) - 4)) AS i FROM docs WHERE len(w) >= 5)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM windows) WHERE n > 1),
repeated AS (SELECT r, count(DISTINCT i + j) AS n FROM twice CROSS JOIN range(0, 5) AS x(j) GROUP BY r),
crc AS (SELECT word, {_CRC} AS h FROM (SELECT DISTINCT word FROM words), ({_CRC_TABLE})),
hashed AS (SELECT r, doc_id, h, lead(h) OVER (PARTITION BY r ORDER BY i) AS next FROM words JOIN crc USING (word)),
grams AS (SELECT r, doc_id, h % {ngram_ratio.BUCKETS} AS bucket FROM hashed UNION ALL SELECT r, doc_id, (h * {ngram_ratio.PAIR} + next) % {ngram_ratio.BUCKETS} FROM hashed WHERE next IS NOT NULL),
counts AS (SELECT bucket, count(*) AS raw, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) AS good FROM grams GROUP BY bucket),
weights AS (SELECT bucket, ln(good + {ngram_ratio.PRIOR}) - ln(raw * (sum(good) OVER () / sum(raw) OVER ()) + {ngram_ratio.PRIOR}) AS weight FROM counts),
scores AS (SELECT r, avg(weight) AS score FROM grams JOIN weights USING (bucket) GROUP BY r),
rules AS (SELECT d.r, d.doc_id, len(w) AS n_words, coalesce(len(array_to_string(w, '')), 0) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(x.n, 0) AS n_repeat_words FROM docs d LEFT JOIN repeated x ON x.r = d.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND coalesce(score, 0) >= {ngram_ratio.THRESHOLD} AS kept FROM rules LEFT JOIN scores ON rules.r = scores.r"""


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that have one: learned models, tokenizers, decoders and byte strings do not."""
    return {"op2_substring_dedup": _SQL2, "op5_decontamination": _SQL5, "op6_minhash": _SQL6, "op10_quality_rules": _SQL10}
