"""Benchmark decontamination by winnowing, with DataFrame functions only.

Method: a text's fingerprints are the least hash of its ``K``-word grams in each window of ``SPAN - K + 1`` grams, so
two texts that share ``SPAN`` words in a row share a fingerprint. Fingerprints of the documents meet those of the
benchmark in a join; in documents with a hit every window of ``SPAN`` words is then compared with the benchmark's
windows by their words, and words under equal windows are counted. Items shorter than ``SPAN`` words are one window
of their own length; no winnowing guarantee holds below ``SPAN``, so their hashes meet all grams of that length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leadloom.plans.storage import join_ids, materialise

SPAN, K = 13, 5
#: Bytes of the benchmark's fingerprints or windows that may be broadcast; more take a shuffled join.
BROADCAST_BYTES = 64_000_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words: runs of digits, letters and non-ASCII characters, A-Z in lower case. Null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _SEPARATORS), "")


def _grams(words: str, n: int) -> Column:
    """Hashes of all grams of ``n`` words; none for shorter texts."""
    count = F.size(words) - (n - 1)
    gram = lambda i: F.xxhash64(*[F.get(F.col(words), i + k) for k in range(n)])
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), gram)).otherwise(F.array().cast("array<long>"))


def _winnow(grams: str) -> Column:
    """Distinct least hashes of all windows of grams that a span of ``SPAN`` words has."""
    width = SPAN - K + 1
    count = F.size(grams) - (width - 1)
    least = lambda i: F.array_min(F.slice(F.col(grams), i, width))
    return F.when(count > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), count), least))).otherwise(F.array().cast("array<long>"))


def _marks(words: str, shorter: list[int]) -> Column:
    """What of a text meets the benchmark: winnowed fingerprints under length 0, grams of the short items' lengths."""
    marked = lambda grams, n: F.transform(grams, lambda g: F.struct(F.lit(n).alias("n"), g.alias("gram")))
    return F.concat(F.transform(_winnow("grams"), lambda g: F.struct(F.lit(0).alias("n"), g.alias("gram"))), *[marked(F.array_distinct(_grams(words, n)), n) for n in shorter])


def _windows(texts: DataFrame, keys: list[str], lengths: list[int], words: bool = True) -> DataFrame:
    """(keys, words, n, at, gram): hash and start of every window of each length.

    Rows that are not shuffled may carry the words of their text, of which there is one array in memory; others must not.
    """
    placed = lambda n: F.transform(_grams("words", n), lambda g, i: F.struct(F.lit(n).alias("n"), i.alias("at"), g.alias("gram")))
    kept = [*keys, "words"] if words else keys
    return texts.select(*kept, F.explode(F.concat(*map(placed, lengths))).alias("w")).select(*kept, "w.*")


def _small(df: DataFrame, row_bytes: Column, most: int) -> bool:
    """Whether all of the benchmark's side of a join may be broadcast."""
    return df.agg(F.coalesce(F.sum(row_bytes), F.lit(0))).first()[0] <= most


def _key(text: str = "text") -> list[Column]:
    """Two 64-bit hashes that name a text; null is the empty text."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def _hits(docs: DataFrame, benchmark: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(k1, k2, n_words, n_hit, items) of the texts that windows of the benchmark hit, once a text."""
    keys = ["k1", "k2"]
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), words_of(F.col("text")).alias("words"))
    items = materialise(items.filter(F.size("words") > 0).distinct(), "benchmark-words")
    shorter = sorted(r[0] for r in items.filter(F.size("words") < SPAN).select(F.size("words")).distinct().collect())

    # One pass over the documents: fingerprints, and the grams of short items, which no winnowing guarantee covers.
    texts = docs.select(*_key(), "text")
    worded = texts.select(*keys, words_of(F.col("text")).alias("words")).select(*keys, "words", _grams("words", K).alias("grams"))
    entries = worded.select(*keys, F.explode(_marks("words", shorter)).alias("m")).select(*keys, "m.*")
    own = items.select("words", _grams("words", K).alias("grams"))
    long_marks = own.select(F.lit(0).alias("n"), F.explode(_winnow("grams")).alias("gram"))
    short_grams = F.coalesce(*[F.when(F.size("words") == n, F.element_at(_grams("words", n), 1)) for n in shorter], F.lit(None).cast("long"))
    short_marks = items.filter(F.size("words") < SPAN).select(F.size("words").alias("n"), short_grams.alias("gram"))
    marks = long_marks.unionByName(short_marks).distinct()
    met = F.broadcast(marks) if _small(marks, F.lit(40), broadcast_bytes) else marks.hint("shuffle_hash")
    found = materialise(entries.join(met, ["n", "gram"], "left_semi").select(*keys).distinct(), "contaminated")

    # Only documents with a shared fingerprint are cut into windows; their words decide, not the hashes.
    suspects = join_ids(texts, found, keys).dropDuplicates(keys).select(*keys, words_of(F.col("text")).alias("words"))
    lengths = [SPAN, *shorter]
    theirs = _windows(items, ["item_id"], lengths).filter(F.col("n") == F.least(F.lit(SPAN), F.size("words")))
    theirs = theirs.select("item_id", "n", "gram", F.slice("words", F.col("at") + 1, F.col("n")).alias("span")).distinct()
    if _small(theirs, F.octet_length(F.array_join("span", " ")) + 16 * F.size("span") + 100, broadcast_bytes):
        pairs = _windows(suspects, keys, lengths).join(F.broadcast(theirs), ["n", "gram"])
    else:
        # Windows are shuffled by their hashes alone; the words of texts meet those that a hash found.
        suspects = materialise(suspects, "suspects")
        pairs = _windows(suspects, keys, lengths, words=False).join(theirs.hint("shuffle_hash"), ["n", "gram"]).join(suspects, keys)
    pairs = pairs.filter(F.slice("words", F.col("at") + 1, F.col("n")) == F.col("span"))
    extended = materialise(pairs.select(*keys, F.size("words").alias("n_words"), "item_id", "at", (F.col("at") + F.col("n")).alias("stop")), "contaminated-spans")

    earlier = Window.partitionBy(*keys).orderBy("at", "stop").rowsBetween(Window.unboundedPreceding, -1)
    merged = extended.groupBy(*keys, "n_words", "at").agg(F.max("stop").alias("stop"))
    merged = merged.withColumn("fresh", F.greatest(F.lit(0), F.col("stop") - F.greatest("at", F.coalesce(F.max("stop").over(earlier), F.lit(0)))))
    covered = merged.groupBy(*keys, "n_words").agg(F.sum("fresh").cast("long").alias("n_hit"))
    named = extended.select(*keys, "item_id").distinct().groupBy(*keys).agg(F.sort_array(F.collect_list("item_id")).alias("items"))
    return materialise(covered.join(named, keys), "contaminated-texts")


def keep_clean(docs: DataFrame, benchmark: DataFrame, percent: int = 5, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Rows of ``docs``, with all their columns, that are not contaminated; each row is judged by its own text."""
    bad = _hits(docs, benchmark, broadcast_bytes).filter(100 * F.col("n_hit") >= percent * F.col("n_words")).select("k1", "k2")
    rows = docs.select(F.struct("*").alias("row"), *_key())
    return join_ids(rows, bad, ["k1", "k2"], "left_anti").select("row.*")


def contamination(docs: DataFrame, benchmark: DataFrame, percent: int = 5, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Words of each document that lie under windows of the benchmark.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text; other columns are ignored. Returns doc_id, n_words,
    n_hit, n_items, items (sorted as strings), contaminated: at least one word and ``percent`` of the words are hit.
    Null and empty texts have no words and are never hit; a null item_id counts as the item ``null``. Rows that repeat
    an id are judged each by its own text. A benchmark of more than ``broadcast_bytes`` meets the documents in shuffled
    joins, in which windows travel without the words of their texts.
    """
    hits = _hits(docs, benchmark, broadcast_bytes).drop("n_words")
    counted = docs.select("doc_id", *_key(), F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    out = counted.join(hits, ["k1", "k2"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (100 * n_hit >= percent * F.col("n_words"))).alias("contaminated"),
    )
