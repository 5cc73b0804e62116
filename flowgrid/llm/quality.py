"""Quality rules: base counts of every text and a hashed n-gram likelihood ratio against the raw corpus.

Words and word pairs are hashed into ``BUCKETS`` buckets. Two multinomials over the buckets, one of trusted
documents and one of the whole corpus, give every bucket a log ratio; a document's verdict is the mean log ratio of
its n-grams against a fixed threshold. All of it is column expressions: no Python runs on the executors.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowgrid.llm.shared import SPACE, pick

BUCKETS = 10_000
#: Mean log ratio (natural log, in MICRO parts) from which a text is kept.
MICRO, THRESHOLD = 1_000_000, -0.07
#: Weight of the corpus-wide share in each bucket of the trusted counts: how many n-grams it counts for.
PRIOR = 10_000
LEAST_WORDS, MOST_REPEATED = 50, 50
SYMBOLS = "[#*$%&|<>]+"


def words(text: Column) -> Column:
    """The words of a text; none if it is null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def ngram_buckets(w: str) -> Column:
    """The buckets of all words and all pairs of neighbouring words in the array column ``w``."""
    one = f"transform({w}, x -> cast(pmod(xxhash64(x), {BUCKETS}) as int))"
    two = f"zip_with(slice({w}, 1, greatest(size({w}) - 1, 0)), slice({w}, 2, greatest(size({w}) - 1, 0)), (x, y) -> cast(pmod(xxhash64(x, y), {BUCKETS}) as int))"
    return F.expr(f"concat({one}, {two})")


def base_columns(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with the array ``words`` and the base counts.

    For the words in repeated 3-word windows, each window's hash is packed with its place into one long and the longs
    are sorted, so that equal windows become neighbours; neighbours are then compared word by word.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.withColumn("words", words(F.col("text")))
    rows = rows.withColumn("lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    rows = rows.withColumns({
        "n_words": F.size("words").cast("long"),
        "word_chars": F.length(F.array_join("words", "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
    })
    # the place takes as many low bits as the text's length needs, the window's hash has the others
    rows = rows.withColumn("b", F.expr("cast(ceil(log2(greatest(size(words), 2) + 1)) as int)"))
    rows = rows.withColumn("sorted", F.expr("""
        case when size(words) < 4 then cast(array() as array<bigint>) else
        sort_array(transform(sequence(1, size(words) - 2), i -> shiftleft(xxhash64(words[i - 1], words[i], words[i + 1]), b) | i)) end"""))  # fmt: skip
    place = "cast({} & (shiftleft(1L, b) - 1) as int)"
    equal = lambda x, y: f"shiftright({x}, b) = shiftright({y}, b) and " + " and ".join(f"words[{place.format(x)} + {k}] = words[{place.format(y)} + {k}]" for k in (-1, 0, 1))
    # a pair of like neighbours gives both places
    pairs = rows.withColumn("at", F.expr(f"""
        array_sort(array_distinct(flatten(transform(filter(sequence(1, size(sorted) - 1), i -> size(sorted) > 1 and {equal('sorted[i - 1]', 'sorted[i]')}),
        i -> array({place.format('sorted[i - 1]')}, {place.format('sorted[i]')})))))"""))  # fmt: skip
    covered = "aggregate(at, named_struct('n', 0L, 'end', 0), (s, p) -> named_struct('n', s.n + p + 3 - greatest(p, s.end), 'end', p + 3), s -> s.n)"
    pairs = pairs.withColumn("n_repeat_words", F.expr(covered))
    return pairs.drop("b", "lines", "sorted", "at")


def bucket_counts(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """bucket, raw, target: how often n-grams of each bucket are in all documents and in the trusted ones.

    ``trusted`` has doc_id, each once, and grows with the corpus; both sides are dealt by doc_id at every size.
    Null doc_ids are never trusted.
    """
    rows = pick(docs, "doc_id", "text").join(trusted.select("doc_id", F.lit(1).alias("is_trusted")).hint("shuffle_hash"), "doc_id", "left")
    grams = rows.select("is_trusted", words(F.col("text")).alias("words")).select("is_trusted", F.explode(ngram_buckets("words")).alias("bucket"))
    return grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("is_trusted").alias("target"))


def log_ratios(counts: DataFrame) -> list[int]:
    """Every bucket's log ratio of the two smoothed multinomials, in whole MICRO parts; BUCKETS numbers."""
    raw, target = [0] * BUCKETS, [0] * BUCKETS
    for r in counts.collect():  # BUCKETS rows at most
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    n, m = sum(raw), sum(target)
    share = [(x + 1) / (n + BUCKETS) for x in raw]
    return [round(MICRO * math.log((t + PRIOR * p) / (m + PRIOR) / p)) for t, p in zip(target, share)]


def trusted_ids(labels: DataFrame) -> DataFrame:
    """The documents that ``labels`` marks as of good quality and not toxic."""
    marks = pick(labels, "doc_id", "quality", "toxic").filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    return marks.filter((F.col("q") == 1) & (F.coalesce("t", F.lit(0)) == 0)).select("doc_id")


def judge(docs: DataFrame, ratios: list[int], threshold: float = THRESHOLD) -> DataFrame:
    """The base counts, base_failed, log_ratio (mean over n-grams) and kept of every whole text.

    base_failed: under 50 words, or over half of the words in repeated windows. kept: not base_failed and the mean
    log ratio is at least ``threshold``. Null and empty texts have no words and fail. Repeated rows and null
    doc_ids are judged like others; extra columns are ignored; an empty table gives an empty result.
    """
    rows = base_columns(pick(docs, "doc_id", "text")).withColumn("ratios", F.from_json(F.lit(str(ratios)), "array<bigint>"))
    total = F.aggregate(ngram_buckets("words"), F.lit(0).cast("long"), lambda s, k: s + F.get(F.col("ratios"), k))
    rows = rows.withColumn("log_ratio", F.coalesce(F.try_divide(total.cast("double"), (2 * F.size("words").cast("double") - 1) * float(MICRO)), F.lit(0.0).cast("double")))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    kept = ~F.col("base_failed") & (F.round("log_ratio", 9) >= threshold)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.round("log_ratio", 9).alias("log_ratio"))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Count both multinomials over all documents, then judge every document."""
    return judge(docs, log_ratios(bucket_counts(docs, trusted_ids(labels))), threshold)
