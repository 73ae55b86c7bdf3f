"""Quality rules: hashed n-gram likelihood ratio beside counted base rules. DataFrame functions only.

Features of a text are all its character n-grams: ``GRAM`` characters from every offset of its words, set apart by one
space, over their borders too; and the one or two characters that are left at the end of a word cut into pieces. They are hashed into
``BUCKETS`` buckets: few enough that even rare words of a clean text have been seen, at any size of corpus. Two
multinomials over the buckets are counted: one over every text of the corpus, one over every trusted
text. ``ngram_score`` is the mean over a text's features of log p_trusted - log p_corpus, so that length
does not move it; it is kept if that is at least the threshold and no base rule fails. ``score`` is the mean over the pieces
alone, each word cut from its start.

N-grams within a word and at its ends depend on the word only. So for the counts words are counted first, and the n-grams of different
words then; n-grams from the last character of a word to the first of the next are counted for themselves.

The counts cover all rows and are summed before the shuffle, so what reaches the driver is one pair
of numbers per bucket: bounded by ``BUCKETS``, whatever the corpus. The threshold is a fixed number.

Null and empty texts have no words: every count is zero, they fail the base rule, their score is
null. Rows with equal or null ids are judged row by row. With no trusted text at all, the trusted
multinomial equals the corpus's and every score is 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cluster_io import Tables, maybe_broadcast

BUCKETS = 1 << 14
GRAM = 3
#: Lowest mean log ratio of a text that is kept: its n-grams are, in the geometric mean, at most e**0.8
#: times rarer in trusted texts than in the corpus. Trained without the fifth of the labelled rows that crc32 holds out
#: (sf0.1), all 670 held-out trusted texts of 50 words score over -0.27, and half of the 116 others under -1.9.
THRESHOLD = -0.8
#: Pseudo-counts, spread as in the corpus: keeps the ratio of rare buckets near 1.
PRIOR = 1e-2
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SPACES, WORD, SYMBOLS = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]", r"[#*$%&|<>]+"


def words_of(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text without nulls."""
    return F.array_remove(F.split(text, SPACES), "")


def runs(words: Column, n: int) -> Column:
    """Structs of n consecutive words; empty if there are fewer."""
    size = F.greatest(F.size(words) - (n - 1), F.lit(0))
    return F.arrays_zip(*(F.slice(words, i + 1, size).alias(str(i)) for i in range(n)))


def bucket(gram: Column) -> Column:
    """Bucket, from 0, of an n-gram."""
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def pieces(word: Column) -> Column:
    """What a word is cut into from its start; the last one may be short."""
    return F.regexp_extract_all(word, F.lit(rf"{WORD}{{1,{GRAM}}}"), F.lit(0))


def overlapping(words: Column) -> Column:
    """The n-grams at every offset of some words, apart by a space and with one at each end."""
    return F.regexp_extract_all(F.concat(F.lit(" "), words, F.lit(" ")), F.lit(rf"(?s)(?=(.{{{GRAM}}}))."), F.lit(1))


def ngrams(word: Column) -> Column:
    """The n-grams of a word that has a space at each side, at every offset, and its short piece."""
    rest = F.char_length(word) % GRAM
    short = F.when(rest > 0, F.array(F.substring(word, -rest, F.lit(GRAM)))).otherwise(F.array().cast("array<string>"))
    return F.concat(overlapping(word), short)


def borders(words: Column) -> Column:
    """The n-grams from the last character of a word to the first of the next."""
    return F.regexp_extract_all(F.array_join(words, " "), F.lit(r"(?s)(?=(.\x20.))."), F.lit(1))


def base_counts(frame: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the base columns, and ``words`` for further use."""
    return counted(frame, id_col, text_col).drop("text")


def counted(frame: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    frame = frame.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    frame = frame.withColumn("words", words_of(text))
    frame = frame.withColumns({
        "n_words": F.size("words").cast("long"),
        "word_chars": F.char_length(F.array_join("words", "")).cast("long"),
        "n_symbols": (F.char_length(text) - F.char_length(F.regexp_replace(text, SYMBOLS, ""))).cast("long"),
        "lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)),
        "triples": F.transform(runs(F.col("words"), 3), lambda x: F.xxhash64(x)),
    })
    frame = frame.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
    frame = frame.withColumn("some", F.size(F.array_distinct("triples")) < F.size("triples"))
    # Windows found twice or more: neighbours in hash order are equal. Only texts that have some are sorted.
    frame = frame.withColumn("sorted", F.when(F.col("some"), F.array_sort(F.transform("triples", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    size = F.size("sorted")
    places = F.filter(F.sequence(F.lit(1), size), lambda j: ((j > 1) & (F.element_at("sorted", F.greatest(j - 1, F.lit(1)))["h"] == F.element_at("sorted", j)["h"])) | ((j < size) & (F.element_at("sorted", F.least(j + 1, size))["h"] == F.element_at("sorted", j)["h"])))
    frame = frame.withColumn("found", F.when(F.col("some"), F.transform(places, lambda j: F.element_at("sorted", j)["i"])))
    covered = F.size(F.array_distinct(F.flatten(F.array(F.col("found"), F.transform("found", lambda p: p + 1), F.transform("found", lambda p: p + 2)))))
    frame = frame.withColumn("n_repeat_words", F.when(F.col("some"), covered).otherwise(0).cast("long"))
    frame = frame.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    return frame.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "words", "text")


def barrier(frame: DataFrame) -> DataFrame:
    """The same rows, in a form that filters are not pushed through.

    A filter pushed below would put whole word lists into lambda bodies, once for each element. Nor
    may a plain explode() follow them, for it implies such a filter.
    """
    return frame.select(F.inline_outer(F.array(F.struct(*frame.columns))))


def word_counts(frame: DataFrame) -> DataFrame:
    """(word, trusted, n) of all texts (column ``trusted``: whether a text is). Partial sums before the shuffle."""
    words = frame.select("trusted", F.explode_outer(words_of(F.coalesce(F.col("text"), F.lit("")))).alias("word"))
    return words.groupBy("word", "trusted").agg(F.count("*").alias("n")).where("word is not null")


def bucket_counts(frame: DataFrame, words: DataFrame) -> tuple[list[int], list[int]]:
    """Features of all texts and of the trusted ones in each bucket, from texts and their word_counts()."""
    inner = words.select("trusted", "n", F.explode(ngrams(F.col("word"))).alias("gram"))
    over = frame.select("trusted", F.explode_outer(borders(words_of(F.coalesce(F.col("text"), F.lit(""))))).alias("gram")).groupBy("gram", "trusted").agg(F.count("*").alias("n"))
    found = inner.unionByName(over.where("gram is not null"), allowMissingColumns=True).groupBy(bucket(F.col("gram")).alias("b"), "trusted").agg(F.sum("n").alias("n"))
    corpus, trusted = [0] * BUCKETS, [0] * BUCKETS
    for row in found.collect():
        corpus[row["b"]] += row["n"]
        if row["trusted"]:
            trusted[row["b"]] += row["n"]
    return corpus, trusted


def log_ratios(corpus: list[int], trusted: list[int]) -> list[float]:
    n, t = sum(corpus), sum(trusted)
    if not n or not t:
        return [0.0] * len(corpus)
    weight = PRIOR * t
    return [math.log((y + weight * (x + 1) / (n + len(corpus))) / (t + weight)) - math.log((x + 1) / (n + len(corpus))) for x, y in zip(corpus, trusted, strict=True)]


class QualityModel:
    """Log ratio per bucket, and the threshold."""

    def __init__(self, ratios: list[float], threshold: float):
        self.ratios, self.threshold = ratios, threshold
        self.literal = "cast(split('" + ",".join(f"{x:.6f}" for x in ratios) + "', ',') as array<double>)"

    def _sum(self, grams: Column) -> Column:
        table = F.expr(self.literal)
        return F.aggregate(grams, F.lit(0.0), lambda a, x: a + F.element_at(table, bucket(x) + 1))

    def scored(self, frame: DataFrame) -> DataFrame:
        """The frame (words) with score, the mean over pieces, and ngram_score, over all n-grams; null without words."""
        some, joined = F.size("words") > 0, F.array_join("words", " ")
        frame = frame.withColumns({"pieces": pieces(joined), "grams": F.when(some, overlapping(joined)).otherwise(F.array().cast("array<string>"))})
        frame = frame.withColumn("short", F.filter("pieces", lambda x: F.char_length(x) < GRAM))
        score = self._sum(F.col("pieces")) / F.size("pieces")
        every = (self._sum(F.col("grams")) + self._sum(F.col("short"))) / (F.size("grams") + F.size("short"))
        return frame.withColumns({"score": F.when(some, F.round(score, 9)), "ngram_score": F.when(some, F.round(every, 9))}).drop("pieces", "grams", "short")


def fit(documents: DataFrame, labels: DataFrame, trusted_col: str = "quality", threshold: float = THRESHOLD) -> QualityModel:
    """Counts both multinomials over all rows; trusted are the rows whose label is 1."""
    ids = Tables(documents.sparkSession).cut(labels.where(F.col(trusted_col) == 1).select("doc_id").where(F.col("doc_id").isNotNull()).distinct())
    marked = documents.select("doc_id", "text").join(maybe_broadcast(ids.withColumn("trusted", F.lit(True)), 24), "doc_id", "left")
    words = Tables(documents.sparkSession).cut(word_counts(marked))
    return QualityModel(log_ratios(*bucket_counts(marked, words)), threshold)


def judge(documents: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, base columns, score, ngram_score, kept. Every input row comes back once."""
    base = model.scored(counted(documents, "doc_id", "text")).drop("words", "text")
    return barrier(base.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("ngram_score") >= model.threshold, F.lit(False))))


def kept_rows(documents: DataFrame, model: QualityModel) -> DataFrame:
    """The rows that are kept, with their own columns, in one pass: no join back by doc_id."""
    row = F.struct(*[F.col(c) for c in documents.columns])
    carried = documents.select(row.alias("doc_id"), F.col("text").alias("text"))
    return judge(carried, model).where("kept").select("doc_id.*")
