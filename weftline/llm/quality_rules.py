"""Quality rules: base counts, and divergence from the references of a document's language.

Each document becomes two histograms: its characters by class and its words by common word of any of the languages (all
others in one bin). The medians over all documents of a language are that language's references. A document is rejected when
the Jensen-Shannon distance to a reference of its own language exceeds the limit, if it is long enough for its histogram to
mean anything. Both passes read every document; what passes between them is one narrow row per document.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import no_cache, saved, slices, small, table, tidy

# Common function words of the four languages.
COMMON = {
    "en": "the of and to in is that for it as was with be by on not he his but at are this have from or an which you one we all were her she there their",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la avec ou son",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha",
}
WORDS = sorted({w.encode() for line in COMMON.values() for w in line.split()})
_BIN = {w: k + 1 for k, w in enumerate(WORDS)}
SYMBOLS = b"#*$%&|<>"
CLASSES = ("vowel", "consonant", "upper", "digit", "space", "stop", "symbol", "other", "high")
#: Below so many words (characters for the class histogram: six times that) a histogram says too little to judge by.
MIN_WORDS = 50
#: Jensen-Shannon distances (base 2, 0 to 1) above which a document is rejected.
#: The first grows for short documents, whose histograms are noisy: by NOISE over the root of the number of words.
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE, NOISE = 0.17, 0.60, 0.5
#: Steps in which shares are counted.
GRID = 100_000
SCHEMA = "id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, classes array<int>, words array<int>"


def _class_table() -> np.ndarray:
    kind = np.full(256, 7, np.uint8)
    kind[[*range(ord("a"), ord("z") + 1)]] = 1
    kind[list(b"aeiouy")] = 0
    kind[[*range(ord("A"), ord("Z") + 1)]] = 2
    kind[[*range(ord("0"), ord("9") + 1)]] = 3
    kind[[*range(9, 14), 32]] = 4
    kind[list(b".,;:!?'\"-()")] = 5
    kind[list(SYMBOLS)] = 6
    kind[0xC0:] = 8  # first byte of a character beyond ASCII
    kind[0x80:0xC0] = 9  # the bytes after it are not characters
    return kind


_KIND = _class_table()
_SYMBOL = re.compile(rb"[#*$%&|<>]")


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """How many words lie in a window of five words that occurs twice or more in the text."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    key = h[:n].copy()
    for k in range(1, width):
        key = key * np.uint64(0x9E3779B97F4A7C15) + (h[k : k + n] ^ (key >> np.uint64(29)))
    order = np.argsort(key)
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int32)
    at = np.flatnonzero(twice)
    edge[at] += 1
    np.subtract.at(edge, at + width, 1)
    return int((np.cumsum(edge) > 0).sum())


def duplicate_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.split(None, 1)] if b"\n" in text else []
    return len(lines) - len(set(lines))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Base counts and histograms of every whole text; one narrow row per document."""

    def run(batches):
        no_cache()
        for batch in batches:
            rows = []
            for text in (t for part in slices(batch.column(2)) for t in part):
                words = text.split()
                kinds = np.bincount(_KIND[np.frombuffer(text, np.uint8)], minlength=10)
                bins = np.bincount(np.fromiter((_BIN.get(w, 0) for w in map(bytes.lower, words)), np.int32, len(words)), minlength=len(WORDS) + 1)
                rows.append((len(words), int(kinds[:9].sum() - kinds[4]), int(kinds[6]), duplicate_lines(text), repeated_words(words), kinds[:9], bins))
            counts = [pa.array([r[k] for r in rows], pa.int64()) for k in range(5)]
            lists = [pa.array([r[k].astype(np.int32) for r in rows], pa.list_(pa.int32())) for k in (5, 6)]
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *counts, *lists], names=names)

    narrow = docs.select(F.col(id_col).cast("long"), F.col(lang_col).cast("string"), F.col(text_col).cast("string"))
    return narrow.mapInArrow(tidy(run), SCHEMA)


def _share(histogram: Column, total: Column) -> Column:
    """Counts as parts of their total, a plain column that is not computed anew for each bin."""
    return F.transform(histogram, lambda x: F.when(total > 0, x / total).otherwise(F.lit(0.0)))


def _references(rows: DataFrame, column: str) -> DataFrame:
    """For each language, the median of its documents' shares in each bin, brought to a sum of 1.

    Medians, unlike means, do not move with the junk that is to be found. Shares are taken in steps of 1 / GRID, so that they
    can be counted map-side and the median of a bin is found exactly, among at most GRID + 1 counts.
    """
    bins = rows.where(F.col("n_words") >= MIN_WORDS).select("lang", F.posexplode(f"p_{column}").alias("bin", "share"))
    steps = bins.groupBy("lang", "bin", F.floor(F.col("share") * GRID).alias("step")).agg(F.count("*").alias("n"))
    by_bin = Window.partitionBy("lang", "bin")
    steps = steps.withColumn("upto", F.sum("n").over(by_bin.orderBy("step"))).withColumn("all", F.sum("n").over(by_bin))
    medians = steps.where(2 * F.col("upto") >= F.col("all")).groupBy("lang", "bin").agg((F.min("step") / GRID).alias("share"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("bin", "share"))), lambda x: x["share"])
    medians = medians.groupBy("lang").agg(ordered.alias("bins")).withColumn("total", F.aggregate("bins", F.lit(0.0), lambda a, x: a + x))
    return medians.select("lang", _share(F.col("bins"), F.col("total")).alias(f"ref_{column}"))


def jensen_shannon(p: Column, q: Column) -> Column:
    """Distance between two histograms that each add up to 1: the root of the divergence to base 2; NULL without either."""

    def part(x, y):
        m = (x + y) / 2
        return F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))

    both = F.zip_with(p, q, lambda x, y: (part(x, y) + part(y, x)) / 2)
    return F.when(both.isNotNull(), F.sqrt(F.greatest(F.lit(0.0), F.aggregate(both, F.lit(0.0), lambda a, x: a + x))))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per document: the base counts, both distances, ``base_failed`` and ``kept``.

    Defined results: a null or empty text has no words and fails the base rules; a null language is a language of its own;
    languages without a long document have no reference and are judged by the base rules alone; repeated rows and null
    ids are judged each for itself; texts of any length are counted whole; an empty table gives an empty table; other
    columns are not read, whatever their names.
    """
    rows = saved(measure(docs, id_col, text_col, lang_col)).withColumn("n_chars", F.aggregate("classes", F.lit(0).cast("long"), lambda a, x: a + x))
    rows = rows.withColumn("p_classes", _share(F.col("classes"), F.col("n_chars"))).withColumn("p_words", _share(F.col("words"), F.col("n_words")))
    refs = _references(rows, "classes").join(_references(rows, "words").withColumnRenamed("lang", "l2"), F.col("lang").eqNullSafe(F.col("l2")))
    refs = saved(refs.select(F.col("lang").alias("l_"), "ref_classes", "ref_words"))
    x = rows.join(small(refs), F.col("lang").eqNullSafe(F.col("l_")), "left")
    long_enough = {"classes": F.col("n_chars") >= 6 * MIN_WORDS, "words": F.col("n_words") >= MIN_WORDS}
    for c in ("classes", "words"):
        x = x.withColumn(f"d_{c}", F.when(long_enough[c] | (F.col("n_words") >= MIN_WORDS), jensen_shannon(F.col(f"p_{c}"), F.col(f"ref_{c}"))))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    far = (F.col("d_classes") > MAX_CLASS_DISTANCE + NOISE / F.sqrt(F.greatest(F.lit(1), F.col("n_words")))) | (F.col("d_words") > MAX_WORD_DISTANCE)
    return x.select(
        "id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & ~F.coalesce(far, F.lit(False))).alias("kept"), F.col("d_classes").alias("class_distance"), F.col("d_words").alias("word_distance"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id").drop("lang")
    return out.withColumn("class_distance", F.round("class_distance", 6)).withColumn("word_distance", F.round("word_distance", 6))
