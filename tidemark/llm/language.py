"""Language identification: known words first, then progressively shorter character n-grams."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import beside, carrying, lean, slices, table, written
from .packing import forget_words

#: The model is fitted on about so many labelled documents of each language, drawn by a hash of the id.
SAMPLE = 400
LONGEST = 4
SEEN = 3
#: Letters and what else counts as part of a word; words that are not letters alone are taken apart once more.
LETTERS = re.compile(r"[^\W\d_]+")
OUT = "id long, lang_pred string, score double"


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def words_of(text: str) -> Counter:
    """Runs of letters (Unicode category L, as in fit()) of a lower-cased text, with their numbers."""
    counts = Counter(LETTERS.findall(text.lower()))
    for word in [w for w in counts if not w.isalpha()]:
        n = counts.pop(word)
        for part in "".join(c if c.isalpha() else " " for c in word).split():
            counts[part] += n
    return counts


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> dict:
    """Per-language log frequencies of words and of their n-grams of 1 to LONGEST characters, from labelled rows.

    Rows with a null text or language teach nothing. The sample of each language is bounded, and with it the model.
    Without any labelled row the model has no language.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    n = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not n:
        return {"langs": [], "levels": {}}
    langs = sorted(n)
    below = F.create_map(*[F.lit(x) for lang, k in n.items() for x in (lang, min(1.0, sample / k))])
    # languages are numbers from here on, so that none is taken for a column
    number = F.create_map(*[F.lit(x) for i, lang in enumerate(langs) for x in (lang, i)])
    drawn = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.element_at(below, F.col("lang")) * (1 << 20)).select("text", F.element_at(number, F.col("lang")).alias("lang"))
    words = drawn.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1))).alias("gram")).groupBy("lang", "gram").agg(F.count("*").alias("n"))
    words = written(words, "language-words")
    padded = F.concat(F.lit(" "), "gram", F.lit(" "))
    grams = F.array(F.struct(F.lit(0).alias("k"), F.col("gram").alias("gram")))
    for k in range(1, LONGEST + 1):
        at = F.when(F.length(padded) >= k, F.sequence(F.lit(1), F.length(padded) - (k - 1))).otherwise(F.array().cast("array<int>"))
        grams = F.concat(grams, F.transform(at, lambda i, k=k: F.struct(F.lit(k).alias("k"), padded.substr(i, F.lit(k)).alias("gram"))))
    both = words.select("lang", "n", F.explode(grams).alias("g")).groupBy("g.k", "g.gram").pivot("lang", list(range(len(langs)))).agg(F.sum("n"))
    kept = both.where(sum((F.coalesce(F.col(f"`{x}`"), F.lit(0)) for x in range(len(langs))), F.lit(0)) >= SEEN)
    found = kept.toArrow()
    import numpy as np

    counts = np.array([np.nan_to_num(found.column(str(x)).to_numpy(zero_copy_only=False).astype(np.float32)) for x in range(len(langs))]).T.reshape(-1, len(langs))
    ks, grams = found.column("k").to_numpy(), found.column("gram").to_pylist()
    del found
    model = {"langs": langs, "levels": {}, "logs": np.zeros((len(counts) + 1, len(langs)), np.float32)}
    for k in range(LONGEST + 1):
        here = np.flatnonzero(ks == k)
        c = counts[here]
        model["logs"][here] = np.log(c + 0.5) - np.log(c.sum(axis=0) + 0.5 * max(1, len(here)))
        model["levels"][k] = {grams[i]: i for i in here.tolist()}
    return model


class Scorer:
    """Scores texts by a model. A word's vector is kept for its next occurrence, up to a number of words."""

    def __init__(self, model: dict, most: int = 100_000):
        import numpy as np

        self.model, self.at = model, {}
        self.vectors = np.zeros((most if model["langs"] else 0, len(model["langs"])), np.float32)

    def grams(self, word: str) -> list[int]:
        """Rows of the model that speak for a word: its own, or those of its longest known n-grams, or the last one, which is zero."""
        levels = self.model["levels"]
        if (found := levels[0].get(word)) is not None:
            return [found]
        padded = f" {word} "
        for k in range(LONGEST, 0, -1):
            level = levels[k]
            if known := [level[x] for i in range(len(padded) - k + 1) if (x := padded[i : i + k]) in level]:
                return known
        return [-1]

    def learn(self, words: list[str]) -> None:
        import numpy as np

        rows = [self.grams(w) for w in words]
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        logs = self.model["logs"][np.fromiter(chain.from_iterable(rows), np.int64, int(sizes.sum()))]
        first = len(self.at)
        self.vectors[first : first + len(words)] = np.add.reduceat(logs, np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]
        self.at.update(zip(words, range(first, first + len(words)), strict=True))

    def of(self, text: str | None) -> tuple[str, float]:
        import numpy as np

        langs, at = self.model["langs"], self.at
        counts = words_of(text) if text else None
        if not counts or not langs:
            return "und", 0.0
        new = [w for w in counts if w not in at]
        if len(at) + len(new) > len(self.vectors):
            at.clear()
            new = list(counts)
            if len(new) > len(self.vectors):
                self.vectors = np.zeros((len(new), len(langs)), np.float32)
        if new:
            self.learn(new)
        own = self.vectors[np.fromiter(map(at.__getitem__, counts), np.int64, len(counts))]
        n = np.fromiter(counts.values(), float, len(counts))
        # a few dozen words' worth of evidence at most, so that the score stays informative
        each = n @ own / n.sum() * min(n.sum(), 24)
        each = np.exp(each - each.max())
        best = int(np.argmax(each))
        score = float(each[best] / each.sum())
        return langs[best], score if math.isfinite(score) else 0.0


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """Per document: id, lang_pred, score in 0..1. A text that is null or has no letter, or a model without languages, gives und and 0.

    carry: the row comes along, its text and the other columns as a struct, so that it need not be found again by its id.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample it was fitted on
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), *([beside(docs, text_col)] if carry else []))

    schema = carrying(OUT, rows)
    names = schema.names

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_words()
        scorer = Scorer(shared.value)
        for batch in slices(batches):
            said = [scorer.of(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in said], pa.string()), pa.array([x for _, x in said], pa.float64()), *(batch.columns[1:] if carry else [])], names)

    return rows.mapInArrow(lean(score), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs, model).select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "lang_pred", "score")
