"""Language identification, word first: known words count by their per-language log frequency,
unseen words back off to ever shorter character n-grams.

Nulls, texts without a letter: ``und`` with score 0. Empty tables give empty results; a text's
answer depends on its text alone, so repeated rows agree. Ties go to the first language in order.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import part_of, slices

GRAMS = (4, 3, 2, 1)
MEMO = 150_000


@dataclass
class Model:
    """``words`` and ``grams`` name rows of ``logs``: one log frequency per language."""
    langs: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    logs: np.ndarray

    def of_word(self, word: str) -> np.ndarray:
        row = self.words.get(word)
        if row is not None:
            return self.logs[row]
        marked = f"^{word}$"
        for n in GRAMS:
            rows = [r for i in range(len(marked) - n + 1) if (r := self.grams.get(marked[i:i + n])) is not None]
            if rows:
                return self.logs[rows].mean(axis=0)
        return np.zeros(len(self.langs))


def fit(labelled: DataFrame, per_language: int = 1000, least_count: int = 3) -> Model:
    """Learn from (text, lang) rows, about ``per_language`` rows of each language drawn by a hash of
    the row: that bounds the vocabulary, which the driver and the tasks hold whole."""
    rows = labelled.filter("lang is not null and text is not null").select("text", "lang")
    share = {r["lang"]: min(1.0, per_language / r["n"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not share:
        return Model([], {}, {}, np.zeros((0, 0)))
    langs = sorted(share)
    draw = F.pmod(F.xxhash64("text", "lang"), F.lit(1_000_000)) / 1_000_000
    bound = F.coalesce(*[F.when(F.col("lang") == k, F.lit(v)) for k, v in share.items()])
    words = (rows.filter(draw < bound)
             .select("lang", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("w")).filter("w <> ''")
             .groupBy("lang", "w").agg(F.count("*").alias("n")))
    marked = F.concat(F.lit("^"), "w", F.lit("$"))

    def pieces(k: int) -> Column:
        # the function for transform takes one argument: a second one, a default too, would be handed the position
        cut = F.transform(F.sequence(F.lit(1), F.length(marked) - (k - 1)), lambda i: F.substring(marked, i, F.lit(k)))
        return F.when(F.length(marked) >= k, cut).otherwise(F.array().cast("array<string>"))

    grams = words.select("lang", "n", F.explode(F.flatten(F.array(*map(pieces, GRAMS)))).alias("w"))
    counted = grams.groupBy("lang", "w").agg(F.sum("n").alias("n")).withColumn("kind", F.lit("g")).unionByName(
        words.withColumn("kind", F.lit("w")))
    place = F.coalesce(*[F.when(F.col("lang") == k, F.lit(i)) for i, k in enumerate(langs)])
    table = (counted.groupBy("kind", "w").agg(F.collect_list(place).alias("at"), F.collect_list("n").alias("n"), F.sum("n").alias("total"))
             .filter(F.col("total") >= least_count).select("kind", "w", "at", "n").toPandas())
    counts = np.zeros((len(table), len(langs)))
    for row, (at, n) in enumerate(zip(table["at"], table["n"])):
        counts[row, at] = n
    kinds, texts = table["kind"].to_numpy(), table["w"].to_numpy()
    classes = np.array([0 if k == "w" else len(t) for k, t in zip(kinds, texts)])
    logs = np.zeros_like(counts)
    for c in np.unique(classes):   # words, and n-grams of each length, are distributions of their own
        part = counts[classes == c]
        logs[classes == c] = np.log((part + 0.5) / (part.sum(axis=0) + 0.5 * len(part)))
    named = {k: {t: i for i, (t, x) in enumerate(zip(texts, kinds)) if x == k} for k in "wg"}
    return Model(langs, named["w"], named["g"], logs)


def _judge(texts: pa.Array, model: Model, memo: dict[str, int], rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(index of the best language or -1, its share) for each text."""
    plain = pc.utf8_lower(pc.replace_substring_regex(pc.fill_null(texts.cast(pa.large_string()), ""), r"[^\p{L}]+", " "))
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(plain))
    coded = lists.flatten().dictionary_encode()
    known = coded.dictionary.to_pylist()
    if len(memo) > MEMO:
        memo.clear()
        rows.clear()
    for w in known:
        if w not in memo:
            memo[w] = len(rows)
            rows.append(model.of_word(w) if w else np.zeros(len(model.langs)))
    ends = np.asarray(lists.offsets, dtype=np.int64)
    ends = ends - ends[0]
    if not known or not model.langs:
        return np.full(len(texts), -1), np.zeros(len(texts))
    of = np.vstack([rows[memo[w]] for w in known])[np.asarray(coded.indices)]
    total = np.vstack([np.zeros(len(model.langs)), np.cumsum(of, axis=0)])
    total = total[ends[1:]] - total[ends[:-1]]
    share = np.exp(total - total.max(axis=1, keepdims=True))
    share /= share.sum(axis=1, keepdims=True)
    letters = np.asarray(pc.greater(pc.binary_length(pc.ascii_trim_whitespace(plain)), 0))
    best = np.where(letters, share.argmax(axis=1), -1)
    return best, np.where(letters, share.max(axis=1), 0.0)


def identify(text: Column, model: Model, spark) -> Column:
    """struct(lang, score) of a text column."""
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model, memo, rows = held.value, {}, []
        names = np.array([*model.langs, "und"], dtype=object)
        for texts in batches:
            parts = [_judge(part_of(texts, a, b), model, memo, rows) for a, b in slices(texts)]
            best = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, int)
            score = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0)
            yield pa.StructArray.from_arrays([pa.array(names[best], pa.string()), pa.array(score)], ["lang", "score"])

    return F.arrow_udf(run, "struct<lang: string, score: double>")(text)


def label_documents(docs: DataFrame, labelled: DataFrame, **options) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``lang_score`` from a model learned on ``labelled`` (text, lang)."""
    model = fit(labelled, **options)
    out = docs.withColumn("__llm_found", identify(F.col("text"), model, docs.sparkSession))
    return out.withColumns({"lang_pred": F.col("__llm_found.lang"), "lang_score": F.col("__llm_found.score")}).drop("__llm_found")
