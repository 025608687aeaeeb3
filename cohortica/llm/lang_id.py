"""Language ID by rank-order profiles (Cavnar and Trenkle, 1994).

A profile is the list of a language's most frequent character n-grams (one to three characters of words set in blanks), most frequent first. A document's
own most frequent n-grams are compared with each profile by the out-of-place distance: the sum over its n-grams of how far apart the two
ranks are, or the profile's length for an n-gram that the profile lacks. The nearest language wins.

Words are runs of letters, in lower case; n-grams are counted over whole texts. Ties in counts are broken by the
n-gram, ties in distance by the language. Profiles are learnt from a bounded sample of each language's labelled rows (about sample_rows, chosen by a hash of the row, all rows if there are no more), so a rare language is learnt at every size: each Arrow batch gives partial counts,
Spark adds them up.
What is sent to the executors is languages * top rows; languages are a set of labels, and more than max_languages raise an error.

Edges: null text, or text without a letter: "und", score 0; no learnt language: "und" everywhere; null lang is not learnt from; repeated rows and extra
columns change nothing (only doc_id, text and lang are read); an empty table gives an empty result.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

TOP = 400
UNDETERMINED = "und"
#: An n-gram is kept as an integer: 21 bits a character.
BITS = 21


@functools.lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text and how often each occurs: letters, pairs with a letter, and triples around a letter; all else counts as a blank."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    m = letters()[c]
    c = np.where(m, c, 32).astype(np.int64)
    pairs = (c[:-1] << BITS) | c[1:]
    triples = (pairs[:-1] << BITS) | c[2:]
    grams = np.sort(np.concatenate([c[m], pairs[m[:-1] | m[1:]], triples[m[1:-1]]]))
    if not len(grams):
        return grams, grams
    starts = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    return grams[starts], np.diff(np.append(starts, len(grams)))


def ranked(grams: np.ndarray, counts: np.ndarray, top: int) -> np.ndarray:
    """The most frequent n-grams, ties by the n-gram."""
    if len(grams) > top:
        least = np.partition(counts, len(counts) - top)[len(counts) - top]
        grams, counts = grams[counts >= least], counts[counts >= least]
    return grams[np.lexsort((grams, -counts))][:top]


def learn(rows: DataFrame, top: int = TOP, max_languages: int = 2_000, sample_rows: int = 10_000) -> dict[str, np.ndarray]:
    """Profiles of the languages of rows (doc_id, text, lang)."""

    def partial(batches):
        for b in batches:
            langs, texts = b.column("lang").to_pylist(), b.column("text").to_pylist()
            by: dict[str, list] = {}
            for lang, text in zip(langs, texts, strict=True):
                by.setdefault(lang, []).append(counted(text))
            for lang, parts in by.items():
                g, c = np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
                u, inverse = np.unique(g, return_inverse=True)
                c = np.bincount(inverse, weights=c, minlength=len(u)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(u), pa.string()), pa.array(u), pa.array(c)], names=["lang", "gram", "n"])

    known = rows.where("text is not null and lang is not null").select("doc_id", "lang", "text")
    sizes = known.groupBy("lang").count().limit(max_languages + 1).collect()
    if len(sizes) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if not sizes:
        return {}
    # a share of the hashes for each language; one row per language, so the join may broadcast
    shares = rows.sparkSession.createDataFrame([(r.lang, int(min(1.0, sample_rows / r["count"]) * 2**62)) for r in sizes], "s_lang string, share long")
    mark = F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit(11)), 2)
    known = known.join(F.broadcast(shares), F.col("lang") == F.col("s_lang")).where(mark <= F.col("share")).select("lang", "text")
    counts = known.mapInArrow(partial, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = _best(counts, top)
    rows = best.collect()  # languages * top rows
    profiles: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r.lang, -r.n, r.gram)):
        profiles.setdefault(r.lang, []).append(r.gram)
    return {k: np.array(v, np.int64) for k, v in profiles.items()}


def _best(counts: DataFrame, top: int) -> DataFrame:
    """The most frequent n-grams of each language: first within slices of the n-grams, then among the slices' best."""
    order = [F.desc("n"), F.asc("gram")]
    sliced = counts.withColumn("slice", F.pmod(F.xxhash64("gram"), F.lit(64)))
    first = sliced.withColumn("r", F.row_number().over(Window.partitionBy("lang", "slice").orderBy(*order))).where(F.col("r") <= top)
    return first.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("r") <= top).select("lang", "gram", "n")


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], top: int = TOP) -> DataFrame:
    """doc_id, lang_pred, score and the other columns of docs but text (score: 1 for a document ranked as the profile, 0 for one that shares nothing)."""
    others = [c for c in docs.columns if c not in ("text", "lang_pred", "score")]
    languages = sorted(profiles)
    vocabulary = np.unique(np.concatenate([profiles[x] for x in languages])) if languages else np.zeros(0, np.int64)
    # rank of every n-gram of the vocabulary in every profile; `top` where it is missing, and for all others in the last column
    ranks = np.full((len(languages), len(vocabulary) + 1), top, np.int64)
    for i, x in enumerate(languages):
        ranks[i, np.searchsorted(vocabulary, profiles[x])] = np.arange(len(profiles[x]))

    def one(text: str | None) -> tuple[str, float]:
        if text is None or not languages:
            return UNDETERMINED, 0.0
        own = ranked(*counted(text), top)
        if not len(own):
            return UNDETERMINED, 0.0
        at = np.minimum(np.searchsorted(vocabulary, own), len(vocabulary) - 1)
        at = np.where(vocabulary[at] == own, at, len(vocabulary))
        r = ranks[:, at]
        away = np.where(r == top, top, np.abs(r - np.arange(len(own)))).sum(axis=1)
        best = int(away.argmin())
        return languages[best], float(1 - away[best] / (top * len(own)))

    def answer(batches):
        for b in batches:
            found = [one(x) for x in b.column("text").to_pylist()]
            arrays = [b.column(c) for c in others] + [pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*others, "lang_pred", "score"])

    schema = StructType([docs.schema[c] for c in others] + [StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return docs.select(*others, "text").mapInArrow(answer, schema)


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training: crc32 of the id as text leaves 1 when divided by 3. Null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def identify(docs: DataFrame, top: int = TOP) -> DataFrame:
    """doc_id, held_out, lang_pred, score per document row."""
    profiles = learn(docs.where(~held_out(F.col("doc_id"))), top)
    return predict(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), profiles, top)


def keep_identified(docs: DataFrame, top: int = TOP) -> DataFrame:
    """Documents with a language; those that are undetermined go, and lang becomes the language found. Columns as in docs."""
    profiles = learn(docs.where(~held_out(F.col("doc_id"))), top)
    languages = sorted(profiles)
    if not languages:
        return docs.where(F.lit(False))
    others = [c for c in docs.columns if c != "text"]
    found = predict(docs.withColumn("l_text", F.col("text")), profiles, top)
    return found.where(F.col("lang_pred") != UNDETERMINED).withColumn("lang", F.col("lang_pred")).withColumnRenamed("l_text", "text").select(*[c for c in docs.columns if c in others or c == "text"])
