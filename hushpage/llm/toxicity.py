"""Toxicity by class-conditional Kneser-Ney models.

p(word | previous word, class) is estimated for toxic and for ordinary documents, in four levels that share what they do not trust:

* pairs: documents of the class that hold the pair, discounted, over those that hold its first word;
* words: continuation counts, the distinct words that come before a word in documents of the class;
* stems (the first five bytes of longer words; a shorter word is its own): the words' counts that were taken off;
* shared: what both classes took off the stems, with a share for stems never seen. A word's share of its stem is shared, too.

Each level takes ``DISCOUNT`` off an expression's count if the documents that hold it tell the classes apart (by a
threshold of standard deviations), else the whole count, and gives exactly what it took to the next level, so each class's
distribution sums to one. Rare expressions thus rest on the counts of both classes. A text's score compares both log-likelihoods,
normalised by its length and calibrated by logistic regression. What rests on shared counts cancels in that
comparison, so only expressions that some threshold trusts reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushpage.llm.blocks import cut
from hushpage.llm.textblocks import mix, release_memory, word_hashes_and_stems

#: Thresholds among which the calibration documents choose, in standard deviations.
THRESHOLDS = (3.0, 4.0, 5.0, 6.0, 8.0)
DISCOUNT = 0.75
START = np.uint64(0x5EED5EED5EED5EED)


def id_remainder(id_col: str, n: int) -> Column:
    """crc32 of an id's decimal text modulo n; a null id has remainder 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % n, F.lit(0))


class Expressions:
    """Hashes of each word of lower-cased texts: the pair that it ends, its previous word, itself and its stem."""

    def __init__(self, texts: list[bytes]):
        self.word, self.off, stems = word_hashes_and_stems([t.lower() for t in texts])
        self.stem = np.where(stems == 0, self.word ^ np.uint64(0x77), stems)
        self.before = np.concatenate(([START], self.word[:-1]))[: len(self.word)]
        self.before[self.off[:-1][self.off[:-1] < self.off[1:]]] = START
        self.pair = mix(self.before * np.uint64(3) + self.word)


def _texts(column: pa.Array) -> list[bytes]:
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


_COUNTS = "level int, before long, expression long, stem long, toxic long, docs long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each class by pair (level 0), word (1) and stem (2), combined for some documents at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            found = Expressions(_texts(part.column(0)))
            toxic = part.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            doc = np.repeat(np.arange(part.num_rows), np.diff(found.off))
            for level, key in enumerate((found.pair, found.word, found.stem)):
                order = np.lexsort((doc, key))
                k, d = key[order], doc[order]
                new = np.concatenate(([True], (k[1:] != k[:-1]) | (d[1:] != d[:-1])))[: len(k)]
                order, k, d = order[new], k[new], d[new]
                first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))[: len(k)])
                if not len(first):
                    continue
                one, n = order[first], np.diff(np.append(first, len(k)))
                named = key if level == 2 else found.word
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(one), level, dtype=np.int32)),
                        pa.array((found.before[one] if level == 0 else np.zeros(len(one), np.uint64)).view(np.int64)),
                        *(pa.array(x[one].view(np.int64)) for x in (named, found.stem)),
                        *(pa.array(x.astype(np.int64)) for x in (np.add.reduceat(toxic[d], first), n)),
                    ],
                    names=["level", "before", "expression", "stem", "toxic", "docs"],
                )


def _deviation(toxic, docs, share: float):
    """How far an expression's toxic documents lie from the share that they would have in both classes alike."""
    expected = docs * share
    square = (toxic - expected) * (toxic - expected) / (expected * (1 - share) + 1)
    return square**0.5 if not isinstance(square, Column) else F.sqrt(square)


class Level:
    """Sorted hashes with a log-likelihood ratio each."""

    def __init__(self, keys: np.ndarray, ratio: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.ratio = keys[order], ratio[order]

    def find(self, hashes: np.ndarray, otherwise) -> np.ndarray:
        if not len(self.keys):
            return np.broadcast_to(otherwise, hashes.shape)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, self.ratio[at], otherwise)


class KneserNey:
    """Both classes' models for one threshold, as the log-likelihood ratios of what it trusts.

    ``pairs`` (before, word, toxic, docs, ctx_toxic, ctx_other: the sums of their first word), ``words`` (word, stem, toxic, docs,
    k_toxic, k_other: continuation counts) and ``stems`` (stem, toxic, docs, k_toxic, k_other, m: its words' continuation
    counts) need only have what some threshold trusts, the words of such pairs, and the stems of these words. ``totals`` are
    the classes' sums of continuation counts, and ``n_stems`` counts all stems.
    """

    def __init__(self, pairs: pd.DataFrame, words: pd.DataFrame, stems: pd.DataFrame, totals: tuple[float, float], n_stems: int, share: float, threshold: float):
        trusts = lambda t: _deviation(t["toxic"].to_numpy(float), t["docs"].to_numpy(float), share) >= threshold
        less = lambda n, sure: np.where(sure, np.maximum(n - DISCOUNT, 0.0), 0.0)
        sure_w, sure_s, sure_p = trusts(words), trusts(stems), trusts(pairs)
        at_stem = np.searchsorted(stems["stem"].to_numpy(), words["stem"].to_numpy())
        kept_w, rest_w, kept_s, rest_s, l1, l2, taken = [], [], [], [], [], [], []
        for name, total in zip(("k_toxic", "k_other"), totals, strict=True):
            k = words[name].to_numpy(float)
            kept_w.append(less(k, sure_w))
            rest_w.append(k - kept_w[-1])
            l1.append(1 - kept_w[-1].sum() / total)
            g = stems[name].to_numpy(float) - np.bincount(at_stem, weights=kept_w[-1], minlength=len(stems))
            kept_s.append(less(g, sure_s))
            rest_s.append(g - kept_s[-1])
            taken.append(total - kept_w[-1].sum())
            l2.append(1 - kept_s[-1].sum() / taken[-1])
        left = sum(n * x for n, x in zip(taken, l2, strict=True))  # of all stems together
        unseen = DISCOUNT * n_stems / left / (n_stems + 1)  # the share of one stem, and of all that were never seen
        shared = np.maximum(rest_s[0] + rest_s[1] - DISCOUNT, 0.0) / left + unseen
        p_stem = [kept / n + x * shared for kept, n, x in zip(kept_s, taken, l2, strict=True)]
        held = sum(np.bincount(at_stem, weights=k, minlength=len(stems)) for k in kept_w)
        inside = (rest_w[0] + rest_w[1]) / (stems["k_toxic"] + stems["k_other"] - held + 1.0).to_numpy()[at_stem]
        p_word = [kept / n + x * p[at_stem] * inside for kept, n, x, p in zip(kept_w, totals, l1, p_stem, strict=True)]
        self.otherwise = float(np.log(l1[0] * l2[0] / (l1[1] * l2[1])))
        unsigned = lambda t, name: t[name].to_numpy(np.int64).view(np.uint64)
        ratio_s = np.log(l1[0] * p_stem[0] / (l1[1] * p_stem[1]))
        self.stems = Level(unsigned(stems, "stem")[sure_s], ratio_s[sure_s])
        self.words = Level(unsigned(words, "word")[sure_w], np.log(p_word[0][sure_w] / p_word[1][sure_w]))
        pairs = pairs[sure_p]
        at_word = np.searchsorted(words["word"].to_numpy(), pairs["word"].to_numpy())
        before, first, context = np.unique(unsigned(pairs, "before"), return_index=True, return_inverse=True)
        p_pair, given = [], []
        for name, count, p in zip(("ctx_toxic", "ctx_other"), (pairs["toxic"], pairs["docs"] - pairs["toxic"]), p_word, strict=True):
            total = pairs[name].to_numpy(float)
            kept = np.maximum(count.to_numpy(float) - DISCOUNT, 0.0) / np.maximum(total, 1.0)
            given.append(1 - np.bincount(context, weights=kept, minlength=len(before)))  # 1 where the class has no such context
            p_pair.append(kept + given[-1][context] * p[at_word])
        self.contexts = Level(before, np.log(given[0] / given[1]))
        self.pairs = Level(mix(unsigned(pairs, "before") * np.uint64(3) + unsigned(pairs, "word")), np.log(p_pair[0] / p_pair[1]))

    def features(self, found: Expressions) -> np.ndarray:
        """Difference of each text's log-likelihoods over its length and over the length's square root."""
        lower = self.words.find(found.word, self.stems.find(found.stem, self.otherwise))
        token = self.pairs.find(found.pair, lower + self.contexts.find(found.before, 0.0))
        total = np.concatenate(([0.0], np.cumsum(token)))
        n = np.maximum(np.diff(found.off), 1)
        gap = np.round(total[found.off[1:]] - total[found.off[:-1]], 9)
        return np.column_stack((gap / n, gap / np.sqrt(n)))


class ToxicityModel:
    """The models of all thresholds, the one that calibration chose, and its logistic weights."""

    def __init__(self, models: list[KneserNey], prior: float):
        self.models, self.chosen, self.weights, self.prior = models, 0, None, prior

    def calibrate(self, candidates: list[np.ndarray], toxic: np.ndarray) -> None:
        """Chooses the threshold with the least loss and fits the logistic weights, by Newton's method."""
        if len(set(toxic)) < 2:
            return
        best = np.inf
        for i, x in enumerate(candidates):
            scale = np.maximum(x.std(axis=0), 1e-9)
            z = np.column_stack((np.ones(len(x)), x / scale))
            w, ridge = np.zeros(z.shape[1]), np.diag([1e-9, 0.05, 0.05])
            for _ in range(50):
                p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
                step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge, z.T @ (toxic - p) - ridge @ w)
                w = w + step
                if np.abs(step).max() < 1e-8:
                    break
            p = np.clip(1 / (1 + np.exp(-np.clip(z @ w, -30, 30))), 1e-12, 1 - 1e-12)
            loss = -np.mean(toxic * np.log(p) + (1 - toxic) * np.log(1 - p))
            if loss < best - 1e-6:
                best, self.chosen = loss, i
                self.weights = np.concatenate((w[:1], w[1:] / scale))
        self.models = [m if i == self.chosen else None for i, m in enumerate(self.models)]

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.prior)
        x = self.models[self.chosen].features(Expressions(texts))
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -500, 500)))


def count_tables(rows: DataFrame, share: float) -> tuple[pd.DataFrame, pd.DataFrame, pd.DataFrame, tuple[float, float], int]:
    """pairs, words, stems, totals and n_stems of KneserNey from (text, toxic), counted in Spark."""
    counted = rows.select("text", "toxic").mapInArrow(_count, _COUNTS).groupBy("level", "before", "expression", "stem")
    counted = cut(counted.agg(F.sum("toxic").alias("toxic"), F.sum("docs").alias("docs")))
    least = F.lit(min(THRESHOLDS))
    sure = _deviation(F.col("toxic"), F.col("docs"), share) >= least
    pairs = counted.where("level = 0").withColumnRenamed("expression", "word")
    ctx = pairs.groupBy("before").agg(F.sum("toxic").alias("ctx_toxic"), F.sum(F.col("docs") - F.col("toxic")).alias("ctx_other"), F.max(sure).alias("any"))
    told = pairs.where(sure).select("before", "word", "toxic", "docs")
    told = cut(told.join(ctx.where("any").drop("any"), "before").select("before", "word", "toxic", "docs", "ctx_toxic", "ctx_other"))
    after = pairs.groupBy("word", "stem").agg(F.count_if(F.col("toxic") > 0).alias("k_toxic"), F.count_if(F.col("docs") > F.col("toxic")).alias("k_other"))
    own = counted.where("level = 1").select(F.col("expression").alias("word"), "toxic", "docs")
    words = after.join(own, "word").join(told.select("word").distinct().withColumn("needed", F.lit(True)), "word", "left")
    words = cut(words.where(sure | F.col("needed")).select("word", "stem", "toxic", "docs", "k_toxic", "k_other"))
    by_stem = after.groupBy("stem").agg(F.sum("k_toxic").alias("k_toxic"), F.sum("k_other").alias("k_other"))
    own = counted.where("level = 2").select("stem", "toxic", "docs")
    stems = cut(by_stem.join(own, "stem").join(words.select("stem").distinct().withColumn("needed", F.lit(True)), "stem", "left"))
    totals = stems.agg(F.sum("k_toxic"), F.sum("k_other"), F.count(F.lit(1))).first()
    stems = stems.where(sure | F.col("needed")).drop("needed").toPandas()
    sort = lambda t, *by: t.sort_values(list(by), ignore_index=True)
    return sort(told.toPandas(), "before", "word"), sort(words.toPandas(), "word"), sort(stems, "stem"), (float(totals[0]), float(totals[1])), totals[2]


def fit_toxicity(labelled: DataFrame, max_docs: int = 20_000) -> ToxicityModel:
    """Fits from (key, text, toxic): at most about ``max_docs`` documents, those whose hashed keys are least.

    Three quarters estimate the counts, one quarter the calibration. Without both labels among the counted the model gives
    the share of toxic labels, or 0 without any.
    """
    place = F.pmod(F.xxhash64("key", F.lit(7)), F.lit(1 << 30))
    rows = labelled.where("toxic IS NOT NULL").select("key", "text", F.col("toxic").cast("int").alias("toxic"), place.alias("place"))
    n, bad = rows.select(F.count(F.lit(1)), F.sum("toxic")).first()
    if not n or not bad or bad == n:
        return ToxicityModel([], (bad or 0) / n if n else 0.0)
    rows = rows.where(F.col("place") <= int((1 << 30) * min(1.0, max_docs / n)))
    fold = F.pmod(F.col("place"), F.lit(4))
    share = bad / n
    tables = count_tables(rows.where(fold != 0), share)
    if not all(tables[3]):  # a class without words has no model
        return ToxicityModel([], share)
    model = ToxicityModel([KneserNey(*tables, share, z) for z in THRESHOLDS], share)
    tests = rows.where(fold == 0).select("text", "toxic")
    sent = labelled.sparkSession.sparkContext.broadcast(model)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = Expressions(_texts(part.column(0)))
                x = np.concatenate([m.features(found) for m in sent.value.models], axis=1)
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(list(x), type=pa.list_(pa.float64()))], names=["toxic", "x"])

    found = tests.mapInArrow(features, "toxic int, x array<double>").toPandas()  # at most a quarter of max_docs rows
    if len(found):
        x = np.array(found["x"].tolist())
        order = np.lexsort(x.T)
        x, y = x[order], found["toxic"].to_numpy(float)[order]
        model.calibrate([x[:, 2 * i : 2 * i + 2] for i in range(len(THRESHOLDS))], y)
    return model


def labelled_documents(docs: DataFrame, labels: DataFrame, max_docs: int = 20_000) -> DataFrame:
    """(key, text, toxic) of labelled documents outside the held-out third (remainder 1 of 3).

    Of many labels, only about the ``max_docs`` with the least hashes are looked up, so the broadcast side is
    bounded. A document with several labels counts as toxic if any says so.
    """
    ids = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (id_remainder("doc_id", 3) != 1))
    ids = ids.groupBy("doc_id").agg(F.max("toxic").alias("its_toxic")).withColumnRenamed("doc_id", "its_id")
    n = ids.count()
    if n > max_docs:
        ids = ids.where(F.pmod(F.xxhash64("its_id", F.lit(11)), F.lit(1 << 30)) <= int((1 << 30) * max_docs / n))
    found = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("its_id"))
    return found.select(F.col("doc_id").alias("key"), "text", F.col("its_toxic").alias("toxic"))


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, max_docs: int = 20_000) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text.

    A null or empty text has no expressions and gets the calibrated score of no evidence. Repeated rows are scored
    alike, null ids count as held in. Without usable labels all scores equal the share of toxic labels. An
    empty table gives no rows. Only doc_id and text are read, so other columns cannot clash.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit_toxicity(labelled_documents(docs, labels, max_docs), max_docs))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                s = model.value.score(_texts(part.column(2)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                    names=["doc_id", "held_out", "score", "predicted"],
                )

    rows = docs.select("doc_id", (id_remainder("doc_id", 3) == 1).alias("held_out"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(score, f"doc_id {kind}, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, max_docs: int = 20_000) -> DataFrame:
    """The rows of documents whose score stays below the threshold, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(fit_toxicity(labelled_documents(docs, labels, max_docs), max_docs))
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                yield part.filter(pa.array(model.value.score(_texts(part.column(at))) < threshold))
        release_memory()

    return docs.mapInArrow(keep, T.StructType(docs.schema.fields))
