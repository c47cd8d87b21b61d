"""Toxicity by class-conditional Kneser-Ney models of words.

A word backs off to its first six bytes and these to its first four, by Kneser-Ney: a stem counts
the different words (or longer stems) that a class has under it. Both classes share the last step:
how the words of a stem and the stems themselves are spread comes from counts over all documents, so
a rare expression is judged by the family it belongs to and not by the class that happened to show
it. A text is compared by the log-likelihood ratio per word, over the whole text and over its most
telling words; a logistic curve fitted on labelled texts that the models have not seen turns these
into a score.

The models learn from a bounded sample of labelled rows (``most_toxic`` and ``most_ordinary`` rows)
and are broadcast: at most ``most_words`` words and their stems.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shelfmark.llm import words as W
from shelfmark.session import settle

STEMS = (6, 4)
COLUMNS = ["key", "six", "four"]


def _keys(data: bytes, starts: np.ndarray, ends: np.ndarray, whole: np.ndarray) -> list[np.ndarray]:
    """Hashes of the words and of their stems."""
    return [whole, *(W.hashes(data, starts, np.minimum(ends, starts + n), W.LETTERS) for n in STEMS)]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def class_words(sample: DataFrame) -> DataFrame:
    """(key, six, four, toxic, ordinary): each word of the sample with its counts by class."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.small(batches):
            label = np.array(batch["toxic"].to_pylist(), bool)
            for first, end, data, starts, ends, words, cut in W.worded(W.as_bytes(batch["text"]), W.LETTERS):
                if not len(words):
                    continue
                toxic = np.repeat(label[first:end], np.diff(cut))
                key, six, four = _keys(data, starts, ends, words)
                _, at, which = np.unique(key, return_index=True, return_inverse=True)
                n_toxic = np.bincount(which, weights=toxic).astype(np.int64)
                n_all = np.bincount(which)
                yield pa.record_batch({"key": _signed(key[at]), "six": _signed(six[at]), "four": _signed(four[at]), "toxic": pa.array(n_toxic, pa.int64()), "ordinary": pa.array(n_all - n_toxic, pa.int64())})

    found = sample.select("text", "toxic").mapInArrow(W.tidied(tally), "key long, six long, four long, toxic long, ordinary long")
    return found.groupBy("key").agg(F.min("six").alias("six"), F.min("four").alias("four"), F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def corpus_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(level, key, n): how often each word (level 0) and stem (1, 2) occurs in all documents."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], [], []]
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for level, parts in enumerate(held):
                key, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.record_batch({"level": pa.array(np.full(len(key), level), pa.int32()), "key": _signed(key), "n": pa.array(n, pa.int64())})
                parts.clear()

        for batch in W.small(batches):
            for _, _, data, starts, ends, words, _ in W.worded(W.as_bytes(batch["text"]), W.LETTERS):
                for parts, key in zip(held, _keys(data, starts, ends, words)):
                    parts.append(key)
                size += len(words)
                if size > 1_000_000:
                    yield from flush()
                    size = 0
        if held[0]:
            yield from flush()

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(W.tidied(tally), "level int, key long, n long")
    return rows.groupBy("level", "key").agg(F.sum("n").alias("n"))


class Ratios:
    """Log-likelihood ratios of known words, of known stems for other words, and of anything else."""

    def __init__(self, tables: list[tuple[np.ndarray, np.ndarray]], default: float):
        self.tables = []
        for keys, values in tables:
            order = np.argsort(keys)
            self.tables.append((keys[order], values[order].astype(np.float32)))
        self.default = default

    def of(self, data: bytes, starts: np.ndarray, ends: np.ndarray, words: np.ndarray) -> np.ndarray:
        _, at, which = np.unique(words, return_index=True, return_inverse=True)
        out = np.full(len(at), self.default, np.float32)
        left = np.arange(len(at))
        starts, ends = starts[at], ends[at]
        for level, (keys, values) in enumerate(self.tables):
            if not len(keys) or not len(left):
                continue
            if level == 0:
                own = words[at]
            else:
                order = left = left[np.argsort(starts[left])]  # stems of the words that no table has had so far
                own = W.hashes(data, starts[order], np.minimum(ends[order], starts[order] + STEMS[level - 1]), W.LETTERS)
            place = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            hit = keys[place] == own
            out[left[hit]] = values[place[hit]]
            left = left[~hit]
        return out[which]


def fit_ratios(found: DataFrame, counts: DataFrame, most_words: int) -> Ratios:
    """Kneser-Ney ratios from the class counts of words and the counts over all documents."""
    total = found.agg(*[F.sum(F.when(F.col(c) >= 1, 1).otherwise(0)) for c in ("toxic", "ordinary")], *[F.sum(c) for c in ("toxic", "ordinary")],
                      *[F.sum(F.when(F.col(c) == n, 1).otherwise(0)) for n in (1, 2) for c in ("toxic", "ordinary")]).first()
    kinds, tokens, ones, twos = [np.array([float(x or 0) for x in total[i : i + 2]]) for i in (0, 2, 4, 6)]
    if tokens.min() == 0:
        return Ratios([], 0.0)
    discount = np.clip(ones / np.maximum(ones + 2 * twos, 1), 0.1, 0.9)

    def share(name: str):  # different continuations per class
        return [F.count(F.when(F.col(c) > 0, 1)).alias(c) for c in ("toxic", "ordinary")]

    six = found.groupBy("six").agg(F.min("four").alias("four"), *share("six"))
    four = six.groupBy("four").agg(*share("four"))
    some = found.where(F.col("toxic") + F.col("ordinary") > 1).orderBy((F.col("toxic") + F.col("ordinary")).desc(), "key").limit(most_words)
    stems = six.where(F.col("toxic") + F.col("ordinary") > 1).orderBy((F.col("toxic") + F.col("ordinary")).desc(), "six").limit(most_words)
    roots = four.orderBy((F.col("toxic") + F.col("ordinary")).desc(), "four").limit(most_words)
    known = settle(some.select(F.lit(0).alias("level"), "key", "six", "four", "toxic", "ordinary")
                   .unionByName(stems.select(F.lit(1).alias("level"), F.col("six").alias("key"), "six", "four", "toxic", "ordinary"))
                   .unionByName(roots.select(F.lit(2).alias("level"), F.col("four").alias("key"), F.col("four").alias("six"), "four", "toxic", "ordinary")), "known")
    asked = (known.select("level", "key").unionByName(known.where("level = 0").select(F.lit(1).alias("level"), F.col("six").alias("key")))
             .unionByName(known.select(F.lit(2).alias("level"), F.col("four").alias("key"))).distinct())
    # at most three times most_words rows, and their stems
    shared, levels = counts.join(asked, ["level", "key"]).toPandas(), known.toPandas()
    everywhere = max(1.0, float(counts.where("level = 2").agg(F.sum("n")).first()[0] or 1))
    n_six = np.array([float(x) for x in six.agg(*[F.count(F.when(F.col(c) > 0, 1)) for c in ("toxic", "ordinary")]).first()])
    n_four = np.array([float(x) for x in four.agg(*[F.count(F.when(F.col(c) > 0, 1)) for c in ("toxic", "ordinary")]).first()])
    by = [levels[levels["level"] == lv] for lv in range(3)]

    back_word = discount * kinds / tokens  # mass left to the stems of six
    back_six = discount * n_six / np.maximum(kinds, 1)
    back_four = discount * n_four / np.maximum(n_six, 1)

    def looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, otherwise: np.ndarray) -> np.ndarray:
        if not len(keys):
            return otherwise
        order = np.argsort(keys)
        at = order[np.minimum(np.searchsorted(keys, wanted, sorter=order), len(keys) - 1)]
        hit = keys[at] == wanted
        return np.where(hit if values.ndim == 1 else hit[:, None], values[at], otherwise)

    def shared_of(level: int, keys: np.ndarray) -> np.ndarray:
        own = shared[shared["level"] == level]
        return looked_up(own["key"].to_numpy(), own["n"].to_numpy(float), keys, np.ones(len(keys)))

    def seen(part, total: np.ndarray) -> np.ndarray:
        return np.maximum(part[["toxic", "ordinary"]].to_numpy(float) - discount, 0) / total

    p_four = seen(by[2], np.maximum(n_six, 1)) + back_four * (shared_of(2, by[2]["key"].to_numpy()) / everywhere)[:, None]

    def four_of(keys: np.ndarray) -> np.ndarray:
        return looked_up(by[2]["key"].to_numpy(), p_four, keys, back_four * (shared_of(2, keys) / everywhere)[:, None])

    def under_four(sixes: np.ndarray, fours: np.ndarray) -> np.ndarray:
        c_six, c_four = shared_of(1, sixes), shared_of(2, fours)
        return back_six * four_of(fours) * (c_six / np.maximum(c_four, c_six))[:, None]

    p_six = seen(by[1], np.maximum(kinds, 1)) + under_four(by[1]["key"].to_numpy(), by[1]["four"].to_numpy())
    words = by[0]
    sixes = words["six"].to_numpy()
    c_word, c_six = shared_of(0, words["key"].to_numpy()), shared_of(1, sixes)
    under = looked_up(by[1]["key"].to_numpy(), p_six, sixes, under_four(sixes, words["four"].to_numpy()))
    p_word = seen(words, tokens) + back_word * under * (c_word / np.maximum(c_six, c_word))[:, None]

    def ratio(p: np.ndarray) -> np.ndarray:
        return np.log(p[:, 0] + 1e-300) - np.log(p[:, 1] + 1e-300)

    step = [float(np.log(b[0]) - np.log(b[1])) for b in (back_word, back_six, back_four)]
    tables = [(words["key"].to_numpy(np.int64).view(np.uint64), ratio(p_word)), (by[1]["key"].to_numpy(np.int64).view(np.uint64), ratio(p_six) + step[0]), (by[2]["key"].to_numpy(np.int64).view(np.uint64), ratio(p_four) + step[0] + step[1])]
    return Ratios(tables, sum(step))


N_FEATURES = 6


def features(ratios: np.ndarray) -> np.ndarray:
    """Length-normalised comparisons: per word, per root of the number of words, and per word among the 1, 2 and 4 most telling."""
    n = len(ratios)
    if not n:
        return np.zeros(N_FEATURES)
    top = np.sort(ratios)[::-1][:4] if n <= 64 else np.sort(np.partition(ratios, n - 4)[n - 4 :])[::-1]
    return np.array([ratios.mean(), ratios.sum() / np.sqrt(n), top[0], top[:2].sum() / 2, top.sum() / 4, np.log1p(n)])


def _features_of(texts: list[bytes | None], ratios: Ratios) -> np.ndarray:
    out = np.zeros((len(texts), N_FEATURES))
    for first, end, data, starts, ends, words, cut in W.worded(texts, W.LETTERS):
        if len(words):
            found = ratios.of(data, starts, ends, words)
            for i in range(end - first):
                out[first + i] = features(found[cut[i] : cut[i + 1]])
    return out


class Curve:
    """A logistic regression on standardised features, fitted by Newton steps with a small ridge."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.mean, self.spread = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = np.column_stack([np.ones(len(x)), (x - self.mean) / self.spread])
        self.weight = np.zeros(z.shape[1])
        ridge = np.diag([1e-6] + [1.0] * x.shape[1])
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(z @ self.weight, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ self.weight)
            size = np.abs(step).max()
            self.weight += step * min(1.0, 3.0 / max(size, 1e-9))
            if size < 1e-6:
                break

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.column_stack([np.ones(len(x)), (x - self.mean) / self.spread])
        return 1 / (1 + np.exp(-np.clip(z @ self.weight, -30, 30)))


class Flat:
    """The same score for every text."""

    def __init__(self, share: float):
        self.share = share

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.share)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.7, most_toxic: int = 10_000, most_ordinary: int = 20_000, most_words: int = 150_000) -> DataFrame:
    """All columns of ``docs`` with held_out, score (0 to 1) and predicted (1 from ``threshold`` on).

    Only labels of rows whose crc32 of the id as text, modulo 3, is not 1 are learnt from; held_out
    marks the others. Labels without an id or a value are ignored; of several labels of an id the
    larger counts. Two thirds of the sample teach the models, one third the curve. Without labels of
    both classes on both sides the score is the share of toxic labels, one added to each class. Null
    and empty texts have no words and get the curve's value there. Ids may repeat or be null (not
    held out). Columns of ``docs`` with one of the three names are replaced.
    """
    spark = docs.sparkSession
    remainder = F.crc32(F.col(id_col).cast("string")) % 3
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (remainder != 1)).groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) > 0).alias("toxic"))
    usable = usable.withColumn("turn", F.xxhash64(F.col("id").cast("string"), F.lit(9)))
    picked = settle(usable.where("toxic").orderBy("turn", "id").limit(most_toxic).unionByName(usable.where("not toxic").orderBy("turn", "id").limit(most_ordinary)), "picked")
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # at most most_toxic + most_ordinary ids
    sample = settle(slim.join(F.broadcast(picked), "id").withColumn("teaches", F.pmod(F.col("turn"), F.lit(3)) > 0), "sample")
    found = settle(class_words(sample.where("teaches")), "words")
    counts = settle(corpus_counts(docs, text_col), "counts")
    ratios = fit_ratios(found, counts, most_words)
    shared = spark.sparkContext.broadcast(ratios)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.small(batches):
            made = _features_of(W.as_bytes(batch["text"]), shared.value)
            yield pa.RecordBatch.from_arrays([batch["toxic"], pa.array(list(made), pa.list_(pa.float64()))], names=["toxic", "x"])

    rows = sample.where("not teaches").select("toxic", "text").mapInArrow(W.tidied(measure), "toxic boolean, x array<double>").toPandas()
    y = rows["toxic"].to_numpy(float) if len(rows) else np.empty(0)
    if ratios.tables and len(y) and 0 < y.sum() < len(y):
        curve = Curve(np.array(rows["x"].tolist()), y)
    else:
        n = picked.agg(F.count("*"), F.coalesce(F.sum(F.col("toxic").cast("int")), F.lit(0))).first()
        share = (n[1] + 1) / (n[0] + 2)
        curve = Flat(share)
    curved = spark.sparkContext.broadcast(curve)
    columns = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.small(batches):
            value = curved.value(_features_of(W.as_bytes(batch[text_col]), shared.value))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in columns), pa.array(value, pa.float64())], names=[*columns, "score"])

    from pyspark.sql import types as T

    kept = docs.select(*columns)
    scored = kept.mapInArrow(W.tidied(score), T.StructType([*(T.StructField(f.name, f.dataType) for f in kept.schema), T.StructField("score", T.DoubleType())]))
    return scored.withColumn("held_out", F.coalesce(remainder == 1, F.lit(False))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
