"""Operator 1: toxicity by a classifier chain.

CHAIN names the categories in order. Each is a logistic regression over the words of a
document (present or not) and the probabilities of the categories before it. In
training those earlier probabilities are out of fold: the labelled rows are dealt
into folds by a hash of the id, a category's model is fitted on all folds but one, and
predicts that one, so a later model never sees a probability that an earlier
model gave to its own training row. Scoring runs the models fitted on all
rows, in order.

Words are chosen from counts over all labelled rows (a distributed aggregation): all those that
are in excess in some category by a likelihood ratio of LEAST_RATIO. The models are fitted on
at most MAX_ROWS labelled rows, the first by hash of their id; that bound
is a parameter and all else covers all data. A word that no fitted row has would get no weight, so only the
fitted rows' words are sent to the driver, which bounds them by the rows' bound and not by the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, slices, split_words, table, two

#: Label column and the value that counts as positive, in chain order.
CHAIN = (("low_quality", "quality", 0), ("toxic", "toxic", 1))
FOLDS, MAX_ROWS, LEAST_RATIO = 5, 20_000, 6.0
#: Labels that are sent to all workers (20 bytes each: under 16 MB); beyond that the join shuffles.
BROADCAST_ROWS = 500_000


def _words_of(texts: pa.Array) -> list[np.ndarray]:
    """Distinct words of each text."""
    words, at = split_words(texts, ALNUM)
    coded = words.dictionary_encode()
    names, index = np.array(coded.dictionary.to_pylist(), object), np.asarray(coded.indices)
    return [names[np.unique(index[s:e])] for s, e in zip(at[:-1], at[1:], strict=True)]


def _counts(labels: int):
    """Rows that hold a word, in all and of each category, summed over a slice."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                words, at = split_words(part.column("text"), ALNUM)
                coded = words.dictionary_encode()
                n = len(coded.dictionary)
                row = np.repeat(np.arange(len(at) - 1), np.diff(at))
                pair = np.unique(row * max(n, 1) + np.asarray(coded.indices, np.int64))
                row, word = pair // max(n, 1), pair % max(n, 1)
                y = [np.asarray(part.column(f"y{i}"), np.int64)[row] for i in range(labels)]
                sums = [np.bincount(word, minlength=n), *(np.bincount(word[v > 0], minlength=n) for v in y)]
                yield pa.RecordBatch.from_arrays([coded.dictionary, *(pa.array(v.astype(np.int64)) for v in sums)], ["word", "n", *(f"y{i}" for i in range(labels))])

    return run


@dataclass
class Logistic:
    """A binary linear model over sparse presence features and dense extras."""

    word: np.ndarray
    extra: np.ndarray
    bias: float

    def predict(self, rows: list[np.ndarray], extra: np.ndarray) -> np.ndarray:
        z = np.array([self.word[r].sum() for r in rows]) + extra @ self.extra + self.bias if len(rows) else np.empty(0)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: list[np.ndarray], extra: np.ndarray, y: np.ndarray, width: int, epochs: int = 150, rate: float = 0.3, l2: float = 1e-4) -> Logistic:
    """Full-batch AdaGrad on the class-balanced logistic loss; deterministic."""
    n, n_extra = len(rows), extra.shape[1]
    model = Logistic(np.zeros(width), np.zeros(n_extra), 0.0)
    if n == 0:
        return model
    if not 0 < y.sum() < n:
        model.bias = 4.0 if y.sum() else -4.0
        return model
    flat, row = np.concatenate(rows), np.repeat(np.arange(n), [len(r) for r in rows])
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (n - y.sum()))
    gw, ge, gb = np.full(width, 1e-8), np.full(n_extra, 1e-8), 1e-8
    for _ in range(epochs):
        z = np.bincount(row, model.word[flat], minlength=n) + extra @ model.extra + model.bias
        d = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        dw = np.bincount(flat, d[row], minlength=width) + l2 * model.word / n
        de, db = extra.T @ d, d.sum()
        gw += dw * dw
        ge += de * de
        gb += db * db
        model.word -= rate * dw / np.sqrt(gw)
        model.extra -= rate * de / np.sqrt(ge)
        model.bias -= rate * db / np.sqrt(gb)
    return model


@dataclass
class Chain:
    names: list[str]
    words: dict[str, int]
    models: list[Logistic]
    cuts: list[float]

    def predict(self, rows: list[np.ndarray]) -> np.ndarray:
        out = np.empty((len(rows), 0))
        for m in self.models:
            out = np.column_stack((out, m.predict(rows, out)))
        return out

    def index(self, words: np.ndarray) -> np.ndarray:
        return np.array(sorted(i for w in words if (i := self.words.get(w)) is not None), np.int64)


def out_of_fold(rows: list[np.ndarray], extra: np.ndarray, y: np.ndarray, fold: np.ndarray, width: int, folds: int) -> np.ndarray:
    """The probability of each row by the model of the rows of the other folds."""
    p = np.zeros(len(rows))
    for k in range(folds):
        out = fold == k
        if out.any():
            m = fit([r for r, o in zip(rows, out, strict=True) if not o], extra[~out], y[~out], width)
            p[out] = m.predict([r for r, o in zip(rows, out, strict=True) if o], extra[out])
    return p


def best_cut(p: np.ndarray, y: np.ndarray) -> float:
    """Between the probabilities at which F1 is best, 0.2 at least; of equal F1 the highest probability."""
    if not len(p):
        return 1.0
    order = np.argsort(-p, kind="stable")
    f1 = 2 * np.cumsum(y[order]) / (np.arange(1, len(y) + 1) + max(y.sum(), 1))
    best = int(np.argmax(f1))
    return max(0.2, float((p[order[best]] + (p[order[best + 1]] if best + 1 < len(p) else 0.0)) / 2))


def train_chain(rows: list[np.ndarray], fold: np.ndarray, labels: np.ndarray, names: list[str], words: dict[str, int], folds: int = FOLDS) -> Chain:
    """Models of a chain, later ones trained on out-of-fold predictions of earlier ones.
    A category's cut is the out-of-fold probability of the best F1."""
    oof, models, cuts = np.empty((len(rows), 0)), [], []
    for c in range(len(names)):
        y = labels[:, c].astype(float)
        p = out_of_fold(rows, oof, y, fold, len(words), folds)
        models.append(fit(rows, oof, y, len(words)))
        cuts.append(best_cut(p, y))
        oof = np.column_stack((oof, p))
    return Chain(list(names), words, models, cuts)


def fold_of(ids, folds: int) -> np.ndarray:
    """Folds of ids by a hash, so equal ids share one."""
    return np.array([((int(i) * 2654435761) >> 7 & 0xFFFF) % folds for i in ids], np.int64)


def _listed(batches):
    """Distinct words of a slice's texts."""
    for batch in batches:
        for part in slices(batch):
            words, _ = split_words(part.column("text"), ALNUM)
            yield pa.RecordBatch.from_arrays([words.unique()], ["word"])


def fit_chain(docs: DataFrame, labels: DataFrame, chain=CHAIN, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS, least_ratio: float = LEAST_RATIO, folds: int = FOLDS) -> Chain:
    """Train on labelled documents. Rows with a null in some label are not used; of
    several labels of one id the greatest counts; document rows that repeat an id are each used, in one fold, and are all
    taken into the sample or none. Without labelled rows nothing is ever positive."""
    names = [n for n, _, _ in chain]
    gold = labels.select(labels[id_col].cast("long").alias("id"), *[(labels[c] == v).cast("int").alias(f"y{i}") for i, (_, c, v) in enumerate(chain)]).dropna()
    gold = gold.groupBy("id").agg(*[F.max(f"y{i}").alias(f"y{i}") for i in range(len(chain))])
    n_gold = gold.count()
    gold = F.broadcast(gold) if n_gold <= BROADCAST_ROWS else gold
    labelled = two(docs, id_col, text_col).join(gold, "id").select("id", *[f"y{i}" for i in range(len(chain))], "text")
    sums = [F.sum(f"y{i}").alias(f"p{i}") for i in range(len(chain))]
    totals = labelled.agg(F.count("*").alias("n"), *sums).first()
    n = totals["n"] or 0
    if not n:
        return Chain(names, {}, [Logistic(np.zeros(0), np.zeros(i), -4.0) for i in range(len(chain))], [0.5] * len(chain))
    counted = labelled.mapInArrow(_counts(len(chain)), "word string, n long" + "".join(f", y{i} long" for i in range(len(chain))))
    ratio = F.lit(0.0)
    for i in range(len(chain)):
        # the likelihood ratio of the word's rows, where it is more common than elsewhere
        o, e = F.col(f"p{i}") + 0.5, F.col("n") * ((totals[f"p{i}"] + 0.5) / (n + 1.0)) + 0.5
        ratio = F.greatest(ratio, F.when(o > e, o * F.log(o / e)).otherwise(0.0))
    told = counted.groupBy("word").agg(F.sum("n").alias("n"), *sums).where(ratio >= least_ratio).select("word")
    sample = labelled.join(F.broadcast(gold.select("id").orderBy(F.xxhash64("id"), "id").limit(max_rows)), "id", "left_semi")
    seen = sample.select("text").mapInArrow(_listed, "word string").distinct()
    words = {r.word: i for i, r in enumerate(told.join(seen, "word", "left_semi").orderBy("word").collect())}

    def indexed(batches):
        for batch in batches:
            for part in slices(batch):
                lists = [sorted(i for w in x if (i := words.get(w)) is not None) for x in _words_of(part.column("text"))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in range(part.num_columns - 1)), pa.array(lists, pa.list_(pa.int32()))], [*part.schema.names[:-1], "at"])

    got = sample.mapInArrow(indexed, "id long, " + "".join(f"y{i} int, " for i in range(len(chain))) + "at array<int>").toPandas()
    got = got.iloc[sorted(range(len(got)), key=lambda i: (got["id"][i], list(got["at"][i])))]
    rows = [np.array(x, np.int64) for x in got["at"]]
    y = got[[f"y{i}" for i in range(len(chain))]].to_numpy(np.int64).reshape(len(rows), len(chain))
    return train_chain(rows, fold_of(got["id"], folds), y, names, words, folds)


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, p_<category>..., <category>...) of each row. A null or empty text has no
    words and gets each model's prior; repeated rows and null ids each get their row;
    an empty table gives no rows. Whole texts are read, however long."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                p = chain.predict([chain.index(w) for w in _words_of(part.column("text"))])
                yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array(p[:, i].copy()) for i in range(p.shape[1])), *(pa.array(p[:, i] >= chain.cuts[i]) for i in range(p.shape[1]))], ["id", *(f"p_{n}" for n in chain.names), *chain.names])

    return two(docs, id_col, text_col).mapInArrow(run, "id long, " + ", ".join(f"p_{n} double" for n in chain.names) + ", " + ", ".join(f"{n} boolean" for n in chain.names))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities and verdicts of the chain that the labels table allows: low quality, then toxic."""
    docs = table(spark, sf_dir, "documents")
    chain = fit_chain(docs, table(spark, sf_dir, "labels"))
    return score(docs, chain).withColumnRenamed("id", "doc_id")
