"""Toxicity by a counterfactual-regularised classifier.

A logistic model over words and word beginnings. Each labelled training text that names a group of people has a twin in
which the name is swapped for another of its kind; beside the usual loss, training pays for the squared change of the
score between a text and its twin. Weight that the labels put on the mere mention of a group is paid for again and again
and goes; weight on abuse, which twins keep, stays.

Training uses a bounded sample of labelled rows (TRAIN_ROWS). Scoring reads whole texts in one pass without a shuffle.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.llm.common import ASCII_LOWER, Stage, by_value, drop_rows, row_key, slices, span_hashes, text_buffer, token_spans, trimmed
from siteloom.llm.decontaminate import word_table

by_value(__name__)

#: Labelled rows to learn from (those of the least hash of their id), and features of the model.
TRAIN_ROWS, FEATURES = 20_000, 4_096
#: Bytes of word beginnings that are features beside the whole word.
BEGINNINGS = (4, 5, 6, 7, 8)
#: How many times a feature has to occur in a text to count as its second, third, ... feature.
TIMES = (1, 2, 4)

#: Bytes of text that a worker turns to features at a time.
SLICE_BYTES = 1 << 20

#: Words that name groups of people, each line one kind; a swap takes the next of its line.
IDENTITY_TERMS = """
muslim christian jewish hindu buddhist atheist catholic protestant
muslims christians jews hindus buddhists atheists catholics protestants
gay lesbian straight bisexual transgender heterosexual
black white asian latino african european
blacks whites asians latinos africans europeans
women men
woman man
girls boys
girl boy
female male
mother father
wife husband
old young
immigrants citizens refugees natives
immigrant citizen refugee native
disabled blind deaf
french german spanish english polish turkish chinese indian russian american
"""


def _swaps() -> dict[str, str]:
    out = {}
    for line in IDENTITY_TERMS.split("\n"):
        terms = line.split()
        out |= {a: b for a, b in zip(terms, terms[1:] + terms[:1])}
    return out


def swap_identity_terms(text: str) -> str:
    """The text with each identity term swapped for another of its kind; the same text if it has none."""
    import re

    swaps = _swaps()
    return re.sub(r"[A-Za-z]+", lambda m: swaps.get(m[0].lower(), m[0]), text)


def features(raw: np.ndarray, offsets: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature hash and how many times it occurs there, for whole words and word beginnings. known: features to keep, in order."""
    raw = np.frombuffer(ASCII_LOWER, np.uint8)[raw]
    starts, ends, row = token_spans(raw, offsets, word_table())
    flags = None
    if known is not None:  # a table of flags passes on the few that may be known
        flags = np.zeros(1 << 20, bool)
        flags[(known >> np.uint64(44)).astype(np.int64)] = True
    rows, hashes = [], []
    for cut in (None, *BEGINNINGS):
        own = np.arange(len(starts)) if cut is None else np.flatnonzero(ends - starts > cut)
        h = span_hashes(raw, starts[own], ends[own] if cut is None else starts[own] + cut)
        h ^= np.uint64(0 if cut is None else 0xA5A5A5A5 * (cut + 1))  # the beginning `idiot` is not the word `idiot`
        if flags is not None:
            maybe = np.flatnonzero(flags[(h >> np.uint64(44)).astype(np.int64)])
            own, h = own[maybe], h[maybe]
        rows.append(row[own])
        hashes.append(h)
    rows, hashes = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    if not len(rows):
        return rows, hashes, rows
    begin = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])]))
    return rows[begin], hashes[begin], np.diff(np.concatenate([begin, [len(rows)]]))


def columns_of(known: np.ndarray, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and model column of each feature that a text has, a slice of the texts at a time."""
    parts = [_columns_of(known, raw[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a], a) for a, z in slices(offsets, SLICE_BYTES)]
    return tuple(np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _columns_of(known: np.ndarray, raw: np.ndarray, offsets: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    rows, hashes, times = features(raw, offsets, known)
    if not len(known) or not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    has = known[at] == hashes
    rows, at, times = rows[has], at[has], times[has]
    r, c = zip(*((rows[times >= t], at[times >= t] + k * len(known)) for k, t in enumerate(TIMES)))
    return np.concatenate(r) + first, np.concatenate(c)


class Rows:
    """A sparse matrix of ones."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, shape: tuple[int, int]):
        self.rows, self.cols, self.shape = rows, cols, shape

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, w[self.cols], self.shape[0])

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.cols, g[self.rows], self.shape[1])


def fit(x: Rows, y: np.ndarray, twin: Rows, penalty: float = 1.0, ridge: float = 0.1, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise log loss + penalty * mean squared logit change to the twins + ridge * |w|^2 / n."""
    n, d = x.shape
    w, b = np.zeros(d), math.log((y.sum() + 0.1) / (n - y.sum() + 0.9))
    m, v, rate = np.zeros(d + 1), np.zeros(d + 1), 0.05
    for t in range(1, steps + 1):
        logit = x.dot(w)
        p = 1 / (1 + np.exp(-np.clip(logit + b, -40, 40)))
        change = logit - twin.dot(w)
        g = np.append(x.back(p - y) / n, (p - y).mean())
        g[:-1] += 2 * penalty * (x.back(change) - twin.back(change)) / n + 2 * ridge * w / n
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w, b


class Model:
    """Feature hashes in order, weights (one for each of TIMES) and bias."""

    def __init__(self, known: np.ndarray, weights: np.ndarray, bias: float):
        self.known, self.weights, self.bias = known, weights, bias

    def scores(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        rows, cols = columns_of(self.known, raw, offsets)
        logit = np.bincount(rows, self.weights[cols], len(offsets) - 1) if len(rows) else np.zeros(len(offsets) - 1)
        return 1 / (1 + np.exp(-np.clip(logit + self.bias, -40, 40)))


def held_out(id_col: str):
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS, n_features: int = FEATURES, penalty: float = 1.0) -> Model:
    """Learn from labelled rows whose crc32 of the id is not divisible by five; ids labelled twice are toxic if either row says so."""
    stage = Stage(docs.sparkSession, "toxicity")
    known = labels.select(F.col("doc_id").alias("label_id"), F.col("toxic").cast("int").alias("label")).dropna().groupBy("label_id").agg(F.max("label").alias("label"))
    picked = known.filter(~held_out("label_id")).orderBy(F.xxhash64("label_id"), "label_id").limit(rows)
    texts = docs.select(F.col(id_col).alias("label_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    sample = stage.put(texts.join(F.broadcast(picked), "label_id").select("label_id", "text", "label").dropDuplicates(["label_id"]), "sample")  # at most `rows` ids are sent

    def seen(batches):
        for b in batches:
            raw, offsets = text_buffer(b.column(0))
            label = b.column(1).to_numpy() > 0
            for a, z in slices(offsets, SLICE_BYTES):
                r, h, _ = features(raw[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a])
                y = label[a:z][r]
                own, at = np.unique(h, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(np.bincount(at, y, len(own)).astype(np.int64)), pa.array(np.bincount(at, ~y, len(own)).astype(np.int64))], ["h", "yes", "no"])

    n_yes = sample.filter("label > 0").count()
    n_no = sample.count() - n_yes
    none = Model(np.zeros(0, np.uint64), np.zeros(0), math.log((n_yes + 0.1) / (n_no + 0.9)))
    if not n_yes or not n_no:
        return none
    counted = sample.select("text", "label").mapInArrow(trimmed(seen), "h long, yes long, no long").groupBy("h").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    p, q = (F.col("yes") + 0.5) / (n_yes + 1), (F.col("no") + 0.5) / (n_no + 1)
    z = F.abs(F.log(p / q)) / F.sqrt(1 / (F.col("yes") + 0.5) + 1 / (F.col("no") + 0.5))
    best = counted.filter("yes + no >= 3").select("h", z.alias("z")).orderBy(F.desc("z"), "h").limit(n_features).collect()
    if not best:
        return none
    hashes = np.sort(np.array([r.h for r in best], np.int64).view(np.uint64))

    def vectors(batches):
        for b in batches:
            texts = b.column(0).to_pylist()
            twins = [swap_identity_terms(t) for t in texts]
            out = []
            for t in (texts, twins):
                r, c = columns_of(hashes, *text_buffer(pa.array(t, pa.string())))
                cut = np.searchsorted(r[o := np.argsort(r, kind="stable")], np.arange(len(t) + 1))
                out.append([c[o][a:z].tolist() for a, z in zip(cut[:-1], cut[1:])])
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(out[0], kind), pa.array(out[1], kind)], ["label", "own", "twin"])

    got = sample.select("text", "label", "label_id").mapInArrow(trimmed(vectors), "label int, own array<int>, twin array<int>").toPandas()
    shape = (len(got), len(TIMES) * len(hashes))
    matrix = lambda lists: Rows(np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.concatenate([np.zeros(0, np.int64), *(np.asarray(x, np.int64) for x in lists)]), shape)
    w, b = fit(matrix(got.own), got.label.to_numpy(float), matrix(got.twin), penalty)
    return Model(hashes, w, b)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row.

    Null texts count as empty and, like texts without a known feature, get the score of the bias alone. A null id is held
    out: null where the remainder is unknown would leave it in neither part. Repeated rows are scored each by itself.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.known, model.weights, model.bias))  # FEATURES bounds it

    def rows(batches):
        m = Model(*sent.value)
        for b in batches:
            s = m.scores(*text_buffer(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(held_out(id_col), F.lit(True)).alias("held_out"))
    return own.mapInArrow(trimmed(rows), "doc_id long, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted, by a model learned from `rows` labelled rows at most.

    Null and empty texts are scored, too, by the model's constant. Repeated rows are scored each. Null ids are held out. An
    empty table gives no rows; without labels there is nothing to learn, and no text is predicted toxic.
    """
    return score(docs, train(docs, labels, id_col, text_col, rows), id_col, text_col)


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows and columns without those predicted toxic; each row has its own decision. Nulls, repeats and empty tables as in toxicity()."""
    keyed = docs.select(row_key(id_col, text_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = score(keyed, train(docs, labels, id_col, text_col))
    return drop_rows(docs, found.filter("predicted = 1").select("doc_id"), Stage(docs.sparkSession, "toxicity"), id_col, text_col)
