"""Interpolated modified Kneser-Ney language model over bigrams of words, with perplexity by memory-mapped arrays.

Spark counts: words by hash, then bigrams of word numbers, pre-aggregated and packed by the workers that read the texts and
dealt to buckets by context; the followers of very frequent words are spread over all buckets. Each bucket is stored in the
shared folder as one array of sorted keys and one of counts, each range of word hashes as arrays of what the model knows of
a word. Workers that score map these files and look texts up in slices; nothing of the model goes through the driver but
counts of counts.
"""

from __future__ import annotations

import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.llm.common import ASCII_LOWER, Stage, by_value, slices, space_table, span_hashes, splitmix, text_buffer, token_spans, trimmed

by_value(__name__)

#: Words in an array of the vocabulary, tokens for each bucket of bigrams, bytes of text and bigrams in a worker at a time.
WORDS_IN_PART, TOKENS_IN_BUCKET, SLICE_BYTES, HELD = 1_000_000, 8_000_000, 2 << 20, 4_000_000
END = np.uint64(0x9D39247E33776D41)  #: the hash that stands for the end of a text


class Store:
    """Arrays as files of a folder that all executors see. Files of other stores than a mounted one are copied before they are mapped."""

    def __init__(self, uri: str):
        self.uri, self.opened = uri, {}
        self.local = uri.removeprefix("file://") if uri.startswith(("file:", "/")) else None
        if self.local and self.local.startswith("file:"):
            self.local = self.local.removeprefix("file:")

    def _remote(self, name: str):
        from pyarrow import fs

        return fs.FileSystem.from_uri(f"{self.uri}/{name}")

    def write(self, name: str, array: np.ndarray) -> None:
        """Write whole, then name: a task that is run twice leaves one good file."""
        if self.local:
            os.makedirs(self.local, exist_ok=True)
            part = f"{self.local}/.{name}-{uuid.uuid4().hex}"
            np.ascontiguousarray(array).tofile(part)
            os.replace(part, f"{self.local}/{name}")
        else:
            system, path = self._remote(name)
            with system.open_output_stream(path) as f:
                f.write(np.ascontiguousarray(array).tobytes())

    def array(self, name: str, dtype) -> np.ndarray:
        if name not in self.opened:
            path = f"{self.local}/{name}"
            if not self.local:
                import tempfile

                system, remote = self._remote(name)
                with system.open_input_stream(remote) as f, tempfile.NamedTemporaryFile(delete=False) as own:
                    while block := f.read(1 << 24):
                        own.write(block)
                path = own.name
            size = os.path.getsize(path)
            self.opened[name] = np.memmap(path, dtype, "r") if size else np.zeros(0, dtype)
            if not self.local:
                os.unlink(path)  # the copy lives as long as it is mapped
        return self.opened[name]


_stores: dict[str, Store] = {}


def opened(uri: str) -> Store:
    return _stores.setdefault(uri, Store(uri))


def squeeze(a: np.ndarray) -> bytes:
    """Bytes of an array, like bytes together, compressed."""
    return pa.compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes(), "zstd", asbytes=True) if len(a) else b""


def unsqueeze(b: bytes, n: int, dtype) -> np.ndarray:
    if not n:
        return np.zeros(0, dtype)
    width = np.dtype(dtype).itemsize
    flat = np.frombuffer(pa.decompress(b, n * width, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(flat.reshape(width, n).T).reshape(-1).view(dtype)


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's words and then one end, and where each text's begin (n + 1 places)."""
    raw = np.frombuffer(ASCII_LOWER, np.uint8)[raw]
    starts, ends, row = token_spans(raw, offsets, space_table())
    h = span_hashes(raw, starts, ends)
    n = len(offsets) - 1
    at = np.searchsorted(row, np.arange(n + 1)) + np.arange(n + 1)
    out = np.empty(len(h) + n, np.uint64)
    out[np.arange(len(h)) + row] = h
    out[at[1:] - 1] = END
    return out, at


class Words:
    """Numbers of words: their places in order of their hashes, over the parts of the vocabulary."""

    def __init__(self, store: Store, bits: int, sizes: list[int]):
        self.store, self.bits = store, bits
        self.first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """-1 for unknown words."""
        out = np.full(len(hashes), -1, np.int64)
        part = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        for k in np.unique(part):
            if self.first[k + 1] == self.first[k]:
                continue
            own = np.flatnonzero(part == k)
            known = self.store.array(f"words-{k}", np.uint64)
            at = np.minimum(np.searchsorted(known, hashes[own]), len(known) - 1)
            out[own] = np.where(known[at] == hashes[own], at + self.first[k], -1)
        return out

    def of(self, name: str, dtype, numbers: np.ndarray) -> np.ndarray:
        """What is stored under name for each word number; 0 for unknown words."""
        out = np.zeros(len(numbers), dtype)
        part = np.searchsorted(self.first, numbers, "right") - 1
        for k in np.unique(part[numbers >= 0]):
            own = np.flatnonzero((part == k) & (numbers >= 0))
            out[own] = self.store.array(f"{name}-{k}", dtype)[numbers[own] - self.first[k]]
        return out


def bucket_of(context: np.ndarray, key: np.ndarray, frequent: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each bigram: by its context, or by the whole of it where the context is a frequent word."""
    spread = np.isin(context, frequent)
    return (splitmix(np.where(spread, key, context.astype(np.uint64))) % np.uint64(buckets)).astype(np.int64)


def bigrams(numbers: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Context and word of each token; the end stands before a text's first."""
    context = np.empty(len(numbers), np.int64)
    context[1:] = numbers[:-1]
    if len(at) > 1:
        context[at[:-1]] = numbers[at[1] - 1]  # the number of the end
    return context, numbers


def discounts(n: np.ndarray) -> np.ndarray:
    """The discounts of counts 1, 2 and 3 or more, from how many n-grams have the counts 1 to 4."""
    n1, n2, n3, n4 = (float(x) for x in n)
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    d = [c - (c + 1) * y * b / a if a else 0.0 for c, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return np.array([min(max(x, 0.0), c) for x, c in zip(d, (1, 2, 3))])


def discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    return counts - np.where(counts > 0, d[np.clip(counts, 1, 3).astype(np.int64) - 1], 0.0)


class Model:
    """Where the arrays are, and the few numbers that go with them."""

    def __init__(self, uri: str, bits: int, sizes: list[int], n: int, buckets: int, frequent: np.ndarray, d2: np.ndarray, d1: np.ndarray, total: int, freed: float):
        self.uri, self.bits, self.sizes, self.n, self.buckets, self.frequent = uri, bits, sizes, n, buckets, frequent
        self.d2, self.d1, self.total, self.freed = d2, d1, total, freed

    @property
    def v(self) -> int:
        return sum(self.sizes)

    def words(self) -> Words:
        return Words(opened(self.uri), self.bits, self.sizes)

    def unigram(self, words: Words, numbers: np.ndarray) -> np.ndarray:
        """Probability by how many different words a word follows, interpolated with an even share for each and for one unknown."""
        even = 1.0 / (self.v + 1)
        if not self.total:
            return np.full(len(numbers), even)
        follows = words.of("follows", np.uint32, numbers).astype(np.float64)
        return discounted(follows, self.d1) / self.total + self.freed / self.total * even

    def bigram(self, words: Words, context: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        p = self.unigram(words, numbers)
        total = words.of("total", np.uint64, context).astype(np.float64)
        has = np.flatnonzero((context >= 0) & (total > 0))
        if not len(has):
            return p
        freed = sum(self.d2[k] * words.of(f"n{k + 1}", np.uint32, context[has]) for k in range(3))
        counts = np.zeros(len(has))
        both = np.flatnonzero(numbers[has] >= 0)
        key = context[has][both].astype(np.uint64) << np.uint64(32) | numbers[has][both].astype(np.uint64)
        bucket = bucket_of(context[has][both], key, self.frequent, self.buckets)
        for b in np.unique(bucket):
            own = np.flatnonzero(bucket == b)
            keys = words.store.array(f"keys-{b}", np.uint64)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, key[own]), len(keys) - 1)
                counts[both[own]] = np.where(keys[at] == key[own], words.store.array(f"counts-{b}", np.uint32)[at], 0)
        p[has] = (discounted(counts, self.d2) + freed * p[has]) / total[has]
        return p


def training_rows(docs: DataFrame, id_col: str, text_col: str):
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(True)))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Count the rows whose crc32 of the id is not divisible by ten. A null id is held out."""
    stage = Stage(docs.sparkSession, "lm")
    uri = f"{stage.root}/arrays"
    texts = training_rows(docs, id_col, text_col).filter("not held_out").select("text")

    def count_words(batches):
        for b in batches:
            raw, at = text_buffer(b.column(0))
            for a, z in slices(at, SLICE_BYTES):
                h, c = np.unique(tokens(raw[at[a] : at[z]], at[a : z + 1] - at[a])[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], ["h", "c"])

    counted = stage.put(texts.mapInArrow(trimmed(count_words), "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "words")
    v, n = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("c"), F.lit(0))).head()
    bits = max(1, (v // WORDS_IN_PART).bit_length())

    def store_words(key, t):
        h, c = t.column("h").to_numpy().view(np.uint64), t.column("c").to_numpy()
        order = np.argsort(h)
        k = key[0].as_py()
        Store(uri).write(f"words-{k}", h[order])
        Store(uri).write(f"count-{k}", c[order].astype(np.uint64))
        return pa.table({"part": pa.array([k], pa.int32()), "size": pa.array([len(h)], pa.int64())})

    parts = stage.put(counted.groupBy(F.shiftrightunsigned("h", 64 - bits).cast("int").alias("part")).applyInArrow(store_words, "part int, size long"), "parts")
    size_of = dict(map(tuple, parts.collect()))  # one row for each WORDS_IN_PART words or less
    sizes = [size_of.get(k, 0) for k in range(1 << bits)]
    buckets = max(8, -(-n // TOKENS_IN_BUCKET))
    most = [r.h for r in counted.filter(F.col("c") > n / (4 * buckets)).select("h").collect()]  # fewer than 4 * buckets
    frequent = np.sort(np.array(most, np.int64).view(np.uint64))

    def count_bigrams(batches):
        words = Words(opened(uri), bits, sizes)
        often = words.numbers(frequent)
        held, amount = [], 0

        def rows():
            key, c = np.unique(np.concatenate(held), return_counts=True)
            bucket = bucket_of((key >> np.uint64(32)).astype(np.int64), key, often, buckets)
            for b in range(buckets):
                own = np.flatnonzero(bucket == b)
                if len(own):
                    k = key[own]
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([len(k)], pa.int64()), pa.array([squeeze(np.diff(k, prepend=np.uint64(0)))]), pa.array([squeeze(c[own].astype(np.uint32))])], ["bucket", "n", "keys", "counts"])

        for b in batches:
            raw, at = text_buffer(b.column(0))
            for a, z in slices(at, SLICE_BYTES):
                h, begin = tokens(raw[at[a] : at[z]], at[a : z + 1] - at[a])
                context, word = bigrams(words.numbers(h), begin)
                held.append(context.astype(np.uint64) << np.uint64(32) | word.astype(np.uint64))
                amount += len(word)
                if amount >= HELD:
                    yield from rows()
                    held, amount = [], 0
        if amount:
            yield from rows()

    def merge(sizes_, payloads):
        """Sorted keys and their summed values."""
        key = np.concatenate([np.zeros(0, np.uint64), *(np.cumsum(unsqueeze(k, m, np.uint64)) for m, k, _ in zip(sizes_, *payloads))])
        value = np.concatenate([np.zeros(0, np.uint32), *(unsqueeze(c, m, np.uint32) for m, _, c in zip(sizes_, *payloads))])
        order = np.argsort(key, kind="stable")
        key, value = key[order], value[order].astype(np.uint64)
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        return key[begin], np.add.reduceat(value, begin)

    first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    def store_bigrams(key, t):
        b = key[0].as_py()
        keys, counts = merge(t.column("n").to_pylist(), (t.column("keys").to_pylist(), t.column("counts").to_pylist()))
        Store(uri).write(f"keys-{b}", keys)
        Store(uri).write(f"counts-{b}", np.minimum(counts, 2**32 - 1).astype(np.uint32))
        out = {"part": [], "n": [], "ids": [], "columns": []}
        # what each word has as a context, and how many contexts it follows; summed over the buckets next
        context, word = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        own, at = np.unique(np.concatenate([context, word]), return_inverse=True)
        c, w = at[: len(keys)], at[len(keys) :]
        columns = [np.bincount(c, counts, len(own)), *(np.bincount(c, f, len(own)) for f in (counts == 1, counts == 2, counts > 2)), np.bincount(w, minlength=len(own))]
        part = np.searchsorted(first, own, "right") - 1
        for k in np.unique(part):
            mine = np.flatnonzero(part == k)
            out["part"].append(int(k))
            out["n"].append(len(mine))
            out["ids"].append(squeeze((own[mine] - first[k]).astype(np.uint32)))
            out["columns"].append([squeeze(x[mine].astype(np.uint64)) for x in columns])
        of_count = [int((counts == k).sum()) for k in (1, 2, 3, 4)]
        rows_ = len(out["part"])
        return pa.table({"part": pa.array(out["part"], pa.int32()), "n": pa.array(out["n"], pa.int64()), "ids": pa.array(out["ids"], pa.binary()), "columns": pa.array(out["columns"], pa.list_(pa.binary())), "of_count": pa.array([of_count if i == 0 else [0] * 4 for i in range(rows_)], pa.list_(pa.int64()))})

    made = texts.mapInArrow(trimmed(count_bigrams), "bucket int, n long, keys binary, counts binary")
    stored = stage.put(made.groupBy("bucket").applyInArrow(store_bigrams, "part int, n long, ids binary, columns array<binary>, of_count array<long>"), "bigrams")

    def store_contexts(key, t):
        k = key[0].as_py()
        sums = [np.zeros(sizes[k], np.uint64) for _ in range(5)]
        for m, ids, columns in zip(t.column("n").to_pylist(), t.column("ids").to_pylist(), t.column("columns").to_pylist()):
            at = unsqueeze(ids, m, np.uint32)
            for s, c in zip(sums, columns):
                s[at] += unsqueeze(c, m, np.uint64)
        for name, s in zip(("total", "n1", "n2", "n3", "follows"), sums):
            Store(uri).write(f"{name}-{k}", s if name == "total" else s.astype(np.uint32))
        follows = sums[4]
        return pa.table({"follows": pa.array([int(follows.sum())], pa.int64()), "of_count": pa.array([[int((follows == c).sum()) for c in (1, 2, 3, 4)] + [int((follows > 2).sum())]], pa.list_(pa.int64()))})

    done = stage.put(stored.groupBy("part").applyInArrow(store_contexts, "follows long, of_count array<long>"), "contexts")
    d2 = discounts(stored.agg(*(F.coalesce(F.sum(F.col("of_count")[k]), F.lit(0)) for k in range(4))).head())
    row = done.agg(F.coalesce(F.sum("follows"), F.lit(0)), *(F.coalesce(F.sum(F.col("of_count")[k]), F.lit(0)) for k in range(5))).head()
    d1 = discounts(row[1:5])
    freed = d1[0] * row[1] + d1[1] * row[2] + d1[2] * row[5]
    known = Words(Store(uri), bits, sizes).numbers(frequent) if len(frequent) else np.zeros(0, np.int64)
    return Model(uri, bits, sizes, int(n), buckets, known, d2, d1, int(row[0]), float(freed))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of the text's probability), perplexity.

    Null texts count as empty: one end token. Repeated rows are scored each. With nothing to train on every token gets an
    even share. An empty table gives no rows.
    """
    fields = (model.uri, model.bits, model.sizes, model.n, model.buckets, model.frequent, model.d2, model.d1, model.total, model.freed)

    def rows(batches):
        m = Model(*fields)
        words = m.words()
        for b in batches:
            raw, at = text_buffer(b.column(1))
            for a, z in slices(at, SLICE_BYTES):
                h, begin = tokens(raw[at[a] : at[z]], at[a : z + 1] - at[a])
                numbers = words.numbers(h)
                context, word = bigrams(numbers, begin)
                counts = words.of("count", np.uint64, word).astype(np.float64)
                base = np.log10((counts + 0.1) / (m.n + 0.1 * (m.v + 1)))
                p = np.log10(m.bigram(words, context, word))
                total = lambda x: np.add.reduceat(x, begin[:-1])  # noqa: E731  every text has its end
                n = np.diff(begin)
                s = total(p)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(a, z - a), b.column(2).slice(a, z - a), pa.array(n), pa.array(total((counts > 0).astype(np.int64))), pa.array(np.full(z - a, m.n)), pa.array(total(base)), pa.array(s), pa.array(10 ** (-s / n))],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
                )

    own = training_rows(docs, id_col, text_col).select("doc_id", "text", "held_out")
    return own.mapInArrow(trimmed(rows), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """score() by a model of the same documents' training rows; see there for nulls, empty texts, repeated rows and empty tables."""
    return score(docs, train(docs, id_col, text_col), id_col, text_col)
