"""Repeated substrings by a run-length index.

Which bytes lie in a `length`-byte string that also starts elsewhere? Three steps find out, exactly but for 64-bit hashes:

1. Every `length`-byte window has a minimizer, the least hash of its inner strings of GRAM bytes; equal windows have equal
   ones. A stretch of windows with one minimizer is a row of (minimizer, hash of the stretch, place): some six rows per
   thousand bytes. Stretches whose minimizer occurs nowhere else are done with, and so are those that occur twice as a whole.
2. The rest, about where copies begin, end or differ, goes with what shares its minimizer into shards. A shard builds the
   Burrows-Wheeler transform of its stretches, compresses it to runs, and samples, at the first and last row of each run,
   how far that suffix agrees with its neighbour. Streaming over the text gives all matching statistics from these samples:
   inside a run, the match of the next suffix is one shorter. Windows with a match of `length` bytes are repeated. A group
   of one minimizer that is larger than HOT_BYTES would make a shard of its own, however large: the hashes of its windows
   are counted instead, dealt out by hash and summed up for each slice of the texts before.
3. Spans are filed by text, and a last scan takes them out.

Texts never move: the requests of step 2, its repeated windows and the spans of step 3 lie in the shared folder as sorted
arrays, and the workers that scan the texts look them up there.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.llm.common import _BASE, _INVERSE, Stage, _byte_codes, _power, by_value, slices, span_hashes, splitmix, text_buffer, trimmed
from siteloom.llm.lm import Store, opened, squeeze, unsqueeze

by_value(__name__)

LENGTH, GRAM = 400, 100
#: Bytes of text in a worker at a time, bytes of a shard, rows of a file of requests or spans.
SLICE_BYTES, SHARD_BYTES, ROWS_IN_FILE = 2 << 20, 1 << 20, 1_000_000
#: Bytes of different stretches with one minimizer that go into a shard; windows of larger groups that are counted in one task.
HOT_BYTES, COUNTED = 1 << 18, 4_000_000
#: Copied stretches that are sent to every executor: 16 MB of longs.
SEND = 2_000_000


def sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """The least or greatest of each `width` neighbours."""
    f = np.minimum if least else np.maximum
    span, m = 1, x
    while span * 2 <= width:
        m, span = f(m[:-span], m[span:]), span * 2
    rest = width - span
    return f(m[: len(m) - rest], m[rest:]) if rest else m


def text_keys(ids, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A key for each row from its id and text, so that only rows alike in both share one."""
    own = np.array([0 if i is None else (i * 2 + 1) & 0xFFFFFFFFFFFFFFFF for i in ids], np.uint64)
    return splitmix(splitmix(own) ^ span_hashes(raw, offsets[:-1], offsets[1:])) if len(own) else own


def stretches(raw: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Row, minimizer, hash, first and last window (places in the text), and whether the minimizer may occur twice, of each stretch."""
    n, width = len(raw), length - gram + 1
    windows = n - length + 1
    if windows <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64, bool))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_byte_codes()[raw] * _power(_BASE, n), out=total[1:])
    inverse = _power(_INVERSE, n + 1)
    h = splitmix((total[gram:] - total[:-gram]) * inverse[: n - gram + 1])
    m = sliding(h, width, True)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    i = np.flatnonzero(row[:windows] == row[length - 1 :])
    if not len(i):
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64, bool))
    own = m[i]
    start = np.flatnonzero(np.concatenate([[True], (np.diff(i) != 1) | (own[1:] != own[:-1]) | (row[i[1:]] != row[i[:-1]])]))
    lo = i[start]
    hi = i[np.concatenate([start[1:], [len(i)]]) - 1]
    digest = splitmix((total[hi + length] - total[lo]) * inverse[lo] ^ (hi - lo).astype(np.uint64) << np.uint64(40))
    # places that are the least of some window; neighbours of equal hash say that a stretch may repeat itself
    padded = np.concatenate([np.zeros(width - 1, np.uint64), m, np.zeros(width - 1, np.uint64)])
    chosen = np.flatnonzero(sliding(padded, width, False) == h)
    twins = chosen[:-1][(h[chosen[1:]] == h[chosen[:-1]]) & (np.diff(chosen) <= width)]  # as far apart as `width`, they follow each other in windows side by side
    twice = np.searchsorted(twins, hi + width) > np.searchsorted(twins, lo)
    r = row[lo]
    return r, own[start], digest, lo - offsets[r], hi - offsets[r], twice


# ---- the run-length index -----------------------------------------------------------------------------------------


def suffix_order(text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """Suffixes in order, their ranks, and the ranks by ever longer beginnings (length, ranks). text: symbols from 1, 0 at `ends`; no two ends are equal."""
    n = len(text)
    place = np.arange(n, dtype=np.uint64)
    small = n < 1 << 21
    depth = 5
    padded = np.concatenate([text, np.zeros(depth, np.uint64)])
    left = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)  # symbols before the end
    key = np.zeros(n, np.uint64)
    for k in range(depth):
        key = key * np.uint64(257) + np.where(left > k, padded[k : k + n], 0)  # below 2^41
    if small:
        packed = np.sort(key << np.uint64(21) | place)
        order, key = (packed & np.uint64((1 << 21) - 1)).astype(np.int64), packed >> np.uint64(21)
    else:
        order = np.argsort(key, kind="stable")
        key = key[order]
    levels = []
    done = left[order] < depth  # the end is in the key: different from all others
    while True:
        new = np.concatenate([[True], (key[1:] != key[:-1]) | done[1:] | done[:-1]])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        levels.append((depth, rank))
        if new.all():
            return order, rank, levels
        second = np.zeros(n, np.int64)
        second[: n - depth] = rank[depth:]
        if small:
            packed = np.sort(rank.astype(np.uint64) << np.uint64(42) | second.astype(np.uint64) << np.uint64(21) | place)
            order, key = (packed & np.uint64((1 << 21) - 1)).astype(np.int64), packed >> np.uint64(21)
        else:
            key = rank.astype(np.uint64) << np.uint64(32) | second.astype(np.uint64)
            order = np.argsort(key, kind="stable")
            key = key[order]
        depth *= 2
        done = left[order] < depth


def agreement(text: np.ndarray, a: np.ndarray, b: np.ndarray, levels: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """How many symbols suffixes a and b have in common, from the ranks of their beginnings and at last symbol by symbol."""
    out = np.zeros(len(a), np.int64)
    n = len(levels[0][1])
    for depth, rank in reversed(levels):
        x, y = a + out, b + out
        inside = (x < n) & (y < n)
        same = np.zeros(len(a), bool)
        same[inside] = rank[x[inside]] == rank[y[inside]]
        out[same] += depth
    going = np.arange(len(a))
    for _ in range(levels[0][0] - 1):
        x, y = a[going] + out[going], b[going] + out[going]
        going, x, y = (v[(x < n) & (y < n)] for v in (going, x, y))
        going = going[(text[x] == text[y]) & (text[x] > 0)]
        out[going] += 1
    return out


def matching_statistics(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each place, the longest match of what starts there with what starts anywhere else; matches stop at ends."""
    order, rank, levels = suffix_order(text, ends)
    n = len(text)
    before = np.where(order > 0, text[order - 1], 0)  # the transform; 0 before the first symbol of a stretch
    change = np.concatenate([[True], (before[1:] != before[:-1]) | (before[1:] == 0)])
    heads, tails = np.flatnonzero(change), np.flatnonzero(np.concatenate([change[1:], [True]]))
    best = np.zeros(n, np.int64)
    for runs, step in ((heads, -1), (tails, 1)):  # the samples at the run ends, then the stream over the text
        has = runs[(runs + step >= 0) & (runs + step < n)]
        sample = np.full(n, -1, np.int64)
        sample[order[runs]] = 0
        sample[order[has]] = agreement(text, order[has], order[has + step], levels)
        at = np.maximum.accumulate(np.where(sample >= 0, np.arange(n), 0))
        best = np.maximum(best, sample[at] - (np.arange(n) - at))
    return best


def repeated_windows(parts: list[np.ndarray], length: int) -> list[np.ndarray]:
    """For each stretch of bytes the places at which a window starts that starts elsewhere in them, too."""
    sizes = np.array([len(p) for p in parts])
    ends = np.cumsum(sizes + 1) - 1
    text = np.zeros(int(ends[-1]) + 1, np.uint64)
    for p, e in zip(parts, ends):
        text[e - len(p) : e] = p.astype(np.uint64) + np.uint64(1)
    hit = np.flatnonzero(matching_statistics(text, ends) >= length)
    cut = np.searchsorted(hit, np.concatenate([[0], ends]))
    return [hit[a:z] - (e - s) for a, z, e, s in zip(cut[:-1], cut[1:], ends, sizes)]


def ranges(x: np.ndarray) -> list[tuple[int, int]]:
    if not len(x):
        return []
    cut = np.flatnonzero(np.diff(x) != 1)
    return list(zip(x[np.concatenate([[0], cut + 1])].tolist(), x[np.concatenate([cut, [len(x) - 1]])].tolist()))


# ---- files of rows by text ----------------------------------------------------------------------------------------


def file_rows(rows: DataFrame, stage: Stage, name: str) -> tuple[str, int]:
    """Write rows (key and other longs) as sorted arrays, by the leading bits of key; the folder and how many bits."""
    rows = stage.put(rows, name)
    bits = max(1, (rows.count() // ROWS_IN_FILE).bit_length())
    uri, columns = f"{stage.root}/{name}-arrays", rows.columns

    def write(key, t):
        k = key[0].as_py()
        order = np.argsort(t.column("key").to_numpy().view(np.uint64), kind="stable")
        for c in columns:
            Store(uri).write(f"{c}-{k}", t.column(c).to_numpy()[order].astype(np.int64))
        return pa.table({"k": pa.array([k], pa.int32())})

    written = rows.groupBy(F.shiftrightunsigned("key", 64 - bits).cast("int").alias("k")).applyInArrow(write, "k int")
    return uri, bits, {r.k for r in stage.put(written, f"{name}-files").collect()}


class Filed:
    """Looks up the rows of a text."""

    def __init__(self, uri: str, bits: int, files: set[int]):
        self.uri, self.bits, self.files = uri, bits, files

    def of(self, key: int, columns: tuple[str, ...]) -> list[np.ndarray]:
        k = key >> (64 - self.bits)
        if k not in self.files:
            return [np.zeros(0, np.int64) for _ in columns]
        store = opened(self.uri)
        keys = store.array(f"key-{k}", np.uint64)
        a, z = np.searchsorted(keys, np.uint64(key)), np.searchsorted(keys, np.uint64(key), "right")
        return [store.array(f"{c}-{k}", np.int64)[a:z] for c in columns]


def spans_of_repeats(docs: DataFrame, stage: Stage, length: int = LENGTH, gram: int = GRAM, hot_bytes: int = HOT_BYTES, counted: int = COUNTED) -> tuple[DataFrame, tuple]:
    """key, lo, hi: first and last start of runs of repeated windows, for texts by their key; and where counted_spans() finds the others."""

    def rows(batches):
        for b in batches:
            raw, at = text_buffer(b.column(1))
            ids = b.column(0).to_pylist()
            for a, z in slices(at, SLICE_BYTES):
                r, o = raw[at[a] : at[z]], at[a : z + 1] - at[a]
                key = text_keys(ids[a:z], r, o)
                row, m, digest, lo, hi, twice = stretches(r, o, length, gram)
                yield pa.RecordBatch.from_arrays([pa.array(m.view(np.int64)), pa.array(digest.view(np.int64)), pa.array(key[row].view(np.int64)), pa.array(lo), pa.array(hi), pa.array(twice)], ["m", "digest", "key", "lo", "hi", "twice"])

    all_ = stage.put(docs.mapInArrow(trimmed(rows), "m long, digest long, key long, lo long, hi long, twice boolean"), "stretches")
    shared = all_.groupBy("m").agg(F.count(F.lit(1)).alias("n"), F.max("twice").alias("twice")).filter("n > 1 or twice").select("m")
    own = stage.put(all_.join(shared, "m", "left_semi"), "shared")
    whole = stage.put(own.groupBy("m", "digest").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "lo", "hi")).alias("one")), "whole")
    copies = stage.put(whole.filter("n > 1").select("digest"), "copies")
    copies = F.broadcast(copies) if copies.limit(SEND + 1).count() <= SEND else copies  # some are in a large part of all texts: those rows stay where they are
    copied = own.join(copies, "digest", "left_semi").select("key", "lo", "hi")
    each = F.sum(F.expr(f"one.hi - one.lo + {length + 1}"))
    sized = whole.groupBy("m").agg(F.min("n").alias("least"), each.alias("size"), F.sum(F.expr("one.hi - one.lo + 1")).alias("windows")).filter("least = 1")
    open_ = stage.put(sized.select("m", "size", "windows", (F.col("size") > hot_bytes).cast("long").alias("hot")), "open")
    asked = whole.join(open_, "m").select("one.key", "one.lo", "one.hi", "m", F.when(F.col("n") == 1, 1).otherwise(0).cast("long").alias("single"), "hot")
    total, crowd = open_.agg(F.coalesce(F.sum(F.expr("if(hot = 0, size, 0)")), F.lit(0)), F.coalesce(F.sum(F.expr("if(hot = 1, windows, 0)")), F.lit(0))).head()
    place, shards = file_rows(asked, stage, "requests"), max(1, -(-int(total) // SHARD_BYTES))
    bits = max(1, (int(crowd) // counted).bit_length())

    def fetch(batches):
        filed = Filed(*place)
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        for b in batches:
            raw, at = text_buffer(b.column(1))
            ids = b.column(0).to_pylist()
            for a, z in slices(at, SLICE_BYTES):
                out: list[list] = [[] for _ in range(7)]
                windows = []
                for d, key in enumerate(text_keys(ids[a:z], raw[at[a] : at[z]], at[a : z + 1] - at[a]).tolist(), a):
                    for x, y, mm, s, h in zip(*(v.tolist() for v in filed.of(key, ("lo", "hi", "m", "single", "hot")))):
                        own = raw[at[d] + x : at[d] + y + length]
                        if h:
                            windows.append(window_hashes(own, length))
                        else:
                            for column, v in zip(out, ((mm & 0xFFFFFFFFFFFFFFFF) % shards, mm, signed(key), x, s, own.tobytes(), None)):
                                column.append(v)
                if windows:
                    w, n = np.unique(np.concatenate(windows), return_counts=True)
                    part = (w >> np.uint64(64 - bits)).astype(np.int64)
                    for k in np.unique(part).tolist():
                        mine = part == k
                        for column, v in zip(out, (k, None, None, len(w[mine]), None, squeeze(np.diff(w[mine], prepend=np.uint64(0))), squeeze(n[mine] > 1))):
                            column.append(v)
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:5]), *(pa.array(x, pa.binary()) for x in out[5:])], ["shard", "m", "key", "lo", "single", "bytes", "several"])

    def search(key, t):
        found: list[list[int]] = [[], [], []]
        names = ("key", "lo", "single", "m")
        key_, lo, single, m = (t.column(c).to_numpy() for c in names)
        order = np.lexsort((lo, key_, m))
        order = order[np.concatenate([[True], (np.diff(m[order]) != 0) | (np.diff(key_[order]) != 0) | (np.diff(lo[order]) != 0)])] if len(order) else order
        texts = t.column("bytes")
        size, own = 0, []

        def look():
            for k, hits in zip(own, repeated_windows([np.frombuffer(texts[int(k)].as_py(), np.uint8) for k in own], length)):
                if single[k]:
                    for a, z in ranges(hits):
                        for column, v in zip(found, (key_[k], lo[k] + a, lo[k] + z)):
                            column.append(int(v))

        for i, k in enumerate(order):  # whole groups of one minimizer at a time, as many as make a shard's size
            if size > SHARD_BYTES and m[k] != m[order[i - 1]]:
                look()
                size, own = 0, []
            own.append(int(k))
            size += len(texts[int(k)].as_py()) + 1
        if own:
            look()
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("key", "lo", "hi"), found)})

    fetched = stage.put(docs.mapInArrow(trimmed(fetch), "shard long, m long, key long, lo long, single long, bytes binary, several binary"), "fetched", compression="zstd")
    indexed = fetched.filter("several is null").drop("several").groupBy("shard").applyInArrow(search, "key long, lo long, hi long")
    uri = f"{stage.root}/again"

    def count(key, t):
        sizes = t.column("n").to_pylist()
        w = np.concatenate([np.cumsum(unsqueeze(x, n, np.uint64), dtype=np.uint64) for x, n in zip(t.column("bytes").to_pylist(), sizes)])
        several = np.concatenate([unsqueeze(x, n, bool) for x, n in zip(t.column("several").to_pylist(), sizes)])
        order = np.argsort(w, kind="stable")
        w, several = w[order], several[order]
        same = w[1:] == w[:-1]
        several[1:] |= same
        several[:-1] |= same
        opened(uri).write(f"windows-{key[0].as_py()}", np.unique(w[several]))
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64())})

    # a stretch that is there once is in a text that is there once, so that equal windows of it are at different places
    parts = fetched.filter("several is not null").select(F.col("shard").alias("part"), F.col("lo").alias("n"), "bytes", "several").groupBy("part").applyInArrow(count, "part long")
    files = {r.part for r in stage.put(parts, "again-files").collect()}  # one for each COUNTED windows or so
    hot = file_rows(asked.filter("hot = 1 and single = 1").select("key", "lo", "hi"), stage, "hot")
    return copied.unionByName(indexed), (hot, uri, bits, files)


def window_hashes(raw: np.ndarray, length: int) -> np.ndarray:
    starts = np.arange(len(raw) - length + 1)
    return span_hashes(raw, starts, starts + length)


def counted_spans(hot: tuple, text: np.ndarray, key: int, length: int) -> list[np.ndarray]:
    """First and last start of runs of windows of a text that were counted more than once."""
    place, uri, bits, files = hot
    found: list[tuple[int, int]] = []
    for x, y in zip(*(v.tolist() for v in Filed(*place).of(key, ("lo", "hi")))):
        w = window_hashes(text[x : y + length], length)
        part = (w >> np.uint64(64 - bits)).astype(np.int64)
        again = np.zeros(len(w), bool)
        for k in np.unique(part).tolist():
            if k in files and len(known := opened(uri).array(f"windows-{k}", np.uint64)):
                mine = np.flatnonzero(part == k)
                again[mine] = known[np.minimum(np.searchsorted(known, w[mine]), len(known) - 1)] == w[mine]
        found += [(x + a, x + z) for a, z in ranges(np.flatnonzero(again))]
    return [np.array([s[i] for s in found], np.int64) for i in (0, 1)]


def union_of(lo: np.ndarray, hi: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Byte spans that runs of windows cover; those that touch are one."""
    out: list[list[int]] = []
    for a, z in sorted(zip(lo.tolist(), (hi + length).tolist())):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [tuple(x) for x in out]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int | None = None, hot_bytes: int = HOT_BYTES, counted: int = COUNTED) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes), spans (start, end).

    Texts are UTF-8 bytes, null as none; matches do not cross texts. Every byte is removed that a `length`-byte string covers
    which also starts elsewhere in the input, same text included, however often. Texts shorter than that are kept. Repeated
    rows are copies of each other. An empty table gives no rows.
    """
    stage = Stage(docs.sparkSession, "substring-dedup")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    spans_, hot = spans_of_repeats(own, stage, length, gram or min(GRAM, max(1, length // 4)), hot_bytes, counted)
    place = file_rows(spans_, stage, "spans")

    def rows(batches):
        filed = Filed(*place)
        for b in batches:
            raw, at = text_buffer(b.column(1))
            ids = b.column(0).to_pylist()
            for a, z in slices(at, SLICE_BYTES):
                n, removed, kept, spans = [], [], [], []
                for d, key in enumerate(text_keys(ids[a:z], raw[at[a] : at[z]], at[a : z + 1] - at[a]).tolist(), a):
                    text = raw[at[d] : at[d + 1]]
                    cut = union_of(*(np.concatenate(v) for v in zip(filed.of(key, ("lo", "hi")), counted_spans(hot, text, key, length))), length)
                    stay = np.ones(len(text), bool)
                    for x, y in cut:
                        stay[x:y] = False
                    n.append(len(text))
                    removed.append(sum(y - x for x, y in cut))
                    kept.append(text[stay].tobytes())
                    spans.append([{"start": x, "end": y} for x, y in cut])
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, z - a), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array([len(s) for s in spans], pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, kind)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "spans"])

    return own.mapInArrow(trimmed(rows), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<start:long,end:long>>")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def digest_of(kept: bytes) -> str:
    return hashlib.sha256(kept).hexdigest()
