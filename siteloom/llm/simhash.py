"""SimHash near duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most 2r bits apart share a variant at most r bits from each. Every distinct fingerprint therefore
emits all variants within r bits; equal variants meet; what met is verified. The shuffle goes by the variants' leading
bits: a fingerprint is sent once to each prefix that some of its variants have (37 of 256 for eight bits, in place of
2,081 variants of 64 bits), and the task that owns the prefix writes out the variants that have it.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.llm.common import ASCII_LOWER, Stage, binary_text, by_value, keep_first, row_key, trimmed
from siteloom.llm.components import components

by_value(__name__)

BITS = 64
#: Fingerprints that a prefix may have on the mean, and at most, before prefixes get longer.
MEAN_IN_PREFIX, MOST_IN_PREFIX = 200_000, 4_000_000
#: Variants that a task holds at a time.
HELD = 2_500_000


def fingerprint(text: bytes, width: int = 4, seed: int = 42) -> int:
    """SimHash of a UTF-8 text: words of non-space bytes, A-Z lower-cased, shingles of `width` words hashed by XXH64; no words: 0."""
    import xxhash

    words = text.translate(ASCII_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(line, seed)
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts = [0, *(gaps[: len(words) - width] + 1).tolist()]
    ends = [*gaps[width - 1 :].tolist(), len(line)]
    set_bits, n, digest = np.zeros(BITS, np.int64), len(starts), xxhash.xxh64_intdigest
    for at in range(0, n, 1 << 15):
        h = np.array([digest(line[a:b], seed) for a, b in zip(starts[at : at + (1 << 15)], ends[at : at + (1 << 15)])], "<u8")
        set_bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << int(b) for b in np.flatnonzero(2 * set_bits > n))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """doc_id, key (row_key), fp (the fingerprint as a signed long) for every row; a null text counts as empty."""

    def rows(batches):
        for b in batches:
            got = np.array([fingerprint(binary_text(b.column(2), i), width) for i in range(b.num_rows)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got.view(np.int64))], ["doc_id", "key", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("key"), F.col(text_col).cast("string").alias("text")).mapInArrow(trimmed(rows), "doc_id long, key long, fp long")


def masks(bits: int, radius: int) -> list[int]:
    return [sum(1 << i for i in at) for r in range(radius + 1) for at in combinations(range(bits), r)]


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that edges a-b lead to."""
    label = np.arange(n)
    while True:
        la, lb = label[a], label[b]
        least = np.minimum(la, lb)
        new = label.copy()
        np.minimum.at(new, la, least)
        np.minimum.at(new, lb, least)
        while not np.array_equal(new, jumped := new[new]):
            new = jumped
        if np.array_equal(new, label):
            return label
        label = new


def _met(fps: np.ndarray, left: np.ndarray, low: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (as indices into fps) that share a variant. left: flips that each may still make in its `low` low bits."""
    if len(fps) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    flips = [np.array([m for m in masks(low, r) if m.bit_count() == r], np.uint64) for r in range(min(radius, low) + 1)]
    per = np.cumsum([len(f) for f in flips])
    if int(per[np.minimum(left, len(per) - 1)].sum()) > HELD and low > 8:  # go on by eight more bits
        out = []
        top = (fps >> np.uint64(low - 8)) & np.uint64(255)
        for q in range(256):
            rest = left - np.bitwise_count(top ^ np.uint64(q)).astype(np.int64)
            own = np.flatnonzero(rest >= 0)
            a, b = _met(fps[own], rest[own], low - 8, radius)
            out.append((own[a], own[b]))
        return tuple(np.concatenate(x) for x in zip(*out))
    tail = fps & np.uint64((1 << low) - 1)
    variants, owners = [], []
    for r, f in enumerate(flips):
        own = np.flatnonzero(left >= r)
        variants.append((tail[own][:, None] ^ f[None, :]).ravel())
        owners.append(np.repeat(own, len(f)))
    variant, owner = np.concatenate(variants), np.concatenate(owners)
    s = np.sort(variant)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    if not len(twice):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # a table of flags finds the few variants that occur twice without sorting their owners along
    slot = lambda v: ((v * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64)
    flags = np.zeros(1 << 24, bool)
    flags[slot(twice)] = True
    maybe = np.flatnonzero(flags[slot(variant)])
    at = np.searchsorted(twice, variant[maybe])
    maybe = maybe[(at < len(twice)) & (twice[np.minimum(at, len(twice) - 1)] == variant[maybe])]
    order = maybe[np.lexsort((owner[maybe], variant[maybe]))]
    v, o = variant[order], owner[order]
    begin = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    first = np.repeat(o[begin], np.diff(np.concatenate([begin, [len(v)]])))
    pair = np.unique(first[first != o].astype(np.uint64) << np.uint64(32) | o[first != o].astype(np.uint64))
    return (pair >> np.uint64(32)).astype(np.int64), (pair & np.uint64(0xFFFFFFFF)).astype(np.int64)


def links_at(prefix: int, bits: int, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (u, v) that connect all fingerprints which share a variant with this prefix; at most one for each fingerprint.

    All who share a variant are within `distance` of each other, so a star from the smallest stands for all their pairs.
    """
    fps = np.unique(fps)
    radius = distance // 2
    left = radius - np.bitwise_count((fps >> np.uint64(BITS - bits)) ^ np.uint64(prefix)).astype(np.int64)
    fps, left = fps[left >= 0], left[left >= 0]
    a, b = _met(fps, left, BITS - bits, radius)
    near = np.bitwise_count(fps[a] ^ fps[b]) <= distance
    label = _forest(len(fps), a[near], b[near])
    linked = np.flatnonzero(label != np.arange(len(fps)))
    return fps[linked], fps[label[linked]]


def ball_links(distinct: DataFrame, stage: Stage, distance: int = 4) -> DataFrame:
    """From distinct fingerprints fp, links (u, v) whose components are those of all pairs within an even `distance`."""
    if distance % 2:
        raise ValueError("the distance must be even: both sides go half of it")
    radius, n = distance // 2, distinct.count()
    ball = lambda k: len(masks(k, radius))
    bits = next(k for k in range(8, 25) if k == 24 or n * ball(k) / 2**k <= MEAN_IN_PREFIX)
    while True:
        each = ", ".join(map(str, masks(bits, radius)))
        sent = distinct.select(F.explode(F.expr(f"transform(array({each}), m -> cast(shiftrightunsigned(fp, {BITS - bits}) as int) ^ m)")).alias("prefix"), "fp")
        if bits == 24 or n <= MOST_IN_PREFIX or not (most := sent.groupBy("prefix").count().agg(F.max("count")).head()[0]) or most <= MOST_IN_PREFIX:
            break
        bits += 4

    def links(key, t):
        u, v = links_at(key[0].as_py(), bits, t.column("fp").to_numpy().view(np.uint64), distance)
        return pa.table({"u": u.view(np.int64), "v": v.view(np.int64)})

    return stage.put(sent.groupBy("prefix").applyInArrow(links, "u long, v long"), "links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, distance: int = 4) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints that differ in at most `distance` bits are linked; component_id is the smallest doc_id that links lead to.
    Null and empty texts have fingerprint zero and are linked like any other. Null ids are passed through and never a
    component_id unless a component has no other. Repeated rows give repeated rows. An empty table gives no rows.
    """
    found = with_components(docs, Stage(docs.sparkSession, "simhash"), id_col, text_col, width, distance)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def with_components(docs: DataFrame, stage: Stage, id_col: str, text_col: str, width: int, distance: int) -> DataFrame:
    prints = stage.put(fingerprints(docs, id_col, text_col, width), "fingerprints")
    distinct = stage.put(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(ball_links(distinct, stage, distance), stage)
    rooted = stage.put(distinct.join(roots, distinct.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least"), "rooted")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(rooted.join(ids, "root").select("fp", "root", "component_id"), "fp")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, distance: int = 4) -> DataFrame:
    """The input's rows and columns, one row of each component: that of the smallest id, null ids last."""
    stage = Stage(docs.sparkSession, "simhash")
    found = with_components(docs, stage, id_col, text_col, width, distance)
    return keep_first(docs, found.select("key", "doc_id", F.col("root").alias("grp")), stage, id_col, text_col)
