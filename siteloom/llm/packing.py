"""Sequence packing by cutting-stock column generation.

Every document is tokenised and cut into full sequences and one rest. What has to be packed is then only a histogram of
rest lengths, in classes of GRAIN tokens: 127 numbers however many documents there are. A linear program over patterns (how many rests
of each length share a sequence) is solved by column generation: a knapsack, solved by dynamic programming, prices new
patterns. The patterns' amounts are rounded down, what that leaves is packed first-fit decreasing, and every rest finds its
sequence from its rank among the rests of its class. A class counts as its longest length, which costs GRAIN / 2 tokens of
padding for each rest in the mean and keeps the program small.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteloom.llm.common import Stage, by_value, trimmed

by_value(__name__)

SIZE = 1024
#: Tokens in a class of lengths.
GRAIN = 8
#: Pieces, of whatever length, that are ranked together.
RANKED = 8_192
#: The program stops at patterns within this share of its lower bound, or after so many columns.
GAP, COLUMNS = 1e-3, 20_000


# ---- the program --------------------------------------------------------------------------------------------------


def best_pattern(value: np.ndarray, lengths: np.ndarray, size: int) -> tuple[float, np.ndarray]:
    """The unbounded knapsack: how many of each length fill `size` with the most value."""
    order = np.argsort(lengths)
    long, worth = lengths[order], value[order]
    most, last = np.zeros(size + 1), np.full(size + 1, -1)
    upto = np.searchsorted(long, np.arange(size + 1), "right")
    for c in range(1, size + 1):
        most[c] = most[c - 1]
        if k := upto[c]:
            got = worth[:k] + most[c - long[:k]]
            j = int(got.argmax())
            if got[j] > most[c] + 1e-12:
                most[c], last[c] = got[j], j
    counts, c = np.zeros(len(lengths), np.int64), size
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            counts[order[last[c]]] += 1
            c -= int(long[last[c]])
    return float(most[size]), counts


def solve(lengths: np.ndarray, demand: np.ndarray, size: int) -> list[tuple[np.ndarray, float]]:
    """Patterns and their fractional amounts that meet the demand with few sequences: revised simplex with priced columns."""
    m = len(lengths)
    patterns = np.zeros((m, m))
    np.fill_diagonal(patterns, size // lengths)
    inverse = np.diag(1 / (size // lengths))
    amount = inverse @ demand
    for _ in range(COLUMNS):
        price = inverse.sum(axis=0)  # every pattern costs one sequence
        value, column = best_pattern(np.maximum(price, 0), lengths, size)
        if value <= 1 + GAP:
            break
        way = inverse @ column
        up = way > 1e-9
        if not up.any():
            break
        ratio = np.full(m, np.inf)
        ratio[up] = amount[up] / way[up]
        out = int(ratio.argmin())
        step = ratio[out]
        amount = np.maximum(amount - step * way, 0)
        amount[out] = step
        row = inverse[out] / way[out]
        inverse -= np.outer(way, row)
        inverse[out] = row
        patterns[:, out] = column
    return [(patterns[:, j].astype(np.int64), float(amount[j])) for j in np.flatnonzero(amount > 1e-9)]


def plan(histogram: dict[int, int], size: int) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each length, ranges of ranks: (first rank, first sequence, rests in a sequence, offset of the first).

    Every rest of the histogram gets a place, so ranges of a length cover its ranks without a gap. Lengths and size are in
    units of whatever the histogram counts.
    """
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    rank = dict.fromkeys(histogram, 0)
    sequence = 0
    lengths = np.array(sorted(x for x, n in histogram.items() if n and x < size), np.int64)
    if n := histogram.get(size, 0):
        slots[size] = [(0, 0, 1, 0)]
        sequence, rank[size] = n, n
    demand = np.array([histogram[int(x)] for x in lengths], float)
    left = demand.astype(np.int64)

    def place(counts: np.ndarray, times: int) -> None:
        nonlocal sequence
        at = 0
        for k in np.flatnonzero(counts)[::-1]:
            x, n = int(lengths[k]), int(counts[k])
            slots.setdefault(x, []).append((rank[x], sequence, n, at))
            rank[x] += n * times
            at += n * x
        sequence += times

    if len(lengths):
        for counts, amount in solve(lengths, demand, size):
            times = int(amount + 1e-9)
            times = min([times, *(int(left[k] // counts[k]) for k in np.flatnonzero(counts))])
            if times > 0:
                place(counts, times)
                left -= counts * times
    # what rounding left: first-fit decreasing, at most a few rests of each length
    while left.any():
        counts, room = np.zeros(len(lengths), np.int64), size
        for k in np.flatnonzero(left)[::-1]:
            counts[k] = min(left[k], room // lengths[k])
            room -= counts[k] * lengths[k]
        times = min(int(left[k] // counts[k]) for k in np.flatnonzero(counts))
        place(counts, times)
        left -= counts * times
    return slots


# ---- tokens -------------------------------------------------------------------------------------------------------


def _byte_of() -> dict[str, int]:
    """The character that a byte-level vocabulary writes for each byte: itself if printable, else the next beyond Latin-1."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_tokenizer(spec: str):
    """An encoder (text -> array of ids) from the text of a byte-level BPE tokenizer file.

    The same ids come from the file's own library; this reads its vocabulary into a faster one, and falls back to the
    library for texts that the faster one refuses. Strings of special tokens are ordinary text.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    byte_of = _byte_of()
    model = json.loads(spec)
    special = {t["content"] for t in model.get("added_tokens", [])}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    slow = Tokenizer.from_str(spec)
    slow.encode_special_tokens = True

    def encode(text: str) -> np.ndarray:
        try:
            return np.asarray(fast.encode_ordinary(text), np.uint32)
        except Exception:  # its regex engine gives up on some very long runs
            return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_encoders: dict[str, object] = {}


def pieces(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's tokens and end_id, cut into full pieces and a rest: doc_id, start, length, ids_crc32, doc_tokens."""
    with open(tokenizer or tokenizer_path(), encoding="utf-8") as f:
        spec = f.read()
    sent = docs.sparkSession.sparkContext.broadcast(spec)  # the vocabulary file, 1.6 MB

    def rows(batches):
        spec = sent.value
        if spec not in _encoders:
            _encoders[spec] = load_tokenizer(spec)
        encode = _encoders[spec]
        names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
        for b in batches:
            out: list[list] = [[] for _ in names]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.append(encode(text.as_py() or ""), end_id).astype("<u4")
                for at in range(0, len(ids), size):
                    own = ids[at : at + size]
                    for column, x in zip(out, (doc, at, len(own), zlib.crc32(own.tobytes()), len(ids))):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], list(names))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(trimmed(rows), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def ranked(cut: DataFrame, pieces: int, per_task: int = RANKED) -> DataFrame:
    """cut with `rank`, from 0 within each class.

    Pieces are dealt into parts of about per_task by a hash, so that no task gets more than another however common a length
    is. A part's pieces of a class are ranked there, from where the parts before it end.
    """
    dealt = cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(max(1, -(-pieces // per_task)))))
    sizes = dealt.groupBy("class", "part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    inside = F.row_number().over(Window.partitionBy("part", "class").orderBy("doc_id", "start", "ids_crc32")) - 1
    own = dealt.repartition("part").withColumn("inside", inside)  # the window and the join below need no other shuffle of the pieces
    return own.join(before.select("part", "class", F.coalesce("before", F.lit(0)).alias("before")), ["part", "class"]).withColumn("rank", F.col("before") + F.col("inside"))


def pack(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE, grain: int = GRAIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null texts count as empty and have the end token alone. Null ids are kept. Repeated rows are packed each. An empty table
    gives no rows. A document of any length is cut; each of its ids is in one piece.
    """
    if size % grain:
        raise ValueError("the grain has to divide the size")
    stage = Stage(docs.sparkSession, "packing")
    cut = stage.put(pieces(docs, tokenizer, size, id_col=id_col, text_col=text_col).withColumn("class", F.ceil(F.col("length") / grain).cast("int")), "pieces")
    counts = {int(r["class"]): int(r.n) for r in cut.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most size / grain rows
    sent = {x: np.array(own, np.int64) for x, own in plan(counts, size // grain).items()}
    kept = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def rows(batches):
        for b in batches:
            own_class, rank = b.column("class").to_numpy(), b.column("rank").to_numpy()
            sequence, place = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(own_class):
                own = np.flatnonzero(own_class == x)
                s = sent[int(x)]
                s = s[np.searchsorted(s[:, 0], rank[own], "right") - 1]
                k = rank[own] - s[:, 0]
                sequence[own], place[own] = s[:, 1] + k // s[:, 2], s[:, 3] + k % s[:, 2] * x
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(sequence), pa.array(place)], [*kept, "sequence_id", "place"])

    placed = ranked(cut, sum(counts.values())).select(*kept, "class", F.col("rank").cast("long").alias("rank")).mapInArrow(trimmed(rows), ", ".join(f"{c} long" for c in (*kept, "sequence_id", "place")))
    before = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)  # at most `size` rows
    return placed.select(*kept, "sequence_id", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"))
