"""Benchmark decontamination by a distributed positional inverted index.

The index is built once and lies in the shared folder. Texts are read in segments; a segment's words are turned into lists of
postings, word positions by term, which go to buckets by term. A bucket is a few sorted arrays: terms, the segments in
which they occur, and the positions. Lists of a word that is frequent in a segment are spread over all buckets by segment.
A large corpus has several shards of buckets.

Test phrases stay in Spark. Their terms are ordered by how often the corpus has them; the list of the rarest one is fetched
and gives the places at which a phrase may be. Each place is then looked up in the list of the next rarest term, shifted by
the term's offset, and so on, in the bucket that has that list. What is left are the exact matches, and the places which
have all terms nearby. Work grows with the occurrences of the rarest terms, not with the corpus times the phrases. Each step
streams through workers that map the few buckets they need; no list or group of matches goes through the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.llm.common import ASCII_LOWER, Stage, by_value, drop_rows, row_key, slices, small_batches, span_hashes, text_buffer, token_spans, trimmed
from siteloom.llm.lm import opened, squeeze, unsqueeze

by_value(__name__)

#: Words of a phrase, and words within which a proximity match has all of them, before or after the rarest.
WINDOW, SPAN = 13, 20
#: Bytes of text in a segment and, about, in a bucket; buckets of a shard; postings of a term in a segment from which its list is spread.
SEGMENT_BYTES, BUCKET_BYTES, BUCKETS, FREQUENT = 2 << 20, 16 << 20, 2048, 1024
#: Positions are words in a segment, with so many left out between documents: no phrase or span reaches from one into the next.
GAP = 64
#: Tasks over which places that ask the same bucket are spread.
SALT = 32
#: Bits of a position that are one block, in which places and documents meet.
BLOCK = 10


def word_table() -> np.ndarray:
    """Flags of the bytes that make words once A-Z are lower-cased: digits, a-z and all beyond ASCII."""
    t = np.zeros(256, bool)
    t[0x30:0x3A] = t[0x61:0x7B] = t[0x80:] = True
    return t


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each word."""
    raw = np.frombuffer(ASCII_LOWER, np.uint8)[raw]
    starts, ends, row = token_spans(raw, offsets, word_table())
    return span_hashes(raw, starts, ends), row


def texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def bisect(values: np.ndarray, low: np.ndarray, high: np.ndarray, x: np.ndarray, right: bool = False) -> np.ndarray:
    """np.searchsorted within a range of its own for each x."""
    while (going := low < high).any():
        middle = (low + high) >> 1
        v = values[np.minimum(middle, len(values) - 1)]
        under = going & ((v <= x) if right else (v < x))
        low, high = np.where(under, middle + 1, low), np.where(going & ~under, middle, high)
    return low


class Bucket:
    """One bucket of the index, opened for search: terms, each with its lists by segment, each with its positions."""

    def __init__(self, uri: str, number: int):
        array = lambda name, kind: opened(uri).array(f"{name}-{number}", kind)
        self.terms, self.ends, self.names = array("terms", np.uint64), array("ends", np.int64), array("names", np.int64)
        self.segments, self.starts, self.positions = array("segments", np.uint32), array("starts", np.uint32), array("positions", np.uint32)

    def lists(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First list of each term and the one after its last."""
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        there = self.terms[at] == terms
        return np.where(there, self.ends[at], 0), np.where(there, self.ends[at + 1], 0)

    def list_of(self, terms: np.ndarray, segments: np.ndarray) -> np.ndarray:
        """The list of each term in each segment; -1 where there is none."""
        low, high = self.lists(terms)
        name = np.minimum(np.searchsorted(self.names, segments), len(self.names) - 1)
        at = bisect(self.segments, low, high, name)
        return np.where((self.names[name] == segments) & (at < high) & (self.segments[np.minimum(at, len(self.segments) - 1)] == name), at, -1)

    def has(self, lists: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether each list has a position between low and high."""
        own = np.maximum(lists, 0)
        a, z = self.starts[own].astype(np.int64), self.starts[own + 1].astype(np.int64)
        return (lists >= 0) & (bisect(self.positions, a, z, low) < bisect(self.positions, a, z, high, True))


class Index:
    """The positional index of a table of texts, which is to be one that is read the same way again if a task is lost: a stored one.

    documents: segment, doc_id, n_words, first (position of the first word); one row per input row.
    frequent: term, segment, n of the lists that are spread.
    """

    def __init__(self, docs: DataFrame, stage: Stage, id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = SEGMENT_BYTES, bucket_bytes: int = BUCKET_BYTES, most: int = BUCKETS, frequent: int = FREQUENT):
        own = texts_of(docs, id_col, text_col)
        size = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).head()[0]
        wanted = max(4, -(-size // bucket_bytes))
        self.shards, self.often, self.uri = -(-wanted // most), frequent, f"{stage.root}/postings"
        self.each = -(-wanted // self.shards)
        each, shards, uri = self.each, self.shards, self.uri

        def rows(batches):
            number = TaskContext.get().partitionId() << 24
            for b in batches:
                raw, at = text_buffer(b.column(1))
                for cut, to in slices(at, segment_bytes):
                    terms, row = word_hashes(raw[at[cut] : at[to]], at[cut : to + 1] - at[cut])
                    n_words = np.bincount(row, minlength=to - cut)
                    first = np.cumsum(n_words) - n_words + np.arange(to - cut) * GAP
                    order = np.argsort(terms, kind="stable")
                    kinds, counts = np.unique(terms[order], return_counts=True)
                    position = (order + row[order] * GAP).astype(np.uint32)
                    home = kinds >> np.uint64(20)
                    spread = counts > frequent
                    home = ((home + np.where(spread, np.uint64(number), np.uint64(0))) % np.uint64(each)).astype(np.int64)
                    by = np.argsort(home, kind="stable")
                    ends = np.cumsum(counts)
                    cuts = np.flatnonzero(np.concatenate([[True], np.diff(home[by]) != 0])) if len(by) else by
                    made: list[list] = [[] for _ in range(6)]
                    for a, z in zip(cuts, [*cuts[1:], len(by)]):
                        lists = by[a:z]
                        take = np.repeat(ends[lists] - np.cumsum(counts[lists]), counts[lists]) + np.arange(counts[lists].sum())
                        for column, v in zip(made, (int(number >> 24) % shards * each + int(home[lists[0]]), len(lists), len(take), squeeze(kinds[lists]), squeeze(counts[lists].astype(np.uint32)), squeeze(np.diff(position[take], prepend=np.uint32(0))))):
                            column.append(v)
                    of_docs = [[-1 - int(number >> 24)], [to - cut], [0], [None], [None], [None]]
                    made = [x + y for x, y in zip(of_docs, made)]
                    n, often = len(made[0]), np.flatnonzero(spread)
                    first_row = lambda v, kind: pa.array([v if i == 0 else None for i in range(n)], pa.list_(kind))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(made[0], pa.int32()), pa.array(np.full(n, number)), *(pa.array(x, pa.int64()) for x in made[1:3]), *(pa.array(x, pa.binary()) for x in made[3:]),
                         first_row(b.column(0).slice(cut, to - cut).to_pylist(), pa.int64()), first_row(n_words.tolist(), pa.int64()), first_row(first.tolist(), pa.int64()),
                         first_row(kinds[often].view(np.int64).tolist(), pa.int64()), first_row(counts[often].tolist(), pa.int64())],
                        ["bucket", "segment", "n_lists", "n", "terms", "counts", "positions", "ids", "words", "firsts", "often", "times"],
                    )
                    number += 1

        columns = ["ids", "words", "firsts", "often", "times"]
        lists = ", ".join(f"{c} array<long>" for c in columns)

        def store(key, t):
            b = key[0].as_py()
            if b < 0:  # the documents of one partition
                return t.select(["bucket", "segment", *columns])
            column = lambda c: t.column(c).to_pylist()
            sizes, n = column("n_lists"), column("n")
            terms = np.concatenate([unsqueeze(x, k, np.uint64) for x, k in zip(column("terms"), sizes)])
            counts = np.concatenate([unsqueeze(x, k, np.uint32) for x, k in zip(column("counts"), sizes)]).astype(np.int64)
            positions = np.concatenate([np.cumsum(unsqueeze(x, k, np.uint32), dtype=np.uint32) for x, k in zip(column("positions"), n)])
            segments = np.repeat(t.column("segment").to_numpy(), sizes)
            order = np.lexsort((segments, terms))
            ends, own = np.cumsum(counts), counts[order]
            take = np.repeat(ends[order] - np.cumsum(own), own) + np.arange(len(positions))
            kinds, ends_ = np.unique(terms[order], return_index=True)
            names, number = np.unique(segments[order], return_inverse=True)
            if len(positions) >= 1 << 32:
                raise ValueError("a bucket has too many postings: make buckets smaller")
            made = {"terms": kinds, "ends": np.append(ends_, len(order)), "names": names, "segments": number.astype(np.uint32), "starts": np.concatenate([[0], np.cumsum(own)]).astype(np.uint32), "positions": positions[take]}
            for name, x in made.items():
                opened(uri).write(f"{name}-{b}", x)
            none = pa.nulls(1, pa.list_(pa.int64()))
            return pa.table({"bucket": pa.array([b], pa.int32()), "segment": pa.nulls(1, pa.int64()), **dict.fromkeys(columns, none)})

        made = own.mapInArrow(trimmed(rows), f"bucket int, segment long, n_lists long, n long, terms binary, counts binary, positions binary, {lists}")
        read = stage.put(made.groupBy("bucket").applyInArrow(store, f"bucket int, segment long, {lists}"), "segments")
        self.buckets = frozenset(r.bucket for r in read.filter("bucket >= 0").select("bucket").collect())  # a number for each BUCKET_BYTES of text
        each_doc = F.explode(F.arrays_zip("ids", "words", "firsts")).alias("d")
        self.documents = read.filter("bucket < 0").select("segment", each_doc).select("segment", F.col("d.ids").alias("doc_id"), F.col("d.words").alias("n_words"), F.col("d.firsts").alias("first"))
        self.frequent = read.filter("bucket < 0 and size(often) > 0").select("segment", F.explode(F.arrays_zip("often", "times")).alias("o")).select(F.col("o.often").alias("term"), "segment", F.col("o.times").alias("n"))

    def shard(self, segment: str = "segment") -> Column:
        return F.expr(f"cast(shiftright({segment}, 24) % {self.shards} * {self.each} as int)")

    def home(self, term: str = "term") -> Column:
        return F.expr(f"cast(shiftrightunsigned({term}, 20) % {self.each} as int)")

    def away(self, term: str = "term", segment: str = "segment") -> Column:
        return F.expr(f"cast((shiftrightunsigned({term}, 20) + {segment}) % {self.each} as int)")

    def every_shard(self, terms: DataFrame) -> DataFrame:
        return terms.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(self.shards - 1)))).withColumn("bucket", F.col("shard") * self.each + self.home()).drop("shard")

    def asked(self, queries: DataFrame, answer, schema: str, *salt: Column) -> DataFrame:
        """answer(Bucket, batch) for the queries (with a column `bucket`) of each bucket that there is; they stream past it, in one task or, by salt, in several. Those of bucket -1 are passed on."""
        uri, there = self.uri, self.buckets

        def rows(batches):
            for b in batches:
                t = pa.Table.from_batches([b])
                number = t.column("bucket").to_numpy()
                for k in np.unique(number):
                    if int(k) in there or k < 0:
                        own = t.filter(pa.array(number == k))
                        yield from (own if k < 0 else answer(Bucket(uri, int(k)), own)).to_batches()

        return queries.repartition("bucket", *salt).mapInArrow(trimmed(rows), schema)

    def frequencies(self, terms: DataFrame) -> DataFrame:
        """term, n: how often each term occurs."""
        often = self.often

        def count(bucket, t):
            own = t.column("term").to_numpy().view(np.uint64)
            low, high = bucket.lists(own)
            sizes = np.diff(bucket.starts.astype(np.int64))
            upto = np.concatenate([[0], np.cumsum(np.where(sizes > often, 0, sizes))])
            return pa.table({"term": t.column("term"), "n": pa.array(upto[high] - upto[low])})

        spread = self.frequent.join(terms, "term", "left_semi").select("term", "n")
        return self.asked(self.every_shard(terms), count, "term long, n long").unionByName(spread).groupBy("term").agg(F.sum("n").alias("n")).filter("n > 0")

    def postings(self, terms: DataFrame) -> DataFrame:
        """term, segment, at (positions): the lists of each term."""
        often = self.often

        def fetch(bucket, t):
            term, segment = t.column("term").to_numpy().view(np.uint64), t.column("segment")
            low, high = bucket.lists(term)
            found: list[list] = [[], [], []]
            for x, s, a, z in zip(term.view(np.int64).tolist(), segment.to_pylist(), low.tolist(), high.tolist()):
                for k in range(a, z):
                    n, name = int(bucket.starts[k + 1]) - int(bucket.starts[k]), int(bucket.names[bucket.segments[k]])
                    if (n <= often) if s is None else name == s:
                        for column, v in zip(found, (x, name, bucket.positions[bucket.starts[k] : bucket.starts[k + 1]].astype(np.int64))):
                            column.append(v)
            return pa.table({"term": pa.array(found[0], pa.int64()), "segment": pa.array(found[1], pa.int64()), "at": pa.array(found[2], pa.list_(pa.int64()))})

        plain = self.every_shard(terms.withColumn("segment", F.lit(None).cast("long")))
        spread = self.frequent.join(terms, "term", "left_semi").select("term", "segment").withColumn("bucket", self.shard() + self.away())
        return self.asked(plain.unionByName(spread), fetch, "term long, segment long, at array<long>")

    def met(self, places: DataFrame, term: Column, offset: Column, span: int | None) -> DataFrame:
        """places (segment, at, exact and more) which have the term at `at` + offset, or within span words; exact: as before, and at `at` + offset. Without a term they stay."""
        own = places.withColumn("term", term).withColumn("offset", offset)
        either = F.array_distinct(F.array(self.shard() + self.home(), self.shard() + self.away()))  # a list is in one of the two
        own = own.withColumn("bucket", F.explode(F.when(F.col("term").isNull(), F.array(F.lit(-1))).otherwise(either)))

        def look(bucket, t):
            lists = bucket.list_of(t.column("term").to_numpy().view(np.uint64), t.column("segment").to_numpy())
            at, offset_ = t.column("at").to_numpy(), t.column("offset").to_numpy()
            here = bucket.has(lists, at + offset_, at + offset_)
            kept = here & t.column("exact").to_numpy(zero_copy_only=False) if span is None else bucket.has(lists, at - span, at + span)
            exact = pa.array(here & t.column("exact").to_numpy(zero_copy_only=False))
            k = t.schema.get_field_index("exact")
            return t.set_column(k, t.schema.field(k), exact).filter(pa.array(kept))

        return self.asked(own, look, _ddl(own), F.pmod(F.xxhash64("segment"), F.lit(SALT))).drop("term", "offset", "bucket")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)


def phrases_of(items: DataFrame, stage: Stage, window: int = WINDOW, item_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """phrases (p, terms): the different ones. members (p, item_id): whose they are; an item's id may be null.

    A phrase is `window` consecutive words of an item; an item of fewer words, but not none, is one phrase.
    """

    def rows(batches):
        for b in batches:
            raw, at = text_buffer(b.column(1))
            terms, row = word_hashes(raw, at)
            cut = np.searchsorted(row, np.arange(len(at)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([terms[a:z].view(np.int64) for a, z in zip(cut[:-1], cut[1:])], pa.list_(pa.int64()))], ["item_id", "words"])

    own = items.select(F.col(item_col).cast("string").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    words = own.mapInArrow(trimmed(rows), "item_id string, words array<long>").filter("size(words) > 0")
    each = words.select("item_id", F.explode(F.expr(f"transform(sequence(0, greatest(0, size(words) - {window})), i -> slice(words, i + 1, {window}))")).alias("terms"))
    each = stage.put(each.distinct(), "windows")
    phrases = stage.put(each.select("terms").distinct().withColumn("p", F.monotonically_increasing_id()), "phrases")
    return phrases, each.join(phrases, "terms").select("p", "item_id")


def search(index: Index, phrases: DataFrame, stage: Stage, span: int | None = None) -> DataFrame:
    """segment, p, start, length: places of phrases, as positions. With span: also, of length 0, places of the rarest term with all others within span."""
    if span is not None and span >= GAP:
        raise ValueError(f"the span has to be below {GAP}")
    term = F.posexplode("terms").alias("offset", "term")
    vocabulary = phrases.select(F.explode("terms").alias("term")).distinct()
    known = phrases.select("p", term).join(index.frequencies(vocabulary), "term")
    ordered = known.groupBy("p").agg(F.array_sort(F.collect_list(F.struct("n", "offset", "term"))).alias("o"))
    ordered = ordered.join(phrases.select("p", F.size("terms").alias("length")), "p").filter("size(o) = length").select("p", "length", F.expr("transform(o, x -> x.term)").alias("terms"), F.expr("transform(o, x -> x.offset - o[0].offset)").alias("offsets"), F.expr("o[0].offset").alias("rarest"))
    ordered = stage.put(ordered, "ordered")
    lists = index.postings(ordered.select(F.col("terms")[0].alias("term")).distinct())
    places = lists.join(ordered.withColumn("term", F.col("terms")[0]), "term").select("segment", F.explode("at").alias("at"), "p", "length", "terms", "offsets", "rarest", F.lit(True).alias("exact"))
    for k in (1, 2):  # by themselves: they leave next to nothing but matches
        places = index.met(places, F.get("terms", F.lit(k)), F.get("offsets", F.lit(k)), span)
    rest = places.select("segment", "at", "p", "length", "rarest", "exact", F.explode_outer(F.expr("slice(arrays_zip(terms, offsets), 4, length)")).alias("x"))
    rest = index.met(rest, F.col("x.terms"), F.col("x.offsets"), span).groupBy("segment", "at", "p", "length", "rarest").agg(F.count(F.lit(1)).alias("n"), F.min("exact").alias("exact"))
    found = stage.put(rest.filter("n = greatest(length - 3, 1)"), "found")
    here = found.filter("exact").select("segment", "p", (F.col("at") - F.col("rarest")).alias("start"), F.col("length").cast("long").alias("length"))
    if span is not None:
        here = here.unionByName(found.select("segment", "p", F.col("at").alias("start"), F.lit(0).cast("long").alias("length")))
    return here


def hits_of(index: Index, found: DataFrame) -> DataFrame:
    """found with `first`, the position of its document's first word."""
    last = f"shiftright(first + n_words - 1, {BLOCK})"
    where = index.documents.filter("n_words > 0").select("segment", "first", "n_words", F.explode(F.expr(f"sequence(shiftright(first, {BLOCK}), {last})")).alias("block"))
    return found.withColumn("block", F.shiftright("start", BLOCK)).join(where, ["segment", "block"]).filter("start between first and first + n_words - 1").drop("block", "n_words")


def islands(spans: DataFrame, *keys: str) -> DataFrame:
    """keys, start, end: spans (start, length) that touch or overlap as one."""
    own = Window.partitionBy(*keys)
    by = own.orderBy("start", "end")
    df = spans.withColumn("end", F.col("start") + F.col("length")).withColumn("before", F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1)))
    df = df.withColumn("island", F.sum(F.when(F.col("before") >= F.col("start"), 0).otherwise(1)).over(by))
    return df.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, span: int | None = None, id_col: str = "doc_id", text_col: str = "text", **sizes) -> DataFrame:
    """One row per document: doc_id, n_words, matches (item_id, start, length in words), by start.

    Exact: runs of words covered by an item's phrases. With `span`: also, as a match of length 0, each place of a phrase's
    rarest word that has all its other words within that many words before or after, in any order.

    Null texts and texts without a word have no words and no matches. Repeated documents and items are answered each by
    itself. Ids of documents and items may be null. Empty tables are answered: no documents no rows, no items no matches.
    """
    stage = Stage(docs.sparkSession, "decontaminate")
    index = Index(docs, stage, id_col, text_col, **sizes)
    phrases, members = phrases_of(items, stage, window)
    found = stage.put(hits_of(index, search(index, phrases, stage, span)).join(members, "p"), "hits")
    exact = islands(found.filter("length > 0"), "segment", "first", "item_id").withColumn("length", F.col("end") - F.col("start"))
    each = exact.drop("end").unionByName(found.filter("length = 0").select("segment", "first", "item_id", "start", "length").distinct())
    lists = each.groupBy("segment", "first").agg(F.array_sort(F.collect_list(F.struct((F.col("start") - F.col("first")).alias("start"), "length", "item_id"))).alias("m"))
    out = "transform(coalesce(m, array()), x -> named_struct('item_id', x.item_id, 'start', x.start, 'length', x.length))"
    return index.documents.join(lists, ["segment", "first"], "left").select("doc_id", "n_words", F.expr(out).alias("matches"))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = 20, span: int | None = None, id_col: str = "doc_id", text_col: str = "text", **sizes) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest_hit, n_near.

    n_hit counts words inside any match, longest_hit those of the longest run; contaminated: any are, and at least one word
    in `share`. n_near: places where a phrase's words stand within `span` words of its rarest, 0 if no span is given. Items
    without an id count for n_hit, and all together as one of n_items; they have no id to be part of items_sha256.

    Null texts and texts without a word have no words, and no hits. Repeated documents are answered each by itself, repeated
    items are one. Null document ids are kept. No documents no rows, no items no hits.
    """
    stage = Stage(docs.sparkSession, "decontaminate")
    index = Index(docs, stage, id_col, text_col, **sizes)
    phrases, members = phrases_of(items, stage, window)
    found = stage.put(hits_of(index, search(index, phrases, stage, span)), "hits")
    place = ["segment", "first"]
    exact = found.filter("length > 0")
    size = F.col("end") - F.col("start")
    words = islands(exact.select(*place, "start", "length").distinct(), *place).groupBy(*place).agg(F.sum(size).alias("n_hit"), F.max(size).alias("longest_hit"))
    ids = exact.select(*place, "p").distinct().join(members, "p").groupBy(*place).agg(F.collect_set("item_id").alias("ids"), F.max(F.col("item_id").isNull()).alias("nameless"))
    hit = words.join(ids, place)
    if span is not None:
        near = found.filter("length = 0").select(*place, "start").distinct().groupBy(*place).agg(F.count(F.lit(1)).alias("n_near"))
        hit = hit.join(near, place, "full_outer")
    else:
        hit = hit.withColumn("n_near", F.lit(0))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    ids_ = F.coalesce("ids", F.array().cast("array<string>"))
    return index.documents.join(hit, place, "left").select(
        "doc_id", "n_words", zero("n_hit").alias("n_hit"), (F.size(ids_) + F.coalesce(F.col("nameless"), F.lit(False)).cast("int")).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(ids_), ","), 256).alias("items_sha256"), ((zero("n_hit") > 0) & (zero("n_hit") * share >= F.col("n_words"))).alias("contaminated"),
        zero("longest_hit").alias("longest_hit"), zero("n_near").alias("n_near"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, share: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows and columns without documents that have a match with an item, however long they are; each row has its own decision.

    With `share`: without those of which at least one word in so many is inside a match. Rows with a null or empty text stay;
    repeated rows go or stay together; without items all stay; an empty table stays empty.
    """
    keyed = docs.select(row_key(id_col, text_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = contamination(keyed, items, share=share or 1)
    return drop_rows(docs, found.filter("n_hit > 0" if share is None else "contaminated").select("doc_id"), Stage(docs.sparkSession, "decontaminate"), id_col, text_col)
