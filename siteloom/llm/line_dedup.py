"""Near-equal lines by a segment-partition edit join, in DataFrame functions only.

A line is cut into threshold + 1 segments. Two lines within the threshold share a segment of the shorter one, at a place
that the edits before it bound. Every distinct line files its segments in an index and probes it with the substrings that
could be a segment of a line as long or shorter; what meets is verified by a banded bit-parallel edit distance. Hashes are
dealt out, and texts only for candidate pairs and for lines that share a segment with several others.

With `grow` the threshold follows the length: one edit from 5 characters, two from 20, and a tenth of the shorter line where
about its first or its last third is the same in both. These thirds are keys of their own, cut to a few lengths.

Groups of near copies are not written out as pairs. Of many lines that share a third, the one with most copies is the center
of a star, and each line of a star knows its distance from the center. Two of them whose distances add up to no more than
either's threshold are linked, by the triangle inequality. A line is in one star at most, so such links are counted from how
many lines a star has at each distance. Pairs are verified and written for what is left.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.llm.common import Stage, fresh_name, row_key

#: Edits within which lines are linked, and characters from which a line is long enough for that to mean something.
EDITS, LEAST = 2, 20
#: With `grow`: characters from which one edit links, and the part of a line's length that may differ.
SHORT, PART = 5, 10
#: Lines that share a segment from which they are verified as they meet; keys that are sent to every executor, 16 MB of longs.
LARGE, SEND = 4, 2_000_000
#: Lines that share a third from which cores are looked for, how often among what is left, and the part of the center's length
#: that a core's lines may differ from it in: twice that is no more than a PART of the shortest one's.
CROWD, ROUNDS, RADIUS = 16, 3, 2 * PART + 1
#: Steps in which distances from a star's center are told apart, up to the threshold of its length; at most twice as many.
STEPS = 32


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """doc_id, line_no (from 0), line for each line that isn't blank, and further columns."""
    split = F.posexplode(F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "\n", -1)).alias("line_no", "line")
    return docs.select(F.col(id_col).alias("doc_id"), *more, split).filter(~F.col("line").rlike(r"\A\s*\z"))


def entries(edits: int) -> list[tuple[int, int, int]]:
    """(shorter by, segment, shift) of the substrings that have to be looked up: those whose edits on either side can add up to no more than allowed."""
    out = []
    for delta in range(edits + 1):
        for i in range(edits + 1):
            for shift in range(max(-i, delta - (edits - i)), min(i, delta + edits - i) + 1):
                out.append((delta, i, shift))
    return out


def keyed(lines: DataFrame, edits: int, least: int, probe: bool, below: int | None = None, middle: bool = False) -> DataFrame:
    """key, id, line, n, spot, shorter for the segments that a line files, or for the substrings that it looks up. The shorter line has from `least` to under `below` characters.

    middle: of two edits the segment between them alone, for lines that share neither third: there one edit lies in either.
    """
    wanted = [x for x in (entries(edits) if probe else [(0, i, 0) for i in range(edits + 1)]) if not middle or x[1] == 1]
    each = ", ".join(f"named_struct('d', {d}, 'i', {i}, 's', {s})" for d, i, s in wanted)
    df = lines.select("id", "line", "n", "spot", F.explode(F.expr(f"array({each})")).alias("e")).withColumn("m", F.expr("cast(n - e.d as int)"))
    parts = edits + 1
    place, long = f"cast(m * e.i div {parts} + e.s as int)", f"cast(m * (e.i + 1) div {parts} - m * e.i div {parts} as int)"
    df = df.filter(f"m >= {least}{f' and m < {below}' if below else ''} and {place} >= 0 and {place} + {long} <= n")
    return df.select(F.expr(f"xxhash64(m, e.i, substring(line, {place} + 1, {long}))").alias("key"), "id", "line", "n", "spot", F.expr("cast(e.d as byte)").alias("shorter"))


def third(m: str) -> str:
    """SQL for about a third of m, which lengths within a sixteenth to an eighth have in common."""
    step = f"cast(shiftleft(1L, greatest(0, cast(floor(log2({m})) as int) - 3)) as int)"
    return f"cast({m} div {step} * {step} div 3 as int)"


def ends_keyed(lines: DataFrame, probe: bool) -> DataFrame:
    """keyed() for the first and the last third of lines that may differ in more than EDITS; `shorter` is -1 for the first, -2 for the last."""
    wide = lines.filter(F.col("n") >= PART * (EDITS + 1))
    sizes = f"array_distinct(transform(sequence(0, 4), j -> {third(f'(n - (n div {PART}) * j div 4)')}))" if probe else f"array({third('n')})"
    ends = "array(named_struct('e', 0, 't', left(line, a)), named_struct('e', 1, 't', right(line, a)))"
    df = wide.select("id", "line", "n", "spot", F.explode(F.expr(sizes)).alias("a")).select("id", "line", "n", "spot", "a", F.explode(F.expr(ends)).alias("e"))
    return df.select(F.expr("xxhash64('end', a, e.e, e.t)").alias("key"), "id", "line", "n", "spot", F.expr("cast(-1 - e.e as byte)").alias("shorter"))


def core_keys(lines: DataFrame) -> DataFrame:
    """lines that may differ in more than EDITS, with a key for each third at either end, in two sets of length bands whose borders lie apart.

    Lines with a key in common have the same characters there over a third of the longest line that the band takes.
    """
    power = lambda x: f"cast(shiftleft(1L, greatest(0, length(bin({x})) - 3)) as int)"
    wide = lines.filter(F.col("n") >= PART * (EDITS + 1)).withColumn("s", F.expr(f"array({power('n')}, {power('n * 16 div 15')})"))
    bands = "array(named_struct('lo', n div s[0] * s[0], 's', s[0]), named_struct('lo', (n + s[1] div 2) div s[1] * s[1] - s[1] div 2, 's', s[1]))"
    df = wide.select(*lines.columns, F.posexplode(F.expr(bands)).alias("band", "b")).withColumn("a", F.expr(third("(b.lo + b.s - 1)")))
    df = df.select(*lines.columns, "band", "b", "a", F.explode(F.expr("array(named_struct('e', 0, 't', left(line, a)), named_struct('e', 1, 't', right(line, a)))")).alias("e"))
    return df.select(F.expr("xxhash64('core', band, b.lo, a, e.e, e.t)").alias("key"), F.expr("shiftleft(1, 2 * band + e.e)").alias("kind"), *lines.columns)


def cores_of(classes: DataFrame, stage: Stage) -> DataFrame | None:
    """id, first, cores: the cores of each line that is in any; None where no lines crowd. Any two lines of a core are linked."""
    lines = core_keys(classes)
    crowded = stage.put(lines.groupBy("key").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") >= CROWD).select("key"), "crowded")
    if not (n := crowded.limit(SEND + 1).count()):
        return None
    rest = stage.put(lines.join(F.broadcast(crowded) if n <= SEND else crowded, "key"), "crowd", compression="zstd")
    found = []
    for _ in range(ROUNDS):
        # the line with most copies is most often what the others were made from
        center = rest.groupBy("key").agg(F.max(F.struct("copies", "id")).alias("c"), F.count(F.lit(1)).alias("k")).filter(F.col("k") >= CROWD).select("key", F.col("c.id").alias("id"))
        center = stage.put(rest.join(center, ["key", "id"]).select("key", F.col("id").alias("c_id"), F.col("line").alias("c_line"), F.col("n").alias("c_n")), "centers", compression="zstd")
        if center.head() is None:
            break
        near = F.expr(f"abs(n - c_n) <= c_n div {RADIUS} and levenshtein(line, c_line, c_n div {RADIUS}) >= 0")
        found.append(stage.put(rest.join(center, "key").filter(near).select("key", "id", "first", F.xxhash64("key", "c_id").alias("core")), "core"))
        before, rest = rest, stage.put(rest.join(found[-1], ["key", "id"], "left_anti"), "crowd", compression="zstd")
        stage.drop(before, center)
    if not found:
        return None
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return stage.put(every.groupBy("id").agg(F.min("first").alias("first"), F.array_sort(F.collect_set("core")).alias("cores")), "cores")


def core_links(cores: DataFrame) -> DataFrame:
    """id, n_links, earlier: to how many lines that share a core with it a line is linked, and whether one of them comes earlier."""
    some = "explode(transform(sequence(1, cast(shiftleft(1, size(cores)) - 1 as int)), b -> named_struct('of', filter(cores, (c, i) -> shiftright(b, i) % 2 = 1), 'sign', if(bit_count(b) % 2 = 1, 1, -1))))"
    sets = cores.select("id", "first", F.expr(some).alias("x")).select("id", "first", F.xxhash64("x.of").alias("set"), "x.sign")
    counted = sets.groupBy("set").agg(F.count(F.lit(1)).alias("k"), F.min("first").alias("least"))
    out = sets.join(counted, "set").groupBy("id").agg((F.sum(F.col("sign") * F.col("k")) - 1).alias("n_links"), F.max(F.col("least") < F.col("first")).alias("earlier"))
    return out.filter("n_links > 0")


def stars_of(classes: DataFrame, stage: Stage) -> DataFrame | None:
    """id, first, star, kinds, far, most for each line that is in a star; None where no lines crowd.

    star: its center's id. kinds: bits for which of the center's thirds it has (core_keys). far, most: its distance from the
    center and the edits that its length allows, in steps of the star, the first rounded up and the second down.
    """
    lines = core_keys(classes)
    crowded = stage.put(lines.groupBy("key").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") >= CROWD).select("key"), "crowded")
    if not (n := crowded.limit(SEND + 1).count()):
        return None
    rest = stage.put(lines.join(F.broadcast(crowded) if n <= SEND else crowded, "key"), "crowd", compression="zstd")
    found = []
    for _ in range(ROUNDS):
        # the line with most copies is most often what the others were made from
        center = rest.groupBy("key").agg(F.max(F.struct("copies", "id")).alias("c"), F.count(F.lit(1)).alias("k")).filter(F.col("k") >= CROWD).select("key", F.col("c.id").alias("id"))
        center = stage.put(rest.join(center, ["key", "id"]).select("key", F.col("id").alias("star"), F.col("line").alias("c_line"), F.col("n").alias("c_n")), "centers", compression="zstd")
        if not (n := center.limit(SEND // 100 + 1).count()):
            break
        texts = center.dropDuplicates(["star"]).drop("key")
        keys, texts = (F.broadcast(x) if n <= SEND // 100 else x for x in (center.select("key", "star"), texts))
        near = rest.join(keys, "key").groupBy("id", "star").agg(F.sum("kind").cast("int").alias("kinds"), *(F.first(c).alias(c) for c in ("line", "n", "first")))
        # stored before it is filtered, lest the distance is worked out for each place that refers to it
        near = stage.put(near.join(texts, "star").select("id", "first", "star", "kinds", "n", "c_n", F.expr(far_from("line", "c_line")).alias("far")), "far").filter("far >= 0")
        step = f"greatest(1, c_n div {PART * STEPS})"
        near = stage.put(near.selectExpr("id", "first", "star", "kinds", f"cast((far + {step} - 1) div {step} as int) as far", f"cast(n div {PART} div {step} as int) as most"), "near")
        # of several centers that of the most lines, so that a group stays together
        size = near.groupBy("star").agg(F.count(F.lit(1)).alias("size"))
        found.append(stage.put(near.join(F.broadcast(size) if n <= SEND // 100 else size, "star").groupBy("id").agg(F.max_by(F.struct("first", "star", "kinds", "far", "most"), F.struct("size", "star")).alias("s")).select("id", "s.*"), "star"))
        before, rest = rest, stage.put(rest.join(found[-1].select("id"), "id", "left_anti"), "crowd", compression="zstd")
        stage.drop(before, center, near)
    return reduce(DataFrame.unionByName, found) if found else None


def far_from(a: str, b: str) -> str:
    """SQL for the edit distance of a and b up to a PART of the shorter one's length, else -1. What both have at either end is cut off first."""
    led = f"transform(array(named_struct('a', {a}, 'b', {b}, 'm', least(length({a}), length({b})))), z -> named_struct('a', z.a, 'b', z.b, 'm', z.m, 'lead', {common('z.a', 'z.b', 'z.m', False)}))"
    both = f"transform({led}, z -> named_struct('a', z.a, 'b', z.b, 'm', z.m, 'lead', z.lead, 'tail', {common('z.a', 'z.b', '(z.m - z.lead)', True)}))"
    cut = lambda x: f"substring(z.{x}, z.lead + 1, length(z.{x}) - z.lead - z.tail)"
    return f"transform({both}, z -> if(abs(length(z.a) - length(z.b)) > z.m div {PART}, -1, levenshtein({cut('a')}, {cut('b')}, cast(z.m div {PART} as int))))[0]"


def in_star(u: str, v: str) -> str:
    """SQL for whether the spots u and v are of one star and so near its center that their lines are linked."""
    return f"coalesce({u}.star = {v}.star and ({u}.kinds & {v}.kinds) <> 0 and {u}.far + {v}.far <= least({u}.most, {v}.most), false)"


def star_links(stars: DataFrame) -> DataFrame:
    """id, n_links, earlier: to how many lines a line is linked by in_star(), and whether one of them comes earlier.

    Lines alike in kinds, far and most are counted together: a star has 15 * 2 STEPS * STEPS / 2 such cells at most, however many its lines.
    """
    cell = ["star", "kinds", "far", "most"]
    cells = stars.groupBy(*cell).agg(F.count(F.lit(1)).alias("k"), F.min("first").alias("least"))
    add = f"if({in_star('x', 'y')}, named_struct('n', s.n + y.k, 'least', least(s.least, y.least)), s)"
    each = f"transform(c, x -> struct(x as of, aggregate(c, named_struct('n', 0L, 'least', cast(null as decimal(38, 0))), (s, y) -> {add}) as got))"
    counted = cells.groupBy("star").agg(F.collect_list(F.struct(*cell, "k", "least")).alias("c")).select(F.explode(F.expr(each)).alias("e")).select(*(f"e.of.{x}" for x in cell), "e.got.*")
    own = "if(2 * far <= most, 1, 0)"
    return stars.join(counted, cell).select("id", F.expr(f"n - {own}").alias("n_links"), F.expr("coalesce(least < first, false)").alias("earlier")).filter("n_links > 0")


def place_of(doc: str, line: str):
    """The place of a line as one number that sorts as (doc_id, line_no), null first. A number, so that its minimum is taken without a sort."""
    return F.expr(f"cast(coalesce(cast({doc} as decimal(20, 0)) + 9223372036854775809, 0) as decimal(20, 0)) * 2147483648 + {line}").cast("decimal(38, 0)")


def banded_distance(a: str, b: str, edits: int) -> str:
    """SQL for the edit distance of a and b, where a is as long or longer, if it is at most `edits`; else more than that.

    One machine word holds the band of 2 * edits + 1 differences around the diagonal; each character of b moves it down by
    one with a handful of bit operations, as in the bit-parallel recurrences for a band that slides along the diagonal.
    """
    w = 2 * edits + 2
    full = (1 << w) - 1
    start = ((1 << (edits + 1)) - 1) << (w - edits - 1)
    chars = f"concat(array_repeat('', {w}), split({a}, ''), array_repeat('', {w}))"
    equal = " + ".join(f"if(p[i + {edits + 1 + j}] = q[i], {1 << j}L, 0L)" for j in range(w))
    horizontal, below = f"({w - 2} - (i - la + {edits}))", f"i < la - {edits}"
    hp, hn = f"((s.vn | ~(d | s.vp)) & {full}L)", "(d & s.vp)"
    step = f"if({below}, s.k + if((d & {1 << (w - 1)}L) = 0, 1, 0), s.k + if((shiftright({hp}, {horizontal}) & 1L) = 1, 1, 0) - if((shiftright({hn}, {horizontal}) & 1L) = 1, 1, 0))"
    new = f"named_struct('vp', ({hn} | ~(shiftright(d, 1) | {hp})) & {full}L, 'vn', shiftright(d, 1) & {hp}, 'k', {step})"
    zero = f"(((((x & s.vp) + s.vp) ^ s.vp) | x | s.vn) & {full}L)"
    merge = f"transform(array({equal}), x -> transform(array({zero}), d -> {new})[0])[0]"
    run = f"aggregate(sequence(0, lb - 1), named_struct('vp', {start}L, 'vn', 0L, 'k', least(la, {edits})), (s, i) -> {merge}, s -> s.k)"
    bound = f"transform(array(named_struct('p', {chars}, 'q', split({b}, ''), 'la', length({a}), 'lb', length({b}))), v -> {run})[0]"
    for name in ("p", "q", "la", "lb"):
        bound = _qualify(bound, name)
    return f"if(length({a}) - length({b}) > {edits}, {edits + 1}, if(length({b}) = 0, length({a}), {bound}))"


def _qualify(sql: str, name: str) -> str:
    import re

    return re.sub(rf"(?<![\w.'])\b{name}\b(?![\w'(])", f"v.{name}", sql)


def common(a: str, b: str, most: str, end: bool) -> str:
    """SQL for how many characters a and b have in common at the start, or at the end, `most` at most: by halving steps."""
    steps = ", ".join(str(1 << k) for k in range(30, -1, -1))
    piece = (lambda x: f"substring({x}, length({x}) - g - h + 1, h)") if end else (lambda x: f"substring({x}, g + 1, h)")
    return f"aggregate(array({steps}), 0, (g, h) -> if(h <= {most} - g, if({piece(a)} = {piece(b)}, g + h, g), g))"


def within(a: str, b: str, edits: int) -> str:
    """SQL for whether a (as long or longer) and b are within the threshold. What both have at either end is cut off first.

    One nested expression, each step of which hands its results on inside a struct: as columns they would be worked out
    again wherever a filter that is pushed down refers to them.
    """
    led = f"transform(array(named_struct('a', {a}, 'b', {b})), z -> named_struct('a', z.a, 'b', z.b, 'lead', {common('z.a', 'z.b', 'length(z.b)', False)}))"
    both = f"transform({led}, z -> named_struct('a', z.a, 'b', z.b, 'lead', z.lead, 'tail', {common('z.a', 'z.b', '(length(z.b) - z.lead)', True)}))"
    left = f"transform({both}, z -> named_struct('x', substring(z.a, z.lead + 1, length(z.a) - z.lead - z.tail), 'y', substring(z.b, z.lead + 1, length(z.b) - z.lead - z.tail)))"
    if edits <= 2:  # what is left begins and ends with an edit, so that all between is the same
        left = f"filter({left}, z -> length(z.x) < 3 or contains(z.y, substring(z.x, 3, length(z.x) - 4)))"
    return f"size(filter({left}, z -> {banded_distance('z.x', 'z.y', edits)} <= {edits})) > 0"


def within_part(a: str, b: str) -> str:
    """SQL for whether a (as long or longer) and b are within the threshold that follows the length of b."""
    led = f"transform(array(named_struct('a', {a}, 'b', {b}, 'm', length({b}))), z -> named_struct('a', z.a, 'b', z.b, 'm', z.m, 'lead', {common('z.a', 'z.b', 'z.m', False)}))"
    both = f"transform({led}, z -> named_struct('a', z.a, 'b', z.b, 'm', z.m, 'lead', z.lead, 'tail', {common('z.a', 'z.b', '(z.m - z.lead)', True)}))"
    most = f"if(z.m < {SHORT}, 0, if(z.m < {LEAST}, 1, if(greatest(z.lead, z.tail) >= {third('z.m')}, greatest({EDITS}, cast(z.m div {PART} as int)), {EDITS})))"
    left = f"transform({both}, z -> named_struct('x', substring(z.a, z.lead + 1, length(z.a) - z.lead - z.tail), 'y', substring(z.b, z.lead + 1, z.m - z.lead - z.tail), 'k', {most}))"
    left = f"filter({left}, z -> length(z.x) - length(z.y) <= z.k)"
    return f"size(filter({left}, z -> levenshtein(z.x, z.y, z.k) >= 0)) > 0"


def within_few(a: str, b: str) -> str:
    """SQL for whether a (as long or longer) and b are 1 edit apart, or 2 where both are long enough, whatever they share."""
    led = f"transform(array(named_struct('a', {a}, 'b', {b}, 'm', length({b}))), z -> named_struct('a', z.a, 'b', z.b, 'm', z.m, 'lead', {common('z.a', 'z.b', 'z.m', False)}))"
    both = f"transform({led}, z -> named_struct('a', z.a, 'b', z.b, 'm', z.m, 'lead', z.lead, 'tail', {common('z.a', 'z.b', '(z.m - z.lead)', True)}))"
    left = f"transform({both}, z -> named_struct('x', substring(z.a, z.lead + 1, length(z.a) - z.lead - z.tail), 'y', substring(z.b, z.lead + 1, z.m - z.lead - z.tail), 'k', if(z.m < {LEAST}, 1, {EDITS})))"
    left = f"filter({left}, z -> length(z.x) < 3 or contains(z.y, substring(z.x, 3, length(z.x) - 4)))"
    return f"size(filter({left}, z -> levenshtein(z.x, z.y, z.k) >= 0)) > 0"


def verified(pairs: DataFrame, edits: int, grow: bool = False) -> DataFrame:
    """Of pairs with the lines a (as long or longer) and b, those within the threshold."""
    return pairs.filter(F.expr(within_part("a", "b") if grow else within("a", "b", edits)))


def line_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, least: int = LEAST, grow: bool = False) -> tuple[DataFrame, DataFrame]:
    """Classes of equal lines, and the links between different ones.

    classes: id (a 64-bit hash of the line), line, n (characters), copies, first (place_of the first copy).
    links: u, v: ids of lines of `least` characters or more that are 1 to `edits` edits apart, the longer one first; each pair once.
    grow: the threshold follows the length instead; `edits` and `least` are then not looked at.
    """
    stage = Stage(docs.sparkSession, "line-dedup")
    classes = classes_of(docs, id_col, text_col, stage)
    return classes, pair_links(classes, None, stage, edits, least, grow)


def counted_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """line_links() with `grow`, as classes, cores (cores_of) and the links between lines that share no core."""
    stage = Stage(docs.sparkSession, "line-dedup")
    classes = classes_of(docs, id_col, text_col, stage)
    cores = cores_of(classes, stage)
    spots = None if cores is None else cores.select("id", F.col("cores").alias("spot"))
    return classes, cores, pair_links(classes, spots, stage, grow=True, together=lambda u, v: f"coalesce(arrays_overlap({u}, {v}), false)")


def star_counted_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """line_links() with `grow`, as classes, stars (stars_of) and the links that in_star() doesn't tell."""
    stage = Stage(docs.sparkSession, "line-dedup")
    classes = classes_of(docs, id_col, text_col, stage)
    stars = stars_of(classes, stage)
    spots = None if stars is None else stars.select("id", F.struct("star", "kinds", "far", "most").alias("spot"))
    return classes, stars, pair_links(classes, spots, stage, grow=True)


def classes_of(docs: DataFrame, id_col: str, text_col: str, stage: Stage) -> DataFrame:
    """The classes of line_links()."""
    own = lines_of(docs, id_col, text_col).withColumn("place", place_of("doc_id", "line_no")).groupBy("line").agg(F.count(F.lit(1)).alias("copies"), F.min("place").alias("first"))
    return stage.put(own.select(F.xxhash64("line").alias("id"), "line", F.length("line").alias("n"), "copies", "first"), "classes", compression="zstd")


def pair_links(classes: DataFrame, spots: DataFrame | None, stage: Stage, edits: int = EDITS, least: int = LEAST, grow: bool = False, together: Callable[[str, str], str] = in_star) -> DataFrame:
    """The links of line_links() as pairs, without those that two lines' spots (id, spot) tell by `together`."""
    lines = classes.select("id", "line", "n")
    if spots is None:
        lines = lines.withColumn("spot", F.lit(None).cast("struct<star: bigint, kinds: int, far: int, most: int>"))
        together = in_star
    elif spots.limit(SEND // 10 + 1).count() <= SEND // 10:
        lines = lines.join(F.broadcast(spots), "id", "left")
    else:
        lines = stage.put(lines.join(spots, "id", "left"), "lines", compression="zstd")
    if grow:
        wide = PART * (EDITS + 1)
        parts = lambda x: (keyed(lines.filter(f"n between {SHORT} and {LEAST}"), 1, SHORT, x, LEAST), keyed(lines.filter(f"n between {LEAST} and {wide + 1}"), EDITS, LEAST, x, wide), keyed(lines.filter(F.col("n") >= wide), EDITS, wide, x, middle=True), ends_keyed(lines, x))
        filed, asked = (reduce(DataFrame.unionByName, parts(x)) for x in (False, True))
    else:
        long = lines.filter(F.col("n") >= least)
        filed, asked = keyed(long, edits, least, False), keyed(long, edits, least, True)

    # Where many lines share a segment, they take their text along and are verified as they meet: pairs that fail are never
    # made. Lines that have a spot always do. Elsewhere hashes go alone, and texts are fetched for the few pairs that met.
    large = stage.put(filed.groupBy("key").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") >= LARGE).select("key", F.lit(True).alias("large")), "large")
    large = F.broadcast(large) if large.limit(SEND + 1).count() <= SEND else large
    filed, asked = (df.join(large, "key", "left").withColumn("own", F.expr("if(large or spot is not null, line, null)")) for df in (filed, asked))
    filed = filed.select("key", F.col("id").alias("v"), F.col("n").alias("v_n"), F.col("own").alias("v_own"), F.col("spot").alias("v_spot"))
    asked = asked.select("key", F.col("id").alias("u"), F.col("n").alias("u_n"), F.col("own").alias("u_own"), F.col("spot").alias("u_spot"), "shorter")
    near = within("u_own", "v_own", edits)
    if grow:
        # Long lines that share a third meet by it, by the first if they share both, and are held against the wider threshold
        # there alone.
        part = third("v_n")
        led, ended, long = f"left(u_own, {part}) = left(v_own, {part})", f"right(u_own, {part}) = right(v_own, {part})", f"v_n >= {wide}"
        near = f"if(shorter = -1, {within_part('u_own', 'v_own')}, if(shorter = -2, not {led} and {within_part('u_own', 'v_own')}, not ({long} and ({led} or {ended})) and {within_few('u_own', 'v_own')}))"
    near = F.expr(f"not {together('u_spot', 'v_spot')} and (u_own is null or v_own is null or {near})")
    lengths = F.expr(f"u <> v and (u_n > v_n or u_n = v_n and u > v) and u_n - v_n <= if(shorter < 0, v_n div {PART}, shorter)")
    met = filed.join(asked, (filed.key == asked.key) & lengths & near).groupBy("u", "v").agg(F.max(F.expr("u_own is not null and v_own is not null")).alias("sure"))
    met = stage.put(met, "met")
    sure, open_ = met.filter("sure").select("u", "v"), met.filter("not sure")
    wanted = stage.put(open_.select(F.col("u").alias("id")).unionByName(open_.select(F.col("v").alias("id"))).distinct(), "wanted")
    wanted = F.broadcast(wanted) if wanted.limit(SEND + 1).count() <= SEND else wanted
    texts = stage.put(classes.join(wanted, "id", "left_semi").select("id", "line"), "texts", compression="zstd")
    text = lambda name, side: texts.select(F.col("id").alias(side), F.col("line").alias(name))
    both = open_.join(text("a", "u"), "u").join(text("b", "v"), "v")
    return stage.put(sure.unionByName(verified(both, edits, grow).select("u", "v")), "links")


def _found(docs: DataFrame, id_col: str, text_col: str, edits: int, least: int, grow: bool, *keys: str) -> DataFrame:
    """doc_id (and own_key, a hash of id and text, if in keys), n_lines, n_links, n_dropped, dropped of documents, or rows, that have lines."""
    if grow:
        classes, stars, links = star_counted_links(docs, id_col, text_col)
    else:
        (classes, links), stars = line_links(docs, id_col, text_col, edits, least), None
    first = classes.select("id", "first")
    both = links.join(first.toDF("u", "u_first"), "u").join(first.toDF("v", "v_first"), "v")
    ends = both.select(F.explode(F.expr("array(struct(u as id, v_first < u_first as earlier), struct(v as id, u_first < v_first as earlier))")).alias("e")).select("e.id", "e.earlier")
    linked = ends.groupBy("id").agg(F.count(F.lit(1)).alias("n_links"), F.max("earlier").alias("earlier"))
    if stars is not None:
        linked = linked.unionByName(star_links(stars)).groupBy("id").agg(F.sum("n_links").alias("n_links"), F.max("earlier").alias("earlier"))
    kinds = Stage(docs.sparkSession, "line-dedup").put(classes.select("id", "copies", "first").join(linked, "id", "left").filter("copies > 1 or n_links is not null").drop("copies"), "kinds")
    own = fresh_name(docs, "own_key")
    rows = lines_of(docs.withColumn(own, row_key(id_col, text_col)), id_col, text_col, own).select("doc_id", F.col(own).alias("own_key"), "line_no", F.xxhash64("line").alias("id"))
    gone = F.col("first").isNotNull() & (F.coalesce("earlier", F.lit(False)) | (place_of("doc_id", "line_no") != F.col("first")))
    return rows.join(kinds, "id", "left").groupBy("doc_id", *keys).agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum(F.coalesce("n_links", F.lit(0))).alias("n_links"), F.sum(F.when(gone, 1).otherwise(0)).cast("long").alias("n_dropped"), F.array_sort(F.collect_list(F.when(gone, F.col("line_no")))).alias("dropped")
    )  # a document's own lines


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, least: int = LEAST, grow: bool = False) -> DataFrame:
    """doc_id, n_lines, n_links, n_dropped, dropped (line numbers, ascending), one row per id.

    A line is dropped if it equals, or is linked to, a line that comes earlier by (doc_id, line_no). n_links: links of the
    document's lines to different lines, counted for each of its lines. Blank lines are kept and not counted. Null and blank
    texts have no lines. Rows of one id are one document: their lines count together, with each row's own line numbers. Ids
    may be null: null comes first. An empty table gives no rows. Lines are equal or not as whole texts, however long.
    """
    found = _found(docs, id_col, text_col, edits, least, grow)
    every = docs.select(F.col(id_col).alias("own_id")).distinct()
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return every.join(found, F.col("own_id").eqNullSafe(F.col("doc_id")), "left").select(F.col("own_id").alias("doc_id"), zero("n_lines"), zero("n_links"), zero("n_dropped"), F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, least: int = LEAST, grow: bool = False) -> DataFrame:
    """doc_id, text without the lines that repeated_lines() tells of, one row per input row.

    Decisions are each row's own, by id and text: rows that share an id keep their other lines. Of lines at the same number
    of rows with one id none comes earlier, so equal ones there stay.
    """
    gone = _found(docs, id_col, text_col, edits, least, grow, "own_key").filter("n_dropped > 0").select("own_key", "dropped")
    text = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), row_key(id_col, text_col).alias("own_key"))
    kept = "if(dropped is null, text, array_join(filter(split(text, '\\n', -1), (x, i) -> not array_contains(dropped, i)), '\\n'))"
    return text.join(gone, "own_key", "left").select("doc_id", F.expr(kept).alias("text"))
