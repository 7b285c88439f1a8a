"""Personal data by candidate gradient boosting, in DataFrame functions only.

Generators of high recall propose spans: the four base formats, and wider ones (addresses written out with "at" and "dot",
any longer run of digits and separators, and the same from where a number begins). Boosted trees score each wide candidate by its format and the words before it.
They are trained on all labelled candidates, with labels from two sources: base matches of the corpus, rewritten into forms that only
the wide generators propose, beside decoys of the same shape; and wide candidates of the corpus, labelled by what evidence
there is: words before it that say what it is, and a format or check digits that fit. A threshold for each kind, calibrated
on held-out candidates, decides which are redacted beside the base matches that pass their checks. The texts are read once:
what the generators propose is written, and the trees, as one SQL expression, score that.
"""

from __future__ import annotations

import re
from functools import reduce
from math import isqrt

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.llm.common import Stage, row_key

KINDS = ("email", "ip", "card", "phone")
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: The base formats, written so that Java's engine neither recurses nor looks at a run of characters more than once: a match
#: starts where its run starts or where the last match ended, and what cannot be given back is possessive. The language and
#: the leftmost matches are those of the plain forms.
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "wide_email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++(?:\x20?[(\[]at[)\]]\x20?|\x20at\x20){_LABEL}++(?:(?:\.|\x20?[(\[]dot[)\]]\x20?|\x20dot\x20){_LABEL}++)++",
    "wide_number": r"[+(]?[0-9][0-9\x20().-]{5,}[0-9]",
    "wide_alone": r"(?<![A-Za-z0-9])[+(]?[0-9][0-9\x20().-]{5,}[0-9]",
}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Words before a candidate that say what it is.
CONTEXT = ("mail|contact|write|reach", "tel|phone|call|fax|mobile", "card|visa|pay|iban|account", r"\bip\b|server|host|address", r"\bid\b|no\.|ref|order|version|page")
BEFORE = 32
#: The same words as evidence, where they begin a word: of an address, of a number that is called, of a card, of what is nobody's.
EVIDENCE = (r"\be?-?mail|\b(?:contact|write|reach)", r"\b(?:tel|phone|call|fax|mobile|contact|reach)", r"\b(?:card|visa|pay|iban|account)", r"\b(?:id|no\.|ref|order|version|page)")
#: Runs of digits that are no number to call: dates, and four or more numbers with dots between.
_DATE = r"^\(?(?:(?:19|20)[0-9]{2}([-./ ])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-./ ])[0-9]{1,2}\2(?:19|20)[0-9]{2})(?![0-9])"
_DOTTED = r"^[0-9]+(?:\.[0-9]+){3,}$"
#: What the candidates learned from weigh together at most, the precision asked of the threshold, and the shape of the model.
CANDIDATE_WEIGHT, PRECISION, TREES, DEPTH = 20_000, 0.95, 12, 3
_BLOCK = 256


def located(df: DataFrame, pattern: str, name: str, check: str) -> DataFrame:
    """df with a column `name`: matches in `text` that pass the check, as (start, end, text, before, after), in code points.

    check is SQL over x, the matched text. The pieces between matches give the places: one running position over all matches, so linear in their number;
    what is found is gathered in blocks, since appending copies.
    """
    p, m = f"{name}__p", f"{name}__m"
    df = df.withColumn(m, F.regexp_extract_all("text", F.lit(pattern), 0)).withColumn(p, F.when(F.size(m) > 0, F.split("text", pattern, -1)))
    kind = "struct<start:int,end:int,text:string,before:string,after:string>"
    x = f"{m}[i]"
    start = f"a.at + length({p}[i])"
    end = f"{start} + length({x})"
    ok = check.replace("{x}", x)
    one = f"named_struct('start', {start}, 'end', {end}, 'text', {x}, 'before', right({p}[i], {BEFORE}), 'after', left({p}[i + 1], 1))"
    step = f"if({ok}, named_struct('at', {end}, 'out', concat(a.out, array({one}))), named_struct('at', {end}, 'out', a.out))"
    none = f"cast(array() as array<{kind}>)"
    block = f"aggregate(sequence(k * {_BLOCK}, least((k + 1) * {_BLOCK}, size({m})) - 1), named_struct('at', o.at, 'out', {none}), (a, i) -> {step})"
    put = f"transform(array({block}), r -> named_struct('at', r.at, 'out', concat(o.out, array(r.out))))[0]"
    blocks = f"sequence(0, cast((size({m}) - 1) div {_BLOCK} as int))"
    spans = f"if(size({m}) = 0, {none}, flatten(aggregate({blocks}, named_struct('at', 0, 'out', cast(array() as array<array<{kind}>>)), (o, k) -> {put}, o -> o.out)))"
    return df.withColumn(name, F.expr(spans)).drop(p, m)


def _digits(c: str) -> str:
    return f"translate({c}, translate({c}, '0123456789', ''), '')"


def passes(kind: str, x: str) -> str:
    """SQL for whether a match of a base format passes its check."""
    n = f"length({_digits(x)})"
    return {
        "email": "true",
        "ip": f"{x} rlike '^{_OCTET}(?:[.]{_OCTET}){{3}}$'",
        "card": f"{n} between 13 and 19 and coalesce(luhn_check({_digits(x)}), false)",
        "phone": f"{n} between 9 and 15",
    }[kind]


def _like(x: str, pattern: str) -> str:
    return f"({x} rlike '" + pattern.replace("\\", "\\\\") + "')"


def evidence(c: str) -> tuple[str, str]:
    """SQL for the evidence that a wide candidate is personal data, 0 to 2, and for whether words before it say that it isn't.

    One for words before it that say what it is, one for a format or check digits that fit. An address with the "at" in
    brackets and a "dot" or a top level of letters is written out to be read as one, and needs no words.
    """
    x, d, before = f"{c}.text", _digits(f"{c}.text"), f"lower({c}.before)"
    mail, call, card, other = (_like(before, words) for words in EVIDENCE)
    bracketed = _like(x, r"[(\[]at[)\]].*(?:\.|[(\[ ]dot[)\] ] ?)[A-Za-z]{2,}$")
    address = f"if({bracketed}, 2, if({mail}, 1, 0) + if({_like(x, r'[(\[ ]dot[)\] ]|[(\[]at[)\]]')}, 1, 0))"
    alone = f"not {_like(f'{c}.before', '[A-Za-z0-9]$')} and not {_like(f'{c}.after', '[A-Za-z0-9]')}"
    to_call = f"length({d}) between 7 and 15 and {alone} and not {_like(x, _DATE)} and not {_like(x, _DOTTED)}"
    checked = f"length({d}) between 13 and 19 and coalesce(luhn_check({d}), false) and {alone}"
    number = f"greatest(if({call}, 1, 0) + if({to_call}, 1, 0), if({card}, 1, 0) + if({checked}, 1, 0))"
    return f"if({_like(x, '[A-Za-z]')}, {address}, {number})", f"({other} and not {mail} and not {call} and not {card})"


def feature_list(c: str) -> str:
    """SQL for the features of a candidate: the evidence, its format, its neighbours, and the words before it.

    The evidence comes first: of features that part a node equally well the trees take the first, and between 0 and 2 they
    part at 1, so that a candidate with half of the evidence is not taken unless the sample speaks for it.
    """
    x, d = f"{c}.text", _digits(f"{c}.text")
    own = [
        evidence(c)[0],
        f"length({x})", f"length({d})", f"length({x}) - length({d})", f"if({x} like '+%', 1, 0)", f"if(contains({x}, '@'), 1, 0)",
        f"if(length({d}) between 13 and 19, if(coalesce(luhn_check({d}), false), 2, 1), 0)", f"length({x}) - length(replace({x}, '.', ''))",
        f"length({x}) - length(replace({x}, ' ', ''))", f"length({x}) - length(replace({x}, '-', ''))", f"size(regexp_extract_all({x}, '[0-9]++', 0))",
        f"size(array_distinct(split({d}, '')))", f"if({c}.before rlike '[A-Za-z0-9]$', 1, 0)", f"if({c}.after rlike '[A-Za-z0-9]', 1, 0)",
        *(f"if(lower({c}.before) rlike '{words}', 1, 0)" for words in (w.replace("\\", "\\\\") for w in CONTEXT)),
    ]
    return "array(" + ", ".join(f"cast({f} as double)" for f in own) + ")"


def candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id and, for each base kind, the matches that pass; `wide`: candidates of the wide generators, but for those inside such a match."""
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    for name, pattern in PATTERNS.items():
        df = located(df, pattern, name, passes(name, "{x}") if name in KINDS else "true")
    df = df.select("doc_id", *KINDS, F.expr("array_distinct(concat(wide_email, wide_number, wide_alone))").alias("wide"))
    base = "concat(" + ", ".join(KINDS) + ")"
    return df.withColumn("wide", F.expr(f"filter(wide, w -> not exists({base}, b -> b.start <= w.start and w.end <= b.end))"))


# ---- the trees ----------------------------------------------------------------------------------------------------


def trees_to_sql(description: str, features: str) -> str:
    """One SQL expression for the raw score of an ensemble, from the text that the model prints of itself."""
    out, weight, lines = [], 1.0, [x.strip() for x in description.splitlines()]
    at = 0

    def node() -> str:
        nonlocal at
        line = lines[at]
        at += 1
        if m := re.match(r"Predict: (\S+)", line):
            return f"{float(m[1])!r}D"
        m = re.match(r"If \(feature (\d+) <= (\S+)\)", line)
        left = node()
        at += 1  # Else
        return f"if({features}[{m[1]}] <= {float(m[2])!r}D, {left}, {node()})"

    while at < len(lines):
        if m := re.match(r"Tree \d+ \(weight (\S+)\):", lines[at]):
            weight, at = float(m[1]), at + 1
            out.append(f"{weight!r}D * {node()}")
        else:
            at += 1
    return " + ".join(out) or "0D"


def probability(raw: str) -> str:
    return f"1 / (1 + exp(-2 * ({raw})))"


def kind_of(c: str) -> str:
    """SQL for the kind that a wide candidate would be."""
    d = _digits(f"{c}.text")
    return f"if({c}.text rlike '[A-Za-z]', 'email', if(length({d}) > 15 or length({d}) > 12 and luhn_check({d}), 'card', 'phone'))"


def rewritten(found: DataFrame) -> DataFrame:
    """doc_id, c, label: base matches of the corpus in forms that only the wide generators propose (1), and decoys of like shape (0), each where it stands."""
    each = "concat(" + ", ".join(f"transform({k}, c -> named_struct('kind', '{k}', 'c', c))" for k in ("email", "card", "phone")) + ")"
    df = found.select("doc_id", F.explode(F.expr(each)).alias("b")).select("doc_id", "b.kind", "b.c").withColumn("h", F.expr("pmod(xxhash64(doc_id, c.start, kind), 3)"))
    d, name, host = _digits("c.text"), "substring_index(c.text, '@', 1)", "substring_index(c.text, '@', -1)"
    groups = "regexp_replace({}, '([0-9]{{4}})(?=[0-9])', '$1.')"
    wrong = f"concat(left({d}, length({d}) - 1), cast((cast(right({d}, 1) as int) + 1) % 10 as string))"
    spoken = f"concat({name}, case h when 0 then ' (at) ' when 1 then ' [at] ' else ' at ' end, if(h = 0, {host}, replace({host}, '.', ' dot ')))"
    forms = {"email": spoken, "card": groups.format(d), "phone": "if(h = 0, substring(c.text, 2), if(h = 1, concat('00', substring(c.text, 2)), concat('(', substring(c.text, 2, 2), ') ', ltrim(substring(c.text, 4)))))"}
    decoys = {"email": f"concat({name}, ' at ', substring_index({host}, '.', 1), '.The')", "card": groups.format(wrong), "phone": f"regexp_replace({d}, '([0-9]{{2}})(?=[0-9])', '$1.')"}
    pick = lambda texts: "case kind " + " ".join(f"when '{k}' then {x}" for k, x in texts.items()) + " end"
    one = "named_struct('start', c.start, 'end', c.end, 'text', {}, 'before', {}, 'after', c.after)"
    right = df.select("doc_id", F.expr(one.format(pick(forms), "c.before")).alias("c"), F.lit(1.0).alias("label"))
    return right.unionByName(df.select("doc_id", F.expr(one.format(pick(decoys), "''")).alias("c"), F.lit(0.0).alias("label")))


def train(found: DataFrame, stage: Stage, rows: int = CANDIDATE_WEIGHT, precision: float = PRECISION) -> tuple[str, dict[str, float | None]]:
    """SQL for a candidate's probability (of a struct c with features f), and for each kind the threshold; None where full evidence has to decide.

    Labels are those of rewritten(), and of the corpus's own wide candidates: with words and format, or words and check
    digits, they are personal data; with neither, or where the words before them call them something else, they are not; the
    rest is left out. All labelled candidates count, alike ones as one row with their number. Half of them, by hash, trains,
    with `rows` // 4 as the most that all of one label and source weigh; the other half sets the thresholds at `precision`, each
    as often as it occurs. Where a half lacks a label there is nothing to learn.
    """
    kinds = ("email", "card", "phone")
    certain = "c.f[0] / 2"
    sure, other = evidence("c")
    label = f"case when {sure} = 2 then 1D when {sure} = 0 or {other} then 0D end"
    each = found.select("doc_id", F.explode("wide").alias("c")).select("doc_id", "c", F.expr(label).alias("label"), F.lit(True).alias("own")).filter("label is not null")
    each = each.unionByName(rewritten(found).withColumn("own", F.lit(False)))
    half = F.expr("pmod(xxhash64(doc_id, c.start, c.end, c.text), 2)").alias("half")
    every = each.select(F.expr(feature_list("c")).alias("f"), "label", "own", F.expr(kind_of("c")).alias("kind"), half)
    every = stage.put(every.groupBy("f", "label", "own", "kind", "half").agg(F.count(F.lit(1)).alias("n")), "labelled")
    n = {(r.label, r.own): r.n for r in every.groupBy("label", "own").agg(F.sum("n").alias("n")).collect()}
    if len({v for v, _ in n}) < 2:
        return certain, dict.fromkeys(kinds)
    share = F.lit(1.0)
    for (v, own), k in n.items():
        share = F.when((F.col("label") == v) & (F.col("own") == own), min(1.0, rows // 4 / k)).otherwise(share)
    learn = every.filter("half = 0").groupBy("f", "label").agg(F.sum(F.col("n") * share).alias("w"))
    learn = stage.put(learn.select(array_to_vector("f").alias("features"), "label", "w"), "learn")
    alike = learn.count()
    if learn.agg(F.countDistinct("label")).head()[0] < 2:
        return certain, dict.fromkeys(kinds)
    bins = 32 if alike <= 10_000 else isqrt(alike) + 1  # MLlib looks for splits in all rows where they are no more than the square of the bins, or 10,000
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=1, cacheNodeIds=False, weightCol="w", maxBins=bins).fit(learn)
    score = probability(trees_to_sql(model.toDebugString, "c.f"))
    tested = every.filter("half = 1").select("kind", F.expr(score.replace("c.f", "f")).alias("p"), (F.col("label") * F.col("n")).alias("yes"), "n")
    tested = tested.groupBy("kind", "p").agg(F.sum("yes").alias("yes"), F.sum("n").alias("w")).orderBy("kind", F.desc("p")).collect()  # as many rows as leaves can make
    thresholds: dict[str, float | None] = dict.fromkeys(kinds)
    for kind in kinds:
        right = every_ = 0.0
        for r in (r for r in tested if r.kind == kind):
            right, every_ = right + r.yes, every_ + r.w
            if r.yes and right / every_ >= precision:
                thresholds[kind] = r.p
    return score, thresholds


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id and, for each kind, the spans (start, end, text, base), by start; base: a base match that passes.

    Null texts count as empty; whole texts are read. Texts of any length and repeated rows are answered each. An empty table
    gives no rows. A kind without any candidate to learn from has those with full evidence added to the base matches.
    """
    stage = Stage(docs.sparkSession, "pii")
    found = stage.put(candidates(docs, id_col, text_col), "candidates")
    score, thresholds = train(found, stage)
    span = "named_struct('start', c.start, 'end', c.end, 'text', c.text, 'base', {})"
    with_f = found.withColumn("wide", F.expr(f"transform(wide, c -> named_struct('start', c.start, 'end', c.end, 'text', c.text, 'f', {feature_list('c')}))"))
    taken = "case k " + " ".join(f"when '{k}' then " + ("c.f[0] >= 2" if t is None else f"{score} >= {t!r}D") for k, t in thresholds.items()) + " end"
    chosen = with_f.withColumn("wide", F.expr(f"filter(transform(wide, c -> named_struct('k', {kind_of('c')}, 'c', c)), z -> transform(array(z.k), k -> transform(array(z.c), c -> {taken})[0])[0])"))
    added = lambda k: f"transform(filter(wide, z -> z.k = '{k}'), z -> {span.replace('c.', 'z.c.').format('false')})"
    whole = lambda k: F.expr(f"transform({k}, c -> {span.format('true')})") if k == "ip" else F.expr(f"array_sort(concat(transform({k}, c -> {span.format('true')}), {added(k)}))")
    return chosen.select("doc_id", *(whole(k).alias(k) for k in KINDS))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, the number of base matches of each kind, base_sha256 and spans, from what find() found."""
    base = {k: F.filter(k, lambda s: s["base"]) for k in KINDS}

    def lines(kind: str, spans: Column) -> Column:
        return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))

    joined = lambda of: F.array_join(reduce(F.concat, (lines(k, of[k]) for k in KINDS)), ",")
    return found.select("doc_id", *(F.size(base[k]).cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined({k: F.col(k) for k in KINDS}).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text with every span replaced by its kind in brackets, one row per input row. Overlapping spans become one, under the first one's kind.

    Spans are joined to rows by id and text, so rows that share an id alone never get each other's. Null texts come out empty.
    """
    keyed = docs.select(row_key(id_col, text_col).alias("doc_id"), F.col(text_col).alias("text"))
    listed = "concat(" + ", ".join(f"transform({k}, c -> named_struct('start', c.start, 'end', c.end, 'kind', '{k}'))" for k in KINDS) + ")"
    spans = find(keyed).select(F.col("doc_id").alias("own_key"), F.expr(f"array_sort({listed})").alias("spans")).filter("size(spans) > 0").dropDuplicates(["own_key"])
    text = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), row_key(id_col, text_col).alias("own_key"))
    step = "if(c.start < a.at, named_struct('at', greatest(a.at, c.end), 'out', a.out), named_struct('at', c.end, 'out', concat(a.out, substring(text, a.at + 1, c.start - a.at), '[', c.kind, ']')))"
    done = f"if(spans is null, text, aggregate(spans, named_struct('at', 0, 'out', ''), (a, c) -> {step}, a -> concat(a.out, substring(text, a.at + 1))))"
    return text.join(spans, "own_key", "left").select("doc_id", F.expr(done).alias("text"))
