"""Personal data: wide candidate spans, boosted trees over their format and context, thresholds that are calibrated per kind.

All of it is column expressions. A pattern's matches and the text between them are two arrays, from which positions
follow by sums of lengths; so nothing is cut out of the text by position, and a text of any length costs in proportion. Strict
patterns with checks give the base spans, which always stay. Wide patterns give candidates that may overlap them and one another. Trees
learn, from all candidates, which formats and contexts the base spans have (the deciding checks themselves are no features),
and a candidate is added where its score is above its kind's threshold, chosen on other candidates for its precision.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewright.llm.base import fresh, stored, text_key

KINDS = ("email", "ip", "card", "phone")
# Strict patterns. They match what their plain forms do; a look at what stands before, or possessive loops, keep long runs of one kind of character linear.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Wide patterns, from whatever might be of the kind.
WIDE = {
    "email": r"(?<![^\s@<>,;])[^\s@<>,;]{1,64}+(?:@|\x20?[\[(]at[\])]\x20?)[^\s@<>,;]{2,255}+",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:[.:,][0-9]{1,3}+){3,7}+",
    "card": r"(?<![0-9])[0-9](?:[\x20.-]?[0-9]){11,22}+",
    "phone": r"(?<![0-9])(?:\+|00)?\(?[0-9](?:[\x20().-]{0,3}+[0-9]){6,14}+(?![0-9])",
}
# A text without this has neither a base span nor a candidate of the kind.
HINT = {
    "email": r"@|[\[(]at[\])]", "ip": r"[0-9][.:,][0-9]{1,3}+[.:,][0-9]|[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20.-]?[0-9]){11}",
    "phone": r"[0-9](?:[\x20().-]{0,3}+[0-9]){6}|\+[0-9][\x20().0-9-]+[0-9]",
}
# Words that tend to stand before data of the kind.
WORDS = {
    "email": "mail|contact|write|kontakt|correo|courriel", "ip": "ip|host|server|addr|node|client",
    "card": "card|visa|credit|karte|carte|tarjeta|pay", "phone": "tel|phone|call|fax|mobil|appel|ruf|llam",
}
CONTEXT = 24
RANGES = 4096
FEATURES = (
    "length", "digits", "letters", "marks", "blanks", "dots", "hyphens", "brackets", "longest_digits", "distinct_digits", "first_digit",
    "word_before", "letter_before", "blank_before", "quote_before", "letter_after", "blank_after", "stop_after", "upper", "non_ascii",
)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value evaluated once."""
    return F.transform(F.array(value), use)[0]


def _prefix_sums(lengths: Column) -> Column:
    """Sums before every element. Blocks of about the root of the number keep it near linear without a running state."""
    def from_blocks(x: Column) -> Column:
        width, blocks = x["width"], F.transform(
            F.sequence(F.lit(0), F.floor((F.size(x["all"]) - 1) / x["width"]).cast("int")),
            lambda b: F.aggregate(F.slice(x["all"], b * x["width"] + 1, x["width"]), F.lit(0), lambda s, y: s + y))
        starts = lambda sums: F.transform(sums, lambda _, b: F.aggregate(F.slice(sums, F.lit(1), b), F.lit(0), lambda s, y: s + y))
        return _let(_let(blocks, starts), lambda before: F.transform(x["all"], lambda _, i: F.get(before, F.floor(i / width).cast("int")) + F.aggregate(
            F.slice(x["all"], F.floor(i / width).cast("int") * width + 1, i % width), F.lit(0), lambda s, y: s + y)))
    block = lambda all_: F.struct(all_.alias("all"), F.greatest(F.ceil(F.sqrt(F.size(all_))).cast("int"), F.lit(1)).alias("width"))
    return _let(lengths, lambda all_: _let(block(all_), from_blocks))


def matches(text: Column, pattern: str, hint: str) -> Column:
    """Non-overlapping matches as ``ARRAY<STRUCT<start, end, match, before, after>>``, in code points; ``before`` and ``after`` are
    what stands next to a match."""
    def positions(x: Column) -> Column:
        lengths = F.zip_with(x["found"], F.slice(x["gaps"], F.lit(1), F.size(x["found"])), lambda m, g: F.length(m) + F.length(g))
        return _let(_prefix_sums(lengths), lambda sums: F.transform(x["found"], lambda m, i: F.struct(
            (F.get(sums, i) + F.length(F.get(x["gaps"], i))).alias("start"),
            (F.get(sums, i) + F.length(F.get(x["gaps"], i)) + F.length(m)).alias("end"),
            m.alias("match"), F.right(F.get(x["gaps"], i), F.lit(CONTEXT)).alias("before"),
            F.left(F.get(x["gaps"], i + 1), F.lit(1)).alias("after"))))

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps"))
    some = _let(both, lambda x: F.when(F.size(x["found"]) > 0, positions(x)))
    none = F.array().cast("ARRAY<STRUCT<start:INT,end:INT,match:STRING,before:STRING,after:STRING>>")
    return F.coalesce(F.when(text.rlike(hint), some), none)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Of 13 to 19 digits: whether the check digit is right."""
    def weight(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = 2 * d
        return F.when((F.length(digits) - i) % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)
    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), weight), F.lit(0), lambda s, x: s + x) % 10 == 0


def _is_base(kind: str, match: Column) -> Column:
    if kind == "ip":
        # without its leading zeros a part may still be too long for a number: then it is none
        value = lambda p: F.concat(F.lit("0"), F.regexp_replace(p, "^0+", "")).try_cast("int")
        return F.forall(F.split(match, r"\."), lambda p: F.coalesce(value(p), F.lit(999)) <= 255)
    if kind == "card":
        return _let(_digits(match), lambda d: F.length(d).between(13, 19) & F.when(F.length(d).between(13, 19), _luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    return F.filter(matches(text, BASE[kind], HINT[kind]), lambda m: _is_base(kind, m["match"]))


def _count(text: Column, members: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{members}]", ""))


def _features(kind: str, m: Column) -> Column:
    text, before, after = m["match"], m["before"], m["after"]
    yes = lambda condition: condition.cast("double")
    values = {
        "length": F.length(F.regexp_replace(text, "[+]", "")), "digits": _count(text, "0-9"), "letters": _count(text, "A-Za-z"), "marks": _count(text, "%_=/#&*!?"),
        "blanks": _count(text, r"\x20"), "dots": _count(text, "."), "hyphens": _count(text, r"\-"), "brackets": _count(text, r"()\[\]"),
        "longest_digits": F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit("[0-9]++"), F.lit(0)), F.length)), F.lit(0)),
        "distinct_digits": F.size(F.array_distinct(F.regexp_extract_all(text, F.lit("[0-9]"), F.lit(0)))),
        "first_digit": F.coalesce(F.regexp_extract(text, "[0-9]", 0).try_cast("int"), F.lit(-1)),
        "word_before": yes(before.rlike(f"(?i)(?:{WORDS[kind]})")), "letter_before": yes(before.rlike(r"\p{L}$")),
        "blank_before": yes(before.rlike(r"(?:^|\s)$")), "quote_before": yes(before.rlike("[\"'=:/]$")),
        "letter_after": yes(after.rlike(r"^\p{L}")), "blank_after": yes(after.rlike(r"^(?:\s|$)")), "stop_after": yes(after.rlike("^[.,;:!?]")),
        "upper": _count(text, "A-Z"), "non_ascii": F.length(F.regexp_replace(text, r"[\x00-\x7F]", "")),
    }
    return F.array(*[values[name].cast("double") for name in FEATURES])


def _candidates(text: Column, kind: str, base: Column) -> Column:
    """Wide matches with their features, and whether they hold or lie in a base span."""
    def against(own: Column) -> Column:
        return F.transform(matches(text, WIDE[kind], HINT[kind]), lambda m: F.struct(
            m["start"].alias("start"), m["end"].alias("end"), _features(kind, m).alias("x"),
            F.exists(own, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])).alias("base")))
    return _let(base, against)


def _slim(spans: Column) -> Column:
    return F.transform(spans, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end")))


def propose(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """``keep`` and for each kind the base spans (``email``, ...) and the candidates (``email_wide``, ...)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    first = docs.select(*keep, text.alias("__text"), *[_slim(base_spans(text, k)).alias(k) for k in KINDS])
    return first.select("*", *[_candidates(F.col("__text"), k, F.col(k)).alias(f"{k}_wide") for k in KINDS])


# ---- boosted trees

def _tree(lines: list[str], x: Callable[[int], Column]) -> Column:
    """A tree's printed form as an expression; takes its lines off the list."""
    line = lines.pop(0)
    if found := re.fullmatch(r"Predict: (\S+)", line):
        return F.lit(float(found[1]))
    test = re.fullmatch(r"If \(feature (\d+) <= (\S+)\)", line)
    yes = _tree(lines, x)
    lines.pop(0)  # Else
    return F.when(x(int(test[1])) <= float(test[2]), yes).otherwise(_tree(lines, x))


class Model:
    """Trees of each kind, as data that makes expressions, and the score from which a candidate is taken."""

    def __init__(self, trees: dict[str, list[tuple[float, list[str]]]], thresholds: dict[str, float]):
        self.trees, self.thresholds = trees, thresholds

    def score(self, kind: str, x: Column) -> Column:
        """Probability, from the features."""
        margin = F.lit(0.0)
        for weight, lines in self.trees[kind]:
            margin = margin + F.lit(weight) * _tree(list(lines), lambda i: F.get(x, F.lit(i)))
        return 1 / (1 + F.exp(-2 * margin))

    def selected(self, kind: str, base: Column, wide: Column) -> Column:
        """Base spans, and candidates above the threshold that reach no base span."""
        if kind not in self.thresholds:
            return base
        added = F.filter(wide, lambda c: ~c["base"] & (self.score(kind, c["x"]) >= self.thresholds[kind]))
        return F.array_sort(F.concat(base, _slim(added)))


def fit(proposed: DataFrame, rounds: int = 20, depth: int = 4, precision: float = 0.95, least: int = 50, seed: int = 7) -> Model:
    """Trees and thresholds from all candidates of each kind. ``__id`` is the hash of a row.

    Equal candidates, those of the same features and label, are one row with their number as its weight. Nine tenths of the candidates, by a hash, train; on the rest, a
    kind's threshold is the lowest score such that of the candidates at or above it ``precision`` are
    base spans, moved half way to the next score below. A kind with fewer than ``least`` base or other candidates, or without such a score, gets none:
    its base spans are all it has.
    """
    fold = F.pmod(F.xxhash64(F.xxhash64("__id", "c.start")), F.lit(10))
    each = [proposed.select(F.lit(k).alias("kind"), "__id", F.explode(f"{k}_wide").alias("c")) for k in KINDS]
    every = each[0].unionByName(each[1]).unionByName(each[2]).unionByName(each[3]).select(
        "kind", F.col("c.x").alias("x"), F.col("c.base").cast("double").alias("label"), (fold == 0).alias("held"))
    grouped = stored(every.groupBy("kind", "x", "label", "held").agg(F.count("*").cast("double").alias("n")), "candidates")
    counts = {(r.kind, r.label): r.n for r in grouped.groupBy("kind", "label").agg(F.sum("n").alias("n")).collect()}
    thresholds, trees = {}, {}
    for kind in KINDS:
        if min(counts.get((kind, 0.0), 0), counts.get((kind, 1.0), 0)) < least:
            continue
        of_kind = grouped.filter(F.col("kind") == kind)
        ready = VectorAssembler(inputCols=["v"], outputCol="features").transform(of_kind.filter("NOT held").select("label", "n", _as_vector("x").alias("v")))
        grown = GBTClassifier(maxIter=rounds, maxDepth=depth, seed=seed, stepSize=0.2, weightCol="n").fit(ready)
        trees[kind] = [(w, [s.strip() for s in t.toDebugString.split("\n")[1:] if s.strip()]) for w, t in zip(grown.treeWeights, grown.trees)]
        scored = of_kind.filter("held").select(Model(trees, {}).score(kind, F.col("x")).alias("score"), "label", "n")
        threshold = _threshold(scored, precision)
        if threshold is not None:
            thresholds[kind] = threshold
    return Model(trees, thresholds)


def _threshold(scored: DataFrame, precision: float) -> float | None:
    """Of ``(score, label, n)``, ``n`` candidates each: the lowest score from which on ``precision`` of them have label 1, moved half way to the next below.

    Running sums go by ranges of scores, the sums of the ranges above added, so neither the driver nor a task sees all scores.
    """
    by_score = stored(scored.groupBy("score").agg(F.sum(F.col("n") * F.col("label")).alias("right"), F.sum("n").alias("n")), "scores")
    ranges = F.floor(F.col("score") * RANGES).alias("range")  # a probability
    totals = by_score.groupBy(ranges).agg(F.sum("right").alias("right"), F.sum("n").alias("n"))
    above = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)  # of RANGES + 1 rows at most
    offsets = totals.select("range", *[F.coalesce(F.sum(c).over(above), F.lit(0.0)).alias(f"{c}_above") for c in ("right", "n")])
    running = Window.partitionBy("range").orderBy(F.desc("score"))
    sums = by_score.withColumn("range", ranges).join(F.broadcast(offsets), "range").select(
        "score", (F.sum("right").over(running) + F.col("right_above")).alias("right"), (F.sum("n").over(running) + F.col("n_above")).alias("n"))
    best = sums.filter(F.col("right") / F.col("n") >= precision).agg(F.min("score")).first()[0]
    if best is None:
        return None
    below = by_score.filter(F.col("score") < best).agg(F.max("score")).first()[0]
    return best if below is None else (best + below) / 2


def _as_vector(x: str) -> Column:
    from pyspark.ml.functions import array_to_vector

    return array_to_vector(F.col(x))


# ---- results

def _joined(kinds: dict[str, Column]) -> Column:
    def written(kind: str) -> Callable[[Column], Column]:
        return lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.concat(*[F.transform(spans, written(kind)) for kind, spans in kinds.items()]), ",")


def find_pii(docs: DataFrame, **settings) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone`` (base spans), ``base_sha256`` (of the base spans as text) and ``spans`` (all spans).

    Null and empty texts have no spans. Rows with null or repeated ids are rows like others, a text of any length is searched whole, and an
    empty table gives an empty result. Further columns are not looked at.
    """
    proposed = stored(propose(docs, [F.col("doc_id"), F.xxhash64("doc_id", text_key(F.col("text"))).alias("__id")]).drop("__text"), "pii")
    model = fit(proposed, **settings)
    base = {k: F.col(k) for k in KINDS}
    every = {k: model.selected(k, F.col(k), F.col(f"{k}_wide")) for k in KINDS}
    return proposed.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
                           F.sha2(_joined(base), 256).alias("base_sha256"), _joined(every).alias("spans"))


def _union(spans: Column) -> Column:
    """Sorted spans with those that overlap made one; touching ones stay apart."""
    def add(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind"))
        return F.when((F.size(done) > 0) & (F.get(done, F.size(done) - 1)["end"] > s["start"]),
                      F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(wider))).otherwise(F.concat(done, F.array(s)))
    return F.aggregate(spans, F.array().cast("ARRAY<STRUCT<start:INT,end:INT,kind:STRING>>"), add)


PIECE = 4096


def _cut(pieces: Column, start: Column, end: Column) -> Column:
    """Code points ``start`` to ``end`` of a text that is cut into pieces of ``PIECE``."""
    a, b = F.floor(start / PIECE).cast("int"), F.floor(end / PIECE).cast("int")
    piece = lambda i: F.coalesce(F.get(pieces, i), F.lit(""))
    within = F.substring(piece(a), start % PIECE + 1, end - start)
    across = F.concat(F.substring(piece(a), start % PIECE + 1, F.lit(PIECE)), F.array_join(F.slice(pieces, a + 2, F.greatest(b - a - 1, F.lit(0))), ""),
                      F.left(piece(b), end % PIECE))
    return F.when(a == b, within).otherwise(across)


def _masked(text: Column, spans: Column) -> Column:
    def build(x: Column) -> Column:
        edges = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(x["spans"], i - 1)["end"])
        parts = F.transform(x["spans"], lambda s, i: F.concat(_cut(x["pieces"], edges(i), s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]")))
        tail = _cut(x["pieces"], F.element_at(x["spans"], -1)["end"], x["length"])
        return F.concat(F.array_join(parts, ""), tail)
    cut = F.struct(spans.alias("spans"), F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0)).alias("pieces"), F.length(text).alias("length"))
    return F.when(F.size(spans) > 0, _let(cut, build)).otherwise(text)


def redact(docs: DataFrame, **settings) -> DataFrame:
    """The documents with every span of personal data replaced by its kind in brackets, ``n_chars`` as the text then has it.

    A text without spans stays as it is, null included. Overlapping spans are replaced as one, by the kind of the first. No row moves: one
    scan proposes candidates to learn from, a second one selects and writes.
    """
    id_, = fresh(docs, "__id")
    learned = stored(propose(docs, [F.xxhash64("doc_id", text_key(F.col("text"))).alias("__id")]).select("__id", *[f"{k}_wide" for k in KINDS]), "pii")
    model = fit(learned, **settings)
    names = fresh(docs, *KINDS, *[f"{k}_wide" for k in KINDS], "spans")
    base, wide, spans = names[:4], names[4:8], names[8]
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select("*", *[_slim(base_spans(text, k)).alias(n) for k, n in zip(KINDS, base)])
    found = found.select("*", *[_candidates(text, k, F.col(b)).alias(n) for k, b, n in zip(KINDS, base, wide)])
    def with_kind(kind: str) -> Callable[[Column], Column]:
        return lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"))
    tagged = [F.transform(model.selected(k, F.col(b), F.col(w)), with_kind(k)) for k, b, w in zip(KINDS, base, wide)]
    found = found.withColumn(spans, _union(F.array_sort(F.concat(*tagged))))
    changed = {"text": F.when(F.size(spans) > 0, _masked(text, F.col(spans))).otherwise(F.col("text"))}
    out = found.select(*[changed.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns], F.size(spans).alias(id_))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(id_) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
