"""Personal data by candidate spans and gradient-boosted trees, inside Spark's own expressions.

1. Fixed patterns give the base spans: their matches, leftmost and without overlap, that pass a check (Luhn, octets,
   number of digits). They always stay.
2. Looser generators propose overlapping candidates: other separators, brackets, spelt-out signs, missing plus signs.
3. Boosted trees score a candidate by format and context. They are fitted on candidates whose label follows from the
   fixed rules: those that coincide with a base span, and those that break a rule whatever their form (a failed
   Luhn sum, an octet above 255). The signs by which the patterns themselves decide are no features.
4. A threshold per kind is calibrated on candidates kept out of the fit: the lowest at which ``PRECISION`` of the accepted
   are right, and no lower than the score that ``LEAST_TYPICAL`` of the known spans miss. Candidates at or above it that
   keep the rules and touch no base span are added, best first.

Scoring is one pass over the documents without a shuffle; the trees are a CASE expression. One pass before it stores the
labelled candidates of all documents. The fit sees at most about ``TRAINING_SPANS`` of each kind and label, those that hash
lowest; thresholds come from counts by score of all the others. A kind whose known spans are all in the fit is calibrated
on these.

Spans count code points, ends exclusive. Defined results: null and empty texts have no spans; null ids
pass through; repeated rows are handled one by one; without enough labelled candidates nothing is added; an empty
table gives an empty result. Patterns never back-track over a run twice, so very long runs of one kind are safe.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtables import session
from flowtables.llm.common import col, text_or_empty

KINDS = ("email", "ip", "card", "phone")
TRAINING_SPANS = 4_000
SCORES = 65_536  # steps of the score in the counts
LEAST_LABELLED = 40
TREES, DEPTH, STEP = 8, 3, 0.3
PRECISION, LEAST_TYPICAL = 0.99, 0.05
CONTEXT = 24

# The base patterns. Each is written so that a start inside a run already tried fails at once:
# email and ip begin at the start of a run (or where the last match ended), card matches whole runs of 13 to 19 digits.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Candidates: wider forms of the same four kinds. A mark is what may stand between the groups of a card or an address.
_EDGE, _AFTER = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
_LOCAL, _LABEL = r"(?<![._%+-])[\p{L}\p{N}._%+-]{1,64}+", r"[\p{L}\p{N}-]{1,63}+"
_DOT = r"(?:\.|\x20?[(\[{]\x20?(?:dot|\.)\x20?[)\]}]\x20?|\x20dot\x20)"
_MARK = r"[-\x20./_]{1,2}+"
WIDE = {
    "email": rf"{_EDGE}{_LOCAL}(?:(?:@|\x20@\x20){_LABEL}(?:\.{_LABEL})++|\x20?[(\[{{]\x20?(?:at|@)\x20?[)\]}}]\x20?{_LABEL}(?:{_DOT}{_LABEL})++"
    rf"|\x20at\x20{_LABEL}(?:\x20dot\x20{_LABEL})++){_AFTER}",
    "ip": rf"{_EDGE}(?<!\.)[0-9]{{1,3}}+(?:(?:\.|\x20?[(\[{{](?:dot|\.)[)\]}}]\x20?)[0-9]{{1,3}}+){{3}}(?!\.?[0-9]){_AFTER}",
    "card": rf"{_EDGE}(?<![0-9][-\x20./_])(?:[0-9]{{13,19}}+|[3-6][0-9]{{3}}(?:{_MARK}[0-9]{{4}}){{3}}|3[47][0-9]{{2}}{_MARK}[0-9]{{6}}{_MARK}[0-9]{{5}})"
    rf"(?![-\x20./_]?[0-9]){_AFTER}",
    "phone": rf"{_EDGE}(?<![0-9][-\x20./+])(?:(?:\+|00)[1-9][0-9]{{0,3}}+(?:[-\x20./()]{{1,2}}+[0-9]{{1,5}}+){{2,5}}+"
    rf"|(?:1[-\x20.])?\([0-9]{{2,4}}\)[-\x20.]?[0-9]{{3,4}}[-\x20.][0-9]{{3,4}}|(?:1([-.]))?[2-9][0-9]{{2}}([-.])[0-9]{{3}}\2[0-9]{{4}})(?![-.]?[0-9]){_AFTER}",
}
# What a text must hold at all for a kind to be looked for.
GUARD = {"email": r"@|[(\[{]\x20?at\x20?[)\]}]|\x20at\x20.{1,64}\x20dot\x20", "ip": "[0-9]", "card": "[0-9]", "phone": "[0-9]"}
# Words near a span of each kind.
CONTEXT_WORDS = {
    "email": r"(?i)mail|contact|write|reach",
    "ip": r"(?i)\bip\b|host|server|address|ping|login",
    "card": r"(?i)card|visa|credit|debit|pay|account",
    "phone": r"(?i)tel|phone|call|mobile|fax|contact|whatsapp",
}
FEATURES = ("digits", "letters", "separators", "separator_kinds", "longest", "shortest", "groups", "luhn", "before", "after", "context", "kind")


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, also where ``use`` mentions it inside lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda x, y: x + y)


def _starts(m: Column, s: Column) -> Column:
    """Where each match begins, from the matches and the pieces of text between them.

    Running sums over about sqrt(n) groups of about sqrt(n), so many matches in one text stay cheap.
    """
    lengths = F.zip_with(F.transform(s, lambda x: F.char_length(x)), F.concat(F.array(F.lit(0)), F.transform(m, lambda x: F.char_length(x))), lambda x, y: x + y)
    width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(m))).cast("int"))
    groups = F.sequence(F.lit(0), F.ceil(F.size(m) / width).cast("int") - 1)

    def placed(each: Column, before: Column) -> Column:
        inside = lambda i: _total(F.slice(each, (i - i % width) + 1, i % width + 1))
        return F.transform(m, lambda x, i: F.get(before, F.floor(i / width).cast("int")) + inside(i))

    def summed(each: Column) -> Column:
        sums = F.transform(groups, lambda g: _total(F.slice(each, g * width + 1, width)))
        return _let(sums, lambda t: _let(F.transform(t, lambda x, i: _total(F.slice(t, F.lit(1), i))), lambda before: placed(each, before)))

    return F.when(F.size(m) > 0, _let(lengths, summed)).otherwise(F.array().cast("array<int>"))


def _found(rows: DataFrame, name: str, pattern: str, guard: Column) -> DataFrame:
    """Adds the matches ``m_``, the pieces between ``s_`` and the starts ``p_`` of a pattern."""
    none = F.array().cast("array<string>")
    rows = rows.withColumn(f"m_{name}", F.when(guard, F.regexp_extract_all("t", F.lit(pattern), F.lit(0))).otherwise(none))
    rows = rows.withColumn(f"s_{name}", F.when(F.size(f"m_{name}") > 0, F.split("t", pattern, -1)).otherwise(none))
    return rows.withColumn(f"p_{name}", _starts(F.col(f"m_{name}"), F.col(f"s_{name}")))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _keeps_rules(kind: str, x: Column) -> Column:
    """The check of a kind, whatever the separators."""
    if kind == "email":
        return x.rlike(r"\p{L}{2,63}$")
    if kind == "ip":
        parts = F.split(F.regexp_replace(x, "[^0-9]+", "."), r"\.")
        return F.forall(parts, lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False)))
    n = F.length(_digits(x))
    return n.between(13, 19) & F.call_function("luhn_check", _digits(x)) if kind == "card" else n.between(9, 15)


def _span(kind: int, start: Column, text: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.char_length(text)).alias("stop"))


def _base(kind: int) -> Column:
    name = f"b{kind}"
    keeps = (lambda x: F.lit(True)) if KINDS[kind] == "email" else (lambda x: _keeps_rules(KINDS[kind], x))
    every = F.transform(f"m_{name}", lambda x, i: F.struct(keeps(x).alias("ok"), _span(kind, F.get(f"p_{name}", i), x).alias("span")))
    return F.transform(F.filter(every, lambda x: x["ok"]), lambda x: x["span"])


def _candidate(kind: int, x: Column, start: Column, before: Column, after: Column) -> Column:
    signs = F.regexp_replace(x, r"[\p{L}\p{N}]", "")
    lengths = F.transform(F.filter(F.split(x, r"[^\p{L}\p{N}]+"), lambda p: p != ""), lambda p: F.char_length(p))
    beside = lambda c: F.when(c == "", 0).when(c == " ", 1).when(c.rlike(r"\p{L}|\p{N}"), 3).otherwise(2)
    values = {
        "digits": F.length(_digits(x)),
        "letters": F.char_length(F.regexp_replace(x, r"[^\p{L}]", "")),
        "separators": F.char_length(signs),
        "separator_kinds": F.size(F.array_distinct(F.split(signs, ""))),
        "longest": F.array_max(lengths),
        "shortest": F.array_min(lengths),
        "groups": F.size(lengths),
        "luhn": F.call_function("luhn_check", _digits(x)).cast("int"),
        "before": beside(F.right(before, F.lit(1))),
        "after": beside(F.left(after, F.lit(1))),
        "context": F.right(before, F.lit(CONTEXT)).rlike(CONTEXT_WORDS[KINDS[kind]]).cast("int"),
        "kind": F.lit(kind),
    }
    numbers = [F.coalesce(values[f].cast("double"), F.lit(0.0)).alias(f) for f in FEATURES]
    return F.struct(_span(kind, start, x).alias("span"), _keeps_rules(KINDS[kind], x).alias("ok"), F.struct(*numbers).alias("x"))


def _wide(kind: int) -> Column:
    m, s, p = (F.col(f"{c}_w{kind}") for c in "msp")
    return F.transform(m, lambda x, i: _candidate(kind, x, F.get(p, i), F.get(s, i), F.get(s, i + 1)))


def candidates(docs: DataFrame) -> DataFrame:
    """Per document: id, base (spans by kind and start) and wide (candidates with features)."""
    rows = docs.select(col("doc_id").alias("id"), text_or_empty().alias("t"))
    guards = {"email": F.contains("t", F.lit("@")), "phone": F.contains("t", F.lit("+"))}
    for k, kind in enumerate(KINDS):
        rows = _found(rows, f"b{k}", BASE[kind], guards.get(kind, F.lit(True)))
        rows = _found(rows, f"w{k}", WIDE[kind], F.col("t").rlike(GUARD[kind]) if kind == "email" else F.lit(True))
    rows = rows.select("id", *[c for c in rows.columns if c[:2] in ("m_", "s_", "p_")])
    rows = rows.withColumns({f"base{k}": _base(k) for k in range(len(KINDS))} | {f"wide{k}": _wide(k) for k in range(len(KINDS))})
    return rows.select(
        "id", *[f"base{k}" for k in range(len(KINDS))],
        F.concat(*[f"base{k}" for k in range(len(KINDS))]).alias("base"), F.concat(*[f"wide{k}" for k in range(len(KINDS))]).alias("wide"),
    )


@dataclass(frozen=True)
class Model:
    """Boosted trees as nested tuples (feature, threshold, left, right) or leaf values, and a threshold per kind."""

    trees: list
    thresholds: dict[int, float]

    def score(self, x: Column) -> Column:
        """Between 0 and 1."""

        def value(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            feature, limit, left, right = node
            return F.when(x[FEATURES[feature]] <= limit, value(left)).otherwise(value(right))

        total = reduce(lambda a, b: a + b, [value(tree) * weight for tree, weight in self.trees])
        return 1 / (1 + F.exp(-2 * total))


def _nodes(node) -> tuple | float:
    """A fitted tree as plain values."""
    if node.subtreeDepth() == 0:
        return float(node.prediction())
    split = node.split()
    return (split.featureIndex(), float(split.threshold()), _nodes(node.leftChild()), _nodes(node.rightChild()))


def train(docs: DataFrame, sample: int = TRAINING_SPANS) -> Model | None:
    """Fits trees on at most about ``sample`` candidates of each kind and label, and thresholds on all documents."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    seen = candidates(docs).select("id", "base", F.explode("wide").alias("w"))
    same = F.exists("base", lambda b: (b["start"] == F.col("w.span.start")) & (b["stop"] == F.col("w.span.stop")) & (b["kind"] == F.col("w.span.kind")))
    place = F.xxhash64("id", "w").bitwiseAND(F.lit(2**62 - 1))
    labelled = seen.select(
        F.when(same, 1.0).when(~F.col("w.ok"), 0.0).alias("label"), F.pmod(F.xxhash64("id", "w.span.start"), F.lit(4)).alias("fold"),
        place.alias("place"), F.floor(F.log2(place + 1) * 8).cast("int").alias("level"), "w.x.*",
    ).where(F.col("label").isNotNull())
    labelled = session.cut_lineage(labelled)
    cells = labelled.where("fold != 0").groupBy(F.col("kind").cast("int").alias("kind"), "label", "level").count().collect()
    sides = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    if len(sides) < 2 or sum(sides.values()) < LEAST_LABELLED:
        return None
    last = _levels([tuple(r) for r in cells], sample)
    fits = reduce(
        lambda a, b: a | b, [(F.col("kind") == kind) & (F.col("label") == label) & (F.col("level") <= level) for (kind, label), level in last.items()], F.lit(False)
    )
    labelled = labelled.withColumn("fit", (F.col("fold") != 0) & fits)
    # Repeated rows are one example, so that their number is no bound.
    chosen = labelled.where("fit").dropDuplicates(["kind", "label", "place"])
    if chosen.select("label").distinct().count() < 2:
        return None
    booster = GBTClassifier(featuresCol="features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=11, maxBins=32)
    fitted = booster.fit(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(chosen))
    trees = [(_nodes(t._java_obj.rootNode()), float(w)) for t, w in zip(fitted.trees, fitted.treeWeights, strict=True)]
    score = F.floor(Model(trees, {}).score(F.struct(*FEATURES)) * SCORES) / SCORES
    counts = labelled.groupBy(F.col("kind").cast("int").alias("kind"), score.alias("score"), "label", "fit").count().collect()
    held = {r["kind"] for r in counts if r["label"] and not r["fit"]}
    return Model(trees, _thresholds([(r["kind"], r["score"], r["label"], r["count"]) for r in counts if not r["fit"] or r["kind"] not in held]))


def _levels(cells: list[tuple[int, float, int, int]], most: int) -> dict[tuple[int, float], int]:
    """Per kind and label the last level of hashes that belongs to the fit, from (kind, label, level, candidates)."""
    out: dict[tuple[int, float], int] = {}
    total: dict[tuple[int, float], int] = {}
    for kind, label, level, n in sorted(cells):
        cell = (kind, label)
        total[cell] = total.get(cell, 0) + n
        if cell not in out or total[cell] <= most:
            out[cell] = level
    return out


def _thresholds(held: list[tuple[int, float, float, int]]) -> dict[int, float]:
    """Per kind, from counts of candidates (kind, score, label, count); kinds without known spans get none."""
    out = {}
    for kind in {k for k, _, _, _ in held}:
        ranked = sorted(((s, y, n) for k, s, y, n in held if k == kind), reverse=True)
        known = sum(n for _, y, n in ranked if y)
        if not known:
            continue
        right, seen, lowest = 0, 0, None
        for at, (s, y, n) in enumerate(ranked, 1):
            right, seen = right + n * (y > 0), seen + n
            if right >= PRECISION * seen and (at == len(ranked) or ranked[at][0] < s):
                lowest = s
        below, typical = 0, 0.0
        for s, y, n in reversed(ranked):
            below += n * (y > 0)
            if below > int(LEAST_TYPICAL * known):
                typical = s
                break
        if lowest is not None:
            out[kind] = max(0.5, lowest, typical)
    return out


def _added(model: Model | None) -> Column:
    """Accepted candidates that touch neither a base span nor a better one before them."""
    none = F.array().cast("array<struct<kind:int,start:int,stop:int>>")
    if model is None or not model.thresholds:
        return none

    def bar(w: Column) -> Column:
        first, *rest = model.thresholds.items()
        chosen = F.when(w["span"]["kind"] == first[0], F.lit(first[1]))
        for kind, value in rest:
            chosen = chosen.when(w["span"]["kind"] == kind, F.lit(value))
        return chosen

    def touches(spans: Column, w: Column) -> Column:
        return F.exists(spans, lambda b: (b["start"] < w["stop"]) & (w["start"] < b["stop"]))

    scored = F.transform("wide", lambda w: F.struct((-model.score(w["x"])).alias("rank"), w["span"].alias("span"), (w["ok"] & (model.score(w["x"]) >= bar(w))).alias("in")))
    passed = F.array_sort(F.filter(scored, lambda w: F.coalesce(w["in"], F.lit(False)) & ~touches(F.col("base"), w["span"])))
    return F.aggregate(passed, none, lambda taken, w: F.when(touches(taken, w["span"]), taken).otherwise(F.concat(taken, F.array(w["span"]))))


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")


def find_spans(docs: DataFrame, model: Model | None) -> DataFrame:
    """Per document: doc_id, the arrays base and spans of (kind, start, stop), sorted by kind and start."""
    rows = candidates(docs).withColumn("added", _added(model))
    return rows.select(F.col("id").alias("doc_id"), *[f"base{k}" for k in range(len(KINDS))], "base", F.array_sort(F.concat("base", "added")).alias("spans"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of the base spans; spans (all) and n_added."""
    found = find_spans(docs, train(docs))
    return found.select(
        "doc_id",
        *[F.size(f"base{k}").cast("bigint").alias(f"n_{kind}") for k, kind in enumerate(KINDS)],
        F.sha2(_written(F.col("base")), 256).alias("base_sha256"),
        _written(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size("base")).cast("bigint").alias("n_added"),
    )
