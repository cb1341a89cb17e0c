"""Personal data by weak supervision, in DataFrame functions alone.

1. Regular expressions give base spans and looser candidates. A match is wrapped in a marker and the
   text split at the markers, so that one pass gives the matches, their offsets and what stands before.
2. Labelers vote yes, no or abstain on each span: by its form (regex), by lists of domains, calling codes
   and card prefixes (gazetteer), and by the words before it (context).
3. Only counts of vote and feature patterns leave the tasks; their number is bounded by the labelers and
   features, not by the data. Expectation-maximisation over them estimates the labelers' reliabilities,
   and the posteriors train a logistic span classifier over the features.
4. Candidates that the classifier accepts and that touch no base span are added. Base spans stay.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from risetide.llm.work import saved

KINDS = ("email", "ip", "card", "phone")
#: Wraps matches; the same character in a text is replaced by its neighbour first.
_MARK, _NEAR = "\ue000", "\ue001"
#: The base patterns. Possessive loops give the same matches without backtracking; a match can only begin
#: where a run of its first characters does, or where the match before it ended.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?=[0-9])(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser candidates, by the kind they may be.
LOOSE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+\x20?[\[(]\x20?at\x20?[\])]\x20?[a-z0-9-]{1,64}+"
             r"(?:\x20?[\[(]\x20?dot\x20?[\])]\x20?[a-z0-9-]{1,64}+){1,8}+",
    "phone": r"(?=[0-9(])(?<![A-Za-z0-9+=_/.-])(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[\x20.-]{1,2}[0-9]{2,4}){2,4}(?![A-Za-z0-9_-])",
}
_OCTETS = r"^0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(\.0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})){3}$"
#: Gazetteers.
DOMAINS = ("com", "net", "org", "edu", "gov", "info", "io", "co", "de", "fr", "es", "uk", "eu", "us")
CALLING_CODES = ("1", "30", "31", "32", "33", "34", "39", "41", "43", "44", "45", "46", "47", "48", "49", "61", "81", "86", "91")
CARD_PREFIXES = r"^(4|5[1-5]|2[2-7]|3[47]|6011|65|35)"
#: Context words.
FOR_WORDS = r"(?i)\b(tel|telephone|phone|call|fax|mobile|cell|mail|email|e-mail|contact|card|visa|credit|ip|address|reach)\b[^\n]{0,20}$"
AGAINST_WORDS = r"(?i)\b(id|no|nr|number|order|version|isbn|page|pages|section|token|key|hash|line)\b\.?[^\n]{0,6}$"
YES, NO, ABSTAIN = "y", "n", "-"
LABELERS = 7
ACCEPT = 0.5
PRIOR = 0.1
_ROUNDS, _STEPS = 200, 400
_PART = 256


def _pieces(text: Column, pattern: str, possible: Column) -> Column:
    """The text cut around its matches: what is between them at even places, matches at odd ones."""
    marked = F.regexp_replace(text, pattern, f"{_MARK}$0{_MARK}")
    return F.when(possible, F.split(marked, _MARK, -1))


def _let(value: Column, body) -> Column:
    """body of value, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _starts(lengths: Column) -> Column:
    """Sums of the lengths before each place, in parts of _PART: a fold copies what it has gathered at every
    step, so none gathers more than a part or a number for each part."""
    def gathered(values: Column, begin: Column) -> Column:
        empty = F.struct(begin.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(values, empty, lambda acc, x: F.struct(
            (acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def part(k: Column) -> Column:
        return F.slice(lengths, k * _PART + 1, F.lit(_PART))

    parts = F.sequence(F.lit(0), ((F.size(lengths) - 1) / _PART).cast("int"))
    sums = F.transform(parts, lambda k: F.aggregate(part(k), F.lit(0), lambda total, x: total + x))
    return F.flatten(F.transform(gathered(sums, F.lit(0)), lambda begin, k: gathered(part(k), begin)))


def _spans(pieces: Column, order: int, loose: bool) -> Column:
    """array<struct(start, ord, end, loose, value, before)> of a text's pieces; null pieces: none."""
    kind = "array<struct<start:int,ord:int,end:int,loose:boolean,value:string,before:string>>"

    def told(ps: Column, starts: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(ps) - 1, F.lit(2)), lambda i: F.struct(
            F.get(starts, i).alias("start"), F.lit(order).alias("ord"), (F.get(starts, i) + F.length(F.get(ps, i))).alias("end"),
            F.lit(loose).alias("loose"), F.get(ps, i).alias("value"), F.right(F.get(ps, i - 1), F.lit(40)).alias("before")))

    def of(ps: Column) -> Column:
        lengths = F.transform(ps, lambda p: F.length(p))
        return _let(lengths, lambda n: _let(_starts(n), lambda starts: told(ps, starts)))

    return F.when(F.size(pieces) > 1, _let(pieces, of)).otherwise(F.array().cast(kind))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9]", "")


def _valid(kind: str, value: Column) -> Column:
    digits = F.length(_digits(value))
    if kind == "ip":
        return value.rlike(_OCTETS)
    if kind == "card":
        return digits.between(12, 19) & F.call_function("luhn_check", _digits(value))
    if kind == "phone":
        return digits.between(9, 15)
    return F.lit(True)


def _check(kind: str):
    return lambda span: _valid(kind, span["value"])


def _failed(kind: str):
    least = {"card": 12, "phone": 7}.get(kind, 4)
    return lambda span: ~_valid(kind, span["value"]) & F.length(_digits(span["value"])).between(least, 24)


def _of_kind(order: int):
    return lambda span: span["ord"] == order


def _any_of(*votes: tuple[Column, str]) -> Column:
    chosen = F.lit(ABSTAIN)
    for condition, vote in reversed(votes):
        chosen = F.when(condition, F.lit(vote)).otherwise(chosen)
    return chosen


def _votes(span: Column) -> Column:
    """One letter for each labeler."""
    value, before, order = span["value"], span["before"], span["ord"]
    email, ip, card, phone = (order == i for i in range(len(KINDS)))
    digits = _digits(value)
    code = F.regexp_extract(value, r"^\+([0-9]{1,2})", 1)
    domain = F.lower(F.element_at(F.split(value, r"[^A-Za-z0-9-]+"), -1))
    form = _any_of((email & ~span["loose"], YES), (ip & ~span["loose"], YES), (card & F.call_function("luhn_check", digits), YES), (card, NO),
                   (phone & value.startswith("+"), YES))
    shape = _any_of((phone & value.rlike(r"[0-9]{3}[\x20.)-]{1,2}[0-9]{3}[\x20.-][0-9]{4}$"), YES),
                    (phone & value.rlike(r"^[0-9]{4}[.-][0-9]{2}[.-][0-9]{2}$|^[0-9]{1,2}[.-][0-9]{1,2}[.-][0-9]{4}$"), NO),
                    (digits.rlike(r"^([0-9])\1+$"), NO))
    count = _any_of((phone & F.length(digits).between(9, 13), YES), (phone, NO), (card & F.length(digits).isin(13, 15, 16, 19), YES))
    listed = _any_of((email & domain.isin(*DOMAINS), YES), (email, NO), (phone & (code.isin(*CALLING_CODES) | F.left(code, F.lit(1)).isin("1")), YES),
                     (card & digits.rlike(CARD_PREFIXES), YES), (card, NO), (ip & value.rlike(r"^(0|255)\."), NO))
    context = _any_of((before.rlike(FOR_WORDS), YES))
    against = _any_of((before.rlike(AGAINST_WORDS), NO))
    glued = _any_of((before.rlike(r"[A-Za-z0-9_=/]$"), NO), (before.rlike(r"(^|[\s,;:(\[])$"), YES))
    return F.concat(form, shape, count, listed, context, against, glued)


def _features(span: Column) -> Column:
    """A short text of discrete features: kind, looseness, size, separators, sign, context."""
    value = span["value"]
    size = F.least(F.length(_digits(value)), F.lit(20)).cast("string")
    parts = F.least(F.size(F.split(value, r"[^A-Za-z0-9]+", -1)), F.lit(6)).cast("string")
    flags = [value.startswith("+"), span["before"].rlike(FOR_WORDS), span["before"].rlike(AGAINST_WORDS), value.contains("(")]
    return F.concat_ws("|", span["ord"].cast("string"), F.when(span["loose"], "loose").otherwise("base"), size, parts,
                       *[F.when(f, "1").otherwise("0") for f in flags])


def spans_of(docs: DataFrame) -> DataFrame:
    """(doc_id, base, found) for every row: base spans, and all spans with their votes and features."""
    raw = F.coalesce(F.col("text").cast("string"), F.lit(""))
    clean = F.when(raw.contains(_MARK), F.translate(raw, _MARK, _NEAR)).otherwise(raw)
    rows = docs.select(F.col("doc_id").cast("long"), clean.alias("text"))
    text = F.col("text")
    possible = {"email": text.contains("@"), "ip": text.contains("."), "card": F.lit(True), "phone": text.contains("+")}
    cut = rows.select(
        "doc_id", *[_pieces(text, BASE[k], possible[k]).alias(f"base_{k}") for k in KINDS],
        _pieces(text, LOOSE["email"], F.lower(text).contains("dot")).alias("loose_email"),
        _pieces(text, LOOSE["phone"], F.lit(True)).alias("loose_phone"))
    matched = cut.select(
        "doc_id", *[_spans(F.col(f"base_{k}"), i, False).alias(k) for i, k in enumerate(KINDS)],
        *[_spans(F.col(f"loose_{k}"), KINDS.index(k), True).alias(f"loose_{k}") for k in LOOSE])
    # base matches that fail their check are candidates, if they are long enough to mean anything
    found = matched.select(
        "doc_id", F.concat(*[F.filter(k, _check(k)) for k in KINDS]).alias("base"),
        F.concat(*[F.col(f"loose_{k}") for k in LOOSE],
                 *[F.transform(F.filter(k, _failed(k)), lambda s: s.withField("loose", F.lit(True))) for k in KINDS]).alias("loose"))
    apart = F.filter("loose", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    told = found.select("doc_id", F.concat("base", apart).alias("spans"))
    return told.select("doc_id", F.transform("spans", lambda s: F.struct(
        s["start"].alias("start"), s["ord"].alias("ord"), s["end"].alias("end"), s["loose"].alias("loose"),
        _votes(s).alias("votes"), _features(s).alias("features"))).alias("spans"))


@dataclass(frozen=True)
class Model:
    reliability: dict[str, list[dict[tuple[bool, str], float]]]
    share: dict[str, float]
    accepted: list[str]


def posteriors(counts: dict[str, int]) -> tuple[dict[str, float], list[dict[tuple[bool, str], float]], float]:
    """Expectation-maximisation over the vote patterns of one kind: P(personal | votes), P(vote | class),
    share. A weak prior, PRIOR of the weight, says that labelers are rather right than wrong."""
    total = sum(counts.values())
    prior = PRIOR * total
    belief = {v: (v.count(YES) + 0.5) / (v.count(YES) + 4 * v.count(NO) + 1) for v in counts}
    chance, share = [], 0.5
    for _ in range(_ROUNDS if total else 0):
        share = (sum(belief[v] * n for v, n in counts.items()) + prior / 2) / (total + prior)
        chance = []
        for j in range(LABELERS):
            own = {(True, YES): 0.6, (True, NO): 0.1, (False, YES): 0.1, (False, NO): 0.6, (True, ABSTAIN): 0.3, (False, ABSTAIN): 0.3}
            own = {k: x * prior + 1e-9 for k, x in own.items()}
            for v, n in counts.items():
                own[True, v[j]] += belief[v] * n
                own[False, v[j]] += (1 - belief[v]) * n
            sums = {c: own[c, YES] + own[c, NO] + own[c, ABSTAIN] for c in (False, True)}
            chance.append({k: x / sums[k[0]] for k, x in own.items()})
        following = {}
        for v in counts:
            odds = math.log(share / (1 - share)) + sum(math.log(chance[j][True, x] / chance[j][False, x]) for j, x in enumerate(v))
            following[v] = 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))
        moved = max(abs(following[v] - belief[v]) for v in counts)
        belief = following
        if moved < 1e-9:
            break
    return belief, chance, share


def train(patterns: dict[str, tuple[float, float]]) -> dict[str, float]:
    """Logistic regression over the parts of the feature texts, by gradient steps.
    patterns: features -> (weight of personal, weight of other); returns each pattern's probability."""
    parts = {p: [f"{i}={x}" for i, x in enumerate(p.split("|"))] + ["kind " + "|".join(p.split("|")[:3])] for p in patterns}
    weights = dict.fromkeys({x for own in parts.values() for x in own} | {""}, 0.0)
    grown = dict.fromkeys(weights, 1e-6)
    total = sum(a + b for a, b in patterns.values()) or 1.0

    def chance(own: list[str]) -> float:
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, weights[""] + sum(weights[x] for x in own)))))

    for _ in range(_STEPS):
        slope = {k: 1e-5 * w for k, w in weights.items()}
        for p, (yes, no) in patterns.items():
            error = (chance(parts[p]) * (yes + no) - yes) / total
            for x in [*parts[p], ""]:
                slope[x] += error
        for k, g in slope.items():
            grown[k] += g * g
            weights[k] -= 0.3 * g / math.sqrt(grown[k])
    return {p: chance(own) for p, own in parts.items()}


def fit(spans: DataFrame) -> Model:
    """Reliabilities and classifier from the patterns of all spans."""
    rows = sorted(spans.select(F.explode("spans").alias("s")).groupBy("s.ord", "s.votes", "s.features")
                  .agg(F.count(F.lit(1)).alias("n")).collect())
    reliability, share = {}, {}
    patterns: dict[str, tuple[float, float]] = {}
    for order, kind in enumerate(KINDS):
        counts: dict[str, int] = {}
        for r in rows:
            if r.ord == order:
                counts[r.votes] = counts.get(r.votes, 0) + r.n
        belief, reliability[kind], share[kind] = posteriors(counts)
        for r in rows:
            if r.ord == order:
                yes, no = patterns.get(r.features, (0.0, 0.0))
                patterns[r.features] = (yes + belief[r.votes] * r.n, no + (1 - belief[r.votes]) * r.n)
    return Model(reliability, share, sorted(p for p, x in train(patterns).items() if x >= ACCEPT))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), s["ord"].alias("b"), s["end"].alias("c"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(
        ":", F.get(names, s["b"]), s["a"].cast("string"), s["c"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row of docs (doc_id, text).

    Offsets are code points, ends exclusive. The counts and the digest are those of the base spans; spans
    holds these and the accepted candidates, which never touch a base span. A null or empty text has
    none: zeros, the digest of the empty string, and an empty string. Rows are judged alike wherever they
    stand, so repeated rows and null ids stay. Empty table: no rows. Other columns are ignored.
    """
    spans = saved(spans_of(docs), "pii-spans")
    accepted = fit(spans).accepted
    base = F.filter("spans", lambda s: ~s["loose"])
    whole = F.filter("spans", lambda s: ~s["loose"] | s["features"].isin(*accepted)) if accepted else base
    return spans.select(
        "doc_id", *[F.size(F.filter(base, _of_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(whole).alias("spans"))
