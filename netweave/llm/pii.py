"""Personal data by weak supervision, with DataFrame functions only.

Base spans come from strict patterns and always stay. Looser patterns add candidates: addresses
written with (at) and (dot), long-form IPv6 addresses, card numbers of 13 to 15 digits, phone numbers
without a country code. Five labelers vote on every span: the pattern (strict or checked), a
gazetteer (top-level domains, first octets, card issuers, country codes), the words before it, its
borders, and its form. For each kind, expectation-maximisation over the counted vote patterns
estimates how reliable each labeler is. The resulting probabilities train the final span
classifier, a logistic regression on votes and span features, which decides on the candidates.

The driver sees counts of (kind, votes, features), whose number is bounded by the labelers
and feature buckets, not by the documents.

Defined results: a null text is empty and has no span. Repeated rows each get their row. Offsets are code
points, ends exclusive. A candidate that overlaps a base span, or an accepted candidate of an
earlier kind, is left out. Without any span the labelers keep their prior
reliability. Extra columns do not matter; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netweave.llm.common import stored
from netweave.plans.once import computed_once

KINDS = ["email", "ip", "card", "phone"]
ACCEPT = 0.8
CONTEXT = 24
BLOCK = 256

# Strict patterns. Runs are read possessively and only from their first character (or where the match before
# ended), which gives the same leftmost matches in time that is linear in the text.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
# Looser patterns.
SPELLED_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[(\[](?:at|AT)[)\]] ?[A-Za-z0-9-]++(?: ?[(\[](?:dot|DOT)[)\]] ?[A-Za-z0-9-]++|\.[A-Za-z0-9-]++)++"
IPV6 = r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])"
SHORT_CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,14}+(?![ -]?[0-9])"
LOCAL_PHONE = r"(?<![0-9A-Za-z+.-])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{4}(?![0-9A-Za-z])"

PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
VALID_IP = rf"^{PART}(?:\.{PART}){{3}}$"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _digit_count_between(text: Column, least: int, most: int) -> Column:
    return F.length(_digits(text)).between(least, most)


@dataclass(frozen=True)
class Pattern:
    kind: int
    base: bool
    regex: str
    maybe: Callable[[Column], Column]  # cheap: false only where the pattern cannot match
    valid: Callable[[Column], Column]


PATTERNS = [
    Pattern(0, True, EMAIL, lambda t: F.contains(t, F.lit("@")), lambda m: F.lit(True)),
    Pattern(1, True, IP, lambda t: t.rlike(r"[0-9]\.[0-9]"), lambda m: m.rlike(VALID_IP)),
    Pattern(2, True, CARD, lambda t: t.rlike(r"[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]"), lambda m: F.call_function("luhn_check", _digits(m))),
    Pattern(3, True, PHONE, lambda t: F.contains(t, F.lit("+")), lambda m: _digit_count_between(m, 8, 15)),
    Pattern(0, False, SPELLED_EMAIL, lambda t: t.rlike(r"[(\[](?:at|AT)[)\]]"), lambda m: F.lit(True)),
    Pattern(1, False, IPV6, lambda t: t.rlike("[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]"), lambda m: F.lit(True)),
    Pattern(2, False, SHORT_CARD, lambda t: t.rlike(r"[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]"), lambda m: F.call_function("luhn_check", _digits(m))),
    Pattern(3, False, LOCAL_PHONE, lambda t: t.rlike("[0-9][ .-][0-9]{4}"), lambda m: F.lit(True)),
]

#: What the gazetteer knows, as patterns on the span.
DOMAINS = r"(?i)[.\]) ](com|org|net|edu|gov|mil|int|info|io|dev|app|eu|de|fr|es|it|nl|be|at|ch|pl|pt|se|no|dk|fi|uk|us|ca|mx|br|ar|au|nz|jp|cn|in|ru)$"
FIRST_OCTETS = r"^0*([1-9]|[1-9][0-9]|1[0-9][0-9]|2[01][0-9]|22[0-3])\."
ISSUERS = r"^(4|5[1-5]|2(22[1-9]|2[3-9]|[3-6]|7[01]|720)|3[47]|3[068]|6011|65|62|35)"
COUNTRIES = r"^(1|7|2[07]|3[0-9]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
BEFORE = {
    0: "mail|contact|write|reach|address|correo|courriel|adresse",
    1: r"\bip\b|host|server|addr|node|client|from",
    2: "card|visa|credit|debit|pay|karte|carte|tarjeta",
    3: "phone|tel|call|mobil|cell|fax|handy|numero",
}
AGAINST = r"version|build|isbn|issn|invoice|order|serial|sku|\bid\b|\bref\b|\bno\.|§|#"

VOTES = ["pattern", "gazetteer", "context", "border", "form"]
FEATURES = ["length_bucket", "digit_bucket"]


def _vote(yes: Column, no: Column) -> Column:
    """1 for, -1 against, 0 for no opinion."""
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _gazetteer(kind: int, base: bool, m: Column) -> Column:
    known = {
        0: m.rlike(DOMAINS), 1: m.rlike(FIRST_OCTETS), 2: _digits(m).rlike(ISSUERS),
        3: _digits(m).rlike(COUNTRIES) if base else _digits(m).rlike("^[2-9]"),
    }[kind]
    return F.lit(0) if (kind, base) == (1, False) else _vote(known, ~known)


def _form(kind: int, base: bool, m: Column) -> Column:
    if kind == 0:
        return _vote(~m.rlike(r"\.\.|^\.|\.@|@-") & (F.length(m) <= 254), F.length(m) > 254)
    if kind == 1:
        return _vote(~m.rlike(r"(^|\.)0[0-9]"), m.rlike(r"(^|\.)0[0-9]"))
    if kind == 2:
        # digits alone or in regular groups
        regular = m.rlike(r"^([0-9]+|[0-9]{4}([ -][0-9]{1,4}){3,4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5})$")
        return _vote(regular, ~regular)
    return _vote(_digit_count_between(m, 10, 13), ~_digit_count_between(m, 9, 15))


def _span(p: Pattern, start: Column, m: Column, left: Column, right: Column) -> Column:
    share = F.length(_digits(m)) / F.length(m)
    edge = left.rlike("[A-Za-z0-9]$") | right.rlike("^[A-Za-z0-9]")
    context = F.lower(left)
    return F.struct(
        F.lit(p.kind).alias("kind"), F.lit(p.base).alias("base"), start.cast("int").alias("start"),
        (start + F.length(m)).cast("int").alias("end"),
        F.lit(1 if p.base else 0).alias("pattern"), _gazetteer(p.kind, p.base, m).alias("gazetteer"),
        _vote(context.rlike(BEFORE[p.kind]), context.rlike(AGAINST)).alias("context"),
        _vote(~edge, edge).alias("border"), _form(p.kind, p.base, m).alias("form"),
        F.least(F.floor(F.length(m) / 8), F.lit(3)).cast("int").alias("length_bucket"),
        F.floor(share * 3.99).cast("int").alias("digit_bucket"), p.valid(m).alias("valid"),
    )


def _lengths(gaps: Column, matches: Column) -> Column:
    return F.transform(matches, lambda m, k: F.length(F.get(gaps, k)) + F.length(m))


def _of_kind(spans: str, kind: int) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def find_spans(documents: DataFrame) -> DataFrame:
    """doc_id and ``spans``: base spans and the candidates that overlap none of them, with votes and features."""
    df = documents.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    none = F.array().cast("array<string>")
    text = F.col("text")
    df = computed_once(df, **{
        f"m{i}": F.when(p.maybe(text), F.regexp_extract_all(text, F.lit(p.regex), F.lit(0))).otherwise(none)
        for i, p in enumerate(PATTERNS)
    })
    df = computed_once(df, **{
        f"p{i}": F.when(F.size(f"m{i}") > 0, F.split(text, p.regex, -1)).otherwise(none) for i, p in enumerate(PATTERNS)
    }).drop("text")
    # lengths of gap and match; their sums in blocks, so that a start needs at most BLOCK additions
    df = computed_once(df, **{
        f"l{i}": _lengths(F.col(f"p{i}"), F.col(f"m{i}")) for i in range(len(PATTERNS))
    })

    def block_starts(i: int) -> Column:
        add = lambda a, x: a + x
        return F.aggregate(
            F.sequence(F.lit(0), F.floor(F.size(f"l{i}") / BLOCK).cast("int")), F.array(F.lit(0)),
            lambda done, b: F.concat(done, F.array(F.aggregate(F.slice(f"l{i}", b * BLOCK + 1, BLOCK), F.get(done, F.size(done) - 1), add))),
        )

    df = computed_once(df, **{f"b{i}": F.when(F.size(f"l{i}") > 0, block_starts(i)) for i in range(len(PATTERNS))})

    def spans(i: int, p: Pattern) -> Column:
        def one(m: Column, k: Column) -> Column:
            block = F.floor(k / BLOCK).cast("int")
            before = F.aggregate(F.slice(f"l{i}", block * BLOCK + 1, k % BLOCK), F.get(f"b{i}", block), lambda a, x: a + x)
            gap = F.get(f"p{i}", k)
            return _span(p, before + F.length(gap), m, F.right(gap, F.lit(CONTEXT)), F.left(F.get(f"p{i}", k + 1), F.lit(1)))

        return F.filter(F.transform(f"m{i}", one), lambda s: s["valid"])

    df = computed_once(df, **{f"s{i}": spans(i, p) for i, p in enumerate(PATTERNS)})
    df = computed_once(
        df,
        base=F.concat(*[F.col(f"s{i}") for i, p in enumerate(PATTERNS) if p.base]),
        loose=F.concat(*[F.col(f"s{i}") for i, p in enumerate(PATTERNS) if not p.base]),
    )
    clear = F.filter("loose", lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    return df.select("doc_id", F.concat("base", clear).alias("spans"))


# ---------------------------------------------------------------- learning from counts


def expectation_maximisation(patterns: dict[tuple[int, ...], int], rounds: int = 40) -> tuple[float, list[dict[int, tuple[float, float]]]]:
    """Share of true spans, and per labeler the chance of each vote given true and given false.

    ``patterns`` counts vote tuples. Priors say that labelers are better than chance; they decide
    while there is little to count.
    """
    labelers = len(VOTES)
    prior = {1: (6.0, 2.0), -1: (1.0, 6.0), 0: (3.0, 3.0)}
    chance = [{v: (prior[v][0] / 10, prior[v][1] / 11) for v in prior} for _ in range(labelers)]
    true_share = 0.5
    for _ in range(rounds):
        counts = [{v: list(prior[v]) for v in prior} for _ in range(labelers)]
        true_sum, total = 1.0, 2.0
        for votes, n in patterns.items():
            p = posterior(votes, true_share, chance)
            true_sum, total = true_sum + n * p, total + n
            for j, v in enumerate(votes):
                counts[j][v][0] += n * p
                counts[j][v][1] += n * (1 - p)
        true_share = min(max(true_sum / total, 0.01), 0.99)
        for j in range(labelers):
            sums = [sum(c[k] for c in counts[j].values()) for k in (0, 1)]
            chance[j] = {v: (c[0] / sums[0], c[1] / sums[1]) for v, c in counts[j].items()}
    return true_share, chance


def posterior(votes: tuple[int, ...], true_share: float, chance: list[dict[int, tuple[float, float]]]) -> float:
    odds = math.log(true_share / (1 - true_share))
    for v, seen in zip(votes, chance):
        odds += math.log(seen[v][0] / seen[v][1])
    return 1 / (1 + math.exp(-max(min(odds, 30), -30)))


def _indicators(votes: tuple[int, ...], features: tuple[int, ...]) -> list[str]:
    return [
        "bias", *[f"{n}={v}" for n, v in zip(VOTES, votes) if v], *[f"{n}={v}" for n, v in zip(FEATURES, features)],
    ]


def train_classifier(rows: list[tuple[tuple[int, ...], tuple[int, ...], int, float]], rounds: int = 200) -> dict[str, float]:
    """Logistic regression on (votes, features, count, probability of being true) by gradient steps; small weights preferred."""
    weights: dict[str, float] = {}
    total = sum(n for *_, n, _ in rows)
    for _ in range(rounds):
        slope: dict[str, float] = {}
        for votes, features, n, target in rows:
            names = _indicators(votes, features)
            wrong = target - 1 / (1 + math.exp(-max(min(sum(weights.get(k, 0.0) for k in names), 30), -30)))
            for k in names:
                slope[k] = slope.get(k, 0.0) + n / total * wrong
        for k, s in slope.items():
            weights[k] = weights.get(k, 0.0) + 2.0 * (s - 1e-4 * weights.get(k, 0.0))
    return weights


#: A classifier per kind, and what the expectation-maximisation says about each labeler of the kind.
@dataclass
class Model:
    weights: dict[int, dict[str, float]]
    chance: dict[int, tuple[float, list[dict[int, tuple[float, float]]]]]

    def accepts(self, span: Column) -> Column:
        """The classifier as one expression over a span's votes and features."""
        out = F.lit(False)
        for kind, weights in self.weights.items():
            odds = F.lit(weights.get("bias", 0.0))
            for name, weight in weights.items():
                if "=" in name:
                    field, value = name.split("=")
                    odds = odds + F.when(span[field] == int(value), weight).otherwise(0.0)
            out = F.when(span["kind"] == kind, odds >= math.log(ACCEPT / (1 - ACCEPT))).otherwise(out)
        return out


def learn(spans: DataFrame) -> Model:
    counted = (
        spans.select(F.explode("spans").alias("s")).groupBy(*[F.col(f"s.{c}") for c in ("kind", *VOTES, *FEATURES)]).count().collect()
    )
    weights, chance = {}, {}
    for kind in sorted({r["kind"] for r in counted}):
        rows = sorted((tuple(r[v] for v in VOTES), tuple(r[f] for f in FEATURES), r["count"]) for r in counted if r["kind"] == kind)
        patterns: dict[tuple[int, ...], int] = {}
        for votes, _, n in rows:
            patterns[votes] = patterns.get(votes, 0) + n
        chance[kind] = expectation_maximisation(patterns)
        weights[kind] = train_classifier([(v, f, n, posterior(v, *chance[kind])) for v, f, n in rows])
    return Model(weights, chance)


def label(documents: DataFrame) -> DataFrame:
    """doc_id, base spans and added spans (kind, start, end) of each whole text."""
    spans = stored(find_spans(documents), "pii-spans")
    model = learn(spans)
    short = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    in_order = lambda spans: F.array_sort(F.transform(spans, short))
    chosen = computed_once(spans, _chosen=F.filter("spans", lambda s: ~s["base"] & model.accepts(s)))
    # of overlapping candidates the one of the earlier kind stays
    apart = F.filter("_chosen", lambda c: ~F.exists("_chosen", lambda o: (o["kind"] < c["kind"]) & (o["start"] < c["end"]) & (c["start"] < o["end"])))
    return computed_once(chosen, base=in_order(F.filter("spans", lambda s: s["base"])), added=in_order(apart)).select("doc_id", "base", "added")


def span_text(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(documents: DataFrame) -> DataFrame:
    """Counts of base spans, their digest, and all spans as text."""
    found = label(documents)
    counts = [
        F.size(_of_kind("base", k)).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)
    ]
    return found.select(
        "doc_id", *counts, F.sha2(span_text(F.col("base")), 256).alias("base_sha256"),
        span_text(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_added"),
    )
