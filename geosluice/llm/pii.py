"""Personal data: candidate spans, gradient-boosted trees, calibrated thresholds.

Base spans (email, ip, card, phone) come from fixed patterns and checks and
always stay.  High-recall generators propose more: numbers in groups, tokens
that mix letters and digits, spelled-out addresses.  Candidates may overlap.
Boosted regression trees score each by its format and its context, and those
over a threshold, calibrated per kind on held-out examples for a wanted
precision and never below even odds, are added unless a base span overlaps them.  Where added spans of
several kinds overlap, the one furthest over its threshold stays.

The trees learn from EXAMPLES made from templates and from all different candidates of
the documents that base patterns label: a number inside a base phone is one, seen without
its country code; a base email spelled out is one; candidates within base spans of
other kinds, and within near misses of base patterns (long numbers that fail the
Luhn check, four parts over 255, numbers after a plus too short or long), are none.
Spark counts them by their features, and trees and thresholds are fitted to these counts:
no candidate is left out.  If there are over VECTORS different vectors of features, those are
made coarser by twos until there are not.  Candidates of documents weigh LABELLED at
most, all together, so that templates keep their say.  Half of all, by hash, calibrates and
measures.  Secrets and ids have no base pattern, so their positive examples are templates
only.  Features are computed by the same Column expressions as for documents.

The trained trees are CASE expressions, so the whole path over documents is
DataFrame functions: spans are found by splitting a text at its matches and
summing lengths, in code points.

Patterns are anchored at the start of a run of their first characters or where
the last match ended, which finds the same matches in linear time, and repeat
possessively, so long runs need no stack.

Cases: null text counts as empty; a document without spans has empty strings and
zero counts; rows with equal doc_id are searched each; extra columns are ignored
whatever their names; no rows, no result.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, table

#: Patterns of the base kinds, in the order in which spans are listed.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Generators: kind and pattern.
GENERATORS = {
    "phone": r"(?<![0-9A-Za-z+.])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{2,4}[ .-]?[0-9]{3,4}(?:[ .-][0-9]{2,4})?+(?![0-9A-Za-z])",
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+ ?[\[(] ?dot ?[\])] ?[A-Za-z]{2,}",
    "id": r"(?<![0-9A-Za-z-])[0-9]{3}[ -][0-9]{2}[ -][0-9]{4}(?![0-9A-Za-z-])",
    "secret": r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z]*+[0-9])[A-Za-z0-9][A-Za-z0-9_+/-]{14,}",
}
KINDS = ("email", "ip", "card", "phone", "id", "secret")
CONTEXT = 24
PRECISION = 0.98
EXAMPLES, LABELLED, VECTORS = 1500, 4000, 50_000
#: Features that are numbers and not flags: the first so many.
NUMBERS = 7


def spans(text: Column, pattern: str) -> Column:
    """Leftmost matches as array<struct<s: start, e: end, m: text>>, in code points."""
    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("gap"))

    def walk(f: Column) -> Column:
        empty = F.expr("named_struct('out', cast(array() as array<struct<s: int, e: int, m: string>>), 'i', 0, 'at', 0)")

        def step(acc, m):
            s = acc["at"] + F.length(F.get(f["gap"], acc["i"]))
            e = s + F.length(m)
            return F.struct(F.array_append(acc["out"], F.struct(s.alias("s"), e.alias("e"), m.alias("m"))).alias("out"), (acc["i"] + 1).alias("i"), e.alias("at"))

        return F.aggregate(f["m"], empty, step, lambda acc: acc["out"])

    return F.get(F.transform(F.array(found), walk), F.lit(0))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    doubled = F.transform(
        F.split(F.reverse(digits), ""),
        lambda d, i: F.when(i % 2 == 0, F.coalesce(F.try_to_number(d, F.lit("9")).cast("int"), F.lit(0))).otherwise(F.coalesce(F.try_to_number(d, F.lit("9")).cast("int"), F.lit(0)) * 2 - F.when(d >= "5", 9).otherwise(0)),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, s: Column) -> Column:
    m = s["m"]
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3) & F.forall(F.split(m, r"\."), lambda p: F.lpad(F.regexp_replace(p, "^0+", ""), 3, "0") <= "255")
    if kind == "card":
        return F.length(_digits(m)).between(13, 19) & luhn(_digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> dict[str, Column]:
    """For each base kind its valid spans; texts without its key character are not searched."""
    none = F.expr("cast(array() as array<struct<s: int, e: int, m: string>>)")
    needs = {"email": F.contains(text, F.lit("@")), "ip": F.rlike(text, F.lit(r"[0-9]\.[0-9]")), "card": F.rlike(text, F.lit("[0-9][ -]?[0-9]")), "phone": F.rlike(text, F.lit(r"\+[0-9]"))}
    valid = lambda kind: lambda s: _valid(kind, s)
    return {k: F.when(needs[k], F.filter(spans(text, p), valid(k))).otherwise(none) for k, p in PATTERNS.items()}


def features(m: Column, left: Column, right: Column) -> list[Column]:
    """Numbers that describe a candidate: its format, and words around it."""
    near = F.lower(left)
    digits, letters = F.length(_digits(m)), F.length(F.regexp_replace(m, "[^A-Za-z]", ""))
    flag = lambda text, pattern: F.rlike(text, F.lit(pattern)).cast("double")
    return [
        F.length(m).cast("double"),
        digits.cast("double"),
        letters.cast("double"),
        F.length(F.regexp_replace(m, "[^A-Z]", "")).cast("double"),
        (F.length(m) - digits - letters).cast("double"),
        F.length(F.regexp_replace(m, "[A-Za-z]+|[0-9]+|[^A-Za-z0-9]+", "x")).cast("double"),
        F.size(F.array_distinct(F.split(m, ""))).cast("double"),
        flag(m, r"^\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}$"),
        flag(m, r"^(19|20)[0-9]{2}[-. ](0[1-9]|1[0-2])"),
        flag(near, r"(pass|pwd|secret|token|key|credential|auth)[^ ]*[ =:\"']*$"),
        flag(near, r"(tel|phone|call|mobile|fax|cell)[^ ]*[ :.]*$"),
        flag(near, r"(ssn|social|security|tax|passport|id)[^ ]*[ :.#]*$"),
        flag(near, r"(order|invoice|part|item|version|commit|isbn|no\.|page|https?:)[^ ]*[ :.#/]*$"),
        flag(right, r"^[ ,.;:)\"'\n]|^$"),
    ]


def examples(n: int, seed: int = 3) -> list[tuple[str, str, str, str, int]]:
    """(kind, candidate, left, right, label) made from templates."""
    rng = random.Random(seed)
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    a = lambda k, s: "".join(rng.choice(s) for _ in range(k))
    hexa, upper, lower = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz"
    prose = ("the line of ", "and then we saw ", "il y a ", "nach dem ", "with ", "")
    after = (" and more", ".", ", then", "\n", "", '"')
    out = []
    while len(out) < n:
        r = rng.randrange(14)
        left, right = rng.choice(prose), rng.choice(after)
        made = {
            0: lambda: ("phone", f"({d(3)}) {d(3)}-{d(4)}", left + rng.choice(("", "tel: ", "call ")), 1),
            1: lambda: ("phone", rng.choice((f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}")), left + rng.choice(("", "phone ", "mobile: ")), 1),
            2: lambda: ("phone", f"20{d(2)}-{rng.randint(10, 12)}-{d(4)}"[:10] + d(1), left, 0),
            3: lambda: ("phone", f"{d(3)} {d(3)} {d(3)}", left + rng.choice(("order ", "invoice no. ", "part ", "")), 0),
            4: lambda: ("id", f"{d(3)}-{d(2)}-{d(4)}", left + rng.choice(("ssn ", "social security: ", "tax id ", "")), 1),
            5: lambda: ("id", f"{d(3)} {d(2)} {d(4)}", left + rng.choice(("order ", "part ", "page ", "")), 0),
            6: lambda: ("secret", "AKIA" + a(16, upper), left + rng.choice(("", "key ", "key=")), 1),
            7: lambda: ("secret", a(rng.choice((18, 20, 32, 40)), hexa) + "7a", left + rng.choice(("password=", 'token = "', "secret: ", "api_key=")), 1),
            8: lambda: ("secret", "gh" + a(1, "pos") + "_" + a(36, hexa + upper), left + rng.choice(("", "token ")), 1),
            9: lambda: ("secret", a(rng.randint(10, 16), lower) + rng.choice(("-", "_")) + a(6, lower) + d(1), left + rng.choice(("item ", "")), 0),
            10: lambda: ("secret", d(rng.randint(15, 22)), left + rng.choice(("order ", "isbn ", "")), 0),
            11: lambda: ("secret", f"2024-{d(2)}-{d(2)}-{a(8, lower)}-{d(2)}", left + rng.choice(("https:", "page ", "")), 0),
            12: lambda: ("email", f"{a(6, lower)} (at) {a(7, lower)} (dot) {rng.choice(('com', 'org', 'net'))}", left, 1),
            13: lambda: ("email", f"{a(1, lower)} (at) {d(2)} (dot) {a(9, lower)}", left + "item ", 0),
        }[r]()
        kind, m, left, label = made
        out.append((kind, m, left[-CONTEXT:], right, label))
    return out


class Boosted:
    """Gradient boosting on the logistic loss with trees of depth two."""

    def __init__(self, rounds: int = 24, rate: float = 0.4):
        self.rounds, self.rate, self.trees, self.start = rounds, rate, [], 0.0

    @staticmethod
    def _split(x, g, h, rows):
        best = (0.0, None, None)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        for f in range(x.shape[1]):
            cuts, at = np.unique(x[rows, f], return_inverse=True)
            lg, lh = (np.cumsum(np.bincount(at, v[rows], len(cuts)))[:-1] for v in (g, h))
            gain = lg**2 / (lh + 1) + (total_g - lg) ** 2 / (total_h - lh + 1) - total_g**2 / (total_h + 1)
            if len(gain) and gain.max() > best[0] + 1e-9:
                best = (gain.max(), f, float(cuts[gain.argmax()]))
        return best[1:]

    def _grow(self, x, g, h, rows, depth):
        f, cut = self._split(x, g, h, rows) if depth else (None, None)
        if f is None:
            return float(g[rows].sum() / (h[rows].sum() + 1) * self.rate)
        low = x[rows, f] <= cut
        return f, cut, self._grow(x, g, h, rows[low], depth - 1), self._grow(x, g, h, rows[~low], depth - 1)

    @staticmethod
    def _value(tree, x):
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        f, cut, a, b = tree
        return np.where(x[:, f] <= cut, Boosted._value(a, x), Boosted._value(b, x))

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Boosted:
        w = np.ones(len(y)) if weight is None else weight
        share = min(max(np.average(y, weights=w), 1e-3), 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        z = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-z))
            tree = self._grow(x, w * (y - p), w * p * (1 - p), np.arange(len(y)), 2)
            self.trees.append(tree)
            z += self._value(tree, x)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.start + sum(self._value(t, x) for t in self.trees)

    def column(self, f: Column) -> Column:
        """The score as an expression over an array of features."""

        def tree(t):
            if not isinstance(t, tuple):
                return F.lit(t)
            return F.when(F.get(f, F.lit(t[0])) <= t[1], tree(t[2])).otherwise(tree(t[3]))

        out = F.lit(self.start)
        for t in self.trees:
            out = out + tree(t)
        return out


def threshold(scores: np.ndarray, y: np.ndarray, precision: float, weight: np.ndarray | None = None) -> float:
    """The lowest score from which on held-out examples are right as often as wanted; infinite if none is."""
    order = np.argsort(-scores, kind="stable")
    w = np.ones(len(y)) if weight is None else weight
    right = np.cumsum(w[order] * y[order]) / np.cumsum(w[order])
    last = np.r_[scores[order][1:] != scores[order][:-1], True] if len(y) else np.zeros(0, bool)
    good = np.flatnonzero((right >= precision) & last)
    return float(scores[order[good[-1]]]) if len(good) else float("inf")


def _based(docs: DataFrame) -> DataFrame:
    """doc_id, text and a column of valid spans for each base kind."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return d.select("doc_id", "text", *[c.alias(k) for k, c in base_spans(F.col("text")).items()])


def _around(s: Column) -> tuple[Column, Column]:
    """What stands left and right of a span."""
    left = F.substring(F.col("text"), F.greatest(s["s"] - CONTEXT + 1, F.lit(1)), F.least(s["s"], F.lit(CONTEXT)))
    return left, F.substring(F.col("text"), s["e"] + 1, F.lit(2))


def _candidates(kind: str) -> Column:
    """Spans that the generator of a kind proposes."""
    none = F.expr("cast(array() as array<struct<s: int, e: int, m: string>>)")
    some = F.rlike(F.col("text"), F.lit("[0-9]")) if kind != "email" else F.rlike(F.col("text"), F.lit(r"[\[(] ?at ?[\])]"))
    return F.when(some, spans(F.col("text"), GENERATORS[kind])).otherwise(none)


def _within(s: Column, others: Column) -> Column:
    return F.exists(others, lambda t: (t["s"] <= s["s"]) & (s["e"] <= t["e"]))


def labelled(docs: DataFrame, most: int | None = None) -> DataFrame:
    """(kind, m, l, r, label): all different candidates of documents that base patterns label, or the `most` of least hash."""
    text = F.col("text")
    digits = lambda s: F.length(_digits(s["m"]))
    misses = [
        F.filter(spans(text, PATTERNS["card"]), lambda s: (digits(s) >= 13) & ~_valid("card", s)),
        F.filter(spans(text, PATTERNS["ip"]), lambda s: ~_valid("ip", s)),
        F.filter(spans(text, PATTERNS["phone"]), lambda s: ~_valid("phone", s)),
    ]
    d = _based(docs).withColumn("missed", F.when(F.rlike(text, F.lit("[0-9]")), F.concat(*misses)).otherwise(F.expr("cast(array() as array<struct<s: int, e: int, m: string>>)")))

    def example(kind: str, m: Column, s: Column, label: Column) -> Column:
        left, right = _around(s)
        return F.struct(F.lit(kind).alias("kind"), m.alias("m"), F.regexp_replace(left, r"\+[0-9 ]*$", "").alias("l"), right.alias("r"), label.alias("label"))

    def of(kind: str) -> Column:
        own = F.col(kind) if kind in PATTERNS else F.expr("cast(array() as array<struct<s: int, e: int, m: string>>)")
        other = F.concat("missed", *[F.col(k) for k in PATTERNS if k != kind])
        label = lambda s: F.when(_within(s, own), 1).when(_within(s, other), 0)
        return F.filter(F.transform(_candidates(kind), lambda s: example(kind, s["m"], s, label(s))), lambda x: x["label"].isNotNull())

    spelled = F.transform(
        F.filter("email", lambda s: F.rlike(s["m"], F.lit(r"@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"))),
        lambda s: example("email", F.regexp_replace(F.regexp_replace(s["m"], "@", " (at) "), r"\.([A-Za-z]+)$", " (dot) $1"), s, F.lit(1)),
    )
    found = d.select(F.explode(F.concat(of("phone"), of("id"), of("secret"), spelled)).alias("x")).select("x.*").distinct()
    return found if most is None else found.orderBy(F.xxhash64("kind", "m", "l", "r"), "kind", "m", "l", "r", "label").limit(most)


def counted(docs: DataFrame, most: int = VECTORS) -> DataFrame:
    """(kind, label, held, f, n): how many labelled candidates have which features, those of each half apart.

    At most `most` rows or so: vectors are made coarser until they are so few."""
    numbers = F.array(*features(F.col("m"), F.col("l"), F.col("r"))).alias("f")
    held = (F.pmod(F.xxhash64("kind", "m", "l", "r"), F.lit(2)) == 1).alias("held")
    fine = cut(labelled(docs).select("kind", "label", held, numbers).groupBy("kind", "label", "held", "f").agg(F.count("*").alias("n")), "examples")
    out, grain = fine, 1
    while out.count() > most and grain < 1 << 30:
        grain *= 2
        f = F.transform("f", lambda v, i: F.when(i < NUMBERS, F.floor(v / grain) * F.lit(float(grain))).otherwise(v)).alias("f")
        out = fine.select("kind", "label", "held", f, "n").groupBy("kind", "label", "held", "f").agg(F.sum("n").alias("n"))
    return out


class Detector:
    """Trees, the threshold of each kind, and for each kind (precision, recall, positives, examples) on held-out examples."""

    def __init__(self, docs: DataFrame, precision: float = PRECISION, n: int = EXAMPLES):
        spark, made = docs.sparkSession, examples(n)
        rows = F.split(F.lit("\x1e".join("\x1f".join(map(str, e)) for e in made)), "\x1e", -1)
        parts = F.split("x", "\x1f", -1)
        shown = spark.range(1).select(F.posexplode(rows).alias("i", "x")).select("i", *[F.get(parts, F.lit(j)).alias(c) for j, c in enumerate(("kind", "m", "l", "r", "label"))])
        numbers = F.array(*features(F.col("m"), F.col("l"), F.col("r"))).alias("f")
        got = [(r["kind"], r["f"], int(r["label"]), r["i"] % 2 == 1, 1) for r in shown.orderBy("i").select("i", "kind", "label", numbers).collect()]
        got += sorted((r["kind"], r["f"], r["label"], r["held"], r["n"]) for r in counted(docs).collect())
        kinds, x, y, held, w = (np.array(v) for v in zip(*got))
        w = w.astype(float)
        self.learned = int(w[len(made) :].sum())
        w[len(made) :] *= min(1.0, LABELLED / max(1, self.learned))
        self.model = Boosted().fit(x[~held], y[~held].astype(float), w[~held])
        s, self.least, self.quality = self.model.score(x), {}, {}
        for k in GENERATORS:
            mine = held & (kinds == k)
            self.least[k] = max(threshold(s[mine], y[mine], precision, w[mine]), 0.0)
            over, true = mine & (s >= self.least[k]), mine & (y == 1)
            hits = w[over & true].sum()
            self.quality[k] = (hits / max(1e-9, w[over].sum()), hits / max(1e-9, w[true].sum()), int(true.sum()), int(mine.sum()))


def find(docs: DataFrame, precision: float = PRECISION) -> DataFrame:
    """doc_id, the base spans of each kind, and `added`: array of struct (kind, s, e), none overlapping."""
    detector = Detector(docs, precision)
    taken = F.concat(*[F.col(k) for k in PATTERNS])
    none = "cast(array() as array<struct<s: int, e: int, kind: string, over: double>>)"

    def selected(kind: str) -> Column:
        def scored(s: Column) -> Column:
            over = F.get(F.transform(F.array(F.array(*features(s["m"], *_around(s)))), detector.model.column), F.lit(0)) - detector.least[kind]
            return F.struct(s["s"].alias("s"), s["e"].alias("e"), F.lit(kind).alias("kind"), over.alias("over"))

        free = F.filter(_candidates(kind), lambda s: ~F.exists(taken, lambda t: (t["s"] < s["e"]) & (s["s"] < t["e"])))
        return F.filter(F.transform(free, scored), lambda x: x["over"] >= 0)

    def apart(out: Column, x: Column) -> Column:
        last = F.get(out, F.size(out) - 1)
        better = F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(x))
        return F.when(last.isNull() | (last["e"] <= x["s"]), F.array_append(out, x)).when(x["over"] > last["over"], better).otherwise(out)

    pool = F.array_sort(F.concat(F.expr(none), *[selected(k) for k in GENERATORS if detector.least[k] < float("inf")]))
    added = F.transform(F.aggregate(pool, F.expr(none), apart), lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
    return _based(docs).select("doc_id", *PATTERNS, added.alias("added"))


def listed(base: bool) -> Column:
    """kind:start:end of all spans, by kind as listed, then start, joined by commas."""
    parts = []

    def of(kind: str):
        return lambda a: a["kind"] == kind

    def text(kind: str):
        return lambda s: F.concat_ws(":", F.lit(kind), s["s"].cast("string"), s["e"].cast("string"))

    for kind in KINDS:
        own = F.transform(F.col(kind), lambda s: F.struct(s["s"], s["e"])) if kind in PATTERNS else F.expr("cast(array() as array<struct<s: int, e: int>>)")
        if not base:
            more = F.transform(F.filter("added", of(kind)), lambda a: F.struct(a["s"], a["e"]))
            own = F.array_sort(F.concat(own, more))
        parts.append(F.transform(own, text(kind)))
    return F.array_join(F.concat(*parts), ",")


def op6_pii(spark, sf_dir) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in PATTERNS]
    return found.select("doc_id", *counts, F.sha2(listed(True).cast("binary"), 256).alias("base_sha256"), listed(False).alias("spans"))
