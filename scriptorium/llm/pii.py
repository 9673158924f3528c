"""Personal data by candidate gradient boosting, in DataFrame functions only.

Base spans are the leftmost non-overlapping matches of one pattern per kind, with checks that drop a
match and never retry it. High-recall generators propose further, overlapping candidates. A candidate has
features of its format (digits, groups, separators, check sums) and of its context (neighbouring
characters, words before it), none of them what only a base pattern asks for. Candidates that cover a base span
of their kind teach the trees what the kind looks like, and so do those that meet no base span but pass the kind's
check (digits, check sum, octets, no sentence's end inside) behind a cue: formats that the base patterns miss. What the
kind does not look like is taught by those that meet no base span and fail the check or have no cue, and by a faint
mirror image of each positive one, as if it failed the check without a cue, so that a kind of which a corpus holds
nothing else can be learnt as well. One that cuts into a base span has no label. The labelled candidates of all documents count as a contingency table of
binned features. The boosted trees become one CASE expression. The threshold is the
lowest score at which the labelled candidates of the calibration half still show the precision asked for; candidates
that reach it add spans, where they meet no base span. Base spans always stay.

Positions are code points, the end is exclusive. Null text is empty text. Null ids, repeated rows and
extra columns change nothing. A text of any length is read whole; patterns use possessive repeats, which
neither recurse nor step back, so that long runs stay linear. Spans of a kind never tie; added ones may overlap
each other and are listed by start, then end. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: The base patterns. A local part or digit run can only match from its first character on or from the end
#: of the last match, so starts inside a run are left out; possessive repeats give the same matches.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to match at all: one of these strings, or this pattern.
NEEDS = {"email": ("@",), "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
#: The generators of further candidates, one per kind.
WIDE = {
    "email": r"[A-Za-z0-9._%+-]{2,64}+[\x20]?(?:@|[(\[]at[)\]]|[\x20]at[\x20])[\x20]?[A-Za-z0-9-]{2,63}+[\x20]?(?:\.|[(\[]dot[)\]]|[\x20]dot[\x20])[\x20]?[A-Za-z]{2,12}(?:[A-Za-z0-9-]*(?:\.[A-Za-z0-9-]{1,63}+)++)?",
    "ip": r"[0-9]{1,4}+(?:\.[0-9]{1,4}+){3,4}+",
    "card": r"[0-9]{3,7}+(?:[\x20.-]?[0-9]{2,6}+){2,6}+",
    "phone": r"[+(]?[0-9]{1,4}+[)]?(?:[\x20().-]{1,2}+[0-9]{2,4}+){2,5}+",
}
WIDE_NEEDS = {"email": ("@", " at ", "(at)", "[at]", "(at]", "[at)"), "ip": r"[0-9]\.[0-9]", "card": r"[0-9]{4}", "phone": r"[0-9][\x20().-]{1,2}[0-9]"}
CUES = {"email": r"(?i)mail|contact|write", "ip": r"(?i)\bip\b|host|server|address", "card": r"(?i)card|visa|pay|account", "phone": r"(?i)phone|tel|call|fax|mobile"}
PRECISION = 0.98
ROUNDS, RATE = 24, 0.3
#: What the mirror image of a positive candidate weighs.
FAINT = 0.1


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of ASCII digits passes the Luhn check."""
    n = F.length(d)

    def add(acc: Column, i: Column) -> Column:
        v = F.substring(d, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return acc + v - F.when(v > 9, 9).otherwise(0)

    return (n > 0) & (F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), add) % 10 == 0)


def valid(kind: str, m: Column) -> Column:
    """The check that a base match of the kind must pass."""
    d = digits(m)
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return m.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.when(F.length(d).between(16, 19), luhn(d)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(d).between(8, 15)
    return F.lit(True)


def matches(text: Column, pattern: str, needs: str | tuple[str, ...]) -> tuple[Column, Column]:
    """All matches of a pattern, and the stretches between them."""
    none = F.array().cast("array<string>")
    has = text.rlike(needs) if isinstance(needs, str) else reduce(lambda a, b: a | b, [F.contains(text, F.lit(x)) for x in needs])
    return F.when(has, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none), F.when(has, F.split(text, pattern, -1)).otherwise(none)


def located(found: Column, gaps: Column) -> Column:
    """array<struct<s, e, m>>: each match with its place, from the lengths of matches and gaps."""
    empty = F.array().cast("array<struct<s:int,e:int,m:string>>")

    def step(acc: Column, i: Column) -> Column:
        s = acc["at"] + F.length(F.get(gaps, i))
        m = F.get(found, i)
        e = s + F.length(m)
        return F.struct(F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), m.alias("m")))).alias("out"), e.alias("at"))

    walk = F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), F.struct(empty.alias("out"), F.lit(0).alias("at")), step)["out"]
    return F.when(F.size(found) > 0, walk).otherwise(empty)


def scanned(docs: DataFrame, patterns: dict[str, str], needs: dict[str, str | tuple[str, ...]], name: str) -> DataFrame:
    """Adds `name`_<kind>: the located matches of each kind's pattern in `__text`."""
    raw = {}
    for k in KINDS:
        raw[f"__m_{k}"], raw[f"__g_{k}"] = matches(F.col("__text"), patterns[k], needs[k])
    out = docs.withColumns(raw)
    out = out.withColumns({f"{name}_{k}": located(F.col(f"__m_{k}"), F.col(f"__g_{k}")) for k in KINDS})
    return out.drop(*raw)


def _checked(kind: str):
    return lambda x: valid(kind, x["m"])


def _described(kind: str):
    return lambda c: F.struct(F.lit(kind).alias("kind"), c["meets"].alias("meets"), c["covers"].alias("covers"), *[c[f].alias(f) for f in FEATURES])


def _named(kind: str):
    return lambda b: F.concat_ws(":", F.lit(kind), b["s"].cast("string"), b["e"].cast("string"))


def _kinded(kind: str):
    return lambda b: F.struct(b["s"].alias("s"), b["e"].alias("e"), F.lit(kind).alias("k"))


def based(docs: DataFrame) -> DataFrame:
    """doc_id, __text and base_<kind>: the valid base spans."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"))
    rows = scanned(rows, BASE, NEEDS, "base")
    return rows.withColumns({f"base_{k}": F.filter(f"base_{k}", _checked(k)) for k in KINDS})


FEATURES = ("digits", "groups", "even", "check", "before", "after", "cue")


def features(kind: str, c: Column, text: Column) -> dict[str, Column]:
    """Binned features, each a small whole number."""
    m, d = c["m"], digits(c["m"])
    context = F.substring(text, F.greatest(c["s"] - 23, F.lit(1)), F.least(c["s"], F.lit(24)))
    before, after = F.substring(text, c["s"], F.when(c["s"] > 0, 1).otherwise(0)), F.substring(text, c["e"] + 1, F.lit(1))
    side = lambda x: F.when(x.rlike("[0-9]"), 2).when(x.rlike(r"[\p{L}.@_-]"), 1).otherwise(0)
    checks = {"card": F.when(F.length(d).between(12, 19), luhn(d)).otherwise(F.lit(False)), "ip": valid("ip", m), "phone": F.length(d).between(8, 15), "email": ~m.rlike(r"\.\x20")}
    # An address spelt out has the groups of one that isn't.
    shape = F.regexp_replace(F.regexp_replace(m, r"[(\[]at[)\]]|\x20at\x20", "@"), r"[(\[]dot[)\]]|\x20dot\x20", ".") if kind == "email" else m
    return {
        "digits": F.least(F.length(d), F.lit(20)),
        "groups": F.least(F.size(F.split(shape, r"[^A-Za-z0-9]+", -1)), F.lit(8)),
        "even": m.rlike(r"^[0-9]{4}(?:[ -]?[0-9]{4}){3}$").cast("int"),
        "check": checks[kind].cast("int"),
        "before": side(before),
        "after": side(after),
        "cue": context.rlike(CUES[kind]).cast("int"),
    }


def candidates(rows: DataFrame) -> DataFrame:
    """Adds cand_<kind>: array<struct<s, e, meets, covers, features...>>."""
    rows = scanned(rows, WIDE, WIDE_NEEDS, "wide")

    def described(kind: str) -> Column:
        text, base = F.col("__text"), F.col(f"base_{kind}")
        every = F.concat(*[F.col(f"base_{k}") for k in KINDS])

        def of(c: Column) -> Column:
            meets = F.exists(every, lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"]))
            covers = F.exists(base, lambda b: (b["s"] >= c["s"]) & (b["e"] <= c["e"]) & (b["e"] - b["s"] >= c["e"] - c["s"] - 2))
            return F.struct(c["s"].alias("s"), c["e"].alias("e"), meets.alias("meets"), covers.alias("covers"), *[v.alias(k) for k, v in features(kind, c, text).items()])

        return F.transform(f"wide_{kind}", of)

    return rows.withColumns({f"cand_{k}": described(k) for k in KINDS})


class Trees:
    """Boosted depth-two trees on a contingency table, for logistic loss."""

    def __init__(self, x: np.ndarray, y: np.ndarray, w: np.ndarray):
        p = np.clip((y * w).sum() / max(w.sum(), 1), 1e-4, 1 - 1e-4)
        self.prior, self.trees = float(np.log(p / (1 - p))), []
        raw = np.full(len(y), self.prior)
        for _ in range(ROUNDS):
            prob = 1 / (1 + np.exp(-raw))
            g, h = w * (y - prob), w * prob * (1 - prob)
            top = self._cut(x, g, h)
            if top is None:
                break
            sides = []
            for left in (True, False):
                own = (x[:, top[0]] <= top[1]) == left
                sub = self._cut(x[own], g[own], h[own])
                value = lambda at: float(RATE * g[at].sum() / (h[at].sum() + 1.0))  # noqa: E731, B023
                if sub is None:
                    sides.append((None, value(own), 0.0))
                else:
                    low = x[:, sub[0]] <= sub[1]
                    sides.append((sub, value(own & low), value(own & ~low)))
            self.trees.append((top, sides))
            raw = self.score(x)

    @staticmethod
    def _cut(x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, int] | None:
        best = None
        for f in range(x.shape[1]):
            for v in np.unique(x[:, f])[:-1]:
                low = x[:, f] <= v
                gain = g[low].sum() ** 2 / (h[low].sum() + 1) + g[~low].sum() ** 2 / (h[~low].sum() + 1)
                if best is None or gain > best[0] + 1e-12:
                    best = (gain, f, int(v))
        return best and best[1:]

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.prior)
        for (f, v), sides in self.trees:
            for left, (sub, a, b) in zip((True, False), sides, strict=True):
                own = (x[:, f] <= v) == left
                low = own if sub is None else own & (x[:, sub[0]] <= sub[1])
                raw += np.where(low, a, 0.0) + np.where(own & ~low, b, 0.0)
        return raw

    def column(self, c: Column) -> Column:
        """The same score as a CASE expression over a candidate's features."""
        get = lambda f: c[FEATURES[f]]
        raw = F.lit(self.prior)
        for (f, v), sides in self.trees:
            side = [F.lit(a) if sub is None else F.when(get(sub[0]) <= sub[1], a).otherwise(b) for sub, a, b in sides]
            raw = raw + F.when(get(f) <= v, side[0]).otherwise(side[1])
        return raw


def learn(docs: DataFrame) -> dict[str, tuple[Trees, float]]:
    """Trees and threshold per kind, from all documents. What comes to the driver is a table of feature bins: bounded by their number."""
    rows = candidates(based(docs))
    half = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(2))
    parts = F.concat(*[F.transform(f"cand_{k}", _described(k)) for k in KINDS])
    seen = rows.select(half.alias("half"), F.explode(parts).alias("c")).select("half", "c.*")
    # One that cuts into a base span teaches nothing.
    seen = seen.where("covers or not meets").withColumn("y", (F.col("covers") | ((F.col("check") == 1) & (F.col("cue") == 1))).cast("int"))
    table = seen.groupBy("half", "kind", "y", *FEATURES).agg(F.count("*").alias("n")).collect()
    out = {}
    for kind in KINDS:
        own = [r for r in table if r["kind"] == kind]
        x = np.array([[int(r[f]) for f in FEATURES] for r in own], dtype=np.int64).reshape(len(own), len(FEATURES))
        y, w = np.array([float(r["y"]) for r in own]), np.array([float(r["n"]) for r in own])
        fit = np.array([r["half"] == 0 for r in own], dtype=bool)
        mirror = x[y == 1].copy()
        mirror[:, [FEATURES.index("check"), FEATURES.index("cue")]] = 0
        x, y, w, fit = np.concatenate((x, mirror)), np.concatenate((y, np.zeros(len(mirror)))), np.concatenate((w, FAINT * w[y == 1])), np.concatenate((fit, fit[y == 1]))
        if not len(own) or len(set(y[fit])) < 2:
            continue  # one class only: nothing to tell apart, and nothing is added
        trees = Trees(x[fit], y[fit], w[fit])
        raw, y, w = trees.score(x[~fit]), y[~fit], w[~fit]
        seen_at = np.unique(raw)
        good = [t for t in seen_at if t > 0 and (y * w)[raw >= t].sum() >= PRECISION * w[raw >= t].sum()]
        if good:
            # Nothing labelled lies between the lowest good score and the one below it: the cut goes halfway, at even odds or more.
            below = seen_at[seen_at < min(good)].max(initial=-np.inf)
            out[kind] = (trees, max(0.0, float(min(good) + below) / 2))
    return out


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, text, base_<kind> and all_<kind> spans (array<struct<s, e>>) of each row of `docs(doc_id, text)`."""
    models = learn(docs)
    rows = candidates(based(docs))

    def every(kind: str) -> Column:
        base = F.transform(f"base_{kind}", lambda b: F.struct(b["s"].alias("s"), b["e"].alias("e")))
        if kind not in models:
            return base
        trees, least = models[kind]
        more = F.filter(f"cand_{kind}", lambda c: ~c["meets"] & (trees.column(c) >= least))
        return F.array_sort(F.concat(base, F.transform(more, lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e")))))

    rows = rows.withColumns({f"all_{k}": every(k) for k in KINDS})
    return rows.select("doc_id", F.col("__text").alias("text"), *[F.transform(f"base_{k}", lambda b: F.struct(b["s"].alias("s"), b["e"].alias("e"))).alias(f"base_{k}") for k in KINDS], *[f"all_{k}" for k in KINDS])


def listed(prefix: str) -> Column:
    """kind:start:end of all spans, by kind as listed, then start."""
    return F.array_join(F.concat(*[F.transform(f"{prefix}_{k}", _named(k)) for k in KINDS]), ",")


def redact(found: DataFrame) -> DataFrame:
    """doc_id and text with each span of detect() replaced by its kind in brackets (an overlapped span gives way to an earlier one)."""
    spans = F.array_sort(F.concat(*[F.transform(f"all_{k}", _kinded(k)) for k in KINDS]))

    def step(acc: Column, x: Column) -> Column:
        skip = x["s"] < acc["at"]
        piece = F.concat(acc["out"], F.expr("substring(text, 1, 0)"), F.substring(F.col("text"), acc["at"] + 1, x["s"] - acc["at"]), F.lit("["), F.upper(x["k"]), F.lit("]"))
        return F.struct(F.when(skip, acc["out"]).otherwise(piece).alias("out"), F.when(skip, acc["at"]).otherwise(x["e"]).alias("at"))

    done = F.aggregate(spans, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step)
    return found.withColumn("__d", done).select("doc_id", F.concat(F.col("__d.out"), F.substring(F.col("text"), F.col("__d.at") + 1, F.length("text"))).alias("text"))
