"""Personal data by candidates and boosted trees, in DataFrame functions alone.

Generators of high recall propose spans, which may overlap. Boosted trees, written out as
conditional expressions, score each from its format and its context, and a threshold for each
kind, calibrated on held-out examples, selects those to redact. Spans of the base rules always
stay. All steps are projections: there is no shuffle, and no Python runs beside the JVM.

The trees are fitted on examples that SQL makes up (``examples``), EXAMPLES rows, whatever the
table's size. Their fitting is the only thing that happens on the driver.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Made-up rows that the trees are fitted and calibrated on.
EXAMPLES = 6000

# Where a kind's rule would go over a run of its characters again from each of them, the look-behind lets it
# begin at the run's start, or where the last match ended, alone: the matches are the same.
BASE = {
    "email": r"(?=[A-Za-z0-9._%+-])(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?=[0-9])(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
WIDE = {
    "email": r"(?i)(?=[a-z0-9])(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+ ?(?:@|\(at\)|\[at\]) ?[a-z0-9-]{1,63}+(?: ?(?:\.|\(dot\)|\[dot\]) ?[a-z0-9-]{1,63}+)++",
    "ip": rf"(?=[0-9A-Fa-f])(?:(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{{1,4}}:){{7}}[0-9A-Fa-f]{{1,4}}(?![0-9A-Za-z:])|(?<![0-9])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]))",
    "card": r"(?=[0-9])(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){2,3}(?:[ -][0-9]{1,3})?|3[0-9]{3}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])",
    "phone": r"(?=[+(0-9])(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])",
}
_VALID_IP = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})){3}$"
_CONTEXT = 16
_SPAN = "array<struct<start:int,stop:int,text:string,before:string,after:string>>"


def _matches(text: Column, pattern: str, gate: Column) -> Column:
    return F.when(gate, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def _bound(value: Column, use) -> Column:
    """``use(value)``, with the value computed once, as a lambda's body would compute it for each element."""
    return F.get(F.transform(F.array(value), use), 0)


def _parts(items: Column) -> Column:
    """An array in parts of about the square root of its length."""
    n = F.size(items)
    size = F.greatest(F.ceil(F.sqrt(n.cast("double"))).cast("int"), F.lit(1))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.ceil(n / size).cast("int") - 1), lambda i: F.slice(items, i * size + 1, size))).otherwise(F.slice(F.array(items), 1, 0))


def _before(values: Column, combine) -> Column:
    """For each of an array of whole numbers (0 at least) the combination of those before it; then that of all.

    A fold copies what it has collected, so it runs over parts of an array and then over their
    totals: m values take about m * sqrt(m) steps.
    """

    def folded(xs: Column) -> Column:
        return F.aggregate(xs, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(combine(F.element_at(acc, -1), x))))

    def joined(scans: Column) -> Column:
        return _bound(folded(F.transform(scans, lambda s: F.element_at(s, -1))), lambda firsts: F.concat(
            F.flatten(F.zip_with(scans, F.slice(firsts, F.lit(1), F.size(scans)), lambda s, first: F.transform(F.slice(s, F.lit(1), F.size(s) - 1), lambda x: combine(x, first)))),
            F.array(F.element_at(firsts, -1)),
        ))

    return _bound(values, lambda v: _bound(_parts(v), lambda parts: _bound(F.transform(parts, folded), joined)))


def _placed(text: Column, pattern: str, matches: Column) -> Column:
    """Matches with their code points' positions and what stands around them, from the stretches between them."""

    def spans(pieces: Column, found: Column) -> Column:
        pairs = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found, lambda p, m: F.struct(p.alias("piece"), m.alias("match")))
        pairs = F.zip_with(pairs, F.slice(pieces, F.lit(2), F.size(found)), lambda p, after: F.struct(p["piece"].alias("piece"), p["match"].alias("match"), F.left(after, F.lit(_CONTEXT)).alias("after")))
        at = _before(F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found, lambda p, m: F.length(p) + F.length(m)), lambda x, y: x + y)

        def span(x: Column, before: Column) -> Column:
            start = before + F.length(x["piece"])
            return F.struct(start.alias("start"), (start + F.length(x["match"])).alias("stop"), x["match"].alias("text"), F.right(x["piece"], F.lit(_CONTEXT)).alias("before"), x["after"].alias("after"))

        return F.zip_with(pairs, F.slice(at, F.lit(1), F.size(found)), span)

    some = _bound(F.struct(F.split(text, pattern, -1).alias("pieces"), matches.alias("found")), lambda x: spans(x["pieces"], x["found"]))
    return F.when(F.size(matches) > 0, some).otherwise(F.array().cast(_SPAN)).cast(_SPAN)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _valid(kind: str, s: Column) -> Column:
    n = F.length(_digits(s))
    return {"email": F.lit(True), "ip": s.rlike(_VALID_IP), "card": n.between(13, 19) & F.call_function("luhn_check", _digits(s)), "phone": n.between(9, 15)}[kind]


def _rule(kind: str):
    return lambda x: _valid(kind, x["text"])


FEATURES = ("kind", "n_digits", "n_chars", "luhn", "octets", "plus", "paren", "breaks", "literal_at", "first", "joined_before", "joined_after", "quoted", "named", "dotted")


def _features(kind: str, x: Column) -> list[Column]:
    s, one = x["text"], lambda c: F.coalesce(c.cast("int"), F.lit(0))
    digits = _digits(s)
    return [
        F.lit(KINDS.index(kind)),
        F.length(digits),
        F.length(s),
        one(F.call_function("luhn_check", digits)) if kind == "card" else F.lit(0),
        one(s.rlike(_VALID_IP)) if kind == "ip" else F.lit(0),
        one(s.startswith("+")),
        one(s.contains("(")),
        F.length(F.regexp_replace(s, "[^ .()-]", "")),
        one(s.contains("@")),
        one(F.left(digits, F.lit(1)).isin("3", "4", "5", "6")),
        one(x["before"].rlike(r"[\p{L}\p{N}_]$")),
        one(x["after"].rlike(r"^[\p{L}\p{N}_]")),
        one(x["before"].rlike("[\"'=#/]$")),
        one(F.lower(x["before"]).rlike(r"(?:call|tel|phone|fax|mobile|mail|contact|card|visa|from|ip|host|addr)[^\p{L}]{0,6}$")),
        one(x["before"].rlike(r"[0-9]\.$") | x["after"].rlike(r"^\.[0-9]")),
    ]


def candidates(docs: DataFrame) -> DataFrame:
    """``docs`` (with column text) and, for each kind, ``_base_<kind>`` (valid spans of its rule) and ``_wide_<kind>`` (proposed spans)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    digit, at = text.rlike("[0-9]"), text.contains("@")
    gates = {"email": at, "ip": digit, "card": digit, "phone": digit & text.contains("+")}
    wide_gates = {"email": at | text.rlike(r"(?i)[\[(]at[\])]"), "ip": digit, "card": digit, "phone": digit}
    out = docs.select("*", *[_matches(text, BASE[k], gates[k]).alias(f"_b_{k}") for k in KINDS], *[_matches(text, WIDE[k], wide_gates[k]).alias(f"_w_{k}") for k in KINDS])
    out = out.select(*docs.columns, *[F.filter(_placed(text, BASE[k], F.col(f"_b_{k}")), _rule(k)).alias(f"_base_{k}") for k in KINDS], *[_placed(text, WIDE[k], F.col(f"_w_{k}")).alias(f"_wide_{k}") for k in KINDS])
    return out


# --- the trees -------------------------------------------------------------------------------


def examples(spark: SparkSession, n: int = EXAMPLES) -> DataFrame:
    """Made-up texts: (id, text, kind, lo, hi, real): one thing between ``lo`` and ``hi``, which is ``kind`` if ``real``."""
    base = spark.range(n, numPartitions=2)
    draw = lambda k, m: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(m))
    pick = lambda k, *xs: F.element_at(F.array(*[F.lit(x) if isinstance(x, str) else x for x in xs]), (draw(k, len(xs)) + 1).cast("int"))
    digits = lambda k, m: F.lpad(F.pmod(F.xxhash64("id", F.lit(1000 + k)), F.lit(10**m)).cast("string"), m, "0")
    octet = lambda k: draw(k, 256).cast("string")

    def check_digit(s: Column) -> Column:
        doubled = F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)])
        digit = lambda i: F.substring(s, F.lit(15) - i, F.lit(1)).cast("int")
        total = F.aggregate(F.sequence(F.lit(0), F.lit(14)), F.lit(0), lambda acc, i: acc + F.when(i % 2 == 0, F.element_at(doubled, digit(i) + 1)).otherwise(digit(i)))
        return (10 - total % 10) % 10

    def spaced(s: Column) -> Column:
        parts = F.array(*[F.substring(s, 4 * i + 1, 4) for i in range(4)])
        return F.when(draw(3, 2) == 0, F.array_join(parts, " ")).otherwise(F.array_join(parts, "-"))

    base = base.select("id", F.left(F.concat(pick(1, "4", "5", "37", "6"), digits(2, 14)), F.lit(15)).alias("body"))
    base = base.select("id", "body", check_digit(F.col("body")).alias("check"))
    base = base.select(
        "id",
        F.concat("body", F.col("check").cast("string")).alias("card"),
        F.concat("body", F.pmod(F.col("check") + 1 + draw(7, 9), F.lit(10)).cast("string")).alias("broken"),
        pick(4, "ana.lee", "j_smith", "office", "m.77", "info").alias("name"),
        F.concat(pick(5, "mail", "corp", "uni-x", "post7"), F.lit("."), pick(6, "com", "org", "example.com", "ac.uk")).alias("host"),
        F.concat_ws(".", octet(13), octet(14), octet(15), octet(16)).alias("address"),
    )
    card, broken, name, host, address = map(F.col, ("card", "broken", "name", "host", "address"))
    phone = F.concat(pick(8, "+1 ", "+44 ", "+49-", "+33."), F.lit("("), digits(9, 3), F.lit(") "), digits(10, 3), pick(11, "-", " ", "."), digits(12, 4))
    things = [
        ("email", F.concat(name, F.lit("@"), host), True),
        ("email", F.concat(name, pick(17, " (at) ", "(at)", " [at] "), F.regexp_replace(host, r"\.", " (dot) ")), True),
        ("ip", address, True),
        ("ip", F.concat_ws(":", *[F.lower(F.hex(draw(18 + i, 65536))) for i in range(8)]), True),
        ("card", card, True),
        ("card", spaced(card), True),
        ("card", broken, False),
        ("card", spaced(broken), False),
        ("phone", phone, True),
        ("phone", F.concat(pick(30, "tel ", "call ", "phone: "), F.lit("("), digits(31, 3), F.lit(") "), digits(32, 3), F.lit("-"), digits(33, 4)), True),
        ("phone", F.concat(digits(34, 4), F.lit("-"), digits(35, 3), F.lit("-"), digits(36, 4)), False),
        ("phone", F.concat(digits(37, 3), F.lit(" "), digits(38, 3), F.lit("."), digits(39, 3)), False),
        ("ip", F.concat(F.lit("v"), draw(40, 10).cast("string"), F.lit("."), address), False),
        ("card", F.concat(F.lit('token = "'), F.lower(F.hex(F.xxhash64("id"))), digits(41, 15), F.lit('"')), False),
        ("card", F.concat(F.lit("#"), digits(42, 13)), False),
    ]
    k = draw(50, len(things))

    def chosen(j: int) -> Column:
        of = lambda t: t[j] if isinstance(t[j], Column) else F.lit(t[j])
        return functools.reduce(lambda rest, i: F.when(k == i, of(things[i])).otherwise(rest), range(1, len(things)), of(things[0]))

    out = base.select("id", chosen(0).alias("kind"), chosen(1).alias("_thing"), chosen(2).alias("real"), pick(60, "see ", "at the end, ", "It was ", "und der ", "la ", "x. ").alias("_before"), pick(61, " and so on", ". Then", ", as it was", " ").alias("_after"))
    lead = F.when(F.col("kind") == "phone", F.length(F.regexp_extract("_thing", "^[a-z: ]+", 0))).otherwise(0)
    return out.select("id", F.concat("_before", "_thing", "_after").alias("text"), "kind", (F.length("_before") + lead).alias("lo"), (F.length("_before") + F.length("_thing")).alias("hi"), "real")


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int):
    """One regression tree: (feature, threshold, left, right), or a leaf's value; ``feature < threshold`` goes left."""
    score = lambda a, b: a * a / (b + 1.0)
    best = (1e-6, None, None)
    if depth:
        whole = score(g[rows].sum(), h[rows].sum())
        for f in range(x.shape[1]):
            values = np.unique(x[rows, f])
            for t in (values[1:] + values[:-1]) / 2 if len(values) < 40 else np.quantile(values, np.linspace(0.02, 0.98, 30)):
                left = rows[x[rows, f] < t]
                gl, hl = g[left].sum(), h[left].sum()
                gain = score(gl, hl) + score(g[rows].sum() - gl, h[rows].sum() - hl) - whole
                if gain > best[0]:
                    best = (gain, f, float(t))
    if best[1] is None:
        return float(-0.3 * g[rows].sum() / (h[rows].sum() + 1.0))
    _, f, t = best
    return f, t, _grow(x, g, h, rows[x[rows, f] < t], depth - 1), _grow(x, g, h, rows[x[rows, f] >= t], depth - 1)


def _apply(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, t, left, right = tree
    return np.where(x[:, f] < t, _apply(left, x), _apply(right, x))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3) -> list:
    """Trees whose summed values are log odds of ``y``."""
    margin, out, rows = np.zeros(len(y)), [], np.arange(len(y))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        out.append(_grow(x, p - y, np.maximum(p * (1 - p), 1e-9), rows, depth))
        margin += _apply(out[-1], x)
    return out


def calibrate(margin: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The least margin from which on held-out examples are right at ``precision``; infinite if there is none."""
    order = np.argsort(-margin, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    last = np.append(margin[order][1:] != margin[order][:-1], True)
    good = np.flatnonzero(last & (right >= precision))
    return float(margin[order][good[-1]]) if len(good) else float("inf")


@functools.lru_cache(maxsize=4)
def fit(spark: SparkSession, n: int = EXAMPLES, precision: float = 0.99) -> tuple[list, dict[str, float]]:
    """Trees, and each kind's threshold, from two thirds and one third of the examples' candidates."""
    found = candidates(examples(spark, n))

    def described(kind: str):
        def one(x: Column) -> Column:
            label = (F.col("kind") == kind) & F.col("real") & (x["start"] == F.col("lo")) & (x["stop"] == F.col("hi"))
            return F.array(label.cast("double"), *[c.cast("double") for c in _features(kind, x)])

        return one

    rows = found.select("id", F.explode(F.concat(*[F.transform(f"_wide_{k}", described(k)) for k in KINDS])).alias("x"))
    table = np.array(sorted([r["id"], *r["x"]] for r in rows.collect()), float)
    ids, y, x = table[:, 0], table[:, 1], table[:, 2:]
    held = ids % 3 == 0
    trees = boost(x[~held], y[~held])
    margin = sum(_apply(t, x) for t in trees)
    limits = {kind: calibrate(margin[held & (x[:, 0] == k)], y[held & (x[:, 0] == k)], precision) for k, kind in enumerate(KINDS)}
    return trees, limits


def _written(tree, features: list[Column]) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(tree)
    f, t, left, right = tree
    return F.when(features[f] < t, _written(left, features)).otherwise(_written(right, features))


# --- spans -----------------------------------------------------------------------------------


def _grouped(spans: Column) -> Column:
    """Spans in order, in parts with what each part covers, so that few of them need to be gone through."""
    ordered = F.sort_array(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"))))
    return _bound(ordered, lambda xs: F.transform(_parts(xs), lambda p: F.struct(F.get(p, 0)["start"].alias("lo"), F.array_max(F.transform(p, lambda s: s["stop"])).alias("hi"), p.alias("spans"))))


def _apart(x: Column, groups: Column) -> Column:
    return ~F.exists(groups, lambda g: (g["lo"] < x["stop"]) & (x["start"] < g["hi"]) & F.exists(g["spans"], lambda o: (o["start"] < x["stop"]) & (x["start"] < o["stop"])))


def found(docs: DataFrame, model: tuple[list, dict[str, float]] | None = None) -> DataFrame:
    """``docs``, all columns, with ``_base_<kind>`` and ``_more_<kind>``: arrays of spans by the base rules and those that the trees add.

    An added span overlaps no base span of any kind. Null and empty texts have no spans, and
    repeated rows have equal ones. Positions are code points, ends exclusive. A text with m
    matches of a rule takes about m * sqrt(m) steps to place them and to compare them with others.
    """
    trees, limits = model or fit(docs.sparkSession)
    out = candidates(docs)
    every = F.concat(*[F.col(f"_base_{k}") for k in KINDS])

    def free(kind: str) -> Column:
        wide = F.col(f"_wide_{kind}")
        # spans are grouped for texts with candidates alone
        return F.when(F.size(wide) > 0, _bound(_grouped(every), lambda groups: F.filter(wide, lambda x: _apart(x, groups)))).otherwise(wide)

    fresh = [free(k).alias(f"_fresh_{k}") for k in KINDS]
    out = out.select(*docs.columns, *[f"_base_{k}" for k in KINDS], *fresh)

    def chosen(kind: str) -> Column:
        if limits[kind] == float("inf"):
            return F.array().cast(_SPAN)

        def selects(x: Column) -> Column:
            # the features are taken once and the trees read them from the array
            one = F.transform(F.array(F.array(*[c.cast("double") for c in _features(kind, x)])), lambda v: functools.reduce(lambda a, b: a + b, [_written(t, [v[i] for i in range(len(FEATURES))]) for t in trees]))
            return one[0] >= F.lit(limits[kind] - 1e-9)

        return F.filter(F.col(f"_fresh_{kind}"), selects)

    return out.select(*docs.columns, *[f"_base_{k}" for k in KINDS], *[chosen(k).alias(f"_more_{k}") for k in KINDS])


def _listed(*arrays: Column) -> Column:
    def names(kind: str):
        return lambda x: F.concat_ws(":", F.lit(kind), x["start"].cast("string"), x["stop"].cast("string"))

    parts = [F.transform(F.sort_array(F.transform(a, lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop")))), names(k)) for k, a in zip(KINDS, arrays, strict=True)]
    return F.array_join(F.concat(*parts), ",")


def report(docs: DataFrame, model=None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, n_added, base_sha256, spans): counts are of base spans, n_added of the trees'."""
    out = found(docs.select("doc_id", "text"), model)
    base = [F.col(f"_base_{k}") for k in KINDS]
    both = [F.concat(f"_base_{k}", f"_more_{k}") for k in KINDS]
    added = functools.reduce(lambda a, b: a + b, [F.size(f"_more_{k}") for k in KINDS])
    return out.select("doc_id", *[F.size(f"_base_{k}").cast("long").alias(f"n_{k}") for k in KINDS], added.cast("long").alias("n_added"), F.sha2(_listed(*base), 256).alias("base_sha256"), _listed(*both).alias("spans"))


def redacted(docs: DataFrame, model=None) -> DataFrame:
    """``docs``, all columns, with ``[EMAIL]`` and the like in text for each span; of overlapping spans the one that begins first names all. A null text stays null."""
    out = found(docs, model)

    def marked(kind: str):
        return lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), F.lit(f"[{kind.upper()}]").alias("mark"))

    spans = F.sort_array(F.concat(*[F.transform(F.concat(f"_base_{k}", f"_more_{k}"), marked(k)) for k in KINDS]))

    def cut(x: Column) -> Column:
        """Parts of the spans, each with the stretch of text that it changes, so that the text isn't gone over for every span."""
        ends = F.zip_with(x["spans"], F.slice(x["ends"], F.lit(1), F.size(x["spans"])), lambda s, at: F.struct(at.alias("at"), s["start"].alias("start"), s["mark"].alias("mark")))
        kept = F.filter(ends, lambda s: s["start"] >= s["at"])

        def stretch(part: Column) -> Column:
            first, last = F.get(part, 0)["at"], F.element_at(part, -1)["start"]
            return F.struct(part.alias("part"), first.alias("first"), F.substring("text", first + 1, last - first).alias("text"))

        def marked_stretch(y: Column) -> Column:
            return F.array_join(F.transform(y["part"], lambda s: F.concat(F.substring(y["text"], s["at"] - y["first"] + 1, s["start"] - s["at"]), s["mark"])), "")

        done = F.transform(_bound(kept, lambda k: F.transform(_parts(k), stretch)), marked_stretch)
        return F.concat(F.array_join(done, ""), F.substring(F.col("text"), F.element_at(x["ends"], -1) + 1, F.length("text")))

    ends = lambda xs: F.struct(xs.alias("spans"), _before(F.transform(xs, lambda s: s["stop"]), F.greatest).alias("ends"))
    whole = _bound(spans, lambda xs: _bound(ends(xs), cut))
    return out.select(*[F.when(F.size(spans) > 0, whole).otherwise(F.col("text")).alias("text") if c == "text" else F.col(c) for c in docs.columns])
