"""Scalar functions over columns: parsing, hashing, calibration curves, rectangles, vectors. NULL in gives NULL out
unless a function says otherwise."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A compact duration such as 1h02m03.5s, and plain seconds.
COMPACT, SECONDS = r"^([0-9]+(\.[0-9]+)?[hms])+$", r"^\+?([0-9]+(\.[0-9]*)?|\.[0-9]+)(e[+-]?[0-9]+)?$"


def first_pattern(text: Column, patterns: list[tuple[str, str]]) -> Column:
    """struct(source, id) of the first pattern whose group 1 is not empty; NULL where none has one."""
    found = [(name, F.regexp_extract(text, pattern, 1)) for name, pattern in patterns]
    return F.coalesce(*[F.when(x != "", F.struct(F.lit(name).alias("source"), x.alias("id"))) for name, x in found])


def seconds(text: Column) -> Column:
    """Seconds of '90', '12.5', '.5', '1e3' or '1h02m03.5s' in any case; units may repeat; NULL for any other text."""
    t = F.lower(F.trim(text))
    parts = F.regexp_extract_all(t, F.lit(r"([0-9]+(?:\.[0-9]+)?[hms])"), 1)
    size = lambda x: x.substr(F.lit(1), F.length(x) - 1).cast("double") * F.when(x.endswith("h"), 3600.0).when(x.endswith("m"), 60.0).otherwise(1.0)
    return F.when(t.rlike(SECONDS), t.try_cast("double")).when(t.rlike(COMPACT), F.aggregate(parts, F.lit(0.0), lambda a, x: a + size(x)))


def url_start(url: Column) -> Column:
    """Seconds of the first readable one of the query keys t, start and time_continue, else of a fragment t=."""
    keys = [seconds(F.regexp_extract(url, rf"[?&]{key}=([^&#]+)", 1)) for key in ("t", "start", "time_continue")]
    return F.coalesce(*keys, seconds(F.regexp_extract(url, r"#t=(.+)$", 1)))


def words(text: Column) -> Column:
    """Lower-case words of ASCII letters and digits, repeats included."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)


def clocks(text: Column) -> Column:
    """Tokens like 3:07 or 1:02:03."""
    return F.regexp_extract_all(text, F.lit(r"([0-9]+(?::[0-9]{2})+)"), 1)


def safe_relative(path: Column) -> Column:
    """Whether a path is relative, not empty and without '.', '..', empty or backslashed parts. NULL is unsafe."""
    return F.coalesce((path != "") & ~path.contains("\\") & ~path.rlike(r"(^|/)\.{0,2}(/|$)"), F.lit(False))


def before_last(text: Column, marker: str) -> Column:
    """What stands before the last marker, or the whole text."""
    return F.when(text.contains(marker), F.regexp_extract(text, "(?s)^(.*)\\Q" + marker + "\\E", 1)).otherwise(text)


def canonical_digest(columns: list[str]) -> Column:
    """SHA-256 of a row's JSON with its keys sorted and NULLs kept."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def salted_key(ident: Column, salt: str) -> Column:
    """A hash to sort or split by: the same for the same salt on every run and machine."""
    return F.sha2(F.concat(F.lit(salt), F.char(F.lit(0)), ident.cast("string")), 256)


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = clip(p, eps, 1 - eps)
    return F.ln(q) - F.ln(1 - q)


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def affine(p: Column, slope: float, intercept: float) -> Column:
    return sigmoid(logit(p) * slope + intercept)


def deweighted(p: Column, weight: float) -> Column:
    """The probability without a class weight that the training applied to positives."""
    return sigmoid(logit(p) - F.ln(F.lit(float(weight))))


def piecewise(x: Column, points: list[tuple[float, float]]) -> Column:
    """Linear between points sorted by x, constant outside them."""
    out = F.when(x <= points[0][0], F.lit(points[0][1]))
    for (a, u), (b, v) in zip(points, points[1:]):
        out = out.when(x <= b, F.lit(u) + (x - a) * ((v - u) / (b - a)))
    return out.when(x.isNotNull(), F.lit(points[-1][1]))


def scaled_rect(box: tuple[Column, Column, Column, Column], scale: tuple[Column, Column], frame: tuple[Column, Column], pad: int) -> Column:
    """struct(x0, y0, x1, y1), ends exclusive: a box (x, y, w, h) scaled outwards, padded and clipped to the frame;
    NULL if the box or what is left of it is empty."""
    x, y, w, h = box
    low = [F.greatest(F.floor(v * s) - pad, F.lit(0)) for v, s in ((x, scale[0]), (y, scale[1]))]
    high = [F.least(F.ceil((v + d) * s) + pad, f) for v, d, s, f in ((x, w, scale[0], frame[0]), (y, h, scale[1], frame[1]))]
    named = [c.cast("long").alias(n) for c, n in zip((*low, *high), ("x0", "y0", "x1", "y1"))]
    return F.when((w > 0) & (h > 0) & (low[0] < high[0]) & (low[1] < high[1]), F.struct(*named))


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation of two arrays of one length; NULL if either is constant. One pass over entries less the first
    one, so that a constant array has a variance of exactly zero."""
    return _held(F.struct(a.cast("array<double>").alias("a"), b.cast("array<double>").alias("b")), lambda s: _correlation(s["a"], s["b"]))


def _correlation(a: Column, b: Column) -> Column:
    names = ("n", "x", "y", "xx", "yy", "xy")
    pairs = F.zip_with(a, b, lambda x, y: F.struct((x - F.get(a, F.lit(0))).alias("x"), (y - F.get(b, F.lit(0))).alias("y")))

    def step(s: Column, r: Column) -> Column:
        x, y = r["x"], r["y"]
        return F.struct(*[(s[k] + v).alias(k) for k, v in zip(names, (F.lit(1.0), x, y, x * x, y * y, x * y))])

    def finish(s: Column) -> Column:
        var = (s["xx"] - s["x"] * s["x"] / s["n"]) * (s["yy"] - s["y"] * s["y"] / s["n"])
        return F.when((s["n"] > 0) & (var > 0), (s["xy"] - s["x"] * s["y"] / s["n"]) / F.sqrt(var))

    return F.aggregate(pairs, F.struct(*[F.lit(0.0).alias(k) for k in names]), step, finish)


def strongest(a: Column, count: int) -> Column:
    """Positions (from 0) of the count largest entries, the first ones on ties."""
    ranked = F.array_sort(F.transform(a, lambda x, i: F.struct((-x).alias("x"), i.alias("i"))))
    return F.transform(F.slice(ranked, 1, count), lambda r: r["i"])


def strongest_dice(a: Column, b: Column, count: int) -> Column:
    """Dice overlap of the count largest positions of two arrays."""
    return F.size(F.array_intersect(strongest(a, count), strongest(b, count))) / F.lit(float(count))


def contrast_bit(signal: Column, dark: Column, bright: Column, floor: float) -> Column:
    """Whether the signal is above the midpoint of two levels; NULL (abstains) where they are less than floor apart."""
    return F.when(bright - dark >= floor, signal > (dark + bright) / 2)


def first_evidence(choices: list[tuple[str, Column]]) -> Column:
    """struct(value, source) of the first choice that isn't NULL."""
    return F.coalesce(*[F.when(c.isNotNull(), F.struct(c.alias("value"), F.lit(name).alias("source"))) for name, c in choices])


def checked_index(code: Column) -> Column:
    """A 28-bit code: 24 bits of index above the XOR of its six nibbles; NULL if that doesn't agree."""
    index = F.shiftright(code, 4)
    nibbles = [F.shiftright(index, shift).bitwiseAND(F.lit(15)) for shift in range(0, 24, 4)]
    return F.when(reduce(lambda a, b: a.bitwiseXOR(b), nibbles) == code.bitwiseAND(F.lit(15)), index)


def strict_json(text: Column, fields: dict[str, str]) -> Column:
    """struct of all fields, or NULL if the text is anything but one JSON object of exactly these keys, or a field is NULL
    or of another type."""
    parsed = F.from_json(text, ", ".join(f"`{k}` {t}" for k, t in fields.items()), {"mode": "PERMISSIVE"})
    # A JSON array of the text holds one object only if nothing follows the object.
    whole = F.size(F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>")) == 1
    keys = F.array_sort(F.json_object_keys(text)) == F.array(*[F.lit(k) for k in sorted(fields)])
    return F.when(reduce(lambda a, b: a & b, [parsed[k].isNotNull() for k in fields], whole & keys), parsed)


def embargoed(value: Column, known: list[str], word: str) -> Column:
    """Whether an id is one of the known embargoed ones or holds the word in any case; a NULL id isn't."""
    return F.coalesce(value.isin(known) | F.contains(F.lower(value), F.lit(word.lower())), F.lit(False))


def ring_contrast(inner_mean: Column, cell_mean: Column, cell_area: Column, ring_mean: Column, ring_area: Column) -> Column:
    """The mean of a cell's inner strip less that of the ring around the cell: means and areas of the cell and of the whole
    box that it lies in give the ring alone; NULL where the box is no larger than the cell."""
    rest = ring_area - cell_area
    return F.when(rest > 0, inner_mean - (ring_mean * ring_area - cell_mean * cell_area) / rest)


def _held(x: Column, of: Callable[[Column], Column]) -> Column:
    """of(x) with x computed once: what a lambda refers to outside itself is computed anew for each entry."""
    return F.get(F.transform(F.array(x), of), F.lit(0))


def edge_similarity(a: Column, b: Column, q: float = 0.85) -> Column:
    """struct(score, correlation, dice) of two arrays of one size: 0.7 times the correlation and 0.3 times the Dice overlap of
    the entries at or above each one's own quantile q, all rounded to 8 digits. A constant array correlates 0."""
    a, b = a.cast("array<double>"), b.cast("array<double>")

    def top(x: Column) -> Column:
        def marked(s: Column) -> Column:
            at = (F.size(s) - 1) * F.lit(q)
            low = F.floor(at).cast("int")
            below, above = F.get(s, low), F.coalesce(F.get(s, low + 1), F.get(s, low))
            return _held(below + (at - low) * (above - below), lambda least: F.transform(x, lambda v: v >= least))

        return _held(F.array_sort(x), marked)

    def trues(x: Column) -> Column:
        return F.size(F.filter(x, lambda v: v))

    def shared(t: Column) -> Column:
        return F.try_divide(2.0 * trues(F.zip_with(t["a"], t["b"], lambda x, y: x & y)), trues(t["a"]) + trues(t["b"]))

    dice = F.coalesce(_held(F.struct(top(a).alias("a"), top(b).alias("b")), shared), F.lit(0.0))
    r = F.coalesce(correlation(a, b), F.lit(0.0))
    return F.struct(F.round(0.7 * r + 0.3 * dice, 8).alias("score"), F.round(r, 8).alias("correlation"), F.round(dice, 8).alias("dice"))


def _limbs(x: Column) -> list[Column]:
    return [F.shiftrightunsigned(x, s).bitwiseAND(F.lit(0xFFFF)) for s in (0, 16, 32, 48)]


def _joined(limbs: list[Column]) -> Column:
    """A 64-bit number of four 16-bit limbs, each of which may carry into the next one."""
    out, carry = F.lit(0).cast("long"), F.lit(0).cast("long")
    for i, limb in enumerate(limbs):
        whole = limb + carry
        out = out.bitwiseOR(F.shiftleft(whole.bitwiseAND(F.lit(0xFFFF)), 16 * i))
        carry = F.shiftright(whole, 16)
    return out


def _constant(c: int) -> list[int]:
    return [c >> s & 0xFFFF for s in (0, 16, 32, 48)]


def _times(x: Column, c: int) -> Column:
    a, b = _limbs(x), _constant(c)
    return _joined([reduce(lambda p, q: p + q, [a[j] * b[i - j] for j in range(i + 1)]) for i in range(4)])


def splitmix64(x: Column) -> Column:
    """The SplitMix64 mix of a 64-bit number, as a signed long. Sums and products wrap in 16-bit limbs, since plain ones raise."""
    z = _joined([a + c for a, c in zip(_limbs(x.cast("long")), _constant(0x9E3779B97F4A7C15), strict=True)])
    z = _times(z.bitwiseXOR(F.shiftrightunsigned(z, 30)), 0xBF58476D1CE4E5B9)
    z = _times(z.bitwiseXOR(F.shiftrightunsigned(z, 27)), 0x94D049BB133111EB)
    return z.bitwiseXOR(F.shiftrightunsigned(z, 31))


def ratio_fit(x: Column, target: float) -> Column:
    """1 at the target, falling by the ratio to it on both sides; 0 without a positive x."""
    return F.when(x > 0, F.exp(-F.abs(F.ln(x / F.lit(float(target)))))).otherwise(0.0)


def credit_fit(x: Column, full: float, tolerated: float) -> Column:
    """1 up to `full`, falling in a line to 0.4 at `tolerated`, then 0.4 with a decay of 6; 0 without a positive x."""
    line = 1.0 - 0.6 * (x - full) / max(tolerated - full, 1e-9)
    return F.when(~(x > 0) | x.isNull(), 0.0).when(x <= full, 1.0).when(x <= tolerated, line).otherwise(0.4 * F.exp(-(x - tolerated) / 6.0))


def growth_fit(x: Column, enough: float) -> Column:
    """x as a share of `enough`, at most 1; 0 without a positive x."""
    return F.when(x > 0, F.least(F.lit(1.0), x / F.lit(float(enough)))).otherwise(0.0)
