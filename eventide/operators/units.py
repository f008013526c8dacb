"""Quantities recorded in different units (problem 5).

A *source* is one way of writing the unit of one quantity: the pair (quantity,
unit key).  Sources are linked through the entities they share:

1. every (entity, quantity, source) is reduced to its mean logarithm; within
   an entity each source is linked to one hub source, so an entity with k
   sources gives k - 1 links, never all pairs;
2. links are aggregated to a median log ratio and quartiles per source pair,
   and the graph of sources is walked from the common unit, strongest links
   first, giving every source an estimated scale (and an offset, from the
   quartiles);
3. scale and offset are snapped together to a known conversion.  The links
   decide, and the spelling is evidence: where it is understood, its
   declared conversion is taken if the links agree with it, and where there
   are too few of them.

Quantities that nobody writes a unit for are split into sources by size: where
their logarithms fall into clusters with hardly anything between, each cluster
is a source, and the one of plausible size in the common unit the root.

Values without any unit, and those of sources that links and spelling leave
open, are a mixture of the quantity's units.  Histograms of their logarithms
are explained by the density of the settled values, shifted by each conversion
in use (EM over the mixture weights); a value goes to the unit that most
likely gave it.

Defined results: values that are null or not positive have no logarithm and
are left out by the caller; rows with a null quantity, or one without a common
unit, have a null factor; repeated rows each get theirs; columns named factor
and offset are replaced; empty tables give no rows.

Everything per row is a JVM expression; Python sees only the source table, the
aggregated links and the histograms.  Nothing is broadcast by hand.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Grams per mole and charge of what each quantity counts.
MOLAR_MASS = {
    "creatinine": 113.12, "glucose_serum": 180.156, "bun": 28.014, "bilirubin_total": 584.66, "calcium_total": 40.078,
    "magnesium": 24.305, "phosphate": 30.974, "lactate": 90.08, "potassium": 39.098, "sodium": 22.990,
}
CHARGE = {"calcium_total": 2, "magnesium": 2, "potassium": 1, "sodium": 1}
KPA_IN_MMHG = 7.50062
_PREFIX = {"": 1.0, "k": 1e3, "d": 1e-1, "c": 1e-2, "m": 1e-3, "u": 1e-6, "n": 1e-9, "p": 1e-12}
_SPELLINGS = (
    (r"\s|[()\[\]]", ""), (r"percent|pct", "%"), (r"%sat", "%"), (r"per", "/"), (r"litres?|liters?", "l"), (r"grams?", "g"), (r"gm", "g"), (r"mcg", "ug"),
    (r"micro(?=mol|g)", "u"), (r"mc(?=mol)", "u"), (r"milli(?=mol|g|l)", "m"), (r"nano(?=mol|g)", "n"), (r"kilopascals?", "kpa"), (r"torr", "mmhg"), (r"thou", "k"),
    (r"/100ml", "/dl"), (r"^(m|u)?g%$", r"\1g/dl"), (r"cumm|mm3|mcl", "ul"), (r"cells", ""),
    (r"^(m|u)m$", r"\1mol/l"), (r"^g/l10\^?9$", "10^9/l"), (r"^x?10[\^*e](\d+)", r"10^\1"),
)
# Multiplier and offset from a temperature scale to Celsius.
TEMPERATURE = {"c": (1.0, 0.0), "degc": (1.0, 0.0), "celsius": (1.0, 0.0), "f": (5 / 9, -160 / 9), "degf": (5 / 9, -160 / 9), "fahrenheit": (5 / 9, -160 / 9), "k": (1.0, -273.15), "kelvin": (1.0, -273.15)}
_NONE = {"", "1", "none", "nounits", "phunits", "ratio", "frac", "fraction", "index"}
MIN_LINKS = 20
SIZE = "size "
_LEAST_SHARE = 0.002
BIN = 0.02
_PRUNE = 0.002
_NEAR = math.log(1.35)


def parse_unit(text: str) -> tuple[str, float] | None:
    """(dimension, size in the dimension's base unit) of a unit spelling, or None."""
    u = text.lower().replace("µ", "u").replace("μ", "u")
    for pattern, by in _SPELLINGS:
        u = re.sub(pattern, by, u)
    if u in _NONE:
        return "part", 1.0
    if u == "%":
        return "part", 0.01
    if u in ("mmhg", "kpa"):
        return "pressure", KPA_IN_MMHG if u == "kpa" else 1.0
    m = re.fullmatch(r"(?:([munpk]?)(g|mol|eq)|10\^(\d+)|(k?))/([dcmun]?)l(/min)?", u) or re.fullmatch(r"([m]?)(l)()()()(/min)", u)
    if not m:
        return None
    if m[6] and m[2] == "l":
        return "flow", _PREFIX[m[1]]
    below = _PREFIX[m[5]]
    if m[2]:
        return {"g": "mass", "mol": "molar", "eq": "charge"}[m[2]], _PREFIX[m[1]] / below
    return "count", (10.0 ** int(m[3]) if m[3] else _PREFIX[m[4] or ""]) / below


def _in_base(quantity: str, unit: tuple[str, float]) -> tuple[str, float]:
    """Charge and amount as mass per volume where the quantity's molar mass is known."""
    kind, size = unit
    mass = MOLAR_MASS.get(quantity)
    if kind == "charge" and quantity in CHARGE:
        kind, size = "molar", size / CHARGE[quantity]
    if kind == "molar" and mass:
        return "mass", size * mass
    return kind, size


def declared_factor(quantity: str, unit: str, common: str) -> float | None:
    """Multiplier from ``unit`` to the common unit of the quantity, None if the spelling or the dimension is not understood."""
    a, b = parse_unit(unit), parse_unit(common)
    if a is None or b is None:
        return None
    (ka, sa), (kb, sb) = _in_base(quantity, a), _in_base(quantity, b)
    return sa / sb if ka == kb else None


def declared_offset(unit: str, common: str) -> tuple[float, float] | None:
    """(multiplier, offset) between temperature scales, None for anything else."""
    a, b = (TEMPERATURE.get(re.sub(r"[\s°._]", "", x.lower())) for x in (unit, common))
    return None if a is None or b is None else (a[0] / b[0], (a[1] - b[1]) / b[0])


def known_conversions(quantity: str, common: str) -> list[float]:
    """All multipliers to the common unit that some usual unit of its dimension has."""
    units = [f"{p}{x}/{v}" for x in ("g", "mol", "eq") for p in ("", "m", "u", "n", "p") for v in ("l", "dl", "ml", "ul")]
    units += ["10^3/ul", "/ul", "10^9/l", "/l", "%", "1", "mmhg", "kpa", "l/min", "ml/min"]
    found = {float(f"{f:.6g}") for u in units if (f := declared_factor(quantity, u, common))}
    return sorted(f for f in found if 1e-6 <= f <= 1e6)


def unit_key(unit: Column) -> Column:
    """Case and blanks folded, so that one spelling is one source."""
    return F.regexp_replace(F.lower(F.translate(unit, "µμ", "uu")), r"[\s()\[\]]", "")


_NUMBER = r"((?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]+)?|\.[0-9]+)"
_TEXT = rf"^\s*(?:[A-Za-z]+:?\s+)?{_NUMBER}\s*(?![0-9.,])(.*)$"
_POWER = rf"^\s*(?:[A-Za-z]+:?\s+)?{_NUMBER}??\s*(x?10[\^*eE][0-9]+/.*)$"
_IN_NAME = r"(?:\s\[(.+)\]|\s\((.+)\)|,\s(.+)|\sin\s(.+))\s*$"


def read_quantity(value: Column, unit: Column, name: Column) -> tuple[Column, Column]:
    """(number, unit text) of a delivered value.

    The number is null for bounds ("> 5"), words and nulls.  The unit comes
    from the unit column, else from the value text, else from the end of the
    name; it is empty where none of them has any.
    """
    plain = value.rlike(r"^[0-9]+(\.[0-9]+)?$")
    powered = value.rlike(r"[0-9 ]x?10[\^*eE][0-9]+/")
    pattern_number = F.when(powered, F.regexp_extract(value, _POWER, 1)).otherwise(F.regexp_extract(value, _TEXT, 1))
    digits = F.when(plain, value).otherwise(F.regexp_replace(pattern_number, ",", ""))
    number = F.when(digits != "", digits.try_cast("double"))
    rest = F.when(plain, "").when(powered, F.regexp_extract(value, _POWER, 2)).otherwise(F.regexp_extract(value, _TEXT, 2))
    in_name = F.concat(*[F.regexp_extract(name, _IN_NAME, k) for k in range(1, 5)])
    blank = F.coalesce(F.trim(unit), F.lit("")) == ""
    text = F.when(~blank, unit).when(F.trim(rest) != "", rest).otherwise(F.coalesce(in_name, F.lit("")))
    return number, text


def _links(rows: DataFrame) -> DataFrame:
    """Aggregated links (quantity, hub, key, n, d, x and y quartiles) between sources sharing an entity."""
    mean = (
        rows.where("entity is not null and key <> '' and v > 0")
        .groupBy("entity", "quantity", "key")
        .agg(F.avg(F.ln("v")).alias("m"))
    )
    hub = F.max(F.struct(F.xxhash64("key").alias("h"), "key", "m")).over(Window.partitionBy("entity", "quantity"))
    pairs = mean.withColumn("hub", hub)
    pairs = pairs.where(F.col("hub.key") != F.col("key"))
    return pairs.groupBy("quantity", F.col("hub.key").alias("hub"), "key").agg(
        F.count("*").alias("n"),
        F.percentile_approx(F.col("hub.m") - F.col("m"), 0.5, 1000).alias("d"),
        F.percentile_approx(F.exp("hub.m"), [0.25, 0.75], 1000).alias("x"),
        F.percentile_approx(F.exp("m"), [0.25, 0.75], 1000).alias("y"),
    )


def _walk(links: pd.DataFrame, roots: set[str]) -> dict[str, tuple[float, int]]:
    """Log scale of every source that a path of links ties to a root, and the weakest link on it; strongest links first."""
    edges: dict[str, list] = {}
    for r in links.itertuples():
        edges.setdefault(r.hub, []).append((r.spoke, r.d, r.n))
        edges.setdefault(r.spoke, []).append((r.hub, -r.d, r.n))
    found = {k: (0.0, 1 << 60) for k in roots}
    frontier = [(n, k, o, d) for k in roots for o, d, n in edges.get(k, ())]
    while frontier:
        best = max(range(len(frontier)), key=lambda i: frontier[i][0])
        n, k, o, d = frontier.pop(best)
        if o in found:
            continue
        found[o] = (found[k][0] + d, min(found[k][1], n))
        frontier += [(n2, o, o2, d2) for o2, d2, n2 in edges.get(o, ()) if o2 not in found]
    return found


def _affine(links: pd.DataFrame, roots: set[str]) -> dict[str, tuple]:
    """(quartiles, multiplier, offset) of every source linked to a root, from the quartiles of both sides of its strongest link."""
    out: dict[str, tuple] = {}
    for r in links.itertuples():
        for root, other, x, y in ((r.hub, r.spoke, r.x, r.y), (r.spoke, r.hub, r.y, r.x)):
            if root in roots and other not in roots and y[1] > y[0] and r.n > out.get(other, (0,))[0]:
                scale = (x[1] - x[0]) / (y[1] - y[0])
                out[other] = (r.n, tuple(y), scale, (x[0] + x[1]) / 2 - scale * (y[0] + y[1]) / 2)
    return {k: v[1:] for k, v in out.items()}


def _snap_offset(fit: tuple[float, float], at: tuple[float, float], spelled: tuple[float, float] | None) -> tuple[float, float] | None:
    """The temperature conversion (multiplier, offset) that agrees with a fitted line at both places, the spelled one first; None if none does."""
    def gap(c: tuple[float, float]) -> float:
        return max(abs(c[0] * y + c[1] - fit[0] * y - fit[1]) for y in at)

    near = [c for c in {*TEMPERATURE.values(), (9 / 5, 32.0), (1.0, 273.15)} if gap(c) < 2.0]
    return spelled if spelled in near else min(near, key=gap, default=None)


def settle(quantity: str, common: str, sources: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
    """Conversion of every source of one quantity: declared, estimated and settled factor and offset; null where nothing settles it."""
    heat = TEMPERATURE.get(re.sub(r"[\s°._]", "", common.lower())) is not None
    affine = {k: declared_offset(k, common) for k in sources["key"]}
    declared = {k: declared_factor(quantity, k, common) for k in sources["key"]}
    roots = {k for k, f in declared.items() if f is not None and abs(math.log(f)) < 0.02}
    roots |= {k for k, a in affine.items() if a == (1.0, 0.0)}
    sized = sources[sources["key"].str.startswith(SIZE)]
    plausible = sized[(sized["level"] >= math.log(sized["lo"].iloc[0])) & (sized["level"] <= math.log(sized["hi"].iloc[0]))] if len(sized) and pd.notna(sized["lo"].iloc[0]) else sized[:0]
    base = plausible.nlargest(1, "n")
    roots |= set(base["key"])
    estimate, fitted = _walk(links, roots), _affine(links, roots)
    known = known_conversions(quantity, common)
    out = []
    for r in sources.itertuples():
        f, est, n = declared[r.key], None, 0
        if r.key in roots:
            f = 1.0
        elif r.key in estimate:
            est, n = math.exp(estimate[r.key][0]), estimate[r.key][1]
        elif len(base) and r.key.startswith(SIZE):  # no entity has both sizes: the clusters themselves are compared
            est, n = math.exp(float(base["level"].iloc[0]) - r.level), MIN_LINKS
        settled, offset = f, 0.0
        if est is not None and (n >= MIN_LINKS or r.key.startswith(SIZE)):
            near = [k for k in known if abs(math.log(est / k)) < _NEAR]
            if f is None or abs(math.log(est / f)) >= _NEAR:
                settled = min(near, key=lambda k: abs(math.log(est / k)), default=f if f is not None and abs(math.log(est / f)) < math.log(2) else None)
        line = fitted.get(r.key)
        if heat:
            settled, offset = affine[r.key] or (None, 0.0)
            if line and n >= MIN_LINKS and r.key not in roots:
                snapped = _snap_offset(line[1:], line[0], affine[r.key])
                settled, offset = snapped or (settled, offset)
        out.append((quantity, r.key, r.n, affine[r.key][0] if affine[r.key] else f, est, line[2] if line else None, n, settled, offset))
    return pd.DataFrame(out, columns=_SOURCE_COLUMNS)


_SOURCE_COLUMNS = ["quantity", "key", "n", "declared", "estimated", "estimated_offset", "links", "factor", "offset"]
_SOURCE_SCHEMA = "quantity string, key string, n bigint, declared double, estimated double, estimated_offset double, links bigint, factor double, offset double"


def source_graph(rows: DataFrame, common: DataFrame) -> DataFrame:
    """One row per source: declared, estimated and settled multiplier to the common unit (null: unresolved).

    ``rows``: entity, quantity, key, v.  ``common``: quantity, unit, and for
    quantities split by size lo and hi, the plausible range in that unit.
    """
    common = common.select("quantity", "unit", *[F.col(c).cast("double") if c in common.columns else F.lit(None).cast("double").alias(c) for c in ("lo", "hi")])
    sources = rows.where("key <> ''").groupBy("quantity", "key").agg(F.count("*").alias("n"), F.avg(F.ln("v")).alias("level")).join(common, "quantity")
    links = _links(rows).toDF("linked", "hub", "spoke", "n", "d", "x", "y")
    both = sources.groupBy("quantity").cogroup(links.groupBy("linked"))

    def one(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty:
            return pd.DataFrame(columns=_SOURCE_COLUMNS)
        return settle(a["quantity"].iloc[0], a["unit"].iloc[0], a, b)

    return both.applyInPandas(one, _SOURCE_SCHEMA)


def size_ranges(h: pd.DataFrame) -> pd.DataFrame:
    """Clusters (quantity, low, high, key) of a histogram (quantity, bin, n) of logarithms: cut where the density falls to a thirtieth of the peaks on both sides, each with a part of the values."""
    at = h["bin"].to_numpy(np.int64)
    lo = at.min() - 20
    n = np.bincount(at - lo, h["n"].to_numpy(float), minlength=at.max() - lo + 20)
    kernel = np.exp(-0.5 * (np.arange(-20, 21) / 8.0) ** 2)
    density = np.convolve(n, kernel / kernel.sum(), "same")
    total = n.sum()
    cuts: list[int] = []

    def split(a: int, b: int) -> None:
        best = None
        for i in range(a + 1, b - 1):
            if min(n[a:i].sum(), n[i:b].sum()) >= _LEAST_SHARE * total and 30 * density[i] < min(density[a:i].max(), density[i:b].max()) and (best is None or density[i] < density[best]):
                best = i
        if best is not None:
            cuts.append(best)
            split(a, best)
            split(best, b)

    split(0, len(n))
    ends = [-(1 << 40), *(c + lo for c in sorted(cuts)), 1 << 40]
    return pd.DataFrame({"quantity": h["quantity"].iloc[0], "low": ends[:-1], "high": ends[1:], "key": [f"{SIZE}{i}" for i in range(len(ends) - 1)]})


def keyed_by_size(rows: DataFrame) -> DataFrame:
    """``rows`` (with quantity, v > 0) of quantities without units, with ``key``, the cluster of the value's size."""
    binned = rows.drop("key").withColumn("__bin", F.floor(F.ln("v") / BIN))
    counted = binned.groupBy("quantity", F.col("__bin").alias("bin")).agg(F.count("*").alias("n"))
    ranges = counted.groupBy("quantity").applyInPandas(size_ranges, "quantity string, low bigint, high bigint, key string")
    return binned.join(ranges.withColumnRenamed("quantity", "__q"), F.col("quantity").eqNullSafe(F.col("__q")) & (F.col("__bin") >= F.col("low")) & (F.col("__bin") < F.col("high"))).drop("__bin", "low", "high", "__q")




def explain_unitless(h: pd.DataFrame) -> pd.DataFrame:
    """Factor of each histogram bin of unit-less values of one quantity.

    ``h``: quantity, factor (null: no unit), bin (of the logarithm of the
    delivered value), n.
    """
    quantity = h["quantity"].iloc[0]
    with_unit, bare = h[h["factor"].notna()], h[h["factor"].isna()]
    out = pd.DataFrame({"quantity": quantity, "bin": bare["bin"], "factor": 1.0})
    if bare.empty or with_unit.empty:
        return out
    shift = np.rint(np.log(with_unit["factor"].to_numpy(float)) / BIN).astype(np.int64)
    at = with_unit["bin"].to_numpy(np.int64) + shift
    lo = at.min() - 20
    density = np.bincount(at - lo, with_unit["n"].to_numpy(float), minlength=at.max() - lo + 20)
    kernel = np.exp(-0.5 * (np.arange(-12, 13) / 5.0) ** 2)
    density = np.convolve(density, kernel / kernel.sum(), "same")
    density /= density.sum()
    factors = sorted({float(f"{f:.4g}") for f in with_unit["factor"]} | {1.0})
    factors = [f for i, f in enumerate(factors) if not i or math.log(f / factors[i - 1]) > 0.02]
    bins, n = bare["bin"].to_numpy(np.int64), bare["n"].to_numpy(float)

    def p(f: float) -> np.ndarray:
        i = bins + int(round(math.log(f) / BIN)) - lo
        return np.where((i >= 0) & (i < len(density)), density[np.clip(i, 0, len(density) - 1)], 0.0)

    like = np.array([p(f) for f in factors])
    weight = np.full(len(factors), 1 / len(factors))
    for _ in range(300):
        joint = like * weight[:, None]
        total = joint.sum(0)
        share = joint / np.where(total > 0, total, 1)
        weight = (share * n).sum(1)
        weight /= max(weight.sum(), 1e-300)
    weight[weight < _PRUNE] = 0
    joint = like * weight[:, None]
    best = np.array(factors)[joint.argmax(0)]
    out["factor"] = np.where(joint.max(0) > 0, best, 1.0)
    return out


def to_common(rows: DataFrame, common: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` (with a column ``key``, ``quantity``, ``entity``, ``v`` > 0) plus ``factor`` and ``offset`` to the common unit, and the source table.

    Rows without a unit, or of a source that stays open, get the factor that
    explains their size, 1 where nothing does; rows of a quantity without a
    common unit have a null factor.
    """
    graph = source_graph(rows, common).select("quantity", "key", "factor", "offset")
    placed = rows.join(graph.withColumnsRenamed({"factor": "__factor", "offset": "__offset"}), ["quantity", "key"], "left").withColumn("__bin", F.floor(F.ln("v") / BIN))
    counted = placed.groupBy("quantity", F.col("__factor").alias("factor"), F.col("__bin").alias("bin")).agg(F.count("*").alias("n"))
    bare = counted.groupBy("quantity").applyInPandas(explain_unitless, "quantity string, bin bigint, factor double")
    bare = bare.join(common.select("quantity").distinct(), "quantity", "left_semi").select("quantity", F.col("bin").alias("__bin"), F.col("factor").alias("__bare"))
    joined = placed.join(bare, ["quantity", "__bin"], "left").withColumn("factor", F.coalesce("__factor", "__bare")).withColumn("offset", F.when(F.col("__factor").isNotNull(), F.col("__offset")).otherwise(0.0))
    return joined.drop("__bin", "__factor", "__offset", "__bare"), graph


def two_digits_milli(x: Column) -> Column:
    """1000 times ``x`` after rounding it to two significant digits."""
    e = F.floor(F.log10(F.abs(x)))
    return F.when(x == 0, F.lit(0).cast("bigint")).otherwise(F.round(F.round(x / F.pow(F.lit(10.0), e - 1)) * F.pow(F.lit(10.0), e + 2)).cast("bigint"))
