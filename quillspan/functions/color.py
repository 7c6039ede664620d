"""OKLab colour arithmetic: column expressions, and numpy over Arrow batches where a colour
is searched for (all rows of a batch move together)."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

# Linear sRGB to cone responses, and cone responses to OKLab.
TO_LMS = (
    (0.4122214708, 0.5363325363, 0.0514459929),
    (0.2119034982, 0.6806995451, 0.1073969566),
    (0.0883024619, 0.2817188376, 0.6299787005),
)
TO_LAB = (
    (0.2104542553, 0.793617785, -0.0040720468),
    (1.9779984951, -2.428592205, 0.4505937099),
    (0.0259040371, 0.7827717662, -0.808675766),
)
# OKLab to the roots of cone responses, and cone responses to linear sRGB.
FROM_LAB = (
    (1.0, 0.3963377774, 0.2158037573),
    (1.0, -0.1055613458, -0.0638541728),
    (1.0, -0.0894841775, -1.291485548),
)
FROM_LMS = (
    (4.0767416621, -3.3077115913, 0.2309699292),
    (-1.2684380046, 2.6097574011, -0.3413193965),
    (-0.0041960863, -0.7034186147, 1.707614701),
)
LUMA = (0.2126, 0.7152, 0.0722)


def channel(hex6: Column, i: int) -> Column:
    """Channel i of rrggbb as linear light in [0, 1]."""
    c = F.conv(F.substring(hex6, 2 * i + 1, 2), 16, 10).cast("double") / 255
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def _apply(matrix, values):
    return [sum(k * c for k, c in zip(row, values, strict=True)) for row in matrix]


def lab_of_linear(rgb) -> tuple[Column, Column, Column]:
    return tuple(_apply(TO_LAB, [F.cbrt(c) for c in _apply(TO_LMS, rgb)]))


def oklab(hex6: Column) -> tuple[Column, Column, Column]:
    return lab_of_linear([channel(hex6, i) for i in range(3)])


def linear_of_lab(lab) -> list:
    """Linear sRGB, columns or arrays; outside [0, 1] if the colour has no place there."""
    return _apply(FROM_LMS, [c * c * c for c in _apply(FROM_LAB, lab)])


def luminance(hex6: Column) -> Column:
    return sum(w * channel(hex6, i) for i, w in enumerate(LUMA))


def contrast(one: Column, other: Column) -> Column:
    return (F.greatest(one, other) + 0.05) / (F.least(one, other) + 0.05)


def hex6_of(text: Column) -> Column:
    """rrggbb of a colour written with or without #; null if it is none."""
    return F.nullif(F.lower(F.regexp_extract(F.trim(text), "^#?([0-9a-fA-F]{6})$", 1)), F.lit(""))


def labs_of(hexes: Column) -> Column:
    """array<array<double>>: OKLab of each rrggbb. One step at a time, as a step's result that an
    expression uses nine times would be worked out nine times."""
    light = F.transform(hexes, lambda h: F.array(*[channel(h, i) for i in range(3)]))
    cones = F.transform(light, lambda c: F.array(*[F.cbrt(x) for x in _apply(TO_LMS, [c[i] for i in range(3)])]))
    return F.transform(cones, lambda c: F.array(*_apply(TO_LAB, [c[i] for i in range(3)])))


def palette_of(colors: Column) -> Column:
    """array<array<double>> of five OKLab colours; null unless there are five and all are written well."""
    return F.when((F.size(colors) == 5) & F.forall(colors, lambda c: hex6_of(c).isNotNull()), labs_of(F.transform(colors, hex6_of)))


def lch(lab) -> tuple[Column, Column, Column]:
    """Lightness, chroma and hue in degrees; a colour without chroma has hue 0."""
    light, a, b = lab
    c, h = F.hypot(a, b), F.degrees(F.atan2(b, a))
    return light, c, F.when(c < 1e-4, 0.0).when(h < 0, h + 360).otherwise(h)


def lab_of_lch(light, c, h) -> tuple[Column, Column, Column]:
    return light, c * F.cos(F.radians(h)), c * F.sin(F.radians(h))


def hue_between(one, other, t: Column) -> tuple[Column, Column, Column]:
    """Lightness, chroma and hue at t in [0, 1] between two colours, over the shorter arc.
    A grey (chroma below 0.005) borrows the other's hue."""
    (l1, c1, h1), (l2, c2, h2) = one, other
    a, b = F.when(c1 < 0.005, h2).otherwise(h1), F.when(c2 < 0.005, h1).otherwise(h2)
    arc = F.pmod(b - a + 540, F.lit(360.0)) - 180  # exactly opposite hues go down
    arc = F.when((arc == -180) & (b > a), 180.0).otherwise(arc)
    return l1 + (l2 - l1) * t, c1 + (c2 - c1) * t, F.pmod(a + arc * t + 360, F.lit(360.0))


def blended(weighted: Column) -> Column:
    """One palette of several: array<struct<w, palette>> to an array of five colours. Chroma is
    averaged apart from hue, which is averaged on the circle, so unlike hues don't turn grey."""
    names = ("l", "c", "x", "y")
    zero = F.array(*[F.struct(*[F.lit(0.0).alias(n) for n in names])] * 5)

    def add(sums: Column, one: Column) -> Column:
        def slot(s: Column, p: Column) -> Column:
            c = F.hypot(p[1], p[2])
            unit = lambda v: F.when(c > 1e-6, v / c).otherwise(0.0)
            parts = zip(names, (p[0], c, unit(p[1]), unit(p[2])), strict=True)
            return F.struct(*[(s[n] + one["w"] * v).alias(n) for n, v in parts])

        return F.zip_with(sums, one["palette"], slot)

    def color_(s: Column) -> Column:
        h = F.atan2(s["y"], s["x"])
        return F.array(s["l"], s["c"] * F.cos(h), s["c"] * F.sin(h))

    return F.aggregate(weighted, zero, add, lambda sums: F.transform(sums, color_))


def _mean(values: Column) -> Column:
    """The mean of an array, which is worked out once."""
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n"))
    return F.aggregate(values, zero, lambda t, x: F.struct((t["s"] + x).alias("s"), (t["n"] + 1).alias("n")), lambda t: t["s"] / t["n"])


def palette_gap(one: Column, other: Column) -> Column:
    """Mean distance of two palettes, slot by slot."""
    return _mean(F.zip_with(one, other, lambda p, q: F.sqrt(F.aggregate(F.zip_with(p, q, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))))


def mean_tone(pixels: Column) -> Column:
    """Mean OKLab colour of an array of rrggbb pixels, to four places (half to even)."""
    zero = F.struct(*[F.lit(0.0).alias(n) for n in "lab"], F.lit(0).alias("n"))
    add = lambda t, p: F.struct(*[(t[n] + p[k]).alias(n) for k, n in enumerate("lab")], (t["n"] + 1).alias("n"))
    return F.aggregate(labs_of(pixels), zero, add, lambda t: F.array(*[F.bround(t[n] / t["n"], 4) for n in "lab"]))


def in_gamut(rgb, slack: float = 1e-4) -> Column:
    out = F.lit(True)
    for c in rgb:
        out &= (c >= -slack) & (c <= 1 + slack)
    return out


def to_gamut(light: Column, c: Column, h: Column, steps: int = 20) -> Column:
    """The largest chroma, found by `steps` bisections, that shows in sRGB at this lightness and hue."""
    fits = lambda x: in_gamut(linear_of_lab(lab_of_lch(light, x, h)))

    def halve(s: Column, _) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        return F.struct(F.when(fits(mid), mid).otherwise(s["lo"]).alias("lo"), F.when(fits(mid), s["hi"]).otherwise(mid).alias("hi"))

    start = F.struct(F.lit(0.0).alias("lo"), c.alias("hi"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve)["lo"]
    return F.when((light <= 0) | (light >= 1), 0.0).when(fits(c), c).otherwise(found)


def season(month: Column, south: Column) -> Column:
    """winter from December in the north; half a year later in the south."""
    at = F.pmod(F.floor(F.pmod(month, F.lit(12)) / 3) + F.when(south, 2).otherwise(0), F.lit(4))
    return F.element_at(F.array(*map(F.lit, ("winter", "spring", "summer", "autumn"))), (at + 1).cast("int"))


def southern(latitude: Column) -> Column:
    """Whether a latitude is below zero; an unknown one counts as north."""
    return F.coalesce(F.nanvl(latitude.cast("double"), F.lit(0.0)) < 0, F.lit(False))


# --- readable text: numpy, colours as rows of (L, a, b) -----------------------------------

TEXT_TARGET, INK_TARGET, PAPER_TARGET = 4.6, 7.0, 4.5
SOFT_MIX = 0.4
# The layers of each room light, as lightness, chroma, hue and strength.
LIGHTS = {
    "dawn": ((0.86, 0.09, 40, 0.3), (0.76, 0.06, 250, 0.2)),
    "golden-hour": ((0.82, 0.15, 70, 0.42),),
    "overcast": ((0.82, 0.02, 240, 0.24), (0.72, 0.025, 240, 0.24)),
    "neon": ((0.66, 0.26, 340, 0.36), (0.82, 0.14, 200, 0.36)),
    "candle": ((0.82, 0.15, 62, 0.45),),
    "moonlight": ((0.86, 0.045, 240, 0.32),),
    "desk-lamp": ((0.9, 0.11, 76, 0.5), (0, 0, 0, 0.14)),
    "fluorescent": ((1, 0, 0, 0.025), (0.96, 0.035, 150, 0.4), (0.9, 0.02, 150, 0.14)),
}


def np_lch(lab: np.ndarray) -> np.ndarray:
    c, h = np.hypot(lab[:, 1], lab[:, 2]), np.degrees(np.arctan2(lab[:, 2], lab[:, 1])) % 360
    return np.stack([lab[:, 0], c, np.where(c < 1e-4, 0.0, h)], axis=1)


def np_lab(lch_: np.ndarray) -> np.ndarray:
    h = np.radians(lch_[:, 2])
    return np.stack([lch_[:, 0], lch_[:, 1] * np.cos(h), lch_[:, 1] * np.sin(h)], axis=1)


def _np_apply(matrix: tuple, values: np.ndarray) -> np.ndarray:
    """_apply() to arrays, all rows of the matrix at once."""
    m = np.array(matrix)[:, :, None]
    return m[:, 0] * values[0] + m[:, 1] * values[1] + m[:, 2] * values[2]


def np_linear_of_lab(lab: np.ndarray) -> np.ndarray:
    """linear_of_lab() of arrays; a row a channel."""
    root = _np_apply(FROM_LAB, lab)
    return _np_apply(FROM_LMS, root * root * root)


def np_gamut(lch_: np.ndarray) -> np.ndarray:
    """Chroma cut to what sRGB shows; black and white have none. Only colours that don't show are
    searched."""
    out, edge = lch_.copy(), (lch_[:, 0] <= 0) | (lch_[:, 0] >= 1)
    out[edge, 0], out[edge, 1] = np.clip(out[edge, 0], 0, 1), 0

    def fits(colors: np.ndarray, c: np.ndarray, ways: np.ndarray) -> np.ndarray:
        rgb = np_linear_of_lab((colors[:, 0], c * ways[0], c * ways[1]))
        return ((rgb >= -1e-4) & (rgb <= 1 + 1e-4)).all(axis=0)

    hue = np.radians(out[:, 2])
    ways = np.stack([np.cos(hue), np.sin(hue)])
    far = np.flatnonzero(~(fits(out, out[:, 1], ways) | edge))
    if len(far):
        colors, ways = out[far], ways[:, far]
        lo, hi = np.zeros(len(far)), colors[:, 1]
        for _ in range(20):
            mid = (lo + hi) / 2
            ok = fits(colors, mid, ways)
            lo, hi = np.where(ok, mid, lo), np.where(ok, hi, mid)
        out[far, 1] = lo
    return out


def np_linear(lab: np.ndarray) -> np.ndarray:
    """Linear sRGB in [0, 1] of the nearest colour in the gamut; a row a channel."""
    return np.clip(np_linear_of_lab(np_lab(np_gamut(np_lch(lab))).T), 0, 1)


def np_srgb(lab: np.ndarray) -> np.ndarray:
    v = np_linear(lab)
    return np.where(v <= 0.0031308, 12.92 * v, 1.055 * np.maximum(v, 1e-12) ** (1 / 2.4) - 0.055)


def np_from_linear(linear: np.ndarray) -> np.ndarray:
    return (np.array(TO_LAB) @ np.cbrt(np.array(TO_LMS) @ linear)).T


def np_from_srgb(rgb: np.ndarray) -> np.ndarray:
    return np_from_linear(np.where(rgb <= 0.04045, rgb / 12.92, ((rgb + 0.055) / 1.055) ** 2.4))


def np_luma(lab: np.ndarray) -> np.ndarray:
    """Luminance as contrast takes it."""
    return np.array(LUMA) @ np_linear(lab) + 0.05


def np_ratio(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum(x, y) / np.minimum(x, y)


def np_contrast(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np_ratio(np_luma(a), np_luma(b))


def np_worst(ink: np.ndarray, grounds: list[np.ndarray]) -> np.ndarray:
    """The least contrast of the ink with any of the grounds."""
    x = np_luma(ink)
    return np.min([np_ratio(x, np_luma(g)) for g in grounds], axis=0)


STEPS = np.arange(1, 5) / 4  # a range is searched by four places at a time


def np_first(holds: Callable[[np.ndarray], np.ndarray], start: np.ndarray, end: np.ndarray, rounds: int) -> np.ndarray:
    """Of each row, the place nearest to start, on the way to end, from which on holds() is true: it
    must be so at end, and change once. The places of a round are asked at once, and the
    range shrinks to the one before the first that holds."""
    for _ in range(rounds):
        places = start + (end - start) * STEPS[:, None]
        first = np.argmax(np.stack([holds(p) for p in places]), axis=0)
        rows = np.arange(len(start))
        start, end = np.where(first == 0, start, places[np.maximum(first - 1, 0), rows]), places[first, rows]
    return end


def np_readable(ink: np.ndarray, grounds: list[np.ndarray], target: float) -> np.ndarray:
    """The ink at the lightness nearest to its own that has the target contrast with all grounds.

    On either side of the grounds contrast grows with the distance in lightness, so the place is
    the first one on the way to white or to black. The way is chosen by what its end reaches, up
    to the target; of equal ends, a dark first ground takes white. If no end reaches the target,
    the ink ends there."""
    lumas = np.stack([np.broadcast_to(np_luma(g), len(ink)) for g in grounds])  # once, not at each place
    worst = lambda lab, rows: np.min(np_ratio(np_luma(lab), lumas[:, rows]), axis=0)
    low = np.flatnonzero(~(worst(ink, slice(None)) >= target))  # the others stay, and are not searched
    if not len(low):
        return ink
    own = np_lch(ink[low])
    shown = lambda lightness: np_lab(np_gamut(np.column_stack([lightness, own[:, 1:]])))
    enough = lambda lightness: worst(shown(lightness), low) >= target
    white, black = (np.minimum(worst(shown(np.full(len(low), x)), low), target) for x in (1.0, 0.0))
    end = np.where(white == black, np.broadcast_to(grounds[0][:, 0], len(ink))[low] < 0.5, white > black).astype(float)
    moved = np.where(np.maximum(white, black) >= target, np_first(enough, own[:, 0], end, 12), end)
    out = ink.copy()
    out[low] = shown(moved)
    return out


@cache
def _layer(color: tuple[float, float, float]) -> np.ndarray:
    return np_srgb(np_lab(np.array([color], float)))


def np_lit(ground: np.ndarray, light: str | None, strength: np.ndarray | float = 1.0) -> list[np.ndarray]:
    """The plain ground, and the ground under each layer of a light as sRGB blending shows it."""
    out, under = [ground], np_srgb(ground)
    for *color, alpha in LIGHTS.get(light, ()):
        a = alpha * strength
        out.append(np_from_srgb(_layer(tuple(color)) * a + under * (1 - a)))
    return out


def np_most_contrast(colors: list[np.ndarray], ground: np.ndarray) -> np.ndarray:
    """The index of the colour with the most contrast; the first one wins a tie."""
    return np.argmax([np_contrast(c, ground) for c in colors], axis=0)


def np_tokens(palette: np.ndarray, light: str | None) -> dict[str, np.ndarray]:
    """Display colours and the light's strength of palettes, an array (rows, 5, 3).

    The first colour is the ground, the one with the most contrast to it the ink, the others keep
    their order as mid tones. Each written colour passes through its requirements in turn; one
    under a light that can't be met is taken back to what the plain ground allows. The light
    is as strong as both inks bear."""
    ground = palette[:, 0]
    ranked = np.argsort(np.arange(1, 5) + 10 * (np.arange(4) == np_most_contrast(list(palette[:, 1:].swapaxes(0, 1)), ground)[:, None]), axis=1) + 1
    mid1, mid2, mid3, lead = (np.take_along_axis(palette, ranked[:, k, None, None], axis=1)[:, 0] for k in range(4))
    plain, lit = [ground], np_lit(ground, light)

    def written(color: np.ndarray) -> np.ndarray:
        best = np_readable(color, lit, TEXT_TARGET)
        short = np.flatnonzero(~(np_worst(best, lit) >= TEXT_TARGET))
        if len(short):
            best = best.copy()
            best[short] = np_readable(color[short], [ground[short]], INK_TARGET)
        return best

    ink = written(np_readable(lead, plain, INK_TARGET))
    soft = written((1 - SOFT_MIX) * ink + SOFT_MIX * ground)
    on_paper = np.stack([ink, ground])[np_most_contrast([ink, ground], mid1), np.arange(len(ink))]
    strength = np.ones(len(ink))
    if light is not None:
        inks = np_luma(ink), np_luma(soft)

        def dark(away: np.ndarray, rows: np.ndarray) -> np.ndarray:
            under = [np_luma(g) for g in np_lit(ground[rows], light, 1 - away)]
            return np.min([np_ratio(x[rows], u) for x in inks for u in under], axis=0) >= TEXT_TARGET

        dim = np.flatnonzero(~dark(np.zeros(len(ink)), np.arange(len(ink))))
        if len(dim):
            strength[dim] = 1 - np_first(lambda away: dark(away, dim) | (away >= 1), np.zeros(len(dim)), np.ones(len(dim)), 8)
    return {"ground": ground, "ink": ink, "soft": soft, "mid1": mid1, "mid2": mid2, "mid3": mid3, "paper_ink": np_readable(on_paper, [mid1], PAPER_TARGET), "strength": strength}


_LAB = ArrayType(DoubleType())
_TOKENS = StructType([*[StructField(n, _LAB) for n in ("ground", "ink", "soft", "mid1", "mid2", "mid3", "paper_ink")], StructField("strength", DoubleType())])


def _stack(colors: pd.Series) -> np.ndarray:
    return np.array([np.stack(c) if len(c) and not np.isscalar(c[0]) else np.asarray(c, float) for c in colors], float)


@F.pandas_udf(_TOKENS)
def tokens(palette: pd.Series, light: pd.Series) -> pd.DataFrame:
    """The display colours of array<array<double>> palettes under a named light (null: none);
    nulls for a null palette."""
    out = {f.name: [None] * len(palette) for f in _TOKENS.fields}
    for name in light.where(light.notna(), None).unique():
        at = np.flatnonzero(palette.notna() & (light.isna() if name is None else light == name))
        if len(at):
            for k, v in np_tokens(_stack(palette.iloc[at]), name).items():
                for i, x in zip(at, v.tolist(), strict=True):
                    out[k][i] = x
    return pd.DataFrame({k: pd.Series(v, dtype=object) for k, v in out.items()})


def readable_on(target: float):
    """A function (ink, ground) that moves the ink until it has the target contrast."""

    @F.pandas_udf(_LAB)
    def move(ink: pd.Series, ground: pd.Series) -> pd.Series:
        return pd.Series(np_readable(_stack(ink), [_stack(ground)], target).tolist())

    return move


@F.pandas_udf(_LAB)
def text_on(paper: pd.Series, palette: pd.Series) -> pd.Series:
    """The palette's colour with the most contrast on paper, moved until text is readable."""
    p, colors = _stack(paper), _stack(palette)
    best = np_most_contrast([colors[:, k] for k in range(5)], p)
    return pd.Series(np_readable(colors[np.arange(len(p)), best], [p], TEXT_TARGET).tolist())


def valid_palette(hexes: Column) -> Column:
    """Whether there are exactly five #rrggbb."""
    return F.coalesce((F.size(hexes) == 5) & F.forall(hexes, lambda h: F.coalesce(h.rlike("(?i)^#[0-9a-f]{6}$"), F.lit(False))), F.lit(False))


def four_places(x: Column) -> Column:
    """Rounded to four places, halves up."""
    return F.floor(x * 1e4 + 0.5) / 1e4
