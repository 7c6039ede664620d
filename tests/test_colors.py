"""Colours that are searched for by bisection, against scalar rules."""

import json
import math
import random

import numpy as np
from pyspark.sql import functions as F

from quillspan.functions import color


def linear(lab):
    a, b, c = (sum(k * x for k, x in zip(row, lab, strict=True)) for row in color.FROM_LAB)
    return [sum(k * x for k, x in zip(row, (a**3, b**3, c**3), strict=True)) for row in color.FROM_LMS]


def shown(lab):
    """The colour with its chroma cut to the gamut."""
    light, c, h = lab[0], math.hypot(lab[1], lab[2]), math.atan2(lab[2], lab[1])
    at = lambda x: (light, x * math.cos(h), x * math.sin(h))
    ok = lambda x: all(-1e-4 <= v <= 1 + 1e-4 for v in linear(at(x)))
    if light <= 0 or light >= 1:
        return (min(max(light, 0), 1), 0.0, 0.0)
    if ok(c):
        return at(c)
    lo, hi = 0.0, c
    for _ in range(20):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if ok(mid) else (lo, mid)
    return at(lo)


def ratio(a, b):
    x, y = (sum(w * min(1, max(0, v)) for w, v in zip(color.LUMA, linear(shown(c)), strict=True)) + 0.05 for c in (a, b))
    return max(x, y) / min(x, y)


def random_labs(n, seed):
    rng = random.Random(seed)
    return [(rng.random(), rng.uniform(-0.3, 0.3), rng.uniform(-0.3, 0.3)) for _ in range(n)]


def test_readable_reaches_the_target_with_the_least_move():
    inks, grounds = random_labs(60, 1), random_labs(60, 2)
    out = color.np_readable(np.array(inks), [np.array(grounds)], 4.5)
    for ink, ground, got in zip(inks, grounds, out.tolist(), strict=True):
        if ratio(ink, ground) >= 4.5:
            assert np.allclose(got, ink)
        else:
            best = max(ratio((x, 0.0, 0.0), ground) for x in (0, 1))
            assert ratio(got, ground) >= min(4.5, best) - 2e-3
            if best >= 4.5:
                step = 1e-3 if got[0] < ink[0] else -1e-3
                nearer = (got[0] + step, ink[1], ink[2])
                assert ratio(nearer, ground) < 4.5 + 2e-2


def test_gamut_equals_the_scalar_rule(spark):
    labs = random_labs(200, 3)
    cut = color.np_lab(color.np_gamut(color.np_lch(np.array(labs))))
    assert np.allclose(cut, [shown(x) for x in labs], atol=1e-6)
    df = spark.createDataFrame([(i, *color.np_lch(np.array([x]))[0].tolist()) for i, x in enumerate(labs)], "i int, l double, c double, h double")
    got = [r.c for r in df.orderBy("i").select(color.to_gamut(F.col("l"), F.col("c"), F.col("h")).alias("c")).collect()]
    assert np.allclose(got, color.np_gamut(color.np_lch(np.array(labs)))[:, 1], atol=1e-6)


def test_tokens_can_be_read(spark):
    rng = random.Random(9)
    hexes = [["%06x" % rng.randrange(1 << 24) for _ in range(5)] for _ in range(40)]
    lights = [*color.LIGHTS, None]
    rows = [(i, h, lights[i % len(lights)]) for i, h in enumerate(hexes)] + [(99, ["red"] * 5, None), (100, None, "dawn")]
    df = spark.createDataFrame(rows, "i int, h array<string>, light string").select("i", "light", color.palette_of(F.col("h")).alias("p"))
    got = {r.i: r for r in df.select("i", "light", "p", color.tokens(F.col("p"), F.col("light")).alias("t")).collect()}
    assert got[99].t.ink is None and got[100].t.strength is None
    for i in range(40):
        t, light = got[i].t, got[i].light
        assert t.ground == got[i].p[0] and 0 <= t.strength <= 1 and (light or t.strength == 1)
        assert sorted([t.mid1, t.mid2, t.mid3])[0] in got[i].p
        plain = max(ratio((x, 0.0, 0.0), t.ground) for x in (0, 1))
        assert ratio(t.ink, t.ground) >= min(4.6, plain) - 0.01 and ratio(t.paper_ink, t.mid1) >= min(4.5, max(ratio((x, 0.0, 0.0), t.mid1) for x in (0, 1))) - 0.01
        lit = color.np_lit(np.array([t.ground]), light, t.strength)
        if t.strength > 0.001:
            assert all(ratio(tuple(ink), tuple(g[0])) >= 4.6 - 0.02 for g in lit for ink in (t.ink, t.soft))


def test_hue_takes_the_shorter_arc(spark):
    cases = [(350.0, 10.0, 0.5, 0.0), (10.0, 350.0, 0.5, 0.0), (0.0, 180.0, 0.5, 90.0), (180.0, 0.0, 0.25, 135.0), (20.0, 40.0, 1.0, 40.0)]
    for a, b, t, want in cases:
        one, other = (F.lit(0.5), F.lit(0.1), F.lit(a)), (F.lit(0.5), F.lit(0.1), F.lit(b))
        assert abs(spark.range(1).select(color.hue_between(one, other, F.lit(t))[2].alias("h")).first().h - want) < 1e-9
    grey = (F.lit(0.5), F.lit(0.001), F.lit(77.0))
    assert spark.range(1).select(color.hue_between(grey, (F.lit(0.5), F.lit(0.1), F.lit(200.0)), F.lit(0.0))[2].alias("h")).first().h == 200


def test_blend_keeps_chroma(spark):
    one, other = [[0.5, 0.1, 0.0]] * 5, [[0.5, -0.05, 0.0866025]] * 5
    df = spark.createDataFrame([([(0.5, one), (0.5, other)],)], "x array<struct<w: double, palette: array<array<double>>>>")
    got = df.select(F.to_json(color.blended(F.col("x"))).alias("j")).first().j
    for light, a, b in json.loads(got):
        assert light == 0.5 and abs(math.hypot(a, b) - 0.1) < 1e-6 and abs(math.degrees(math.atan2(b, a)) - 60) < 1e-3


def test_a_ground_is_worked_out_once_and_only_unreadable_inks_are_searched(monkeypatch):
    rng = np.random.default_rng(4)
    inks, grounds = color.np_from_srgb(rng.random((3, 50))), [color.np_from_srgb(rng.random((3, 50))) for _ in range(3)]
    asked, real = [], color.np_gamut
    monkeypatch.setattr(color, "np_gamut", lambda lch: asked.append(len(lch)) or real(lch))
    moved = color.np_readable(inks, grounds, 4.5)
    assert len(asked) < 2 * 4 * 12 + 20  # of each place: the colour, and its luminance
    low = color.np_worst(inks, grounds) < 4.5
    assert (moved[~low] == inks[~low]).all() and 0 < low.sum() < 50 and max(asked[4:]) <= 50
    assert asked.count(int(low.sum())) >= 4 * 12


def test_palettes_are_worked_off_by_all_cores(spark):
    from quillspan.plans import palettes

    for query in (palettes.palette_tokens, palettes.palette_import, palettes.contrast_clamp):
        assert query(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_palette_rows_refuse_other_shapes(spark):
    from quillspan.sources.io import palette_rows

    five = [[0.5, 0.0, 1.0]] * 5
    rows = [("a ", five), ("b", [*five, [9.0, 9.0, 9.0]]), ("c", five[:4]), ("d", [*five[:4], [1.0]]), ("e", [*five[:4], None]), ("f", None), (" ", five), (None, five), ("g", [[0.5, 2.5, 3.5]] * 5)]
    got = {r.phrase: r.rgb for r in palette_rows(spark.createDataFrame(rows, "phrase string, colors array<array<double>>")).collect()}
    assert got == {"a": [[128, 0, 255]] * 5, "b": [[128, 0, 255]] * 5, "g": [[0, 2, 4]] * 5}
