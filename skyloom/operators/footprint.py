"""Which detectors a source's trace meets: cells of the focal plane first, traces of what is left after."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions import scalar as S
from skyloom.operators.sky import small
from skyloom.sources.readers import kept

#: Side of a focal-plane cell in degrees, below half a detector's.
CELL = 0.05
#: Cells on a side of a coarse cell, which are tried first.
COARSE = 8


def held(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with more columns, made once a row: as outputs of a generator, filters on them don't repeat what makes them."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def terms() -> dict[str, Column]:
    """What a trace is made of at a place (xf, yf), whatever the wavelength: its reference position, and the coefficients of each power."""
    out = {"x_ref": S.poly2d("xf", "yf", F.col("x_ij")), "y_ref": S.poly2d("xf", "yf", F.col("y_ij"))}
    return out | {f"{n}{k}": S.poly2d("xf", "yf", F.col(f"{n}_ijk")[k]) for n in "cd" for k in range(S.POWERS)}


def traced(df: DataFrame, wavelength: Column) -> DataFrame:
    """``df``, which has :func:`terms` of each place, with the pixels px, py of light of a wavelength (micron), made once a row."""
    c, d = ([F.col(f"{n}{k}") for k in range(S.POWERS)] for n in "cd")
    df = held(held(df, {"t": S.wl_transform(wavelength, "wl_ref", "kind")}), {"along": S.horner(F.col("t"), d)})
    px, py = S.mpa_sca(F.col("x_ref") + S.horner(F.col("along"), c), F.col("y_ref") + F.col("along"))
    return held(df, {"px": px, "py": py})


class Bounds:
    """Lower and upper bounds over a cell, as SQL, of columns that are made step by step so that no expression grows."""

    def __init__(self, df: DataFrame):
        self.df = df

    def keep(self, named: dict[str, tuple[str, str]]) -> dict[str, tuple[str, str]]:
        columns = ", ".join(f"{low} AS {n}_lo, {high} AS {n}_hi" for n, (low, high) in named.items())
        self.df = self.df.selectExpr("*", f"inline(array(struct({columns})))")
        return {n: (f"{n}_lo", f"{n}_hi") for n in named}

    def horner(self, sums: dict[str, tuple[tuple[str, str], list[tuple[str, str]]]]) -> dict[str, tuple[str, str]]:
        """Bounds of several sums of coefficients[i] x**i, given as {name: (x, coefficients)}."""
        out = {n: c[-1] for n, (_, c) in sums.items()}
        for k in range(max(len(c) for _, c in sums.values()) - 1):
            step = {}
            for n, (x, c) in sums.items():
                if len(c) > k + 1:
                    ends = ", ".join(f"{a} * {b}" for a in set(out[n]) for b in set(x))
                    low, high = (f"least({ends})", f"greatest({ends})") if ", " in ends else (ends, ends)
                    step[n] = f"{low} + {c[-2 - k][0]}", f"{high} + {c[-2 - k][1]}"
            done = self.keep({f"{n}{k}": v for n, v in step.items()})
            out |= {n: done[f"{n}{k}"] for n in step}
        return out


def cells_met(cells: DataFrame, side: float, waves: tuple[float, ...], low: float, high: float) -> DataFrame:
    """(gx, gy, sca, ord) of ``cells`` (with calibration columns) where some trace from the cell may have a bounding box that meets [low, high] on both axes. None is missed."""
    b, n_waves, powers, (n_x, n_y) = Bounds(cells), range(len(waves)), range(S.POWERS), S.GRID
    edges = b.keep({a: (f"g{a} * {side}D", f"(g{a} + 1) * {side}D") for a in "xy"})
    grids = {"px": "x_ij", "py": "y_ij"} | {f"{n}{k}": f"{n}_ijk[{k}]" for n in "cd" for k in powers}
    rows = b.horner({f"{n}r{i}": (edges["y"], [(f"{g}[{i}][{j}]",) * 2 for j in range(n_y)]) for n, g in grids.items() for i in range(n_x)})
    at = b.horner({n: (edges["x"], [rows[f"{n}r{i}"] for i in range(n_x)]) for n in grids})
    b.df = b.df.withColumns({f"t{w}": S.wl_transform(F.lit(wave), "wl_ref", "kind") for w, wave in enumerate(waves)})
    along = b.horner({f"along{w}": ((f"t{w}",) * 2, [at[f"d{k}"] for k in powers]) for w in n_waves})
    across = b.horner({f"across{w}": (along[f"along{w}"], [at[f"c{k}"] for k in powers]) for w in n_waves})
    ends = {"lo": 0, "hi": 1}
    mm = {f"m{a}{w}": tuple(f"{at['p' + a][e]} + {part[w][e]}" for e in ends.values()) for a, part in (("x", [across[f"across{w}"] for w in n_waves]), ("y", [along[f"along{w}"] for w in n_waves])) for w in n_waves}
    b.keep(mm)
    pixel = {f"{a}{w}{e}": S.mpa_sca(f"mx{w}_{'hi' if e == 'lo' else 'lo'}", f"my{w}_{e}")["xy".index(a)] for a in "xy" for w in n_waves for e in ends}
    df = held(b.df, pixel)
    meets = [(F.greatest(*(f"{a}{w}hi" for w in n_waves)) >= low - 1e-6) & (F.least(*(f"{a}{w}lo" for w in n_waves)) <= high + 1e-6) for a in "xy"]
    return df.filter(meets[0] & meets[1]).select("gx", "gy", "sca", "ord")


def detector_overlap(sources: DataFrame, calibration: DataFrame, waves: tuple[float, ...], low: float = -300.0, high: float = 4388.0) -> DataFrame:
    """Rows of ``sources`` (xf, yf in degrees on the focal plane) once for each (sca, ord) whose padded detector the trace's bounding box meets.

    Sources meet detectors by equi-join on focal-plane cells, whose number is
    set by the field and not by the sources. ``calibration`` is one row per
    detector and order, with nested coefficients.
    """
    at = lambda c, side: F.floor(F.col(c) / side)
    rows = sources.withColumns({"gx": at("xf", CELL), "gy": at("yf", CELL)})
    cells = rows.select("gx", "gy").distinct().withColumns({"cx": at("gx", COARSE), "cy": at("gy", COARSE)})
    coarse = cells.select(F.col("cx").alias("gx"), F.col("cy").alias("gy")).distinct().crossJoin(F.broadcast(calibration))
    coarse = cells_met(coarse, CELL * COARSE, waves, low, high).select(F.col("gx").alias("cx"), F.col("gy").alias("cy"), "sca", "ord")
    fine = cells.join(F.broadcast(kept(coarse)), ["cx", "cy"]).join(F.broadcast(calibration), ["sca", "ord"])
    met = kept(cells_met(fine, CELL, waves, low, high))
    pairs = rows.join(small(met), ["gx", "gy"]).join(F.broadcast(calibration), ["sca", "ord"])
    df = held(pairs, terms())
    coefficients = {n: [F.col(f"{n}{k}") for k in range(S.POWERS)] for n in "cd"}
    df = held(df, {f"along{w}": S.horner(S.wl_transform(F.lit(wave), "wl_ref", "kind"), coefficients["d"]) for w, wave in enumerate(waves)})
    along = [F.col(f"along{w}") for w in range(len(waves))]
    places = [S.mpa_sca(F.col("x_ref") + S.horner(a, coefficients["c"]), F.col("y_ref") + a) for a in along]
    df = held(df, {f"{n}{w}": c for w, place in enumerate(places) for n, c in zip(("px", "py"), place, strict=True)})
    most = lambda f, a: f(*(F.col(f"p{a}{w}") for w in range(len(waves))))
    meets = [(most(F.greatest, a) >= low) & (most(F.least, a) <= high) for a in "xy"]
    return df.filter(meets[0] & meets[1]).select(*sources.columns, "sca", "ord")
