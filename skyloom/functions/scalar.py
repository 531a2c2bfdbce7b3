"""Column builders for photometry, sky geometry, focal-plane frames and dispersion."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: AB zero point, speed of light in Angstrom per second, focal plane orientation in degrees.
AB_ZERO, LIGHT, FOCAL_PA = 3.631e-20, 2.99792458e18, -60.0


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def mag_to_flux(mag) -> Column:
    return F.pow(F.lit(10.0), -0.4 * col(mag))


def flux_to_mag(flux) -> Column:
    """NaN where the flux is not positive."""
    f = col(flux).cast("double")
    return F.when(f > 0, -2.5 * F.log10(f)).otherwise(F.lit(float("nan")))


def fnu_to_flam(f, wavelength) -> Column:
    return col(f) * LIGHT / (col(wavelength) * col(wavelength))


def flat_ab_flam(wavelength, mag) -> Column:
    return AB_ZERO * LIGHT / (col(wavelength) * col(wavelength)) * mag_to_flux(mag)


def haversine(ra1, dec1, ra2, dec2) -> Column:
    """Separation in degrees; all arguments in degrees, DOUBLE."""
    d1, d2 = F.radians(col(dec1)), F.radians(col(dec2))
    a = F.pow(F.sin((d2 - d1) / 2), 2) + F.cos(d1) * F.cos(d2) * F.pow(F.sin(F.radians(col(ra2) - col(ra1)) / 2), 2)
    return F.degrees(2 * F.asin(F.sqrt(F.least(a, F.lit(1.0)))))


def require_double(df: DataFrame, *names: str) -> None:
    """Absolute sky coordinates lose their differences in single precision, so FLOAT is refused."""
    for n in names:
        if df.schema[n].dataType.simpleString() != "double":
            raise TypeError(f"{n} must be DOUBLE, not {df.schema[n].dataType.simpleString()}")


def tangent_offsets(ra, dec, ra0, dec0) -> tuple[Column, Column]:
    """Gnomonic (East, North) offsets in degrees about a pointing; periodic in RA."""
    da, d, d0 = F.radians(col(ra) - col(ra0)), F.radians(col(dec)), F.radians(col(dec0))
    depth = F.cos(d0) * F.cos(d) * F.cos(da) + F.sin(d0) * F.sin(d)
    east = F.cos(d) * F.sin(da)
    north = F.cos(d0) * F.sin(d) - F.sin(d0) * F.cos(d) * F.cos(da)
    return F.degrees(east / depth), F.degrees(north / depth)


def flat_sky_offsets(ra, dec, ra0, dec0) -> tuple[Column, Column]:
    return (col(ra) - col(ra0)) * F.cos(F.radians(col(dec0))), col(dec) - col(dec0)


def pa_rotation(xi, eta, pa) -> tuple[Column, Column]:
    """Sky offsets to focal-plane degrees: rotate by pa + 180 + FOCAL_PA and negate both."""
    t = F.radians(col(pa) + 180 + FOCAL_PA)
    return F.sin(t) * col(eta) - F.cos(t) * col(xi), -(F.sin(t) * col(xi)) - F.cos(t) * col(eta)


def _detector(c: str = "") -> dict[str, Column]:
    return {k: F.col(c + k) for k in ("crpix", "pixel_scale", "plate_scale", "xcen", "ycen")}


def sca_mpa(x, y) -> tuple[Column, Column]:
    """Pixels to mm; x flips. Detector columns (crpix, pixel_scale, plate_scale, xcen, ycen) stand beside x and y."""
    d = _detector()
    return d["xcen"] - (col(x) - d["crpix"]) / d["plate_scale"], d["ycen"] + (col(y) - d["crpix"]) / d["plate_scale"]


def mpa_sca(x, y) -> tuple[Column, Column]:
    d = _detector()
    return d["crpix"] - (col(x) - d["xcen"]) * d["plate_scale"], d["crpix"] + (col(y) - d["ycen"]) * d["plate_scale"]


def _mm_to_deg() -> Column:
    d = _detector()
    return d["plate_scale"] * d["pixel_scale"] / 3600


def mpa_fpa(x, y) -> tuple[Column, Column]:
    return col(x) * _mm_to_deg(), col(y) * _mm_to_deg()


def fpa_mpa(x, y) -> tuple[Column, Column]:
    return col(x) / _mm_to_deg(), col(y) / _mm_to_deg()


def sca_fpa(x, y) -> tuple[Column, Column]:
    return mpa_fpa(*sca_mpa(x, y))


def fpa_sca(x, y) -> tuple[Column, Column]:
    return mpa_sca(*fpa_mpa(x, y))


def wl_transform(wavelength, ref, kind) -> Column:
    return F.when(col(kind) == "log", F.log10(col(wavelength) / col(ref))).otherwise(col(wavelength) - col(ref))


def wl_inverse(t, ref, kind) -> Column:
    return F.when(col(kind) == "log", col(ref) * F.pow(F.lit(10.0), col(t))).otherwise(col(t) + col(ref))


#: Sizes of a calibration's coefficient arrays: powers of the wavelength term, and of x and y in each coefficient.
POWERS, GRID = 3, (2, 2)


def horner(x: Column, coefficients: list[Column]) -> Column:
    """Sum of coefficients[i] x**i, written out, so that it compiles to plain arithmetic."""
    out = coefficients[-1]
    for c in reversed(coefficients[:-1]):
        out = out * x + c
    return out


def poly2d(x, y, grid: Column, shape: tuple[int, int] = GRID) -> Column:
    """Sum of grid[i][j] x**i y**j over a grid of the given shape."""
    x, y = col(x), col(y)
    return horner(x, [horner(y, [grid[i][j] for j in range(shape[1])]) for i in range(shape[0])])


def nested_calibration(calibration: DataFrame) -> DataFrame:
    """Coefficient columns as nested arrays: xy grids of the reference position, and per power of curvature and dispersion."""
    zero = F.lit(0.0)
    flat = lambda c: F.array(F.array(F.col(c), zero), F.array(zero, zero))
    tilted = lambda c, s: F.array(F.array(F.col(c), zero), F.array(F.col(s), zero))
    return calibration.select(
        "sca", "ord", "crpix", "pixel_scale", "plate_scale", "xcen", "ycen", "kind", "wl_ref",
        F.array(F.array("x00", "x01"), F.array("x10", "x11")).alias("x_ij"),
        F.array(F.array("y00", "y01"), F.array("y10", "y11")).alias("y_ij"),
        F.array(flat("c0"), tilted("c1", "cx"), flat("c2")).alias("c_ijk"),
        F.array(flat("d0"), tilted("d1", "dx"), flat("d2")).alias("d_ijk"),
    )


def trace_coeffs(x, y, cube: Column, powers: int = POWERS) -> list[Column]:
    """Coefficients at a position, one for each power."""
    return [poly2d(x, y, cube[k]) for k in range(powers)]


def trace_mpa(x, y, wavelength) -> tuple[Column, Column]:
    """Position in mm of light of a wavelength (micron) from focal-plane (x, y) in degrees; calibration as nested columns."""
    along = horner(wl_transform(wavelength, "wl_ref", "kind"), trace_coeffs(x, y, F.col("d_ijk")))
    across = horner(along, trace_coeffs(x, y, F.col("c_ijk")))
    return poly2d(x, y, F.col("x_ij")) + across, poly2d(x, y, F.col("y_ij")) + along


def trace_position(x, y, wavelength) -> tuple[Column, Column]:
    """As :func:`trace_mpa`, in pixels."""
    return mpa_sca(*trace_mpa(x, y, wavelength))


def uniq_pack(order, pix) -> Column:
    """4**(order + 1) + pix."""
    head = F.lit(4 ** (order + 1)).cast("long") if isinstance(order, int) else F.pow(F.lit(4.0), order + 1).cast("long")
    return head + col(pix)


def uniq_order(uniq) -> Column:
    """From the bit length, so exact for all cells."""
    return (F.floor((F.length(F.bin(col(uniq))) - 1) / 2) - 1).cast("int")


def uniq_pix(uniq) -> Column:
    k = uniq_order(uniq)
    return col(uniq) - F.pow(F.lit(4.0), k + 1).cast("long")


def cell_parent(pix, steps: int) -> Column:
    return F.shiftright(col(pix), 2 * steps)


def _spread(v: Column) -> Column:
    """Bits of a number below 2**16 moved to even places."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        v = (v.bitwiseOR(F.shiftleft(v, shift))).bitwiseAND(F.lit(mask).cast("long"))
    return v


def sky_cell(ra, dec, order: int) -> Column:
    """NESTED cell of equal area (Gorski et al. 2005) of a sky position in degrees."""
    n = 1 << order
    z = F.sin(F.radians(col(dec)))
    tt = F.pmod(col(ra), F.lit(360.0)) / 90
    floor = lambda c: F.floor(c).cast("long")
    up, down = floor(n * (0.5 + tt) - n * z * 0.75), floor(n * (0.5 + tt) + n * z * 0.75)
    fup, fdown = F.shiftright(up, order), F.shiftright(down, order)
    face_eq = F.when(fup == fdown, fup.bitwiseOR(F.lit(4).cast("long"))).when(fup < fdown, fup).otherwise(fdown + 8)
    ix_eq, iy_eq = down.bitwiseAND(F.lit(n - 1).cast("long")), (n - 1) - up.bitwiseAND(F.lit(n - 1).cast("long"))
    quarter = F.least(floor(tt), F.lit(3).cast("long"))
    tp = tt - quarter
    reach = n * F.sqrt(3 * (1 - F.abs(z)))
    jp, jm = F.least(floor(tp * reach), F.lit(n - 1).cast("long")), F.least(floor((1 - tp) * reach), F.lit(n - 1).cast("long"))
    north = z >= 0
    face = F.when(F.abs(z) <= 2 / 3, face_eq).when(north, quarter).otherwise(quarter + 8)
    ix = F.when(F.abs(z) <= 2 / 3, ix_eq).when(north, (n - 1) - jm).otherwise(jp)
    iy = F.when(F.abs(z) <= 2 / 3, iy_eq).when(north, (n - 1) - jp).otherwise(jm)
    return F.shiftleft(face, 2 * order) + _spread(ix) + F.shiftleft(_spread(iy), 1)


def line_spectrum(wavelength: Column, lines: Column, continuum: Column, with_continuum: bool = True, with_lines: bool = True) -> Column:
    """Continuum plus Gaussians: lines is an array of (center_a, fwhm_a, amp_rel), amplitudes relative to the continuum."""
    width = 2 * math.sqrt(2 * math.log(2))
    gauss = lambda l: continuum * l["amp_rel"] * F.exp(-0.5 * F.pow((wavelength - l["center_a"]) / (l["fwhm_a"] / width), 2))
    total = F.aggregate(lines, F.lit(0.0), lambda acc, l: acc + gauss(l)) if with_lines else F.lit(0.0)
    return total + (continuum if with_continuum else F.lit(0.0))


def sky_pa_theta(pa, pointing_pa) -> Column:
    return F.radians(col(pa) - col(pointing_pa) + 150)


def radius_to_pixels(arcsec, pixel_scale, oversample: int) -> Column:
    return col(arcsec) / col(pixel_scale) * oversample


def center_to_corner(center, n, step) -> Column:
    """First pixel's position of an image of n pixels around a centre."""
    return col(center) - (col(n) - 1) / 2 * col(step)


def sim_key(sim) -> Column:
    """'sim_%03d' of a number, 'sim_<name>' of a name."""
    text = col(sim).cast("string")
    return F.when(text.rlike("^[0-9]+$"), F.concat(F.lit("sim_"), F.when(F.length(text) < 3, F.lpad(text, 3, "0")).otherwise(text))).otherwise(F.concat(F.lit("sim_"), text))


def pointing_name(prefix, *ids) -> Column:
    return F.concat(F.lit(prefix + "_"), F.concat_ws(".", *(F.lpad(col(i).cast("string"), 3, "0") for i in ids)))


def pointing_key(tag, seed: int) -> Column:
    """First four bytes of SHA-256, xor the seed: the same whatever else is processed."""
    return F.conv(F.substring(F.sha2(col(tag), 256), 1, 8), 16, 10).cast("long").bitwiseXOR(F.lit(seed).cast("long"))
