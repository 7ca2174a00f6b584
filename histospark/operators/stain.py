"""Stain operators: optical density, basis fit, concentrations, deconvolution, channel separation."""

from __future__ import annotations

from math import sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histospark.operators.hist import otsu
from histospark.operators.pixels import luma
from histospark.operators.quantiles import exact_quantiles

#: White level, reference basis and reference concentrations of the H&E normaliser.
WHITE = 240
REFERENCE = ((0.5626, 0.2159), (0.7201, 0.8012), (0.4062, 0.5581))
REFERENCE_MAX = (1.9705, 1.0308)
#: Stain vectors (red, green, blue) of the brightfield profiles, and their stains' names.
PROFILES = {
    "H&E": {"Hematoxylin": (0.650, 0.704, 0.286), "Eosin": (0.072, 0.990, 0.105)},
    "H-DAB": {"Hematoxylin": (0.650, 0.704, 0.286), "DAB": (0.268, 0.570, 0.776)},
    "HED": {"Hematoxylin": (0.650, 0.704, 0.286), "Eosin": (0.072, 0.990, 0.105), "DAB": (0.268, 0.570, 0.776)},
}


def custom_profile(matrix: list[list[float]]) -> dict[str, tuple[float, float, float]]:
    """A profile of a matrix of three rows (red, green, blue) with a column for each stain; the stains are Stain0, Stain1, ..."""
    if len(matrix) != 3 or len({len(row) for row in matrix}) != 1 or not 2 <= len(matrix[0]) <= 3:
        raise ValueError("a stain matrix has three rows of two or three stains")
    return {f"Stain{k}": tuple(map(float, v)) for k, v in enumerate(zip(*matrix, strict=True))}


def optical_density(value: Column, white: float = WHITE) -> Column:
    return -F.log((value + 1) / white)


def optical_density10(unit: Column) -> Column:
    return -F.log10(F.greatest(unit, F.lit(1e-8)))


def od_covariance(df: DataFrame, keys: list[str]) -> DataFrame:
    """Sample covariances of the optical densities of c0, c1, c2."""
    od = df.select(*keys, *[optical_density(F.col(f"c{k}")).alias(f"o{k}") for k in range(3)])
    return od.groupBy(*keys).agg(*[F.covar_samp(f"o{a}", f"o{b}").alias(f"v{a}{b}") for a in range(3) for b in range(a, 3)])


def tissue_sample(df: DataFrame, keys: list[str], width: int, every: int = 10) -> DataFrame:
    """Pixels darker than the Otsu threshold of their luma, one in ``every`` of the image's places."""
    gray = df.withColumn("gray", luma(F.col("c0"), F.col("c1"), F.col("c2")))
    return gray.join(otsu(gray, keys, "gray"), keys).where(F.col("gray") < F.col("threshold")).where(F.pmod(F.col("y") * width + F.col("x"), F.lit(every)) == 0).drop("gray", "threshold")


def stain_basis(sample: DataFrame, keys: list[str], alpha: float = 1.0) -> DataFrame:
    """keys and the two stain vectors (h0, h1, h2, e0, e1, e2) of each image's sample of tissue pixels.

    The two leading eigenvectors of the density covariance (their component sums made positive) span
    a plane; the ``alpha`` and 100 - alpha percentiles of the angles in it are the stains, the one
    with more red first. The eigenvectors come from one row of six numbers per image.
    """

    def plane(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in pdf.itertuples(index=False):
            m = np.array([[r.v00, r.v01, r.v02], [r.v01, r.v11, r.v12], [r.v02, r.v12, r.v22]], dtype=float)
            vectors = np.linalg.eigh(np.nan_to_num(m))[1][:, [2, 1]]
            vectors = vectors * np.where(vectors.sum(axis=0) < 0, -1, 1)
            out.append(vectors.T.ravel().tolist())
        return pd.concat([pdf[keys].reset_index(drop=True), pd.DataFrame(out, columns=["a0", "a1", "a2", "b0", "b1", "b2"], dtype=float)], axis=1)

    fields = ", ".join(f"{k} {sample.schema[k].dataType.simpleString()}" for k in keys)
    planes = od_covariance(sample, keys).mapInPandas(lambda it: map(plane, it), f"{fields}, a0 double, a1 double, a2 double, b0 double, b1 double, b2 double")
    od = [optical_density(F.col(f"c{k}")) for k in range(3)]
    on = sample.join(planes, keys)
    p, q = (sum(od[k] * F.col(f"{v}{k}") for k in range(3)) for v in "ab")
    angles = on.groupBy(*keys, "a0", "a1", "a2", "b0", "b1", "b2").agg(F.percentile(F.atan2(q, p), F.array(F.lit(alpha / 100), F.lit(1 - alpha / 100))).alias("t"))
    for n, i in (("u", 0), ("w", 1)):
        for k in range(3):
            angles = angles.withColumn(f"{n}{k}", F.cos(F.col("t")[i]) * F.col(f"a{k}") + F.sin(F.col("t")[i]) * F.col(f"b{k}"))
    first = F.col("u0") > F.col("w0")
    return angles.select(*keys, *[F.when(first, F.col(f"u{k}")).otherwise(F.col(f"w{k}")).alias(f"h{k}") for k in range(3)], *[F.when(first, F.col(f"w{k}")).otherwise(F.col(f"u{k}")).alias(f"e{k}") for k in range(3)])


def concentrations(df: DataFrame, basis: DataFrame, keys: list[str]) -> DataFrame:
    """Adds conc0 and conc1: the least-squares fit of each pixel's densities to its image's two vectors, in closed form."""
    on = df.join(basis, keys)
    h, e = ([F.col(f"{v}{k}") for k in range(3)] for v in "he")
    dot = lambda a, b: a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    od = [optical_density(F.col(f"c{k}")) for k in range(3)]
    det = dot(h, h) * dot(e, e) - dot(h, e) * dot(h, e)
    return on.withColumns({"conc0": (dot(e, e) * dot(h, od) - dot(h, e) * dot(e, od)) / det, "conc1": (dot(h, h) * dot(e, od) - dot(h, e) * dot(h, od)) / det}).drop(*[f"{v}{k}" for v in "he" for k in range(3)])


def max_concentrations(df: DataFrame, keys: list[str]) -> DataFrame:
    top = lambda c: exact_quantiles(df, keys, f"conc{c}", [0.99]).select(*keys, F.col("p")[0].alias(f"max{c}"))
    return top(0).join(top(1), keys)


def as_byte(value: Column) -> Column:
    """Truncated to an integer; what exceeds 255 becomes 254."""
    return F.floor(F.when(value > 255, 254).otherwise(value)).cast("long")


def rebuilt(white: float = WHITE) -> list[Column]:
    """The three channels that the reference basis gives for scaled concentrations n0, n1."""
    return [as_byte(white * F.exp(-(REFERENCE[k][0] * F.col("n0") + REFERENCE[k][1] * F.col("n1")))).alias(f"c{k}") for k in range(3)]


def normalised_stain(df: DataFrame, basis: DataFrame, keys: list[str]) -> DataFrame:
    """keys, y, x, c0, c1, c2: concentrations scaled to the reference maxima and rebuilt with the reference basis."""
    c = concentrations(df, basis, keys)
    scaled = c.join(max_concentrations(c, keys), keys).withColumns({f"n{k}": F.col(f"conc{k}") / (F.col(f"max{k}") / REFERENCE_MAX[k]) for k in range(2)})
    return scaled.select(*keys, "y", "x", *rebuilt())


def separated_stains(df: DataFrame, basis: DataFrame, keys: list[str], white: float = WHITE) -> DataFrame:
    """keys, y, x, h, e: gray planes of the two stains, concentrations divided by their 99th percentiles."""
    c = concentrations(df, basis, keys)
    scaled = c.join(max_concentrations(c, keys), keys)
    return scaled.select(*keys, "y", "x", *[as_byte(white * F.exp(-(F.col(f"conc{k}") / F.col(f"max{k}")))).alias(n) for k, n in enumerate("he")])


def deconvolution_matrix(profile: dict[str, tuple[float, float, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Unit stain vectors as columns, with the cross product as third where two are given, and the inverse."""
    m = np.array([*profile.values()], dtype=float).T
    m = m / np.linalg.norm(m, axis=0)
    if m.shape[1] == 2:
        third = np.cross(m[:, 0], m[:, 1])
        size = np.linalg.norm(third)
        if size < 1e-6:
            raise ValueError("the stain vectors lie on one line")
        m = np.column_stack([m, third / size])
    return m, np.linalg.inv(m) if abs(np.linalg.det(m)) > 1e-12 else np.linalg.pinv(m)


def deconvolved(df: DataFrame, keys: list[str], profile: dict[str, tuple[float, float, float]], top: float = 255.0) -> DataFrame:
    """keys, y, x, stain, r, g, b: each stain alone, by projections only; the residual isn't returned."""
    m, inverse = deconvolution_matrix(profile)
    od = [optical_density10((F.col(f"c{k}") / top)) for k in range(3)]
    ln10 = 2.302585092994046
    out = []
    for j, name in enumerate(profile):
        d = sum(od[k] * float(inverse[j, k]) for k in range(3))
        out.append(F.struct(F.lit(name).alias("stain"), *[F.floor(255 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.exp(-d * float(m[c, j]) * ln10))) + 1e-9).cast("long").alias(n) for c, n in enumerate("rgb")]))
    return df.select(*keys, "y", "x", F.explode(F.array(*out)).alias("s")).select(*keys, "y", "x", "s.*")


def separated_channels(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """One image per channel without its background, which is estimated on the smallest level (the largest number) and used for all.

    pixels has keys, level, channel, y, x, value.
    """
    from histospark.operators.hist import background_estimate
    from histospark.operators.pixels import without_background

    top = pixels.groupBy(*keys).agg(F.max("level").alias("level"))
    small = pixels.join(top, [*keys, "level"])
    return without_background(pixels, background_estimate(small, [*keys, "channel"], "value"), [*keys, "channel"])


def unit_length(vector: tuple[float, float, float]) -> list[float]:
    size = sqrt(sum(v * v for v in vector))
    return [v / size for v in vector]
