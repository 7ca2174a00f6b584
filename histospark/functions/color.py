"""Column functions for colours, units and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Colours of channels without a known dye, in order.
PALETTE = ((255, 0, 0), (0, 255, 0), (0, 0, 255), (255, 0, 255), (0, 255, 255), (255, 255, 0), (255, 128, 0), (153, 0, 255), (0, 179, 77), (255, 153, 153))
#: Parts of dye names, in the order in which they are tried, and their colours.
DYE_COLOURS = (
    ("dapi|hoechst", (0, 0, 255)),
    ("fitc|gfp|alexa 488|af488|cy2", (0, 255, 0)),
    ("tritc|cy3|alexa 555|alexa 568|af555|af568|texas red|tdtomato|mcherry", (255, 0, 0)),
    ("cy5|alexa 647|af647|far red|far-red", (255, 0, 255)),
)
MICRON = "µm"


def rgb(colour: tuple[int, int, int]) -> Column:
    return F.array(*map(F.lit, colour))


def palette_rgb(index: Column) -> Column:
    return F.element_at(F.array(*map(rgb, PALETTE)), (F.pmod(index, F.lit(len(PALETTE))) + 1).cast("int"))


def dye_rgb(name: Column, fallback: Column) -> Column:
    out = None
    for pattern, colour in DYE_COLOURS:
        hit = F.lower(name).rlike(pattern)
        out = F.when(hit, rgb(colour)) if out is None else out.when(hit, rgb(colour))
    return out.otherwise(fallback)


def packed_rgba(colour: Column, alpha: int = 255) -> Column:
    """0xRRGGBBAA as a signed 32-bit integer."""
    clip = lambda c: F.greatest(F.lit(0), F.least(F.lit(255), c)).cast("long")
    v = clip(colour[0]) * (1 << 24) + clip(colour[1]) * (1 << 16) + clip(colour[2]) * (1 << 8) + alpha
    return F.when(v >= 1 << 31, v - (1 << 32)).otherwise(v).cast("int")


def length_unit(unit: Column) -> Column:
    """Spellings of the micrometre become one; the empty unit is null."""
    u = F.trim(unit)
    return F.when(u == "", None).when(F.lower(u).isin("um", "micron", "microns", "micrometer", "micrometre", "µm", "μm"), MICRON).otherwise(u)


#: Units of length in a metre.
PER_METRE = {MICRON: 1e6, "nm": 1e9, "mm": 1e3, "cm": 1e2, "m": 1.0}


def in_unit(metres: Column, unit: Column) -> Column:
    """A length in metres in a unit (spellings of the micrometre are one; a null or empty unit is the micrometre); null for unknown units."""
    known = F.create_map(*[F.lit(x) for pair in PER_METRE.items() for x in pair])
    return metres * F.try_element_at(known, F.coalesce(length_unit(unit), F.lit(MICRON)))


def slug(name: Column) -> Column:
    """Characters other than letters, digits, '-', '.' and '_' become '_'."""
    return F.regexp_replace(name, r"[^\p{L}\p{N}\-._]", "_")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(name: Column) -> Column:
    return F.regexp_extract(name, r"(\.[^.]+)$", 1)


def stem(name: Column) -> Column:
    """The name without any of its suffixes."""
    return F.regexp_replace(name, r"(\.[^.]+)+$", "")


def gray_code(zone: Column) -> Column:
    """Zones as gray values: portal 85, middle 170, central 255, background 0."""
    return F.when(zone == "PP", 85).when(zone == "MID", 170).when(zone == "PV", 255).otherwise(0)


def blended(gray: Column, colour: Column, alpha: float) -> Column:
    """A colour laid over a gray value, as three truncated bytes."""
    return F.transform(colour, lambda c: F.floor(gray * (1 - alpha) + c * alpha).cast("long"))
