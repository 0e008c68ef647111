"""Column functions of the engine."""

from .exprs import GeoRef, SectionFrame, clamp, dip_azimuth, fade, gray, hex_colour, hsv, index_capped, index_clipped, index_nearest, lab

__all__ = ["GeoRef", "SectionFrame", "clamp", "dip_azimuth", "fade", "gray", "hex_colour", "hsv", "index_capped", "index_clipped", "index_nearest", "lab"]
