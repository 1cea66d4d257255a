"""Radio propagation and terrain formulas, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SENTINEL_PATH_LOSS = 299.0
UNSET_PATH_LOSS, UNSET_RSSI, SENTINEL_RSSI = 300.0, -200.0, -110.0

lg = F.log10


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), x))


def km(distance_m: Column) -> Column:
    return F.greatest(distance_m / 1000.0, F.lit(0.001))


def free_space(distance_m: Column, f_mhz: Column) -> Column:
    return 20 * lg(km(distance_m)) + 20 * lg(f_mhz) + 32.44


def _hata(d_km: Column, f: Column, h_tx: Column, a_h: Column) -> Column:
    return 69.55 + 26.16 * lg(f) - 13.82 * lg(h_tx) - a_h + (44.9 - 6.55 * lg(h_tx)) * lg(d_km)


def _suburban(f: Column) -> Column:
    return -2 * F.pow(lg(f / 28.0), 2) - 5.4


def _rural(f: Column) -> Column:
    return -4.78 * F.pow(lg(f), 2) + 18.33 * lg(f) - 40.94


def hata_large_city(distance_m: Column, f: Column, h_tx: Column, h_rx: Column, environment: str = "urban") -> Column:
    """Okumura-Hata with the large city's antenna correction, whose form changes at 300 MHz."""
    a_h = F.when(f <= 300, 8.29 * F.pow(lg(1.54 * h_rx), 2) - 1.1).otherwise(3.2 * F.pow(lg(11.75 * h_rx), 2) - 4.97)
    base = _hata(km(distance_m), f, h_tx, a_h)
    return {"urban": base, "suburban": base + _suburban(f), "rural": base + _rural(f)}[environment]


def small_city_correction(f: Column, h_rx: Column) -> Column:
    return (1.1 * lg(f) - 0.7) * h_rx - (1.56 * lg(f) - 0.8)


def cost231(distance_m: Column, f: Column, h_tx: Column, h_rx: Column, urban: bool = True) -> Column:
    return 46.3 + 33.9 * lg(f) - 13.82 * lg(h_tx) - small_city_correction(f, h_rx) + (44.9 - 6.55 * lg(h_tx)) * lg(km(distance_m)) + (3.0 if urban else 0.0)


def log_distance(distance_m: Column, f: Column, exponent: float = 3.5, d0: float = 1.0, shadowing: float = 0.0) -> Column:
    d = F.greatest(distance_m, F.lit(d0))
    return free_space(F.lit(d0), f) + 10 * exponent * lg(d / d0) + shadowing


#: Name to path loss of (distance in metres, MHz), with the usual heights.
MODELS = {
    "fspl": free_space,
    "okumura_hata_urban": lambda d, f: hata_large_city(d, f, F.lit(30.0), F.lit(1.5)),
    "okumura_hata_suburban": lambda d, f: hata_large_city(d, f, F.lit(30.0), F.lit(1.5), "suburban"),
    "okumura_hata_rural": lambda d, f: hata_large_city(d, f, F.lit(30.0), F.lit(1.5), "rural"),
    "cost231_urban": lambda d, f: cost231(d, f, F.lit(30.0), F.lit(1.5)),
    "cost231_suburban": lambda d, f: cost231(d, f, F.lit(30.0), F.lit(1.5), urban=False),
    "log_distance": log_distance,
}


def hata_small_city(distance_m: Column, f: Column, h_tx: Column, h_rx: Column, environment: str = "suburban") -> Column:
    """Okumura-Hata with the small city's correction and the frequency held within 150 and 2000 MHz."""
    f = clip(f, 150, 2000)
    base = _hata(km(distance_m), f, h_tx, small_city_correction(f, h_rx))
    return {"urban": base, "suburban": base + _suburban(f), "rural": base + _rural(f)}[environment]


def cost231_clipped(distance_m: Column, f: Column, h_tx: Column, h_rx: Column, urban: bool = False) -> Column:
    return cost231(distance_m, clip(f, 1500, 2000), h_tx, h_rx, urban)


def terrain_attenuation(slope: Column) -> Column:
    """Kinked at slope 0.1, held within 0 and 30 dB."""
    return clip(slope * 20 + F.when(slope > 0.1, (slope - 0.1) * 30).otherwise(0.0), 0, 30)


def vegetation_attenuation(distance_m: Column, f: Column, ndvi: Column) -> Column:
    depth = distance_m * clip((ndvi + 1) / 2, 0, 1) * 0.3
    return clip(0.25 * F.pow(f, F.lit(0.39)) * F.pow(F.least(depth, F.lit(400.0)), F.lit(0.25)), 0, 40)


def combined_loss(distance_m: Column, f: Column, h_tx: Column, h_rx: Column, ndvi: Column, slope: Column) -> Column:
    base = F.when(f <= 1500, hata_small_city(distance_m, f, h_tx, h_rx)).otherwise(cost231_clipped(distance_m, f, h_tx, h_rx))
    return base + vegetation_attenuation(distance_m, f, ndvi) + terrain_attenuation(slope)


def coverage_class(rssi: Column) -> Column:
    return F.when(rssi >= -70, 5).when(rssi >= -85, 4).when(rssi >= -100, 3).when(rssi >= -110, 2).otherwise(1)


def environment_of(f: Column) -> Column:
    return F.when(f > 1800, "urban").when(f > 800, "suburban").otherwise("rural")


def watts_to_dbm(watts: Column) -> Column:
    """Powers below 1 mW, zero and null are taken as 30 dBm."""
    dbm = 10 * lg(F.nullif(watts * 1000, F.lit(0.0)))
    return F.when(dbm >= 0, dbm).otherwise(30.0)


def positive_height(metres: Column) -> Column:
    return F.when(metres > 0, metres).otherwise(30.0)


def knife_edge(v: Column) -> Column:
    """Loss of a knife edge by Fresnel parameter, in five branches, never negative."""
    loss = lambda amplitude: -20 * lg(F.greatest(amplitude, F.lit(1e-9)))
    middle = 0.4 - F.sqrt(F.greatest(0.1184 - F.pow(0.38 - 0.1 * v, 2), F.lit(1e-9)))
    branches = F.when(v < -0.7, 0.0).when(v <= 0, loss(0.5 - 0.62 * v)).when(v <= 1, loss(0.5 * F.exp(-0.95 * v))).when(v <= 2.4, loss(middle)).otherwise(loss(0.225 / F.greatest(v, F.lit(1e-6))))
    return F.greatest(branches, F.lit(0.0))


def shadow_margin(ndvi: Column, distance_m: Column, f_mhz: float, threshold: float = 0.5) -> Column:
    return clip(distance_m * clip(ndvi - threshold, 0, 1) * 0.2 * clip(ndvi, 0, 1) * (f_mhz / 1000 / 1.8) ** 0.4, 0, 40)


def diffraction(tri_m: Column, roughness: Column, distance_m: Column, f_mhz: float) -> Column:
    wave = 3e8 / (f_mhz * 1e6)
    height = clip(F.greatest(tri_m, F.lit(0.0)) * 0.5 + roughness * 0.5, 0, 80)
    half = F.greatest(distance_m / 2, F.lit(1.0))
    return clip(knife_edge(height * F.sqrt(2 * (half + half) / (wave * half * half + 1e-9))), 0, 40)


def normalised_difference(a: Column, b: Column) -> Column:
    return clip((a - b) / (a + b + 1e-6), -1, 1)


def bare_soil_index(b02: Column, b03: Column, b04: Column, b08: Column) -> Column:
    return clip(((b04 + b02) - (b08 + b03)) / ((b04 + b02) + (b08 + b03) + 1e-6), -1, 1)


def shadow_index(b02: Column, b03: Column, b04: Column) -> Column:
    return clip(1 - F.sqrt((b02 * b02 + b03 * b03 + b04 * b04) / 3), 0, 1)


def flow_proxy(curvature: Column) -> Column:
    return F.log1p(F.abs(curvature) * 100 + 1)
