"""Products of a full-waveform lidar footprint mission: their columns and coordinates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# The beam groups, and the pattern of their names.
BEAMS = ("BEAM0000", "BEAM0001", "BEAM0010", "BEAM0011", "BEAM0101", "BEAM0110", "BEAM1000", "BEAM1011")
BEAM_PATTERN = r"BEAM\d{4}$"
#: Value that stands for a missing measurement in the files; it is replaced on request only.
SENTINEL = -9999.0
SRID = 4326

N_RH, N_BINS, BIN_METRES = 101, 30, 5


@dataclass(frozen=True)
class Product:
    """points: pairs (x, y) that must all lie in a bounding box; the first one is tested against polygons."""

    name: str
    points: tuple[tuple[str, str], ...]


WAVEFORM_GEO = Product("waveform_geolocation", (("longitude_bin0", "latitude_bin0"), ("longitude_lastbin", "latitude_lastbin")))
HEIGHTS = Product("height_metrics", (("lon_lowestmode", "lat_lowestmode"),))
CANOPY = Product("canopy_metrics", (("longitude_bin0", "latitude_bin0"), ("longitude_lastbin", "latitude_lastbin")))
PAI = Product("pai_profile", (("lon_lowestmode", "lat_lowestmode"),))
PAVD = Product("pavd_profile", (("lon_lowestmode", "lat_lowestmode"),))
#: Variants of the height product by algorithm: lowest and highest return in the box, lowest in the polygon.
HEIGHT_VARIANTS = Product("height_variants", (("lon_lowest", "lat_lowest"), ("lon_highest", "lat_highest")))
PRODUCTS = {p.name: p for p in (WAVEFORM_GEO, HEIGHTS, CANOPY, PAI, PAVD, HEIGHT_VARIANTS)}

# Column orders of the extracts.
GEO_COLUMNS = ("latitude_bin0", "latitude_lastbin", "longitude_bin0", "longitude_lastbin")
GEO_DEFAULT = ("elevation_bin0", "elevation_lastbin")
HEIGHT_COLUMNS = ("beam", "shot_number", "degrade_flag", "quality_flag", "delta_time", "sensitivity", "solar_elevation", "lat_lowestmode", "lon_lowestmode", "elev_highestreturn", "elev_lowestmode")
PROFILE_COLUMNS = ("beam", "shot_number", "algorithmrun_flag", "l2b_quality_flag", "delta_time", "lat_lowestmode", "lon_lowestmode", "elev_highestreturn", "elev_lowestmode", "height_lastbin", "height_bin0")
CANOPY_DEFAULT = (
    "beam", "shot_number", "algorithmrun_flag", "l2b_quality_flag", "delta_time", "sensitivity", "solar_elevation", "latitude_lastbin", "latitude_bin0", "longitude_bin0",
    "longitude_lastbin", "elev_highestreturn", "elev_lowestmode", "rh100", "pai", "fhd_normal", "omega", "pgap_theta", "cover",
)
# Logical canopy columns by the group of the file that holds them.
CANOPY_ROOT = (
    "algorithmrun_flag", "ancillary", "beam", "channel", "cover", "delta_time", "fhd_normal", "l2a_quality_flag", "l2b_quality_flag", "land_cover_data", "master_frac", "master_int",
    "num_detectedmodes", "omega", "pai", "pgap_theta", "pgap_theta_error", "rg", "rh100", "rhog", "rhog_error", "rhov", "rhov_error", "rossg", "rv", "selected_l2a_algorithm",
    "selected_rg_algorithm", "sensitivity", "shot_number", "stale_return_flag", "surface_flag",
)
CANOPY_GEOLOCATION = (
    "degrade_flag", "digital_elevation_model", "elev_highestreturn", "elev_lowestmode", "elevation_bin0", "elevation_bin0_error", "elevation_lastbin", "elevation_lastbin_error",
    "height_bin0", "height_lastbin", "lat_highestreturn", "lat_lowestmode", "latitude_bin0", "latitude_bin0_error", "latitude_lastbin", "latitude_lastbin_error", "local_beam_azimuth",
    "local_beam_elevation", "lon_highestreturn", "lon_lowestmode", "longitude_bin0", "longitude_bin0_error", "longitude_lastbin", "longitude_lastbin_error", "solar_azimuth", "solar_elevation",
)
CANOPY_LAND_COVER = ("landsat_treecover", "modis_nonvegetated", "modis_nonvegetated_sd", "modis_treecover", "modis_treecover_sd")
CANOPY_MAP = {c: c for c in CANOPY_ROOT} | {c: f"geolocation.{c}" for c in CANOPY_GEOLOCATION} | {c: f"land_cover_data.{c}" for c in CANOPY_LAND_COVER}


def profile_names(prefix: str) -> list[str]:
    """Names of the vertical bins, such as pai_z0_5m."""
    return [f"{prefix}_z{k * BIN_METRES}_{(k + 1) * BIN_METRES}m" for k in range(N_BINS)]


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


_D, _F, _I, _S, _L = T.DoubleType(), T.FloatType(), T.IntegerType(), T.ShortType(), T.LongType()
WAVEFORM_SCHEMA = _schema(("beam", T.StringType()), ("shot_number", _L), *((c, _D) for c in (*GEO_COLUMNS, *GEO_DEFAULT)), ("delta_time", _D), ("rx_sample_count", _I), ("tx_sample_count", _I), ("rxwaveform", T.ArrayType(_F)), ("txwaveform", T.ArrayType(_F)))
HEIGHT_SCHEMA = _schema(("beam", T.StringType()), ("shot_number", _L), ("degrade_flag", _S), ("quality_flag", _S), ("delta_time", _D), ("sensitivity", _F), ("solar_elevation", _F), ("lat_lowestmode", _D), ("lon_lowestmode", _D), ("elev_highestreturn", _F), ("elev_lowestmode", _F), ("rh", T.ArrayType(_F)), ("lat_highestreturn", _D), ("lon_highestreturn", _D))
PROFILE_SCHEMA = _schema(("beam", T.StringType()), ("shot_number", _L), ("algorithmrun_flag", _S), ("l2b_quality_flag", _S), ("delta_time", _D), ("lat_lowestmode", _D), ("lon_lowestmode", _D), ("elev_highestreturn", _F), ("elev_lowestmode", _F), ("height_lastbin", _F), ("height_bin0", _F), ("pai_z", T.ArrayType(_F)), ("pavd_z", T.ArrayType(_F)))
CANOPY_SCHEMA = _schema(("beam", T.StringType()), ("shot_number", _L), ("algorithmrun_flag", _S), ("l2b_quality_flag", _S), ("delta_time", _D), ("sensitivity", _F), ("solar_elevation", _F), *((c, _D) for c in GEO_COLUMNS), ("elev_highestreturn", _F), ("elev_lowestmode", _F), *((c, _F) for c in ("rh100", "pai", "fhd_normal", "omega", "pgap_theta", "cover")))
SCHEMAS = {"waveform": WAVEFORM_SCHEMA, "heights": HEIGHT_SCHEMA, "canopy": CANOPY_SCHEMA, "profiles": PROFILE_SCHEMA}
#: Columns that a product table must have; all others are as the table has them.
MANDATORY = {"waveform": ("beam", "shot_number", *GEO_COLUMNS), "heights": ("beam", "shot_number", "lat_lowestmode", "lon_lowestmode"), "canopy": ("beam", "shot_number"), "profiles": ("beam", "shot_number", "lat_lowestmode", "lon_lowestmode")}
