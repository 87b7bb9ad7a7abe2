"""Canonical schemas, and adapters from the external spellings of the columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_D, _S, _L = T.DoubleType(), T.StringType(), T.LongType()
_DOUBLES = T.ArrayType(T.DoubleType())

PEAKS = T.StructType(
    [T.StructField(c, _D) for c in ("mh", "mh_min", "mh_max", "rt", "rt_min", "rt_max", "area", "height", "sn")]
    + [T.StructField("sample", _S)]
    + [T.StructField(c, _DOUBLES) for c in ("iso_mass", "iso_mass_link", "iso_mz", "iso_rt", "iso_height")]
    + [T.StructField("adduct", _S), T.StructField("intensity", _D)]
)

#: The sixteen external columns of a full peak list, in order.
EXTERNAL_PEAKS = [
    "M+H", "M+H.min", "M+H.max", "rt", "rtmin", "rtmax", "Area", "Height", "SN", "sample", "iso.mass", "iso.mass.link",
    "mz_PeaksIsotopics_Group", "rt_PeaksIsotopics_Group", "Height_PeaksIsotopics_Group", "Adduct",
]
REQUIRED = ["M+H", "rt", "Area", "Height", "sample"]
NUMERIC = ["M+H", "rt", "Area", "Height"]

#: External spelling -> canonical name.
SPELLINGS = {
    "M+H": "mh", "M.H": "mh", "mz": "mh", "mzmed": "mh", "M+H.min": "mh_min", "M.H.min": "mh_min", "M+H.max": "mh_max",
    "M.H.max": "mh_max", "CE-time": "rt", "CE.time": "rt", "rt": "rt", "rtmed": "rt", "CE-time.min": "rt_min", "rtmin": "rt_min",
    "CE-time.max": "rt_max", "rtmax": "rt_max", "Area": "area", "integrated-intensity": "area", "into": "area", "Height": "height",
    "maxo": "intensity", "intensity": "intensity", "Intensity": "intensity", "SN": "sn", "sn": "sn", "sample": "sample",
    "iso.mass": "iso_mass", "iso.mass.link": "iso_mass_link", "mz_PeaksIsotopics_Group": "iso_mz",
    "rt_PeaksIsotopics_Group": "iso_rt", "Height_PeaksIsotopics_Group": "iso_height", "Adduct": "adduct", "ID": "id",
}

PROJECTS = T.StructType(
    [T.StructField("project_id", _L)]
    + [T.StructField(c, _S) for c in ("project_name", "data_directory", "created_at", "last_modified", "status")]
    + [T.StructField("total_files", _L)]
    + [T.StructField(c, _S) for c in ("processing_stage", "cache_directory", "cache_id")]
)
CHECKPOINTS = T.StructType(
    [T.StructField("checkpoint_id", _L), T.StructField("project_id", _L)]
    + [T.StructField(c, _S) for c in ("step_id", "step_name", "checkpoint_file_path", "created_at")]
    + [T.StructField("file_size_mb", _D), T.StructField("checksum_md5", _S), T.StructField("is_valid", T.BooleanType())]
    + [T.StructField("variables_stored", T.ArrayType(_S)), T.StructField("next_step", _S), T.StructField("execution_time_seconds", _D)]
)
LOGS = T.StructType(
    [T.StructField("log_id", _L), T.StructField("project_id", _L)]
    + [T.StructField(c, _S) for c in ("timestamp", "step_name", "log_level", "message")]
    + [T.StructField("execution_time_seconds", _D), T.StructField("error_details", _S)]
)


def col(name: str) -> Column:
    """A column whose name may hold dots or plus signs."""
    return F.col(f"`{name}`")


def number_list(text: Column) -> Column:
    """A comma list of numbers as an ascending array without repeats; what is no number goes."""
    items = F.filter(F.transform(F.split(text, ","), lambda s: F.trim(s).try_cast("double")), lambda x: x.isNotNull())
    return F.array_sort(F.array_distinct(items))


def to_canonical(df: DataFrame) -> DataFrame:
    """Rename known spellings and parse comma lists; unknown columns keep their names. The first of two spellings wins."""
    seen: set[str] = set()
    out = []
    for name, kind in df.dtypes:
        target = SPELLINGS.get(name, name)
        if target in seen:
            continue
        seen.add(target)
        c = number_list(col(name)) if target.startswith("iso_") and kind == "string" else col(name)
        out.append(c.alias(target))
    return df.select(*out)
