"""Scans: field trees, catalogs, best tracks, station files and metric tables."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veriskill.functions import scalars as S
from veriskill.operators.tracks import keep_last

#: The columns of station files that are read.
STATION_COLUMNS = (
    "DATE", "STATION", "ELEVATION", "LONGITUDE", "LATITUDE", "temperature", "dew_point_temperature", "station_level_pressure", "sea_level_pressure", "wind_direction", "wind_speed", "wind_gust", "relative_humidity",
    "precipitation_3_hour", "precipitation_6_hour", "precipitation_9_hour", "precipitation_12_hour", "precipitation_24_hour",
)
#: Name of daily climate files.
CLIMATE_FILES = r"^era5\.2_metre_temperature\.(\d{8})\.nc$"
#: Columns of raw track tables that reports read.
TRACK_COLUMNS = {
    "Storm_ID": "string", "Storm_Name": "string", "Init_Time": "string", "Valid_Time": "string", "Lead_Time": "int", "Pred_Lat": "double", "Pred_Lon": "double", "True_Lat": "double", "True_Lon": "double",
    "Track_Error_km": "double", "Wind_Error": "double", "MSL_Error": "double", "Status": "string", "Eval_Key": "string",
}


def _fields(line: Column, sep: str) -> Column:
    """The fields of a line, any number; in lines with a quote, quoted fields may hold separators and doubled quotes."""
    one = re.escape(sep)
    quoted = F.regexp_extract_all(F.concat(line, F.lit(sep)), F.lit(rf'((?:\s*+"[^"]*+(?:""[^"]*+)*+"\s*+|[^{one}]*+)){one}'), F.lit(1))
    bare = F.transform(quoted, lambda x: F.when(F.trim(x).startswith('"'), F.replace(F.regexp_replace(F.trim(x), '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(x))
    return F.when(F.contains(line, F.lit('"')), bare).otherwise(F.split(line, one, -1))


def named_rows(spark: SparkSession, path: str, wanted: Sequence[str], sep: str = ",") -> DataFrame:
    """Lines of text tables: the columns of partition folders, the ``wanted`` columns as strings, and ``line`` (their order).

    Files may have any number of columns, in any order, as each file's header tells where the wanted ones are; one that
    it lacks is null, of a repeated name the first counts. A folder's column stands for a wanted one of its name. A line
    is split once and only wanted fields are kept. Blank lines and lines that equal the header are none. Fields are
    trimmed, empty ones are null. Headers are found by a scan of their own, without splitting lines.
    """
    text = spark.read.text(path)
    folders = [c for c in text.columns if c != "value"]
    names = [c for c in dict.fromkeys(wanted) if c not in folders]
    lines = text.select(*folders, "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("line"))
    heads = lines.where("_block = 0").groupBy("_file").agg(F.min_by("value", "line").alias("_head"))
    clean = F.transform(_fields(F.replace(F.col("_head"), F.lit("\ufeff"), F.lit("")), sep), lambda x: F.trim(x))
    heads = heads.select("_file", "_head", clean.alias("_names")).select("_file", "_head", F.array(*(F.array_position("_names", F.lit(n)).cast("int") for n in names)).alias("_at"))
    rows = lines.join(heads, "_file").where((F.col("value") != F.col("_head")) & (F.trim("value") != ""))
    # the line is split once, as the variable of a function of its fields
    pick = lambda f: F.array(*(F.when(F.col("_at")[k] > 0, F.nullif(F.trim(F.get(f, F.col("_at")[k] - 1)), F.lit(""))) for k in range(len(names))))
    rows = rows.select(*folders, "line", F.transform(F.array(_fields(F.col("value"), sep)), pick)[0].alias("_row"))
    return rows.select(*folders, *(F.col("_row")[k].alias(n) for k, n in enumerate(names)), "line")


def npy_fields(spark: SparkSession, path: str, dataset: str, flip: bool = False) -> DataFrame:
    """[S1, S4] One row for each latitude row of a tree of ``.npy`` files ``.../<YYYY>/<YYYY-MM-DD>/<HH:MM:SS>-<variable>[-<level>].npy``.

    Times may be written with ``-`` too. A local folder is read without checksum files, whose names cannot hold a colon. Anything but two dimensions fails on reading. NaN becomes null.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").option("recursiveFileLookup", "true").option("fs.file.impl", "org.apache.hadoop.fs.RawLocalFileSystem").option("fs.file.impl.disable.cache", "true").load(path)
    name = F.regexp_extract("path", r"([^/]+)\.npy$", 1)
    files = files.select(
        F.try_to_timestamp(F.concat_ws(" ", F.regexp_extract("path", r"(\d{4}-\d{2}-\d{2})/[^/]+$", 1), F.replace(F.substring(name, 1, 8), F.lit("-"), F.lit(":")))).alias("valid_time"),
        F.regexp_extract(name, r"^\d{2}[-:]\d{2}[-:]\d{2}-([A-Za-z0-9_]+?)(?:-[0-9.]+)?$", 1).alias("variable"), F.regexp_extract(name, r"-[A-Za-z][A-Za-z0-9_]*-([0-9]+)(?:\.0)?$", 1).try_cast("int").alias("level_hpa"), "content")
    schema = "valid_time timestamp, variable string, level_hpa int, lat_i int, vals array<float>"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                field = np.load(io.BytesIO(batch.column("content")[k].as_py()), allow_pickle=False)
                if field.ndim != 2:
                    raise ValueError(f"a field has {field.ndim} dimensions")
                field = field[::-1] if flip else field
                n, width = field.shape
                flat = pa.array(field.astype(np.float32).ravel(), mask=np.isnan(field.ravel()))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), flat)
                same = lambda c: pa.array([batch.column(c)[k].as_py()] * n, batch.column(c).type)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([same("valid_time"), same("variable"), same("level_hpa"), pa.array(np.arange(n), pa.int32()), lists], ["valid_time", "variable", "level_hpa", "lat_i", "vals"])

    return files.mapInArrow(rows, schema).withColumn("dataset", F.lit(dataset))


def snapshot(fields: DataFrame, channels: DataFrame) -> DataFrame:
    """[S2, S3] Fields of the listed channels (``variable, level_hpa, ord``), with their order."""
    same = (fields["variable"] == channels["variable"]) & fields["level_hpa"].eqNullSafe(channels["level_hpa"])
    return fields.join(F.broadcast(channels), same).select(fields["*"], channels["ord"])  # some seventy channels


def forecast_catalog(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """[S10] ``path, model, init_time, lead_hours, member`` of files ``<model>/<YYYYMMDDHH>/<YYYY-MMDD>-<LL>[_member].<ext>``; other names give no row."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "length")
    shape = r"([^/]+)/(\d{10})/\d{4}-\d{4}-(\d+)(?:_(\d+))?\.[^./]+$"
    part = lambda k: F.regexp_extract("path", shape, k)
    out = files.select("path", "length", part(1).alias("model"), F.try_to_timestamp(part(2), F.lit("yyyyMMddHH")).alias("init_time"), part(3).try_cast("int").alias("lead_hours"), part(4).try_cast("int").alias("member"))
    return out.where(F.col("lead_hours").isNotNull() & F.col("init_time").isNotNull())


def first_inits(catalog: DataFrame, by: Sequence[str], init: str, most: int) -> DataFrame:
    """[S11, T4] Rows of the first initialisations of each group."""
    w = Window.partitionBy(*by).orderBy(init)
    return catalog.withColumn("_r", F.dense_rank().over(w)).where(F.col("_r") <= most).drop("_r")


def best_tracks(spark: SparkSession, path: str) -> DataFrame:
    """[S15] Best-track CSV (a line of units below the header is dropped): coerced columns, longitude in [0, 360), synoptic times only, the last row of repeated (SID, time)."""
    raw = spark.read.csv(path, header=True)
    number = lambda c: S.clean(F.trim(c).try_cast("double"))
    rows = raw.select(
        F.trim("SID").alias("sid"), F.trim("NAME").alias("name"), F.coalesce(F.nullif(F.trim("BASIN"), F.lit("")), F.lit("UNKNOWN")).alias("basin"), F.trim("SUBBASIN").alias("subbasin"), F.trim("SEASON").try_cast("int").alias("season"),
        F.try_to_timestamp(F.trim("ISO_TIME")).alias("iso_time"), number("LAT").alias("lat"), S.lon_360(number("LON")).alias("lon"), number("WMO_PRES").alias("wmo_pres"), number("WMO_WIND").alias("wmo_wind"), F.monotonically_increasing_id().alias("_line"))
    synoptic = F.hour("iso_time").isin(0, 6, 12, 18) & (F.minute("iso_time") == 0) & (F.second("iso_time") == 0)
    return keep_last(rows.where(synoptic), ["sid", "iso_time"], ["_line"]).drop("_line")


def storm_lookup(tracks: DataFrame, season: int, name: str, start: str, end: str, step_hours: int | None = None) -> DataFrame:
    """[S16] Points of the season's storms whose name contains ``name``, in a time range, optionally every ``step_hours`` from its start."""
    found = tracks.where((F.col("season") == season) & F.contains(F.lower("name"), F.lit(name.lower())) & F.col("iso_time").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")) & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    if step_hours:
        found = found.where(F.pmod(F.unix_timestamp("iso_time") - F.unix_timestamp(F.lit(start).cast("timestamp")), F.lit(step_hours * 3600)) == 0)
    return found


def station_files(spark: SparkSession, path: str) -> DataFrame:
    """[S17, P24] Pipe-separated station files: used columns by name, null where a file lacks one, numbers coerced, sentinels null."""
    raw = named_rows(spark, path, STATION_COLUMNS, "|")
    number = lambda c: S.clean(F.col(c).try_cast("double"))
    rows = raw.select(*((F.try_to_timestamp("DATE").alias("time") if c == "DATE" else F.col(c).alias("station") if c == "STATION" else number(c).alias(c.lower())) for c in STATION_COLUMNS))
    return rows.withColumn("wind_direction", S.without(F.col("wind_direction"), 999.0))


def station_catalog(spark: SparkSession, path: str) -> DataFrame:
    """[S19] ``station, lat, lon`` of a JSON object of ids."""
    text = spark.read.text(path, wholetext=True)
    entries = F.from_json("value", "map<string, struct<latitude: double, longitude: double>>")
    return text.select(F.explode(entries).alias("station", "p")).select("station", F.col("p.latitude").alias("lat"), F.col("p.longitude").alias("lon"))


def metric_tables(spark: SparkSession, path: str, keys: Sequence[str] = ("init_time", "lead_hours", "variable"), columns: Sequence[str] = ("valid_time", "wrmse", "bias", "mae", "activity", "acc")) -> DataFrame:
    """[S23] Metric CSVs by the names in each file's header, with missing columns null and only the last row of each key. Other columns of partition folders are part of the key."""
    raw = named_rows(spark, path, [*keys, *columns])
    text = lambda c: F.col(c).cast("string")
    typed = lambda c: text(c) if c in ("init_time", "valid_time", "variable") else text(c).try_cast("int") if c == "lead_hours" else S.clean(text(c).try_cast("double"))
    folders = [c for c in raw.columns if c not in (*keys, *columns, "line")]
    out = raw.select(*folders, *(typed(c).alias(c) for c in (*keys, *columns)), "line")
    return keep_last(out, [*folders, *keys], ["line"]).drop("line")


def at_level(fields: DataFrame, hpa: float, level: str = "level_hpa") -> DataFrame:
    """[S12] Fields on a pressure level, matched with a tolerance of 1e-5 of it."""
    return fields.where(F.abs(F.col(level) - hpa) <= 1e-8 + 1e-5 * abs(hpa))


def levels_present(fields: DataFrame, by: Sequence[str], hpa: float, level: str = "level_hpa") -> DataFrame:
    """[S12] Whether each group has the pressure level."""
    near = F.abs(F.col(level) - hpa) <= 1e-8 + 1e-5 * abs(hpa)
    return fields.groupBy(*by).agg(F.coalesce(F.bool_or(near), F.lit(False)).alias("has_level"))


def variables_of(fields: DataFrame, by: Sequence[str]) -> DataFrame:
    """[S13] Channels (``variable_level``, or the variable alone) that each group has."""
    return fields.select(*by, F.concat_ws("_", "variable", "level_hpa").alias("channel")).distinct()


def track_tables(spark: SparkSession, path: str) -> DataFrame:
    """[S24, P29] Raw track CSVs under ``source=.../model=...``: numbers coerced, rows that are not ok or lack an error dropped."""
    raw = named_rows(spark, path, list(TRACK_COLUMNS))
    folders = [c for c in raw.columns if c not in TRACK_COLUMNS and c != "line"]
    rows = raw.where(F.lower(F.coalesce("Status", F.lit("ok"))) == "ok")
    typed = lambda c, kind: S.clean(F.col(c).cast("string").try_cast(kind)) if kind == "double" else F.col(c).cast("string").try_cast(kind)
    rows = rows.select(*folders, *(typed(c, kind).alias(c) for c, kind in TRACK_COLUMNS.items()))
    return rows.na.drop(subset=["Lead_Time", "Track_Error_km"])


def dated_files(spark: SparkSession, path: str, start: str, end: str, pattern: str = CLIMATE_FILES) -> DataFrame:
    """[S20] ``path, day`` of files whose name matches the pattern (one group of eight digits), in an inclusive range of days."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    day = F.to_date(F.nullif(F.regexp_extract(F.regexp_extract("path", r"([^/]+)$", 1), pattern, 1), F.lit("")), "yyyyMMdd")
    return files.select("path", day.alias("day")).where(F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def concat_dated(spark: SparkSession, path: str, start: str, end: str, pattern: str = r"(\d{4}-?\d{2}-?\d{2})[^/]*$", fmt: str = "parquet") -> DataFrame:
    """[S20, S21] Rows of all dated files of an inclusive range of days, with ``day``, which the first group of ``pattern`` finds in a file's path.

    Files of other days are not read: the range is a filter on the file's own path, which prunes files before the scan.
    """
    name = F.regexp_extract(F.col("_metadata.file_path"), pattern, 1)
    rows = spark.read.format(fmt).option("recursiveFileLookup", "true").load(path)
    day = F.to_date(F.nullif(F.replace(name, F.lit("-"), F.lit("")), F.lit("")), "yyyyMMdd")
    return rows.select("*", day.alias("day")).where(F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def observations_at(obs: DataFrame, forecasts: DataFrame, keys: Sequence[str] = ("station", "variable"), time: str = "valid_time") -> DataFrame:
    """[S18] Station forecasts with the observation of their valid time; the date leads both keys, so that partitions by date are pruned."""
    dated = lambda df: df.withColumn("date", F.col(time).cast("date"))
    return dated(forecasts).join(dated(obs), ["date", *keys, time]).drop("date")
