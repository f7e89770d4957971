"""Readers and writers (SRC-01 to SRC-05, SNK-01 to SNK-05)."""

from __future__ import annotations

import json
import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.operators.schema import require

_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType()}


def _schema(fields: str) -> T.StructType:
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (f.split() for f in fields.split(","))])


#: Columns of the flight table, in file order.
FLIGHTS = _schema(
    "FL_DATE string, OP_CARRIER_AIRLINE_ID int, OP_CARRIER_FL_NUM int, ORIGIN_AIRPORT_ID int, DEST_AIRPORT_ID int, CRS_DEP_TIME int, ARR_DELAY_NEW double, "
    "CANCELLED double, DIVERTED double, CRS_ELAPSED_TIME double, WEATHER_DELAY double, NAS_DELAY double, UNUSED_COL string"
)

#: Value columns of an observation; each but the station type has a text flag after it.
OBSERVED = {
    "StationType": "int", "SkyCondition": "string", "Visibility": "string", "WeatherType": "string", "DryBulbFarenheit": "double", "DryBulbCelsius": "double",
    "WetBulbFarenheit": "double", "WetBulbCelsius": "double", "DewPointFarenheit": "double", "DewPointCelsius": "double", "RelativeHumidity": "double",
    "WindSpeed": "double", "WindDirection": "double", "ValueForWindCharacter": "string", "StationPressure": "double", "PressureTendency": "string",
    "PressureChange": "double", "SeaLevelPressure": "string", "RecordType": "string", "HourlyPrecip": "string", "Altimeter": "double",
}
WEATHER = _schema(
    "WBAN string, Date string, Time string, " + ", ".join(f"{c} {t}" + ("" if c == "StationType" else f", {c}Flag string") for c, t in OBSERVED.items())
)
AIRPORTS = _schema("AirportID int, WBAN string, TimeZone int")


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType, header: bool = True, multi_line: bool = False, date_columns: dict[str, str] | None = None, drop: tuple[str, ...] = ()) -> DataFrame:
    """SRC-01 to SRC-03: text by an explicit schema (never inferred), quoted with ``"``; dates parsed by
    their formats, unused columns dropped. Values that don't fit are null."""
    df = spark.read.schema(schema).option("header", header).option("quote", '"').option("escape", '"').option("multiLine", multi_line).option("ignoreLeadingWhiteSpace", True).option("mode", "PERMISSIVE").csv(path)
    for c, fmt in (date_columns or {}).items():
        df = df.withColumn(c, F.try_to_timestamp(F.col(c), F.lit(fmt)).cast("date"))
    return df.drop(*drop)


def read_flights(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, FLIGHTS, multi_line=True, date_columns={"FL_DATE": "yyyy-MM-dd"}, drop=("UNUSED_COL",))


def read_weather(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, WEATHER, date_columns={"Date": "yyyyMMdd"})


def read_airports(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, AIRPORTS)


def read_table(spark: SparkSession, csv_path: str | None, stored_path: str, reader=None, required: list[str] | None = None) -> DataFrame:
    """SRC-04, SRC-05: from text through ``reader`` (and stored as Parquet), or from the stored copy."""
    if csv_path is not None:
        write_table(reader(spark, csv_path), stored_path)
    return require(spark.read.parquet(stored_path), required or [])


def write_table(df: DataFrame, path: str, compression: str = "zstd", partition_by: list[str] | None = None) -> None:
    """SNK-01: Parquet, overwritten. Files are sized by a rebalance that adaptive execution plans, not by a
    fixed count."""
    writer = df.hint("rebalance").write.mode("overwrite").option("compression", compression)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str, max_rows: int | None = None, keys: list[str] | None = None, seed: int = 42) -> None:
    """SNK-02, SNK-03: small tables as text with a header; with ``max_rows`` a stable sample of so many."""
    from tidewater.operators.sampling import at_most

    out = at_most(df, max_rows, keys or df.columns, seed) if max_rows else df
    out.write.mode("overwrite").option("header", True).csv(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name where driver and executors share files: under ``spark.checkpoint.dir``, or under a
    local folder where a local session names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("/tmp/checkpoints/tidewater")
        folder = spark.sparkContext.getCheckpointDir()
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once into a new folder of ``scratch`` and read from there, columns with their metadata: for what is read
    many times, as by each stage and step of a fit, and would be joined or shuffled anew each time. The folder stays."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def read_text_file(spark: SparkSession, path: str) -> str | None:
    """A small text file of any file system that Spark knows, or None if there is none."""
    fs, at = _file_system(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def write_text_file(spark: SparkSession, path: str, text: str) -> None:
    fs, at = _file_system(spark, path)
    stream = fs.create(at, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it is there."""
    fs, at = _file_system(spark, path)
    fs.delete(at, True)


def save_model(model, path: str, inputs: DataFrame | None = None) -> None:
    """SNK-04: a fitted pipeline or model; with ``inputs`` (what it was fitted on) beside the schema of the columns it
    reads."""
    model.write().overwrite().save(path)
    if inputs is not None:
        write_text_file(inputs.sparkSession, f"{path}/input-schema.json", inputs.schema.json())


class SchemaMismatch(ValueError):
    """A frame lacks columns that a stored model was fitted on, or has them in other types."""


def load_model(path: str, kind=PipelineModel, inputs: DataFrame | None = None):
    """SNK-04: the stored model. With ``inputs`` (what it shall be applied to) it is refused, by ``SchemaMismatch``, if
    a column that it was fitted on is absent or of another type; more columns and another order are no mismatch."""
    if inputs is not None:
        stored = read_text_file(inputs.sparkSession, f"{path}/input-schema.json")
        if stored is None:
            raise SchemaMismatch(f"{path} has no input schema")
        wanted = {f.name: f.dataType for f in T.StructType.fromJson(json.loads(stored)).fields}
        found = {f.name: f.dataType for f in inputs.schema.fields}
        wrong = [f"{c}: {found[c].simpleString() if c in found else 'absent'}, not {t.simpleString()}" for c, t in wanted.items() if c not in found or found[c].simpleString() != t.simpleString()]
        if wrong:
            raise SchemaMismatch("; ".join(wrong))
    return kind.load(path)


def register(df: DataFrame, name: str) -> DataFrame:
    """SNK-05: as a view for SQL."""
    df.createOrReplaceTempView(name)
    return df
