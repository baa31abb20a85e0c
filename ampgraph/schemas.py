"""Relations of the engine. All times are UTC; measures are single precision at rest and double in arithmetic."""

from pyspark.sql import types as T

TELEMETRY = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("device_id", T.StringType(), False),
        T.StructField("device_type", T.StringType()),
        T.StructField("zone", T.StringType()),
        T.StructField("ts", T.TimestampType(), False),
        T.StructField("voltage", T.FloatType(), False),
        T.StructField("current", T.FloatType(), False),
        T.StructField("power", T.FloatType(), False),
        T.StructField("energy", T.FloatType()),
        T.StructField("frequency", T.FloatType(), False),
        T.StructField("power_factor", T.FloatType(), False),
        T.StructField("status", T.StringType()),
        T.StructField("node", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("seed", T.LongType()),
        T.StructField("arrival", T.TimestampType()),
    ]
)

METERS = T.StructType(
    [
        T.StructField("device_id", T.StringType(), False),
        T.StructField("device_type", T.StringType()),
        T.StructField("zone", T.StringType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("node", T.StringType()),
        T.StructField("installed_at", T.TimestampType()),
        T.StructField("last_seen", T.TimestampType()),
        T.StructField("active", T.BooleanType()),
    ]
)

MESSAGE = "device_id string, device_type string, zone string, timestamp_utc string, voltage double, current double, power double, energy double, frequency double, power_factor double, status string, lat double, lon double"
TOPOLOGY = "meters array<struct<device_id:string, zona:string, lat:double, lon:double>>"
CALIBRATION = "format string, version int, magnitude string, zones map<string, struct<zone:string, threshold:double, sigma_spatial:double, seed:long, n_instants:int, source:string, fingerprint:string, n_meters:int>>"
