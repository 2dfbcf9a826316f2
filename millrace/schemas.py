"""Schemas of the benchmark domains; built without a session."""

from pyspark.sql import types as T

_KINDS = {"bin": T.BinaryType(), "str": T.StringType(), "ts": T.TimestampType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "byte": T.ByteType()}


def _of(spec: str) -> T.StructType:
    return T.StructType([T.StructField(n, _KINDS[k]) for n, k in (x.split(":") for x in spec.split())])


AD_EVENT = _of("user_id:bin page_id:bin campaign_id:bin ad_type:str event_type:str ts:ts ip:long")
AD_CSV = _of("timestamp:str user_id:str page_id:str ad_id:str ad_type:str event_type:str ip:str")
TRIP = _of("medallion:str hack_license:str vendor_id:str rate_code:long pickup_ts:ts dropoff_ts:ts passengers:long trip_secs:long distance:double pickup_lon:double pickup_lat:double dropoff_lon:double dropoff_lat:double store_flag:byte")
BID = _of("auction:long bidder:long price:long dateTime:long")
VEHICLE_FIELDS = ["type", "time", "vid", "speed", "xway", "lane", "dir", "seg", "pos", "qid", "sinit", "send", "dow", "tod", "day"]
TOLL = _of("type:int vid:long time:long emit:long spd:int toll:int")
KEY_VALUE = _of("key:long value:long ts:ts")
