"""Every schema the sources read, declared once."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "long": T.LongType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "float": T.FloatType(),
    "string": T.StringType(),
    "boolean": T.BooleanType(),
    "ts": T.TimestampNTZType(),
    "floats": T.ArrayType(T.FloatType()),
    "doubles": T.ArrayType(T.DoubleType()),
}


def schema(spec: str) -> T.StructType:
    """``"a:long b:string"`` to a StructType of nullable fields."""
    pairs = (field.split(":") for field in spec.split())
    return T.StructType([T.StructField(name, _TYPES[kind], True) for name, kind in pairs])


# The tables of the test data.
TABLES = {
    "region": schema("r_regionkey:int r_name:string"),
    "nation": schema("n_nationkey:int n_name:string n_regionkey:int"),
    "customer": schema("c_custkey:long c_name:string c_nationkey:int c_acctbal:double c_mktsegment:string"),
    "supplier": schema("s_suppkey:long s_name:string s_nationkey:int s_acctbal:double"),
    "part": schema("p_partkey:long p_name:string p_brand:string p_type:string p_size:int p_retailprice:double"),
    "orders": schema(
        "o_orderkey:long o_custkey:long o_orderstatus:string o_totalprice:double o_orderdate:ts o_orderpriority:string"
    ),
    "lineitem": schema(
        "l_orderkey:long l_partkey:long l_suppkey:long l_linenumber:int l_quantity:double l_extendedprice:double "
        "l_discount:double l_tax:double l_returnflag:string l_linestatus:string l_shipdate:ts"
    ),
    "events": schema("event_id:long ts:ts user_id:long event_type:string value:double props:string"),
    "documents": schema("doc_id:long text:string lang:string source:string n_chars:long"),
    "embeddings": schema("vec_id:long embedding:floats label:int"),
    "pages": schema("page_id:long url:string html:string"),
    "benchmark": schema("item_id:long text:string"),
    "labels": schema("doc_id:long quality:int toxic:int"),
    "conversations": schema("conv_id:long turn:long role:string text:string"),
}

# Daily flight files, by the type in the file name. Times arrive as text and are cast leniently.
FLIGHT_FILES = {
    "runways_data_set": schema(
        "gufi:string arrival_runway_actual:string arrival_runway_actual_time:string "
        "departure_runway_actual:string departure_runway_actual_time:string relevant_date:string"
    ),
    "TFM_track_data_set": schema("gufi:string arrival_runway_estimated_time:string timestamp:string"),
    "ETD_data_set": schema("gufi:string departure_runway_estimated_time:string timestamp:string"),
    "MFS_data_set": schema("gufi:string aircraft_type:string"),
}

FLIGHTS = schema(
    "gufi:string arrival_airport:string arrival_runway_actual_time:ts departure_runway_actual_time:ts "
    "is_arrival:boolean"
)

OBSERVATIONS = schema(
    "station_id:string datetime:ts visibility:float altimeter_tenths_hpa:int temperature:float dew_point:float "
    "wind_direction:float wind_speed:float wind_gust:float "
    "cover_type_1:string altitude_1:int cloud_type_1:string "
    "cover_type_2:string altitude_2:int cloud_type_2:string "
    "cover_type_3:string altitude_3:int cloud_type_3:string"
)

PARSED_OBSERVATIONS = T.StructType([*OBSERVATIONS.fields, *schema("source_file:string block_no:int").fields])

POLYGONS = schema("source_file:string path:string coords:doubles")

TEMPLATE = schema("ID:string Value:int")
