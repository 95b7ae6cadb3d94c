"""Schemas of the canonical tables, the relations and their roles."""

from __future__ import annotations

from pyspark.sql import types as T

DAY_NS = 86_400_000_000_000

NODES = T.StructType([
    T.StructField("uuid", T.StringType(), False), T.StructField("node_type", T.StringType()), T.StructField("label", T.StringType()),
    T.StructField("host", T.StringType()), T.StructField("semantic_key", T.StringType()), T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
])

EDGES = T.StructType([
    T.StructField("event_id", T.StringType(), False), T.StructField("src", T.StringType(), False), T.StructField("dst", T.StringType(), False),
    T.StructField("relation", T.StringType(), False), T.StructField("timestamp_ns", T.LongType(), False), T.StructField("host", T.StringType()),
    T.StructField("data_size", T.LongType()),
])

# Relations whose information flows from the object to the subject, and those anchored at their destination.
READ_LIKE = ("EVENT_ACCEPT", "EVENT_LOADLIBRARY", "EVENT_MMAP", "EVENT_READ", "EVENT_READ_SOCKET_PARAMS", "EVENT_RECVFROM", "EVENT_RECVMSG")
DESTINATION_ANCHORED = (*READ_LIKE, "EVENT_CLONE", "EVENT_FORK")
