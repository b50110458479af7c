"""Schemas of the tables passed between stages."""

from pyspark.sql import types as T

FILES = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("format", T.StringType()),
    T.StructField("content", T.StringType()),
])

# One cue inside a file row. Times stay text so that a file can be written back
# without loss; ``raw`` is the event line of an ASS file, else null.
CUE = T.StructType([
    T.StructField("cue_index", T.StringType()),
    T.StructField("start", T.StringType()),
    T.StructField("end", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("raw", T.StringType()),
])

CUES = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("format", T.StringType()),
    T.StructField("pos", T.IntegerType()),
    *CUE.fields,
])

SAMPLES = T.StructType([
    T.StructField("clean_text", T.StringType()),
    T.StructField("label", T.IntegerType()),
])

CUE_COLUMNS = CUES.names
KEY = ["path", "pos"]
