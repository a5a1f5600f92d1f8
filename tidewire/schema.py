"""Column layouts of the tables the operators exchange."""

from pyspark.sql import types as T

PART = T.StructType(
    [
        T.StructField("part_no", T.IntegerType()),
        T.StructField("filename", T.StringType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("content", T.BinaryType()),
    ]
)

# One row per article. Header names are lower-case, the last value of a
# repeated header wins.
MESSAGES = T.StructType(
    [
        T.StructField("newsgroup", T.StringType()),
        T.StructField("article_number", T.LongType()),
        T.StructField("path", T.StringType()),
        T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
        T.StructField("is_multipart", T.BooleanType()),
        T.StructField("body", T.StringType()),
        T.StructField("parts", T.ArrayType(PART)),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("error", T.StringType()),
    ]
)

#: What Spark's binaryFile gives of a file.
BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"

LOG_JSON = T.StructType(
    [
        T.StructField("asctime", T.StringType()),
        T.StructField("levelname", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("exc_info", T.StringType()),
        T.StructField("stderr", T.StringType()),
        T.StructField("threadName", T.StringType()),
    ]
)
