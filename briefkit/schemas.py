"""Fixed schemas (never inferred)."""

from pyspark.sql import types as T

S = T.StringType()
L = T.LongType()

# M1: exported message resource (one JSON object per line).
HEADER = T.StructType([T.StructField("name", S), T.StructField("value", S)])
BODY = T.StructType([T.StructField("data", S)])
PART = T.StructType([T.StructField("mimeType", S), T.StructField("body", BODY)])
PAYLOAD = T.StructType([
    T.StructField("headers", T.ArrayType(HEADER)),
    T.StructField("parts", T.ArrayType(PART)),
    T.StructField("body", BODY),
])
MESSAGE = T.StructType([
    T.StructField("id", S),
    T.StructField("labelIds", T.ArrayType(S)),
    T.StructField("internalDate", L),
    T.StructField("payload", PAYLOAD),
])
# A line of an export: what does not parse is kept as it is.
MESSAGE_LINE = T.StructType([*MESSAGE.fields, T.StructField("_corrupt_record", S)])

# M2/M3: flat newsletter record; ``ord`` is the list order.
RECORD = T.StructType([
    T.StructField("ord", L),
    T.StructField("subject", S),
    T.StructField("date", S),
    T.StructField("sender", S),
    T.StructField("body", S),
    T.StructField("body_format", S),
])

# M7: model response envelope.
USAGE = T.StructType([
    T.StructField("total_tokens", L),
    T.StructField("prompt_tokens", L),
    T.StructField("completion_tokens", L),
    T.StructField("cost", T.DoubleType()),
])
RESPONSE = T.StructType([
    T.StructField("choices", T.ArrayType(T.StructType([
        T.StructField("message", T.StructType([T.StructField("content", S)])),
    ]))),
    T.StructField("usage", USAGE),
])

# M9: one model call in the cost log.
COST = T.StructType([
    T.StructField("timestamp", S),
    T.StructField("model", S),
    T.StructField("provider", S),
    T.StructField("prompt_tokens", L),
    T.StructField("completion_tokens", L),
    T.StructField("total_tokens", L),
    T.StructField("cost", T.DoubleType()),
])
COST_WITH_CORRUPT = T.StructType(COST.fields + [T.StructField("_corrupt_record", S)])

# Site registry row.
REGISTRY = T.StructType([
    T.StructField("name", S),
    T.StructField("url", S),
    T.StructField("verified", T.BooleanType()),
])
REGISTRY_ENTRY = T.StructType([T.StructField("url", S), T.StructField("verified", T.BooleanType())])

# Review decision.
DECISION = T.StructType([
    T.StructField("name", S),
    T.StructField("action", S),
    T.StructField("new_url", S),
])

# Scoring output.
SCORED = T.StructType([
    T.StructField("batch_id", L),
    T.StructField("response", S),
    T.StructField("status", S),
    T.StructField("error", S),
    T.StructField("attempt", T.IntegerType()),
    T.StructField("model", S),
])

# Ledger of answers (E4): SCORED keyed by the hash of what was asked.
LEDGER = T.StructType([T.StructField("key", S)] + SCORED.fields[1:])
