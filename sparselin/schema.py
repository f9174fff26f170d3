"""Schemas of every table the library reads, writes or returns."""

from pyspark.sql import types as T

# One example per row; feature ids are 0-based and ascending, an absent feature is 0.
ROWS = T.StructType([
    T.StructField("row_id", T.LongType()),
    T.StructField("label", T.DoubleType()),
    T.StructField("indices", T.ArrayType(T.LongType())),
    T.StructField("values", T.ArrayType(T.DoubleType())),
])

# One stored entry per row.
COO = T.StructType([
    T.StructField("row_id", T.LongType()),
    T.StructField("j", T.LongType()),
    T.StructField("v", T.DoubleType()),
])

WEIGHTS = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("j", T.LongType()),
    T.StructField("w", T.DoubleType()),
])

SCORES = T.StructType([
    T.StructField("row_id", T.LongType()),
    T.StructField("label", T.DoubleType()),
    T.StructField("margin", T.DoubleType()),
])

_STEP = [
    T.StructField("iter", T.IntegerType()),
    T.StructField("f", T.DoubleType()),
    T.StructField("g_norm", T.DoubleType()),
    T.StructField("delta", T.DoubleType()),
    T.StructField("actred", T.DoubleType()),
    T.StructField("prered", T.DoubleType()),
    T.StructField("ratio", T.DoubleType()),
    T.StructField("cg", T.IntegerType()),
    T.StructField("accepted", T.BooleanType()),
    T.StructField("t_sec", T.DoubleType()),
]
STEP = T.StructType(_STEP)
HISTORY = T.StructType([T.StructField("run_id", T.StringType()), *_STEP])

META = T.StructType([
    T.StructField(name, T.StringType())
    for name in ("timestamp_utc", "user", "hostname", "python", "numpy", "pyspark", "mode")
])

CONFIG = T.StructType([
    T.StructField("data_path", T.StringType()),
    T.StructField("train_path", T.StringType()),
    T.StructField("test_path", T.StringType()),
    T.StructField("solver", T.StringType()),
    T.StructField("approach", T.StringType()),
    T.StructField("C", T.DoubleType()),
    T.StructField("eps", T.DoubleType()),
    T.StructField("bias", T.DoubleType()),
    T.StructField("regParam", T.DoubleType()),
    T.StructField("tol", T.DoubleType()),
    T.StructField("maxIter", T.IntegerType()),
    T.StructField("seed", T.IntegerType()),
    T.StructField("fitIntercept", T.BooleanType()),
    T.StructField("n_samples", T.LongType()),
    T.StructField("n_features", T.LongType()),
    T.StructField("numPartitions", T.IntegerType()),
])

SUMMARY = T.StructType([
    T.StructField("iters", T.IntegerType()),
    T.StructField("final_f", T.DoubleType()),
    T.StructField("f_train", T.DoubleType()),
    T.StructField("final_grad_norm", T.DoubleType()),
    T.StructField("reason", T.StringType()),
    T.StructField("time_sec", T.DoubleType()),
    T.StructField("start_time_epoch", T.DoubleType()),
    T.StructField("end_time_epoch", T.DoubleType()),
    T.StructField("weights_path", T.StringType()),
    T.StructField("accuracy_test", T.DoubleType()),
    T.StructField("roc_auc_test", T.DoubleType()),
])

RUNS = T.StructType([
    T.StructField("meta", META),
    T.StructField("config", CONFIG),
    T.StructField("summary", SUMMARY),
    T.StructField("history", T.ArrayType(STEP)),
])

THRESHOLD = T.StructType([
    T.StructField("metric", T.StringType()),
    T.StructField("best_threshold", T.DoubleType()),
    T.StructField("best_score", T.DoubleType()),
])

# Timings of two aggregation strategies, kept as parallel arrays in their log files.
TIMINGS = T.StructType([
    T.StructField("t_map", T.ArrayType(T.DoubleType())),
    T.StructField("f_map", T.ArrayType(T.DoubleType())),
    T.StructField("t_mappart", T.ArrayType(T.DoubleType())),
    T.StructField("f_mappart", T.ArrayType(T.DoubleType())),
])
