"""Line parsing, readers and writers."""

import math

import pytest
from pyspark.sql import functions as F

from sparselin import sinks
from sparselin.functions import rows as R
from sparselin.functions import text as X
from sparselin.schema import ROWS
from sparselin.sources import libsvm


def as_dict(rows):
    return {r["row_id"]: (r["label"], dict(zip(r["indices"], r["values"]))) for r in rows.collect()}


def test_micro_lines(micro):
    assert as_dict(micro) == {
        0: (1.0, {0: 0.5, 2: 2.0}), 1: (-1.0, {1: 1.5}), 2: (1.0, {0: -1.0, 2: 1.0}),
        3: (-1.0, {1: 0.25}), 4: (-1.0, {0: 1.0}), 7: (1.0, {})}
    assert micro.where(F.col("row_id") == 2).first()["indices"] == [0, 2]


def test_strict_labels(lines):
    assert as_dict(libsvm.parse(lines, "svmlight")) == {
        1: (-1.0, {1: 1.5}), 2: (1.0, {0: -1.0, 2: 1.0}), 3: (0.0, {1: 0.25}), 7: (2.0, {})}


def test_unknown_dialect(lines):
    with pytest.raises(ValueError):
        libsvm.parse(lines, "csv")


@pytest.mark.parametrize("token, kept", [
    ("1:2", (0, 2.0)), ("+3:.5", (2, 0.5)), ("2:1e3", (1, 1000.0)), ("2:-1.", (1, -1.0)), ("4:inf", (3, math.inf)),
    ("0:1", None), ("-1:1", None), ("1.5:1", None), (":1", None), ("1:", None), ("1:2:3", None), ("1:1_0", None),
    ("1:1d", None), ("qid:7", None), ("x", None), ("99999999999999999999:1", None),
])
def test_feature_grammar(spark, token, kept):
    got = spark.range(1).select(X.feature_pairs(F.array(F.lit(token))).alias("p")).first()["p"]
    assert [(e["j"], e["v"]) for e in got] == ([] if kept is None else [kept])


@pytest.mark.parametrize("token, label", [
    ("+1", 1.0), ("2", 1.0), ("0", -1.0), ("-3", -1.0), ("abc", -1.0), ("nan", -1.0), ("inf", 1.0), ("1e-9", 1.0)])
def test_lenient_label(spark, token, label):
    assert spark.range(1).select(X.lenient_label(F.lit(token))).first()[0] == label


def test_spaces_and_bytes(spark, tmp_path):
    path = tmp_path / "odd.txt"
    path.write_bytes("\t+1\t1:1  2:2\r\n".encode() + b"-1 1:\xff3\n" + b"   \n \t# c\n\xff\n")
    rows = libsvm.parse(libsvm.with_row_id(libsvm.read_lines(spark, str(path)))).orderBy("row_id").collect()
    assert [(r["label"], r["indices"], r["values"]) for r in rows] == [
        (1.0, [0, 1], [1.0, 2.0]), (-1.0, [0], [3.0])]


def test_many_repetitions_are_summed(spark):
    line = "1 " + " ".join(f"{i % 7 + 1}:1" for i in range(70_000))
    rows = libsvm.parse(spark.createDataFrame([(0, line)], "row_id bigint, value string"))
    got = rows.first()
    assert got["indices"] == list(range(7)) and got["values"] == [10_000.0] * 7


def test_bias(micro):
    rows, n = libsvm.with_bias(micro, 1.0)
    assert n == 4
    assert as_dict(rows)[7] == (1.0, {3: 1.0})
    rows, n = libsvm.with_bias(micro, 0.0)
    assert n == 4 and as_dict(rows)[7] == (1.0, {3: 0.0})
    assert libsvm.with_bias(micro, -1.0)[1] == 3
    assert libsvm.with_bias(micro, 1.0, 9)[1] == 9


def test_width_errors(spark, micro):
    with pytest.raises(Exception, match="does not fit into 3 columns with a bias"):
        libsvm.with_bias(micro, 1.0, 3)[0].collect()  # a feature would share the bias column
    with pytest.raises(Exception, match="does not fit into 2 columns"):
        libsvm.with_bias(micro, -1.0, 2)[0].collect()
    with pytest.raises(ValueError):
        libsvm.feature_width(spark.createDataFrame([], ROWS))


def test_comment_only_file(spark, tmp_path):
    path = tmp_path / "empty.svm"
    path.write_text("# a\n\n  # b\n")
    with pytest.raises(ValueError):
        libsvm.read_libsvm(spark, str(path))
    with pytest.raises(ValueError):
        libsvm.read_libsvm(spark, str(path), n_features=4)


def test_row_ids_are_dense_over_files(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"part{k}.txt").write_text("".join(f"1 1:{k}\n" for _ in range(10 + k)))
    ids = libsvm.with_row_id(libsvm.read_lines(spark, str(tmp_path)))
    assert sorted(r["row_id"] for r in ids.collect()) == list(range(33))


def test_partition_hint(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1 1:1\n" * 20)
    assert libsvm.read_lines(spark, str(tmp_path), 4).rdd.getNumPartitions() == 4


def test_write_and_read(spark, random_rows):
    from sparselin.session import scratch_path
    rows, dense, y = random_rows
    path = scratch_path(spark, "svm")
    sinks.write_libsvm(rows, path)
    back, n = libsvm.read_libsvm(spark, path)
    assert n == dense.shape[1]

    def bag(df):
        return sorted(((r["label"], tuple(r["indices"]), tuple(r["values"])) for r in df.collect()))
    assert bag(back) == bag(rows)
    strict = libsvm.read_strict(spark, path, n)
    assert strict.count() == 200 and strict.first()["features"].size == n


def test_densify_and_inline_dot(micro):
    dense = micro.select("row_id", R.densify(F.col("indices"), F.col("values"), 3).alias("x"),
                         R.inline_dot(F.col("indices"), F.col("values"), [0.1, -0.2, 0.3]).alias("m"))
    got = {r["row_id"]: (r["x"], round(r["m"], 9)) for r in dense.collect()}
    assert got[0] == ([0.5, 0.0, 2.0], 0.65) and got[7] == ([0.0, 0.0, 0.0], 0.0)
    with pytest.raises(ValueError):
        R.inline_dot(F.col("indices"), F.col("values"), [0.0] * 5000)


@pytest.mark.parametrize("size", [1 << 20, 100, 9])
def test_row_ids_are_line_numbers_in_path_order(spark, tmp_path, size):
    """Also where large files come first in a scan, and where a partition reads pieces of several files."""
    lines = []
    for name, n in (("a", 3), ("b/c", 400), ("b-d", 0), ("z", 37), ("m", 1)):
        path = tmp_path / f"{name}.txt"
        path.parent.mkdir(exist_ok=True)
        mine = [f"{name} {i} " + "x" * (i % 11) for i in range(n)]
        path.write_text("".join(x + "\n" for x in mine))
        lines.append((f"{path}", mine))
    want = [x for _, mine in sorted(lines) for x in mine]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        got = libsvm.numbered_lines(spark, str(tmp_path) + "/{*.txt,b/*.txt}").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {r["row_id"]: r["value"] for r in got} == dict(enumerate(want)) and len(got) == len(want)
