import math
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from trellis.functions.report import threshold_report
from trellis.operators import metrics, prep, profile
from trellis.sources import io


def _csv(rows, sep):
    folder = tempfile.mkdtemp(prefix="trellis-csv-")
    path = f"{folder}/data.csv"
    with open(path, "w") as fh:
        fh.write(sep.join(["fixed acidity", "alcohol", "quality", "type"]) + "\n")
        for r in rows:
            fh.write(sep.join(str(x) for x in r) + "\n")
    return path


def test_sniffed_loader_dedups_labels_and_drops_leaks(spark):
    rows = [(7.4, 9.4, 5, "red"), (7.4, 9.4, 5, "red"), (7.8, 12.8, 7, "red"), (6.0, 10.0, 8, "white")]
    from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType
    schema = StructType([StructField("fixed acidity", DoubleType()), StructField("alcohol", DoubleType()),
                         StructField("quality", IntegerType()), StructField("type", StringType())])
    for sep in (";", ","):
        df = prep.load_dataset(spark, _csv(rows, sep), schema=schema)
        assert sorted(df.columns) == ["alcohol", "fixed acidity", "target"]
        assert sorted(r.target for r in df.collect()) == [0, 1, 1]


def test_missing_file_fails_fast(spark):
    with pytest.raises(AnalysisException):
        prep.load_dataset(spark, "/nonexistent/trellis.csv", sep=",")


def test_missing_label_and_score_is_an_error(spark):
    path = _csv([(1.0, 2.0, 5, "red")], ",")
    with pytest.raises(ValueError):
        prep.load_dataset(spark, path, score="nope", drop=("quality", "type"))


def test_bundle_roundtrip(spark):
    from pyspark.ml import Pipeline

    from trellis.operators import models
    df = spark.range(100).select(F.col("id").cast("double").alias("a"),
                                 (F.col("id") % 2).cast("int").alias("label"))
    m = Pipeline(stages=[models.assembler(["a"]), models.logistic_regression(100.0)]).fit(df)
    path = tempfile.mkdtemp(prefix="trellis-bundle-") + "/b"
    io.save_bundle(spark, m, path)
    again, meta = io.load_bundle(spark, path)
    assert meta["description"] and meta["created"]
    a = [r.prediction for r in m.transform(df).collect()]
    b = [r.prediction for r in again.transform(df).collect()]
    assert a == b


def test_report_strings(spark):
    df = spark.createDataFrame([(q,) for q in [5, 6, 7, 7, 8]], "quality int")
    rep = {r["Threshold"]: r for r in threshold_report(profile.threshold_sensitivity(df)).collect()}
    assert rep[">= 7"]["Good %"] == "60.0%" and rep[">= 8"]["Imbalance Ratio"] == "1:4.0"


def test_text_report_and_csv_sink(spark):
    folder = tempfile.mkdtemp(prefix="trellis-sink-")
    df = spark.createDataFrame([(1, 0.5)], "a int, b double")
    io.write_table(df, f"{folder}/csv", fmt="csv", single_file=True)
    assert spark.read.option("header", True).csv(f"{folder}/csv").count() == 1
    io.write_text_report({"metrics": df}, f"{folder}/report")
    text = [r.value for r in spark.read.text(f"{folder}/report").collect()]
    assert text[0] == "== metrics ==" and "a | b" in text


def test_kde_matches_numpy(spark):
    rnd = np.random.default_rng(4)
    x = np.round(rnd.normal(size=500), 2)
    df = spark.createDataFrame([(float(v),) for v in x], "e double")
    got = sorted((r.idx, r.density) for r in metrics.gaussian_kde(df, "e", 50).collect())
    h = x.std(ddof=1) * len(x) ** -0.2
    grid = np.linspace(x.min(), x.max(), 50)
    want = np.exp(-0.5 * ((grid[:, None] - x[None, :]) / h) ** 2).sum(axis=1) / (len(x) * h * math.sqrt(2 * math.pi))
    assert np.allclose([d for _, d in got], want, rtol=1e-10)


def test_release_written_tables(spark):
    from trellis.session import cut_lineage, release_tables
    t = cut_lineage(spark.range(10), "tmp")
    assert t.count() == 10
    assert release_tables(spark) >= 1


def test_parquet_sink_and_table_source(spark):
    folder = tempfile.mkdtemp(prefix="trellis-pq-")
    df = spark.createDataFrame([(1, 0.5), (2, 1.5)], "a int, b double")
    io.write_table(df, f"{folder}/t.parquet")
    back = io.read_table(spark, folder, "t")
    assert sorted(tuple(r) for r in back.collect()) == [(1, 0.5), (2, 1.5)]


def test_sniff_delimiter():
    assert io.sniff_delimiter("a;b;c") == ";"
    assert io.sniff_delimiter("a,b") == ","
    assert io.sniff_delimiter("a\tb\tc") == "\t"
    assert io.sniff_delimiter("single") == ","


def test_scan_types_from_the_header_and_keeps_rejected_lines(spark):
    rows = [(7.4, 9.4, 5, "red"), ("n/a", 9.0, 6, "red"), (1.0, 2.0, 3), ("", 10.0, 8, "white"), (1, 2, 3, "red", "more")]
    for sep in (";", ","):
        path = _csv(rows, sep)
        got, bad = io.scan_csv(spark, path, text=["type"], whole=["quality"])
        assert [f.dataType.simpleString() for f in got.schema] == ["double", "double", "int", "string"]
        assert sorted(tuple(r) for r in got.collect() if r[0]) == [(7.4, 9.4, 5, "red")]
        assert [r[1] for r in got.collect() if r[0] is None] == [10.0]      # an empty field is NULL, not an error
        assert bad.count() == 3 and sep.join(["n/a", "9.0", "6", "red"]) in [r.line for r in bad.collect()]
    with pytest.raises(ValueError):
        io.scan_csv(spark, path, "a double, b double")
    with pytest.raises(AnalysisException):
        io.scan_csv(spark, "/nonexistent/trellis.csv")
