"""Command line: run one of the analyses on CSV or parquet tables and write
every report table.

    # single source: dedup, label, split, clean, models, curves, tests, attributions
    python -m trellis.plans.run classify data.csv out/ --label target --score quality

    # two sources pooled with a 0/1 source marker (+ polarity check)
    python -m trellis.plans.run combined a.csv out/ --second b.csv

    # regression of the score; prediction of the source type
    python -m trellis.plans.run score merged.csv out/ --score quality
    python -m trellis.plans.run type merged.csv out/ --type-col type

Tables are written as parquet (``--format csv`` for CSV with header); fitted
models as Spark ML bundles.
"""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from trellis.functions.columns import numeric_columns
from trellis.operators import prep, profile
from trellis.plans import workflow
from trellis.session import get_session, release_tables
from trellis.sources.io import save_bundle, scan_csv, write_table, write_text_report

# Fixed values of the reference workflow.
TYPE_CODES = {"red": 0, "white": 1}

SUMMARY_TABLES = ("comparison", "metrics", "report", "split_check", "threshold_sensitivity", "tuned_metrics",
                  "t_test", "cv_summary", "cv", "vif", "importance_rf", "importance", "attribution_summary",
                  "polarity")


#: tables that grow with the rows or with distinct scores, written in parallel
BY_ROW = ("attributions", "roc_curve", "roc_curve_gbt", "pr_curve", "pr_curve_gbt", "actual_vs_predicted", "rejected",
          "rejected_second")


def _read(spark, path: str, args, tables: dict):
    """A parquet table, or a CSV typed by ``--schema`` or by its header; lines that do not fit are
    written out as the table ``rejected``."""
    if not path.endswith(".csv"):
        return prep.clean_numeric(spark.read.parquet(path))
    rows, rejected = scan_csv(spark, path, args.schema, text=[args.type_col], whole=[args.score, args.label])
    tables["rejected" if "rejected" not in tables else "rejected_second"] = rejected
    return prep.clean_numeric(rows)


def _features(df, exclude) -> list[str]:
    return [c for c in numeric_columns(df) if c not in set(exclude)]


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    ap.add_argument("entry", choices=["classify", "combined", "score", "type"])
    ap.add_argument("source")
    ap.add_argument("out_dir")
    ap.add_argument("--second", default=None, help="second source (combined)")
    ap.add_argument("--label", default="target")
    ap.add_argument("--score", default="quality")
    ap.add_argument("--type-col", default="type")
    ap.add_argument("--threshold", type=float, default=prep.DEFAULT_LABEL_THRESHOLD)
    ap.add_argument("--features", default=None, help="comma separated; default: numeric columns")
    ap.add_argument("--key", default=None)
    ap.add_argument("--format", default="parquet", choices=["parquet", "csv"])
    ap.add_argument("--small", action="store_true", help="small learners (smoke runs)")
    ap.add_argument("--folds", type=int, default=10, help="cross-validation folds")
    ap.add_argument("--tune", action="store_true", help="grid search of forest and boosted trees")
    ap.add_argument("--resample", choices=["smote"], default=None, help="oversample inside the training parts, no weights")
    ap.add_argument("--schema", default=None, help="typed columns of a CSV, e.g. 'a double, quality int'")
    ap.add_argument("--master", default=None)
    a = ap.parse_args(argv)
    spark = get_session(a.master)
    sizes = workflow.ModelSizes.small() if a.small else None
    rejected: dict = {}
    raw = _read(spark, a.source, a, rejected)
    chosen = a.features.split(",") if a.features else None
    tables: dict = {}

    if a.entry == "classify":
        labelled = prep.binary_label(raw, a.score, a.label, a.threshold)
        feats = chosen or _features(labelled, (a.label, a.score, a.type_col, a.key))
        body = prep.drop_leaks(labelled, [c for c in ("quality", a.type_col, a.score) if c != a.label])
        tables = workflow.full_report(body, a.label, feats, key=a.key, cv_folds=a.folds, sizes=sizes,
                                      out_dir=a.out_dir, tune=a.tune, resample=a.resample)
        if a.score in labelled.columns:   # on the raw, non-deduplicated rows
            tables["threshold_sensitivity"] = profile.threshold_sensitivity(labelled, a.score)

    elif a.entry == "combined":
        if not a.second:
            raise SystemExit("combined needs --second")
        frames = []
        for df in (raw, _read(spark, a.second, a, rejected)):
            df = prep.binary_label(df, a.score, a.label, a.threshold)
            frames.append(prep.drop_leaks(df, [c for c in ("quality", a.type_col, a.score) if c != a.label]))
        feats = chosen or _features(frames[0], (a.label, a.key))
        out = workflow.combined(frames, [0, 1], a.key or "row_key", a.label, feats, marker=a.type_col,
                                sizes=sizes, report=True, cv_folds=a.folds, out_dir=a.out_dir, tune=a.tune)
        tables = {k: v for k, v in out.items() if k != "fitted"}

    elif a.entry == "score":
        df = prep.encode_category(raw, a.type_col, TYPE_CODES) if a.type_col in raw.columns else raw
        df = prep.dedup(df)
        key = a.key or "row_key"
        df = prep.row_key(df, key) if key not in df.columns else df
        df = df.withColumn(a.score, F.col(a.score).cast("double"))
        feats = chosen or _features(df, (a.score, a.label, key))
        out = workflow.score_regression(df, key, a.score, feats, k=min(a.folds, 5))
        tables = {k: v for k, v in out.items() if k != "model"}
        save_bundle(spark, out["model"], f"{a.out_dir}/bundle_score")

    else:  # type
        df = prep.encode_category(raw, a.type_col, TYPE_CODES)
        df = prep.dedup(df).where(F.col(a.type_col).isNotNull())
        key = a.key or "row_key"
        df = prep.row_key(df, key) if key not in df.columns else df
        feats = chosen or _features(df, (a.type_col, a.score, a.label, key))
        out = workflow.type_prediction(df, key, a.type_col, feats, sizes)
        tables = {k: v for k, v in out.items() if k != "model"}
        save_bundle(spark, out["model"], f"{a.out_dir}/bundle_type")

    for name, df in {**tables, **rejected}.items():
        write_table(df, f"{a.out_dir}/{name}", fmt=a.format, single_file=name not in BY_ROW)
    # the human-readable summary: the small report tables as text
    summary = {n: tables[n] for n in SUMMARY_TABLES if n in tables}
    if summary:
        write_text_report(summary, f"{a.out_dir}/report_txt")
    release_tables(spark)   # everything is saved: the run's intermediate tables go


if __name__ == "__main__":
    main()
