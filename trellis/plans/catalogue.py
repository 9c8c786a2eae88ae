"""Driver catalogue: every operator applied to the driver's tables, with the
equivalent DuckDB SQL as an independent oracle.

Stand-ins for the reference's data model (whole tables, no subsets):

* ``lineitem``: features ``l_quantity, l_extendedprice, l_discount, l_tax``;
  a 0-9 score ``q10 = floor((l_quantity - 1) / 5)``; label ``q10 >= 7``;
  group ``l_linestatus``.
* ``events``: key ``event_id``; class ``event_type = 'purchase'``; feature
  ``value``; score ``s = clip(value / 100, 0, 1)``.
* ``orders``: key ``o_orderkey`` for plain folds and splits.

Every double output is rounded to 6 digits in both engines (float sums differ
in the last bits between engines).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.functions.columns import round_doubles
from trellis.session import cut_lineage, forget
from trellis.operators import prep, profile
from trellis.sources.io import read_table

# Fixed values of the stand-in workflow.
SEED = 42
FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LABEL_THRESHOLD = 7

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return wrap


# --------------------------------------------------------------------------- tables

def lineitem(spark: SparkSession, d: str) -> DataFrame:
    li = read_table(spark, d, "lineitem")
    li = prep.clean_numeric(li, FEATURES)
    return li.withColumn("q10", F.floor((F.col("l_quantity") - 1) / 5).cast("int"))


def labelled_lineitem(spark: SparkSession, d: str) -> DataFrame:
    return prep.binary_label(lineitem(spark, d), "q10", "label", LABEL_THRESHOLD)


def events(spark: SparkSession, d: str) -> DataFrame:
    ev = prep.clean_numeric(read_table(spark, d, "events"), ["value"])
    return ev.withColumn("label", F.when(F.col("event_type") == "purchase", 1).otherwise(0))


LI_SQL = """li AS (
  SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus,
         CASE WHEN isnan(l_quantity) THEN NULL ELSE l_quantity + CAST(0 AS DOUBLE) END AS l_quantity,
         CASE WHEN isnan(l_extendedprice) THEN NULL ELSE l_extendedprice + CAST(0 AS DOUBLE) END AS l_extendedprice,
         CASE WHEN isnan(l_discount) THEN NULL ELSE l_discount + CAST(0 AS DOUBLE) END AS l_discount,
         CASE WHEN isnan(l_tax) THEN NULL ELSE l_tax + CAST(0 AS DOUBLE) END AS l_tax,
         CAST(floor((l_quantity - 1) / 5) AS INTEGER) AS q10
  FROM lineitem),
lil AS (SELECT *, CASE WHEN q10 >= 7 THEN 1 ELSE 0 END AS label FROM li)"""

EV_SQL = """ev AS (
  SELECT event_id, ts, user_id, event_type, props,
         CASE WHEN isnan(value) THEN NULL ELSE value + CAST(0 AS DOUBLE) END AS value,
         CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS label
  FROM events)"""


def r6(df: DataFrame) -> DataFrame:
    return round_doubles(df, 6)


# --------------------------------------------------------------------------- prep

@query("dedup_rows", f"""
WITH {LI_SQL}
SELECT DISTINCT q10, l_returnflag, l_linestatus, l_discount, l_tax FROM li""")
def q_dedup_rows(spark, d):
    return prep.dedup(lineitem(spark, d).select("q10", "l_returnflag", "l_linestatus",
                                                "l_discount", "l_tax"))


@query("dedup_summary", f"""
WITH {LI_SQL},
g AS (SELECT q10, l_returnflag, l_linestatus, l_discount, l_tax, count(*) AS n
      FROM li GROUP BY ALL)
SELECT CAST(sum(n) AS BIGINT) AS initial_rows, count(*) AS final_rows,
       CAST(sum(n) - count(*) AS BIGINT) AS removed,
       round(CAST(sum(n) - count(*) AS DOUBLE) * 100.0 / CAST(sum(n) AS DOUBLE), 6) AS removed_pct
FROM g""")
def q_dedup_summary(spark, d):
    return r6(prep.dedup_summary(lineitem(spark, d).select(
        "q10", "l_returnflag", "l_linestatus", "l_discount", "l_tax")))


@query("binary_label", f"""
WITH {LI_SQL}
SELECT l_orderkey, l_linenumber, q10, CASE WHEN q10 >= 7 THEN 1 ELSE 0 END AS label FROM li""")
def q_binary_label(spark, d):
    return labelled_lineitem(spark, d).select("l_orderkey", "l_linenumber", "q10", "label")


@query("encode_category", """
SELECT l_orderkey, l_linenumber,
       CASE WHEN l_linestatus = 'F' THEN 0 WHEN l_linestatus = 'O' THEN 1 END AS status_code,
       CASE WHEN l_returnflag = 'A' THEN 0 WHEN l_returnflag = 'R' THEN 1 END AS flag_code
FROM lineitem""")
def q_encode_category(spark, d):
    li = read_table(spark, d, "lineitem")
    li = prep.encode_category(li, "l_linestatus", {"F": 0, "O": 1}, out="status_code")
    li = prep.encode_category(li, "l_returnflag", {"A": 0, "R": 1}, out="flag_code")
    return li.select("l_orderkey", "l_linenumber", "status_code", "flag_code")


@query("drop_leaks", f"""
WITH {LI_SQL}
SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity, l_extendedprice, l_discount, l_tax,
       CASE WHEN q10 >= 7 THEN 1 ELSE 0 END AS label
FROM li""")
def q_drop_leaks(spark, d):
    li = labelled_lineitem(spark, d).drop("l_partkey", "l_suppkey", "l_shipdate")
    return prep.drop_leaks(li, ["q10", "l_linestatus", "not_present"])


@query("union_typed", f"""
WITH {LI_SQL}
SELECT *, 0 AS type FROM (SELECT DISTINCT q10, l_returnflag, l_discount, l_tax FROM li WHERE l_linestatus = 'F')
UNION ALL
SELECT *, 1 AS type FROM (SELECT DISTINCT q10, l_returnflag, l_discount, l_tax FROM li WHERE l_linestatus = 'O')""")
def q_union_typed(spark, d):
    li = lineitem(spark, d)
    cols = ["q10", "l_returnflag", "l_discount", "l_tax"]
    f = li.where(F.col("l_linestatus") == "F").select(*cols)
    o = li.where(F.col("l_linestatus") == "O").select(*cols)
    return prep.union_sources([f, o], marker="type", markers=[0, 1])


# --------------------------------------------------------------------------- IQR

def _iqr_sql(table: str, cols: list[str]) -> str:
    parts = [f"SELECT '{c}' AS feature, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {table}"
             for c in cols]
    return " UNION ALL ".join(parts)


@query("quantile_bounds", f"""
WITH {LI_SQL}, q AS ({_iqr_sql('li', FEATURES)})
SELECT feature, round(q1, 6) AS q1, round(q3, 6) AS q3, round(q3 - q1, 6) AS iqr,
       round(q1 - 1.5 * (q3 - q1), 6) AS lower, round(q3 + 1.5 * (q3 - q1), 6) AS upper
FROM q""")
def q_quantile_bounds(spark, d):
    return r6(profile.iqr_bounds(lineitem(spark, d), FEATURES))


@query("iqr_filter", f"""
WITH {EV_SQL},
b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM ev)
SELECT event_id, value FROM ev, b
WHERE NOT coalesce(value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1), false)""")
def q_iqr_filter(spark, d):
    ev = events(spark, d).select("event_id", "value")
    return profile.iqr_filter(ev, ["value"])


@query("iqr_summary", f"""
WITH {LI_SQL},
b AS (SELECT {", ".join(f"quantile_cont({c}, 0.25) AS {c}_q1, quantile_cont({c}, 0.75) AS {c}_q3" for c in FEATURES)} FROM li),
f AS (SELECT ({" OR ".join(f"coalesce({c} < {c}_q1 - 1.5 * ({c}_q3 - {c}_q1) OR {c} > {c}_q3 + 1.5 * ({c}_q3 - {c}_q1), false)" for c in FEATURES)}) AS out FROM li, b)
SELECT count(*) AS initial_rows, count(*) FILTER (WHERE NOT out) AS final_rows,
       count(*) FILTER (WHERE out) AS removed,
       round(CAST(count(*) FILTER (WHERE out) AS DOUBLE) * 100.0 / CAST(count(*) AS DOUBLE), 6) AS removed_pct
FROM f""")
def q_iqr_summary(spark, d):
    return r6(profile.iqr_summary(lineitem(spark, d), FEATURES))


# --------------------------------------------------------------------------- profiles

@query("threshold_sensitivity", f"""
WITH {LI_SQL}, t AS (SELECT unnest([6, 7, 8]) AS threshold),
c AS (SELECT threshold, count(*) AS n, count(*) FILTER (WHERE q10 >= threshold) AS n_pos
      FROM li, t GROUP BY threshold)
SELECT CAST(threshold AS INTEGER) AS threshold, n_pos, n - n_pos AS n_neg,
       round(CAST(n_pos AS DOUBLE) * 100.0 / CAST(n AS DOUBLE), 6) AS pos_pct,
       round(CAST(n - n_pos AS DOUBLE) / CAST(greatest(n_pos, 1) AS DOUBLE), 6) AS neg_per_pos
FROM c""")
def q_threshold_sensitivity(spark, d):
    return r6(profile.threshold_sensitivity(lineitem(spark, d), "q10", [6, 7, 8]))


@query("class_distribution", f"""
WITH {EV_SQL}, c AS (SELECT event_type AS class, count(*) AS n FROM ev GROUP BY 1)
SELECT class, n, round(CAST(n AS DOUBLE) / CAST(sum(n) OVER () AS DOUBLE), 6) AS frac FROM c""")
def q_class_distribution(spark, d):
    return r6(profile.class_distribution(events(spark, d), "event_type"))


@query("class_weights", f"""
WITH {EV_SQL}, c AS (SELECT label AS class, count(*) AS n FROM ev GROUP BY 1)
SELECT class, n, round(CAST(sum(n) OVER () AS DOUBLE) / CAST(count(*) OVER () * n AS DOUBLE), 6) AS weight FROM c""")
def q_class_weights(spark, d):
    return r6(profile.class_weights(events(spark, d), "label"))


@query("pos_weight", f"""
WITH {EV_SQL}
SELECT count(*) FILTER (WHERE label = 1) AS n_pos, count(*) FILTER (WHERE label = 0) AS n_neg,
       round(CAST(count(*) FILTER (WHERE label = 0) AS DOUBLE) / CAST(count(*) FILTER (WHERE label = 1) AS DOUBLE), 6) AS pos_weight
FROM ev""")
def q_pos_weight(spark, d):
    return r6(profile.pos_weight(events(spark, d), "label"))


def _corr_sql(a: str, b: str) -> str:
    if a == b:
        return f"CASE WHEN stddev_pop({a}) > 0 THEN CAST(1 AS DOUBLE) END"
    return (f"covar_pop({a}, {b}) / nullif(stddev_pop(CASE WHEN {b} IS NOT NULL THEN {a} END)"
            f" * stddev_pop(CASE WHEN {a} IS NOT NULL THEN {b} END), 0)")


@query("corr_matrix", f"""
WITH {LI_SQL}, a AS (SELECT {", ".join(f"{_corr_sql(x, y)} AS r_{i}_{j}" for i, x in enumerate(FEATURES) for j, y in enumerate(FEATURES))} FROM li)
{" UNION ALL ".join(f"SELECT '{x}' AS x, '{y}' AS y, round(r_{i}_{j}, 6) AS r FROM a" for i, x in enumerate(FEATURES) for j, y in enumerate(FEATURES))}""")
def q_corr_matrix(spark, d):
    return r6(profile.corr_matrix(lineitem(spark, d), FEATURES))


@query("label_corr_rank", f"""
WITH {LI_SQL}, lb AS (SELECT *, CASE WHEN q10 >= 7 THEN 1 ELSE 0 END AS label FROM li),
a AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, round({_corr_sql(c, 'label')}, 6) AS r FROM lb" for c in FEATURES)})
SELECT feature, r, CAST(row_number() OVER (ORDER BY r DESC NULLS LAST, feature) AS INTEGER) AS rank FROM a""")
def q_label_corr_rank(spark, d):
    res = profile.label_correlation(labelled_lineitem(spark, d), "label", FEATURES)
    return res.select("feature", F.round("r", 6).alias("r"), "rank")


@query("polarity_check", f"""
WITH {LI_SQL}, lb AS (SELECT *, CASE WHEN q10 >= 7 THEN 1 ELSE 0 END AS label FROM li),
g AS ({" UNION ALL ".join(f"SELECT l_linestatus AS grp, '{c}' AS feature, {_corr_sql(c, 'label')} AS r FROM lb GROUP BY l_linestatus" for c in FEATURES)}),
p AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, {_corr_sql(c, 'label')} AS r FROM lb" for c in FEATURES)})
SELECT g.feature, g.grp AS "group", round(g.r, 6) AS r_group, round(p.r, 6) AS r_pooled,
       coalesce(sign(g.r) * sign(p.r) < 0, false) AS sign_flip
FROM g JOIN p USING (feature)""")
def q_polarity_check(spark, d):
    res = profile.polarity_check(labelled_lineitem(spark, d), "label", "l_linestatus", FEATURES)
    return r6(res)


VIF_COLS = ["l_quantity", "l_extendedprice", "l_discount"]


def _vif_sql() -> str:
    a, b, c = VIF_COLS
    sums = (f"sum({a}*{a}) AS g11, sum({a}*{b}) AS g12, sum({a}*{c}) AS g13, "
            f"sum({b}*{b}) AS g22, sum({b}*{c}) AS g23, sum({c}*{c}) AS g33")
    return f"""
WITH {LI_SQL},
g AS (SELECT {sums} FROM li WHERE {a} IS NOT NULL AND {b} IS NOT NULL AND {c} IS NOT NULL),
d AS (SELECT *, g11*(g22*g33 - g23*g23) - g12*(g12*g33 - g23*g13) + g13*(g12*g23 - g22*g13) AS det FROM g)
SELECT '{a}' AS feature, round(g11 * (g22*g33 - g23*g23) / det, 6) AS vif FROM d
UNION ALL SELECT '{b}', round(g22 * (g11*g33 - g13*g13) / det, 6) FROM d
UNION ALL SELECT '{c}', round(g33 * (g11*g22 - g12*g12) / det, 6) FROM d"""


@query("vif_uncentered", _vif_sql())
def q_vif_uncentered(spark, d):
    return r6(profile.vif(lineitem(spark, d), VIF_COLS))


@query("vif_singular", _vif_sql() + """
UNION ALL SELECT 'zero', CAST(NULL AS DOUBLE)""")
def q_vif_singular(spark, d):
    """A column without variation leaves the others' factors finite."""
    li = lineitem(spark, d).withColumn("zero", F.lit(0.0))
    return r6(profile.vif(li, [*VIF_COLS, "zero"]))


# --------------------------------------------------------------------------- splits

MD5_EV = "md5(CAST(event_id AS VARCHAR) || ':42')"
MD5_OR = "md5(CAST(o_orderkey AS VARCHAR) || ':42')"

QUOTA_SQL = f"""c AS (SELECT label, count(*) AS n_c FROM ev GROUP BY 1),
t AS (SELECT sum(n_c) AS n, (sum(n_c) + 4) // 5 AS n_test FROM c),
qq AS (SELECT label, (n_c * n_test) // n AS base, (n_c * n_test) % n AS rem, n_test FROM c, t),
qr AS (SELECT *, row_number() OVER (ORDER BY rem DESC, label) AS rr,
              n_test - sum(base) OVER () AS leftover FROM qq),
quota AS (SELECT label, base + CASE WHEN rr <= leftover THEN 1 ELSE 0 END AS quota FROM qr),
sp AS (SELECT ev.*, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY {MD5_EV}, event_id) <= quota
                        THEN 'test' ELSE 'train' END AS split
       FROM ev JOIN quota USING (label))"""


def split_events(spark, d):
    from trellis.operators import split
    return split.stratified_split(events(spark, d), "event_id", "label")


@query("stratified_split", f"""
WITH {EV_SQL}, {QUOTA_SQL}
SELECT event_id, label, split FROM sp""")
def q_stratified_split(spark, d):
    return split_events(spark, d).select("event_id", "label", "split")


MD5_GAP = "md5(coalesce(CAST(k AS VARCHAR), chr(0)) || chr(1) || CAST(event_id AS VARCHAR) || ':42')"


@query("stratified_split_nulls", f"""
WITH ev AS (SELECT CASE WHEN event_id % 10 = 0 THEN NULL ELSE event_id END AS k, event_id,
                   CASE WHEN event_type = 'error' THEN NULL WHEN value > 100 THEN 1 ELSE 0 END AS label FROM events),
c AS (SELECT label, count(*) AS n_c FROM ev GROUP BY 1),
t AS (SELECT sum(n_c) AS n, (sum(n_c) + 4) // 5 AS n_test FROM c),
qq AS (SELECT label, (n_c * n_test) // n AS base, (n_c * n_test) % n AS rem, n_test FROM c, t),
qr AS (SELECT *, row_number() OVER (ORDER BY rem DESC, label NULLS LAST) AS rr,
              n_test - sum(base) OVER () AS leftover FROM qq),
quota AS (SELECT label, base + CASE WHEN rr <= leftover THEN 1 ELSE 0 END AS quota FROM qr)
SELECT ev.event_id, ev.label,
       CASE WHEN row_number() OVER (PARTITION BY ev.label ORDER BY {MD5_GAP}) <= quota THEN 'test' ELSE 'train' END AS split
FROM ev JOIN quota ON ev.label IS NOT DISTINCT FROM quota.label""")
def q_stratified_split_nulls(spark, d):
    """A class that is missing for error events and a key with missing parts: no row is lost."""
    from trellis.operators import split
    ev = read_table(spark, d, "events").select(
        F.when(F.col("event_id") % 10 != 0, F.col("event_id")).alias("k"), "event_id",
        F.when(F.col("event_type") != "error", (F.col("value") > 100).cast("int")).alias("label"))
    return split.stratified_split(ev, ["k", "event_id"], "label").select("event_id", "label", "split")


@query("split_verification", f"""
WITH {EV_SQL}, {QUOTA_SQL},
per AS (SELECT label AS class, count(*) FILTER (WHERE split = 'train') AS train_n,
               count(*) FILTER (WHERE split = 'test') AS test_n FROM sp GROUP BY 1),
pct AS (SELECT class, train_n, test_n,
               CAST(train_n AS DOUBLE) * 100.0 / CAST(sum(train_n) OVER () AS DOUBLE) AS train_pct,
               CAST(test_n AS DOUBLE) * 100.0 / CAST(sum(test_n) OVER () AS DOUBLE) AS test_pct FROM per)
SELECT class, train_n, test_n, round(train_pct, 6) AS train_pct, round(test_pct, 6) AS test_pct,
       round(abs(train_pct - test_pct), 6) AS diff_pp, abs(train_pct - test_pct) <= 0.5 AS within_tol
FROM pct""")
def q_split_verification(spark, d):
    return r6(profile.split_verification(split_events(spark, d), "label"))


@query("random_split", f"""
WITH n AS (SELECT (count(*) + 4) // 5 AS n_test FROM orders)
SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY {MD5_OR}, o_orderkey) <= n_test
                        THEN 'test' ELSE 'train' END AS split
FROM orders, n""")
def q_random_split(spark, d):
    from trellis.operators import split
    return split.random_split(read_table(spark, d, "orders").select("o_orderkey"), "o_orderkey")


@query("stratified_kfold", f"""
WITH {EV_SQL}
SELECT event_id, label,
       CAST((row_number() OVER (PARTITION BY label ORDER BY {MD5_EV}, event_id) - 1) % 3 AS INTEGER) AS fold
FROM ev""")
def q_stratified_kfold(spark, d):
    from trellis.operators import split
    return split.stratified_kfold(events(spark, d), "event_id", "label", k=3) \
        .select("event_id", "label", "fold")


@query("kfold", f"""
SELECT o_orderkey, CAST((row_number() OVER (ORDER BY {MD5_OR}, o_orderkey) - 1) % 5 AS INTEGER) AS fold
FROM orders""")
def q_kfold(spark, d):
    from trellis.operators import split
    return split.kfold(read_table(spark, d, "orders").select("o_orderkey"), "o_orderkey", k=5)


def _fracs_sql() -> str:
    from trellis.operators.split import LEARNING_FRACTIONS
    return ", ".join(f"CAST({repr(x)} AS DOUBLE)" for x in LEARNING_FRACTIONS)


@query("learning_subsets", f"""
WITH {EV_SQL},
fo AS (SELECT event_id, label, {MD5_EV} AS h,
              (row_number() OVER (PARTITION BY label ORDER BY {MD5_EV}, event_id) - 1) % 5 AS fold FROM ev),
ff AS (SELECT unnest(range(5)) AS f),
tr AS (SELECT ff.f, fo.label, row_number() OVER (PARTITION BY ff.f ORDER BY fo.h, fo.event_id) AS pos,
              count(*) OVER (PARTITION BY ff.f) AS n_train
       FROM fo, ff WHERE fo.fold <> ff.f),
sz AS (SELECT unnest(range(5)) AS size_idx, unnest([{_fracs_sql()}]) AS frac),
tz AS (SELECT DISTINCT f, n_train FROM tr),
grid AS (SELECT f, size_idx, CAST(floor(frac * n_train) AS BIGINT) AS train_size FROM tz, sz)
SELECT CAST(grid.f AS INTEGER) AS fold, CAST(grid.size_idx AS INTEGER) AS size_idx, grid.train_size,
       count(tr.pos) AS n_rows, CAST(coalesce(sum(tr.label), 0) AS BIGINT) AS n_pos
FROM grid LEFT JOIN tr ON tr.f = grid.f AND tr.pos <= grid.train_size
GROUP BY ALL""")
def q_learning_subsets(spark, d):
    from trellis.operators import split
    folded = cut_lineage(split.stratified_kfold(events(spark, d).select("event_id", "label"), "event_id", "label", k=5), "folds")
    return split.learning_subset_counts(folded, "event_id", "label", 5)


@query("fixed_sample", f"""
WITH {EV_SQL}
SELECT event_id, label FROM ev ORDER BY {MD5_EV}, event_id LIMIT 1000""")
def q_fixed_sample(spark, d):
    return prep.fixed_sample(events(spark, d).select("event_id", "label"), "event_id", 1000)


# --------------------------------------------------------------------------- transformers

EVN_SQL = f"""{EV_SQL}, evn AS (SELECT event_id, label, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value FROM ev),
{QUOTA_SQL.replace('FROM ev GROUP BY 1', 'FROM evn GROUP BY 1').replace('sp AS (SELECT ev.*', 'sp AS (SELECT evn.*').replace('FROM ev JOIN quota', 'FROM evn JOIN quota')}"""


def events_with_gaps(spark, d):
    """``value`` is missing for error events: a data-driven gap pattern."""
    from trellis.operators import split
    ev = events(spark, d).select(
        "event_id", "label", F.when(F.col("event_type") == "error", F.lit(None).cast("double"))
        .otherwise(F.col("value")).alias("value"))
    # the quantile passes and the transform read the split, which is not made again for each
    return cut_lineage(split.stratified_split(ev, "event_id", "label"), "split")


@query("median_impute", f"""
WITH {EVN_SQL},
m AS (SELECT quantile_cont(value, 0.5) AS med FROM sp WHERE split = 'train')
SELECT event_id, split, round(coalesce(value, med), 6) AS value_imputed FROM sp, m""")
def q_median_impute(spark, d):
    from trellis.operators.transform import fit_median_imputer
    sp = events_with_gaps(spark, d)
    model = fit_median_imputer(sp.where(F.col("split") == "train"), ["value"], suffix="_imputed")
    return r6(model.transform(sp).select("event_id", "split", "value_imputed"))


@query("standard_scale", f"""
WITH {EV_SQL}, {QUOTA_SQL},
m AS (SELECT avg(value) AS mu, coalesce(nullif(stddev_pop(value), 0), 1) AS sd FROM sp WHERE split = 'train')
SELECT event_id, split, round((value - mu) / sd, 6) AS value_scaled FROM sp, m""")
def q_standard_scale(spark, d):
    from trellis.operators.transform import fit_standard_scaler
    sp = split_events(spark, d)
    model = fit_standard_scaler(sp.where(F.col("split") == "train"), ["value"], suffix="_scaled")
    return r6(model.transform(sp).select("event_id", "split", "value_scaled"))


# --------------------------------------------------------------------------- scored table

SC_SQL = f"""{EV_SQL}, sc AS (
  SELECT event_id, label, value,
         least(CAST(1 AS DOUBLE), greatest(CAST(0 AS DOUBLE), value / 100)) AS s,
         CASE WHEN least(CAST(1 AS DOUBLE), greatest(CAST(0 AS DOUBLE), value / 100)) >= 0.5 THEN 1 ELSE 0 END AS prediction
  FROM ev)"""

CURVE_SQL = f"""{SC_SQL},
dd AS (SELECT s AS score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg
       FROM sc GROUP BY 1),
cc AS (SELECT *, sum(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tps,
               sum(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fps,
               lead(pos) OVER (ORDER BY score DESC) AS next_pos, lead(neg) OVER (ORDER BY score DESC) AS next_neg,
               row_number() OVER (ORDER BY score DESC) AS rn
       FROM dd),
tt AS (SELECT sum(pos) AS P, sum(neg) AS N FROM dd),
auc AS (SELECT CAST(sum(pos * (2 * N - 2 * fps + neg)) AS DOUBLE) / CAST(2 * P * N AS DOUBLE) AS roc_auc FROM cc, tt GROUP BY P, N),
pr AS (SELECT score AS threshold, CAST(tps AS DOUBLE) / CAST(tps + fps AS DOUBLE) AS precision,
              CAST(tps AS DOUBLE) / CAST(P AS DOUBLE) AS recall FROM cc, tt),
prf AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2.0 * precision * recall / (precision + recall) END AS f1 FROM pr)"""


def scored_events(spark, d):
    s = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("value") / 100))
    return events(spark, d).select("event_id", "label", "value", s.alias("s"),
                                   F.when(s >= 0.5, 1).otherwise(0).alias("prediction"))


def _counts_sql(pred: str = "prediction", src: str = "sc") -> str:
    return (f"SELECT count(*) FILTER (WHERE label = 1 AND {pred} = 1) AS tp, count(*) FILTER (WHERE label = 0 AND {pred} = 1) AS fp, "
            f"count(*) FILTER (WHERE label = 1 AND {pred} = 0) AS fn, count(*) FILTER (WHERE label = 0 AND {pred} = 0) AS tn FROM {src}")


def _metric_cols_sql() -> str:
    return ("round(CAST(tp + tn AS DOUBLE) / CAST(tp + fp + fn + tn AS DOUBLE), 6) AS accuracy, "
            "round(coalesce(CAST(tp AS DOUBLE) / nullif(CAST(tp + fp AS DOUBLE), 0), 0), 6) AS precision, "
            "round(coalesce(CAST(tp AS DOUBLE) / nullif(CAST(tp + fn AS DOUBLE), 0), 0), 6) AS recall, "
            "round(coalesce(2.0 * tp / nullif(2.0 * tp + fp + fn, 0), 0), 6) AS f1")


@query("confusion_matrix", f"""
WITH {SC_SQL}, c AS ({_counts_sql()})
SELECT 1 AS actual, 1 AS predicted, tp AS n FROM c UNION ALL SELECT 0, 1, fp FROM c
UNION ALL SELECT 1, 0, fn FROM c UNION ALL SELECT 0, 0, tn FROM c""")
def q_confusion_matrix(spark, d):
    from trellis.operators.metrics import confusion_matrix
    return confusion_matrix(scored_events(spark, d))


@query("binary_metrics", f"""
WITH {CURVE_SQL}, c AS ({_counts_sql()})
SELECT 'score_rule' AS model, {_metric_cols_sql()}, round(roc_auc, 6) AS roc_auc FROM c, auc""")
def q_binary_metrics(spark, d):
    from trellis.operators.metrics import binary_metrics
    return r6(binary_metrics(scored_events(spark, d), "label", "prediction", "s", "score_rule"))


@query("classification_report", f"""
WITH {SC_SQL}, c AS ({_counts_sql()}),
per AS (SELECT '0' AS class, CAST(tn AS DOUBLE) / nullif(tn + fn, 0) AS precision, CAST(tn AS DOUBLE) / nullif(tn + fp, 0) AS recall, tn + fp AS support FROM c
        UNION ALL SELECT '1', CAST(tp AS DOUBLE) / nullif(tp + fp, 0), CAST(tp AS DOUBLE) / nullif(tp + fn, 0), tp + fn FROM c),
pf AS (SELECT class, coalesce(precision, 0) AS precision, coalesce(recall, 0) AS recall,
              coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1, support FROM per)
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM pf
UNION ALL SELECT 'accuracy', NULL, NULL, round(CAST(tp + tn AS DOUBLE) / (tp + fp + fn + tn), 6), tp + fp + fn + tn FROM c
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM pf
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
                 round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM pf""")
def q_classification_report(spark, d):
    from trellis.operators.metrics import classification_report
    return r6(classification_report(scored_events(spark, d)))


@query("roc_auc", f"""
WITH {CURVE_SQL}
SELECT round(roc_auc, 6) AS roc_auc FROM auc""")
def q_roc_auc(spark, d):
    from trellis.operators.curves import roc_auc
    return r6(roc_auc(scored_events(spark, d), "label", "s"))


@query("roc_curve", f"""
WITH {CURVE_SQL}
SELECT CAST(NULL AS DOUBLE) AS threshold, CAST(0 AS DOUBLE) AS fpr, CAST(0 AS DOUBLE) AS tpr
UNION ALL
SELECT round(score, 6), round(CAST(fps AS DOUBLE) / CAST(N AS DOUBLE), 6), round(CAST(tps AS DOUBLE) / CAST(P AS DOUBLE), 6)
FROM cc, tt WHERE rn = 1 OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg""")
def q_roc_curve(spark, d):
    from trellis.operators.curves import roc_curve
    return r6(roc_curve(scored_events(spark, d), "label", "s"))


@query("pr_curve", f"""
WITH {CURVE_SQL}
SELECT round(threshold, 6) AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM prf""")
def q_pr_curve(spark, d):
    from trellis.operators.curves import pr_curve
    return r6(pr_curve(scored_events(spark, d), "label", "s"))


@query("best_threshold", f"""
WITH {CURVE_SQL}
SELECT round(threshold, 6) AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1
FROM prf ORDER BY f1 DESC, threshold ASC LIMIT 1""")
def q_best_threshold(spark, d):
    from trellis.operators.curves import best_threshold
    return r6(best_threshold(scored_events(spark, d), "label", "s"))


@query("tuned_metrics", f"""
WITH {CURVE_SQL}, bt AS (SELECT threshold FROM prf ORDER BY f1 DESC, threshold ASC LIMIT 1),
tp AS (SELECT sc.*, CASE WHEN s >= bt.threshold THEN 1 ELSE 0 END AS tuned FROM sc, bt),
c AS ({_counts_sql('tuned', 'tp')})
SELECT 'score_rule_tuned' AS model, {_metric_cols_sql()}, round(roc_auc, 6) AS roc_auc, round(bt.threshold, 6) AS threshold
FROM c, auc, bt""")
def q_tuned_metrics(spark, d):
    from trellis.operators.curves import best_threshold_value, roc_auc_value, score_counts, tuned_metrics
    sc = scored_events(spark, d)
    counts = score_counts(sc, "label", "s")   # one distinct-score table for both
    t = best_threshold_value(sc, "label", "s", counts)
    auc = roc_auc_value(sc, "label", "s", counts)
    return r6(tuned_metrics(sc, "label", "s", t, "score_rule_tuned", auc))


def _calib_sql() -> str:
    from trellis.operators.curves import calibration_edges
    edges = calibration_edges()[1:-1]
    return " + ".join(f"CASE WHEN s > CAST({repr(e)} AS DOUBLE) THEN 1 ELSE 0 END" for e in edges)


@query("calibration_bins", f"""
WITH {SC_SQL}
SELECT CAST({_calib_sql()} AS INTEGER) AS bin, count(*) AS n, round(avg(s), 6) AS mean_predicted,
       round(avg(CAST(label AS DOUBLE)), 6) AS fraction_positive
FROM sc GROUP BY 1""")
def q_calibration_bins(spark, d):
    from trellis.operators.curves import calibration_bins
    return r6(calibration_bins(scored_events(spark, d), "label", "s"))


@query("first_positive", f"""
WITH {SC_SQL}
SELECT event_id, round(s, 6) AS s, prediction FROM sc ORDER BY prediction DESC, event_id LIMIT 1""")
def q_first_positive(spark, d):
    return r6(prep.first_positive(scored_events(spark, d), "event_id").select("event_id", "s", "prediction"))


# --------------------------------------------------------------------------- regression

REG_SQL = f"""{LI_SQL}, rg AS (SELECT l_quantity AS actual, l_extendedprice / 1500 AS predicted,
                                     l_quantity - l_extendedprice / 1500 AS e FROM li)"""


def regression_frame(spark, d):
    li = lineitem(spark, d)
    return li.select(F.col("l_quantity").alias("actual"), (F.col("l_extendedprice") / 1500).alias("predicted"))


@query("regression_metrics", f"""
WITH {REG_SQL}
SELECT count(*) AS n, round(avg(e * e), 6) AS mse, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(abs(e)), 6) AS mae,
       round(1 - sum(e * e) / (var_pop(actual) * count(actual)), 6) AS r2 FROM rg""")
def q_regression_metrics(spark, d):
    from trellis.operators.metrics import regression_metrics
    return r6(regression_metrics(regression_frame(spark, d)))


@query("residual_hist", f"""
WITH {REG_SQL}, b AS (SELECT min(e) AS mn, max(e) AS mx FROM rg),
h AS (SELECT CAST(least(floor((e - mn) * 30 / (mx - mn)), 29) AS INTEGER) AS bin, count(*) AS n FROM rg, b GROUP BY 1),
bins AS (SELECT CAST(unnest(range(30)) AS INTEGER) AS bin)
SELECT bins.bin, round(mn + bins.bin * (mx - mn) / 30, 6) AS lo, round(mn + (bins.bin + 1) * (mx - mn) / 30, 6) AS hi,
       coalesce(n, 0) AS n
FROM bins CROSS JOIN b LEFT JOIN h ON h.bin = bins.bin""")
def q_residual_hist(spark, d):
    from trellis.operators.metrics import histogram
    rf = regression_frame(spark, d).select((F.col("actual") - F.col("predicted")).alias("e"))
    return r6(histogram(rf, "e", 30))


# --------------------------------------------------------------------------- fold scores

FOLD_SQL = f"""{SC_SQL},
fo AS (SELECT sc.*, CASE WHEN value >= 30 THEN 1 ELSE 0 END AS pred_b,
              (row_number() OVER (PARTITION BY label ORDER BY {MD5_EV}, event_id) - 1) % 10 AS fold FROM sc),
fc AS (SELECT fold,
              count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp_a, count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp_a,
              count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn_a,
              count(*) FILTER (WHERE label = 1 AND pred_b = 1) AS tp_b, count(*) FILTER (WHERE label = 0 AND pred_b = 1) AS fp_b,
              count(*) FILTER (WHERE label = 1 AND pred_b = 0) AS fn_b FROM fo GROUP BY fold),
fs AS (SELECT 'rule_a' AS model, CAST(fold AS INTEGER) AS fold, coalesce(2.0 * tp_a / nullif(2.0 * tp_a + fp_a + fn_a, 0), 0) AS score FROM fc
       UNION ALL SELECT 'rule_b', CAST(fold AS INTEGER), coalesce(2.0 * tp_b / nullif(2.0 * tp_b + fp_b + fn_b, 0), 0) FROM fc)"""


def fold_score_table(spark, d):
    from trellis.operators import split
    from trellis.operators.metrics import fold_scores
    sc = scored_events(spark, d).withColumn("pred_b", F.when(F.col("value") >= 30, 1).otherwise(0))
    folded = split.stratified_kfold(sc, "event_id", "label", k=10)
    return fold_scores(folded, {"rule_a": "prediction", "rule_b": "pred_b"})


@query("cv_scores", f"""
WITH {FOLD_SQL}
SELECT model, fold, round(score, 6) AS score FROM fs""")
def q_cv_scores(spark, d):
    return r6(fold_score_table(spark, d))


@query("cv_summary", f"""
WITH {FOLD_SQL}
SELECT model, count(*) AS n_folds, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std FROM fs GROUP BY model""")
def q_cv_summary(spark, d):
    from trellis.operators.metrics import cv_summary
    return r6(cv_summary(fold_score_table(spark, d)))


def _t_p_sql(t: str, dof: int) -> str:
    """Closed-form two-sided p for odd ``dof`` (Abramowitz & Stegun 26.7.4)."""
    theta = f"atan(abs({t}) / sqrt({dof}))"
    c2 = f"pow(cos({theta}), 2)"
    terms, coef = ["1.0"], 1.0
    power = "1.0"
    for j in range(1, (dof - 1) // 2):
        coef *= (2.0 * j) / (2.0 * j + 1.0)
        power = f"({power} * {c2})"
        terms.append(f"CAST({repr(coef)} AS DOUBLE) * {power}")
    series = " + ".join(terms)
    return f"1.0 - (2.0 / pi()) * ({theta} + sin({theta}) * cos({theta}) * ({series}))"


@query("paired_t_test", f"""
WITH {FOLD_SQL},
pp AS (SELECT fold, max(score) FILTER (WHERE model = 'rule_a') AS a, max(score) FILTER (WHERE model = 'rule_b') AS b FROM fs GROUP BY fold),
st AS (SELECT count(*) AS n, avg(a - b) AS mean_diff, stddev_samp(a - b) AS sd FROM pp),
tt AS (SELECT *, mean_diff / (sd / sqrt(n)) AS t_stat FROM st)
SELECT 'rule_a' AS model_a, 'rule_b' AS model_b, n, round(mean_diff, 6) AS mean_diff, round(t_stat, 6) AS t_stat,
       round({_t_p_sql('t_stat', 9)}, 6) AS p_value,
       ({_t_p_sql('t_stat', 9)}) < 0.05 AS significant, n >= 5 AS reliable
FROM tt""")
def q_paired_t_test(spark, d):
    from trellis.operators.metrics import paired_t_test
    return r6(paired_t_test(fold_score_table(spark, d), "rule_a", "rule_b"))


@query("box_stats", f"""
WITH {FOLD_SQL},
q AS (SELECT model, quantile_cont(score, 0.25) AS q1, quantile_cont(score, 0.5) AS median, quantile_cont(score, 0.75) AS q3 FROM fs GROUP BY model)
SELECT model, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
       round(min(score) FILTER (WHERE score >= q1 - 1.5 * (q3 - q1)), 6) AS whisker_low,
       round(max(score) FILTER (WHERE score <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_high,
       count(*) FILTER (WHERE score < q1 - 1.5 * (q3 - q1) OR score > q3 + 1.5 * (q3 - q1)) AS n_fliers
FROM fs JOIN q USING (model) GROUP BY model, q1, median, q3""")
def q_box_stats(spark, d):
    from trellis.operators.metrics import box_stats
    return r6(box_stats(fold_score_table(spark, d)))


@query("majority_baseline", f"""
WITH {EV_SQL}, {QUOTA_SQL},
mj AS (SELECT label AS majority FROM sp WHERE split = 'train' GROUP BY label ORDER BY count(*) DESC, label LIMIT 1),
te AS (SELECT sp.label, mj.majority AS pred FROM sp, mj WHERE split = 'test'),
cm AS ({_counts_sql('pred', 'te')})
SELECT 'Baseline (majority)' AS model, {_metric_cols_sql()}, CAST(0.5 AS DOUBLE) AS roc_auc FROM cm""")
def q_majority_baseline(spark, d):
    from trellis.operators.metrics import majority_baseline
    sp = split_events(spark, d)
    return r6(majority_baseline(sp.where(F.col("split") == "train"), sp.where(F.col("split") == "test")))


@query("model_comparison", f"""
WITH {FOLD_SQL},
ca AS ({_counts_sql('prediction', 'fo')}), cb AS ({_counts_sql('pred_b', 'fo')})
SELECT 'rule_a' AS model, {_metric_cols_sql()}, CAST(0.5 AS DOUBLE) AS roc_auc, 0 AS ord FROM ca
UNION ALL SELECT 'rule_b', {_metric_cols_sql()}, CAST(0.5 AS DOUBLE), 1 FROM cb""")
def q_model_comparison(spark, d):
    from trellis.operators.metrics import binary_metrics, compare_models
    sc = scored_events(spark, d).withColumn("pred_b", F.when(F.col("value") >= 30, 1).otherwise(0))
    return r6(compare_models([binary_metrics(sc, "label", "prediction", None, "rule_a"),
                              binary_metrics(sc, "label", "pred_b", None, "rule_b")]))


# --------------------------------------------------------------------------- linear attributions

# Coefficients with long binary mantissas: short decimals such as 1.5 make
# phi = c * (x - mean) land exactly on a 6-digit rounding tie, where Spark
# (half-up on the exact value) and DuckDB (rounding the scaled double) differ.
LINEAR_COEF = {"l_quantity": 0.0213, "l_extendedprice": 0.0000117, "l_discount": -1.537, "l_tax": 2.113}


def _lin_sql() -> str:
    means = ", ".join(f"avg({c}) AS m_{c}" for c in LINEAR_COEF)
    rows = " UNION ALL ".join(
        f"SELECT l_orderkey, l_linenumber, label, '{c}' AS feature, {c} AS value, "
        f"CAST({repr(w)} AS DOUBLE) * ({c} - m_{c}) AS phi, l_quantity, l_extendedprice, l_discount, l_tax FROM lil, m"
        for c, w in LINEAR_COEF.items())
    return f"{LI_SQL}, m AS (SELECT {means} FROM li), att AS ({rows})"


def linear_attr_frame(spark, d):
    from trellis.operators.explain import linear_attributions
    return linear_attributions(labelled_lineitem(spark, d), ["l_orderkey", "l_linenumber", "label"], LINEAR_COEF)


@query("linear_shap", f"""
WITH {_lin_sql()}
SELECT l_orderkey, l_linenumber, feature, round(value, 6) AS value, round(phi, 6) AS phi FROM att""")
def q_linear_shap(spark, d):
    return r6(linear_attr_frame(spark, d).drop("label"))


@query("linear_shap_global", f"""
WITH {_lin_sql()}
SELECT feature, round(avg(abs(phi)), 6) AS mean_abs_phi FROM att GROUP BY feature""")
def q_linear_shap_global(spark, d):
    from trellis.operators.explain import global_importance
    return r6(global_importance(linear_attr_frame(spark, d)))


def _picked_attributions(spark, d):
    from trellis.operators.explain import linear_attributions
    li = labelled_lineitem(spark, d)
    order = [F.col("label").desc(), "l_orderkey", "l_linenumber", *FEATURES]
    pick = li.orderBy(*order).limit(1)   # the P9 row: first positive, else first
    return linear_attributions(pick, ["l_orderkey", "l_linenumber"], LINEAR_COEF, background=li)


@query("local_explanation_folded", f"""
WITH {_lin_sql()},
pick AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lil
         ORDER BY label DESC, l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax LIMIT 1),
r AS (SELECT feature, value, phi, CAST(row_number() OVER (ORDER BY abs(phi) DESC, feature) AS INTEGER) AS rank
      FROM att JOIN pick USING (l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax))
SELECT 4 AS shown, feature, round(value, 6) AS value, round(phi, 6) AS phi, rank FROM r
UNION ALL SELECT 3, feature, round(value, 6), round(phi, 6), rank FROM r WHERE rank < 3
UNION ALL SELECT 3, 'other', NULL, round(sum(phi), 6), 3 FROM r WHERE rank >= 3""")
def q_local_explanation_folded(spark, d):
    """As many features as the limit are all shown; one more, and the rest is summed."""
    from trellis.operators.explain import local_explanation
    att = _picked_attributions(spark, d)
    parts = [local_explanation(att, limit, ["l_orderkey", "l_linenumber"]).select(
        F.lit(limit).alias("shown"), "feature", "value", "phi", F.col("rank").cast("int")) for limit in (4, 3)]
    return r6(parts[0].unionByName(parts[1]))


@query("local_explanation", f"""
WITH {_lin_sql()},
pick AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lil
         ORDER BY label DESC, l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax LIMIT 1)
SELECT feature, round(value, 6) AS value, round(phi, 6) AS phi,
       CAST(row_number() OVER (ORDER BY abs(phi) DESC, feature) AS INTEGER) AS rank
FROM att JOIN pick USING (l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax)""")
def q_local_explanation(spark, d):
    from trellis.operators.explain import local_explanation
    att = _picked_attributions(spark, d)
    return r6(local_explanation(att, keys=["l_orderkey", "l_linenumber"])
              .select("feature", "value", "phi", F.col("rank").cast("int")))


# --------------------------------------------------------------------------- models (rows-only checks)

MODEL_FEATURES = ["l_extendedprice", "l_discount", "l_tax"]


def lineitem_frame(spark, sf_dir: str) -> DataFrame:
    """lineitem as a labelled modelling table: dedup at load, the 0-9 score and its label, a content key."""
    li = lineitem(spark, sf_dir).select("q10", "l_extendedprice", "l_discount", "l_tax", "l_linestatus")
    return prep.row_key(prep.binary_label(prep.dedup(li), "q10", "label", 7), "row_key")


def flagship(spark, d):
    """Model comparison (baseline, LR, RF, GBT) on a leak-safe split."""
    from trellis.plans import workflow
    df = lineitem_frame(spark, d)
    res = workflow.classification(df, "row_key", "label", MODEL_FEATURES)
    return r6(res.comparison)


@query("ml_model_comparison")
def q_ml_model_comparison(spark, d):
    return flagship(spark, d)


@query("ml_model_comparison_smote")
def q_ml_model_comparison_smote(spark, d):
    """The same comparison with SMOTE on the training rows instead of weights."""
    from trellis.plans import workflow
    df = lineitem_frame(spark, d)
    res = workflow.classification(df, "row_key", "label", MODEL_FEATURES, resample="smote")
    return r6(res.comparison)


# --------------------------------------------------------------------------- preparation inside folds

FOLDED_EVENTS_SQL = f"""{EV_SQL},
fo AS (SELECT event_id, label, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value,
       CAST((row_number() OVER (PARTITION BY label ORDER BY {MD5_EV}, event_id) - 1) % 5 AS INTEGER) AS fold FROM ev),
ff AS (SELECT unnest(range(5)) AS f)"""


@query("impute_scale_pipeline", f"""
WITH {FOLDED_EVENTS_SQL},
med AS (SELECT f, quantile_cont(value, 0.5) AS med FROM ff, fo WHERE fold <> f GROUP BY f),
st AS (SELECT f, avg(coalesce(value, med)) AS mu, stddev_pop(coalesce(value, med)) AS sd
       FROM med JOIN fo ON fold <> f GROUP BY f)
SELECT event_id, fold, round((coalesce(value, med) - mu) / sd, 6) + 0 AS prepared
FROM fo JOIN med ON med.f = fold JOIN st ON st.f = fold""")
def q_impute_scale_pipeline(spark, d):
    """Every row prepared by the preparation of the fold that holds it out: median, mean and
    deviation of the other folds. The statistics of all folds come from one search and one aggregate."""
    from trellis.operators import split
    from trellis.operators.preparation import Preparation, fold_parts
    ev = events(spark, d).select("event_id", "label", F.when(F.col("event_type") != "error", F.col("value")).alias("value"))
    folded = cut_lineage(split.stratified_kfold(ev, "event_id", "label", k=5), "folds")
    steps = Preparation("event_id", "label", ["value"], scale=True)
    held = fold_parts(folded, steps, "fold", range(5)).where("part = 'validation'")
    return r6(held.select(F.col("event_id").cast("long").alias("event_id"), "fold", F.col(steps.columns[0]).alias("prepared")))


@query("fold_smote_counts", """
WITH j AS (SELECT l.doc_id, l.quality AS label FROM labels l JOIN documents d USING (doc_id)),
fo AS (SELECT label, (row_number() OVER (PARTITION BY label ORDER BY md5(CAST(doc_id AS VARCHAR) || ':42')) - 1) % 5 AS fold FROM j),
ff AS (SELECT CAST(unnest(range(5)) AS INTEGER) AS f),
tr AS (SELECT f, label, count(*) AS n FROM ff JOIN fo ON fold <> f GROUP BY f, label),
few AS (SELECT f, label, (SELECT max(n) FROM tr t WHERE t.f = tr.f) - n AS more,
               row_number() OVER (PARTITION BY f ORDER BY n, CAST(label AS VARCHAR)) AS k FROM tr)
SELECT f AS fold, 'train' AS part, label, false AS synthetic, n AS n_rows FROM tr
UNION ALL SELECT f, 'train', label, true, more FROM few WHERE k = 1 AND more > 0
UNION ALL SELECT f, 'validation', label, false, count(*) FROM ff JOIN fo ON fold = f GROUP BY f, label""")
def q_fold_smote_counts(spark, d):
    """What the learner of every fold sees: SMOTE inside the training part, real rows held out."""
    from trellis.operators import split
    from trellis.operators.preparation import Preparation, fold_parts
    docs = labelled_documents(spark, d)
    folded = cut_lineage(split.stratified_kfold(docs, "doc_id", "label", k=5), "folds")
    parts = fold_parts(folded, Preparation("doc_id", "label", ["n_chars", "n_words"], scale=True, resample="smote"), "fold", range(5))
    return parts.groupBy("fold", "part", "label", "synthetic").agg(F.count(F.lit(1)).alias("n_rows"))


# --------------------------------------------------------------------------- sources

@query("csv_scan", """
SELECT o_orderkey, o_orderstatus, round(o_totalprice, 6) + 0 AS o_totalprice FROM orders WHERE o_orderkey % 7 <> 0""")
def q_csv_scan(spark, d):
    """A CSV copy of ``orders`` under a sniffed delimiter, typed from its header without an inference
    pass; lines whose price is no number are rejected, the others come through."""
    rows, _ = _orders_csv(spark, d)
    return r6(rows)


@query("csv_rejected", """
SELECT CAST(o_orderkey AS VARCHAR) AS key, o_orderstatus || ';n/a' AS rest FROM orders WHERE o_orderkey % 7 = 0""")
def q_csv_rejected(spark, d):
    _, rejected = _orders_csv(spark, d)
    return rejected.select(F.substring_index("line", ";", 1).alias("key"), F.expr("substring(line, instr(line, ';') + 1)").alias("rest"))


def _orders_csv(spark, d):
    import uuid

    from trellis.session import checkpoint_dir
    from trellis.sources.io import scan_csv
    path = f"{checkpoint_dir(spark).rstrip('/')}/orders-{uuid.uuid4().hex}"
    price = F.when(F.col("o_orderkey") % 7 == 0, F.lit("n/a")).otherwise(F.col("o_totalprice").cast("string"))
    read_table(spark, d, "orders").select("o_orderkey", "o_orderstatus", price.alias("o_totalprice")) \
        .write.option("header", True).option("sep", ";").csv(path)
    return scan_csv(spark, path, "o_orderkey bigint, o_orderstatus string, o_totalprice double")


# --------------------------------------------------------------------------- SMOTE

def labelled_documents(spark, d):
    """``labels`` joined to ``documents``; label 1 = quality; length features
    standardised on the whole table (SMOTE runs after the scaler)."""
    from trellis.operators.transform import fit_standard_scaler
    lab = read_table(spark, d, "labels").select("doc_id", F.col("quality").alias("label"))
    doc = read_table(spark, d, "documents").select(
        "doc_id", F.col("n_chars").cast("double").alias("n_chars"),
        F.size(F.split(F.col("text"), r"\s+")).cast("double").alias("n_words"))
    df = lab.join(doc, on="doc_id", how="inner")
    sc = fit_standard_scaler(df, ["n_chars", "n_words"])
    return sc.transform(df)


def _labelled_documents_sql() -> str:
    z = lambda c: f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()"
    return f"""raw AS (SELECT doc_id, quality AS label, CAST(n_chars AS DOUBLE) AS n_chars,
      CAST(len(string_split_regex(text, '\\s+')) AS DOUBLE) AS n_words FROM labels JOIN documents USING (doc_id)),
j AS (SELECT doc_id, label, {z('n_chars')} AS n_chars, {z('n_words')} AS n_words FROM raw)"""


def _smote_sql(k: int, seed: int, feats: list[str]) -> str:
    """Brute force: every pair of minority rows, the k nearest by distance, then by coordinates."""
    d2 = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in feats)
    row = ", ".join(f"round(p.{c} + u * (s.{c} - p.{c}), 6) + 0 AS {c}" for c in feats)
    return f"""cnt AS (SELECT label, count(*) AS n FROM j GROUP BY label),
few AS (SELECT label, n, (SELECT max(n) FROM cnt) - n AS more FROM cnt ORDER BY n, CAST(label AS VARCHAR) LIMIT 1),
p AS (SELECT CAST(j.doc_id AS VARCHAR) AS doc_id, j.label, {', '.join(feats)}, few.n, few.more, least({k}, few.n - 1) AS k,
      row_number() OVER (ORDER BY md5(CAST(j.doc_id AS VARCHAR) || ':{seed}')) AS rank FROM j JOIN few USING (label)),
s AS (SELECT a.doc_id, {', '.join('b.' + c for c in feats)}, row_number() OVER (PARTITION BY a.doc_id
      ORDER BY {d2}, {', '.join('b.' + c for c in feats)}) - 1 AS slot FROM p a JOIN p b ON a.doc_id <> b.doc_id),
c AS (SELECT p.*, unnest(range(more // n + CASE WHEN rank <= more % n THEN 1 ELSE 0 END)) AS copy FROM p WHERE n > 1),
h AS (SELECT *, md5(doc_id || '|' || copy || '|{seed}') AS h FROM c),
g AS (SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % k AS slot, ('0x' || substr(h, 9, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u FROM h)
SELECT CAST(doc_id AS VARCHAR) AS doc_id, label, {', '.join(f'round({c}, 6) + 0 AS {c}' for c in feats)}, false AS synthetic FROM j
UNION ALL
SELECT p.doc_id || '#' || copy, label, {row}, true FROM g p JOIN s USING (doc_id, slot)"""


@query("smote", f"WITH {_labelled_documents_sql()}, {_smote_sql(5, 42, ['n_chars', 'n_words'])}")
def q_smote(spark, d):
    from trellis.operators.resample import smote
    return r6(smote(labelled_documents(spark, d), "doc_id", "label", ["n_chars", "n_words"]))


@query("smote_counts", """
WITH j AS (SELECT l.quality AS label FROM labels l JOIN documents d USING (doc_id)),
c AS (SELECT label, count(*) AS n FROM j GROUP BY label),
m AS (SELECT min(n) AS n_min, max(n) AS n_max FROM c),
mi AS (SELECT label FROM c, m WHERE n = n_min ORDER BY CAST(label AS VARCHAR) LIMIT 1)
SELECT c.label, false AS synthetic, c.n FROM c
UNION ALL
SELECT mi.label, true, n_max - n_min FROM mi, m WHERE n_max > n_min""")
def q_smote_counts(spark, d):
    from trellis.operators.resample import smote
    out = smote(labelled_documents(spark, d), "doc_id", "label", ["n_chars", "n_words"])
    return out.groupBy("label", "synthetic").agg(F.count(F.lit(1)).alias("n"))


def model_split(spark, d):
    """Prepared lineitem modelling table with its exact stratified split."""
    from trellis.plans import workflow
    df = lineitem_frame(spark, d)
    return workflow.prepare(df, "row_key", "label", MODEL_FEATURES + ["q10"], checkpoint=True)


def _train_test(spark, d):
    sp = model_split(spark, d)
    return sp.where(F.col("split") == "train"), sp.where(F.col("split") == "test")


def _folded(spark, d, k: int):
    """The training rows with their fold, what a learner needs of them; the split goes when they are written."""
    from trellis.operators import split
    train, _ = _train_test(spark, d)
    folded = cut_lineage(split.stratified_kfold(train.select("row_key", "label", *MODEL_FEATURES), "row_key", "label", k=k), "folds")
    forget(train)
    return folded


@query("lr_coefficients")
def q_lr_coefficients(spark, d):
    from pyspark.ml import Pipeline

    from trellis.operators import models, profile
    from trellis.operators.transform import fit_standard_scaler
    train, _ = _train_test(spark, d)
    train = profile.with_class_weights(train, "label", "weight")
    sc = fit_standard_scaler(train, MODEL_FEATURES, suffix="__z")
    n_w = train.agg(F.sum("weight")).first()[0]
    pipe = Pipeline(stages=[sc.as_stage(), models.assembler([f + "__z" for f in MODEL_FEATURES]),
                            models.logistic_regression(n_w, "label", "weight")]).fit(train)
    lr = pipe.stages[-1]
    rows = [(f, float(c)) for f, c in zip(MODEL_FEATURES, lr.coefficients.toArray())]
    rows.append(("intercept", float(lr.intercept)))
    return spark.createDataFrame(rows, "feature string, coefficient double")


def _model(kind: str, balanced: bool = True, **sizes):
    """A function from a training part to a fitted pipeline, by default at the flows' sizes; the part's
    medians and weights are fitted with it."""
    from trellis.plans import workflow
    _, steps, learner = workflow.recipe(kind, "row_key", "label", MODEL_FEATURES, workflow.ModelSizes(**sizes), balanced)
    return steps.model(learner)


#: sizes of the learners that are fitted for every fold or subset (10 to 25 times a query) or explained leaf by leaf
FOLD_SIZES = {"rf_trees": 20, "rf_depth": 8, "gbt_iter": 20, "gbt_depth": 4}


@query("rf_feature_importance")
def q_rf_feature_importance(spark, d):
    from trellis.operators import models
    m = _model("rf")(_train_test(spark, d)[0])
    return models.feature_importance(m, MODEL_FEATURES, spark)


@query("gbt_feature_importance")
def q_gbt_feature_importance(spark, d):
    from trellis.operators import models
    m = _model("gbt")(_train_test(spark, d)[0])
    return models.feature_importance(m, MODEL_FEATURES, spark)


SPLIT_FEATURES = ["l_quantity", "l_discount", "l_tax"]


def _gain_sql(features: list[str], reg: float, least: float) -> str:
    """Search of the best first split: every distinct value of every feature as a cut."""
    cells = " UNION ALL ".join(f"SELECT {i} AS f, '{c}' AS feature, {c} AS cut, sum(0.5 - y) AS g, count(*) * 0.25 AS h FROM r GROUP BY {c}"
                               for i, c in enumerate(features))
    value = lambda g, h: f"({g}) * ({g}) / (({h}) + {reg})"
    return f"""cells AS ({cells}),
s AS (SELECT f, feature, cut, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(g) OVER (PARTITION BY f) AS g,
             sum(h) OVER (PARTITION BY f) AS h FROM cells WINDOW w AS (PARTITION BY f ORDER BY cut)),
b AS (SELECT *, {value('gl', 'hl')} + {value('g - gl', 'h - hl')} - {value('g', 'h')} AS gain FROM s
      WHERE hl >= {least} AND h - hl >= {least} ORDER BY gain DESC, f, cut LIMIT 1)"""


@query("boost_first_split", f"""
WITH {LI_SQL}, r AS (SELECT {', '.join(SPLIT_FEATURES)}, CAST(l_extendedprice >= 50000 AS INT) AS y FROM li),
{_gain_sql(SPLIT_FEATURES, 1.0, 1.0)}
SELECT feature, round(cut, 6) + 0 AS threshold, round(gain, 6) AS gain, round(-0.1 * gl / (hl + 1.0), 6) AS left_value,
       round(-0.1 * (g - gl) / (h - hl + 1.0), 6) AS right_value FROM b""")
def q_boost_first_split(spark, d):
    """First split of the second-order boosted trees: feature, cut, gain and the two leaf values."""
    import json

    from trellis.operators import models
    from trellis.operators.boosting import NewtonBoosting
    rows = lineitem(spark, d).withColumn("y", (F.col("l_extendedprice") >= 50000).cast("int"))
    model = NewtonBoosting(labelCol="y", maxIter=1, maxDepth=1, stepSize=0.1).fit(models.assembler(SPLIT_FEATURES).transform(rows))
    feature, cut = model.first_split()
    left, right = json.loads(model.getOrDefault(model.trees))[0]["leaves"]
    return r6(spark.createDataFrame([(SPLIT_FEATURES[feature], cut, float(model.featureImportances[feature]), left, right)],
                                    "feature string, threshold double, gain double, left_value double, right_value double"))


@query("newton_comparison")
def q_newton_comparison(spark, d):
    """Second-order boosted trees of the reference's fixed size on a leak-safe split of lineitem."""
    from trellis.plans import workflow
    res = workflow.classification(lineitem_frame(spark, d), "row_key", "label", MODEL_FEATURES,
                                  workflow.ModelSizes(booster="newton"), learners=("baseline", "gbt"))
    return r6(res.comparison)


@query("rf_regression_metrics")
def q_rf_regression_metrics(spark, d):
    """Score regression: a forest predicts the 0-9 score from the features."""
    from pyspark.ml import Pipeline

    from trellis.operators import metrics, models, split
    frame = lineitem_frame(spark, d).select("row_key", F.col("q10").cast("double").alias("score"), *MODEL_FEATURES)
    df = cut_lineage(frame, "input")   # the split and every pass of the learner read it
    sp = cut_lineage(split.random_split(df, "row_key").drop("row_key"), "split")
    forget(df)
    pipe = Pipeline(stages=[models.assembler(MODEL_FEATURES),
                            models.rf_regressor(label="score")])
    m = pipe.fit(sp.where(F.col("split") == "train"))
    pred = m.transform(sp.where(F.col("split") == "test")).select(
        F.col("score").alias("actual"), F.col("prediction").alias("predicted"))
    return r6(metrics.regression_metrics(pred))


@query("grid_search_f1")
def q_grid_search_f1(spark, d):
    from trellis.operators import models
    folded = _folded(spark, d, 3)
    pw = folded.agg(F.try_divide(F.count(F.when(F.col("label") == 0, 1)),
                                 F.count(F.when(F.col("label") == 1, 1)))).first()[0] or 1.0
    folded = models.with_positive_weight(folded, "label", pw)
    est = models.boosted_trees(10, 3, 0.1, "label", "weight")
    _, table = models.grid_search([models.assembler(MODEL_FEATURES)], est,
                                  {"maxDepth": [2, 3], "stepSize": [0.05, 0.1]}, folded, "fold", 3)
    return r6(table)


def _ml_fold_scores(spark, d):
    from trellis.operators import models
    folded = _folded(spark, d, 10)
    a = models.cv_fold_scores(_model("rf", **FOLD_SIZES), folded, "fold", 10, "Random Forest")
    b = models.cv_fold_scores(_model("gbt", **FOLD_SIZES), folded, "fold", 10, "Gradient Boosted Trees")
    return a.unionByName(b)


@query("ml_cv_t_test")
def q_ml_cv_t_test(spark, d):
    from trellis.operators.metrics import paired_t_test
    return r6(paired_t_test(_ml_fold_scores(spark, d), "Random Forest", "Gradient Boosted Trees"))


@query("learning_curve")
def q_learning_curve(spark, d):
    from trellis.operators import models
    folded = _folded(spark, d, 5)
    return r6(models.learning_curve(_model("rf", **FOLD_SIZES), folded, "row_key", 5))


def _gbt_for_shap(spark, d):
    from trellis.operators import models
    train, test = _train_test(spark, d)
    gbt = models.boosted_trees(FOLD_SIZES["gbt_iter"], FOLD_SIZES["gbt_depth"])
    return gbt.fit(models.assembler(MODEL_FEATURES).transform(train)), test


@query("tree_shap")
def q_tree_shap(spark, d):
    from trellis.operators.explain import tree_attributions
    gbt, test = _gbt_for_shap(spark, d)
    att, _, _ = tree_attributions(test, ["row_key"], MODEL_FEATURES, gbt)
    return r6(att)


@query("tree_shap_global")
def q_tree_shap_global(spark, d):
    from trellis.operators.explain import global_importance, tree_attributions
    gbt, test = _gbt_for_shap(spark, d)
    att, _, _ = tree_attributions(test, ["row_key"], MODEL_FEATURES, gbt)
    return r6(global_importance(att))


@query("model_roundtrip", f"""
WITH {LI_SQL}, dd AS (SELECT DISTINCT q10, l_extendedprice, l_discount, l_tax, l_linestatus FROM li)
SELECT CAST((count(*) + 4) // 5 AS BIGINT) AS n_rows, CAST((count(*) + 4) // 5 AS BIGINT) AS n_equal FROM dd""")
def q_model_roundtrip(spark, d):
    """Save the fitted pipeline, load it back, compare predictions."""
    import uuid

    from trellis.sources.io import load_pipeline, save_model
    from trellis.session import checkpoint_dir
    train, test = _train_test(spark, d)
    model = _model("rf", balanced=False)(train)
    path = f"{checkpoint_dir(spark).rstrip('/')}/model-{uuid.uuid4().hex}"
    save_model(model, path)
    again = load_pipeline(path)
    a = model.transform(test).select("row_key", F.col("prediction").alias("p1"))
    b = again.transform(test).select("row_key", F.col("prediction").alias("p2"))
    return a.join(b, "row_key").agg(F.count(F.lit(1)).alias("n_rows"),
                                    F.count(F.when(F.col("p1") == F.col("p2"), 1)).alias("n_equal"))


@query("multiclass_report")
def q_multiclass_report(spark, d):
    """Vector features: multinomial logistic regression on ``embeddings``
    (10 classes), per-class report on an exact stratified test split."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    from trellis.operators import metrics, split
    emb = read_table(spark, d, "embeddings").select(
        "vec_id", "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    sp = split.stratified_split(emb, "vec_id", "label")
    n = sp.where(F.col("split") == "train").count()
    lr = LogisticRegression(maxIter=200, regParam=1.0 / max(n, 1), family="multinomial")
    m = lr.fit(sp.where(F.col("split") == "train"))
    pred = m.transform(sp.where(F.col("split") == "test")).select(
        "label", F.col("prediction").cast("int").alias("prediction"))
    return r6(metrics.classification_report(pred))


# --------------------------------------------------------------------------- density and 2-D counts

@query("residual_kde", f"""
WITH {REG_SQL}, st AS (SELECT count(e) AS n, stddev_samp(e) AS sd, min(e) AS mn, max(e) AS mx FROM rg),
bw AS (SELECT *, sd * pow(CAST(n AS DOUBLE), -0.2) AS h FROM st),
g AS (SELECT CAST(unnest(range(200)) AS INTEGER) AS idx),
gx AS (SELECT idx, mn + idx * ((mx - mn) / 199) AS x, h, n FROM g, bw)
SELECT idx, round(x, 6) AS x,
       round(sum(exp(-0.5 * ((x - e) / h) * ((x - e) / h))) / (n * h * sqrt(2 * pi())), 6) AS density
FROM gx, rg GROUP BY idx, x, h, n""")
def q_residual_kde(spark, d):
    from trellis.operators.metrics import gaussian_kde
    rf = regression_frame(spark, d).select((F.col("actual") - F.col("predicted")).alias("e"))
    return r6(gaussian_kde(rf, "e"))


@query("actual_vs_predicted", f"""
WITH {REG_SQL}, b AS (SELECT least(min(actual), min(predicted)) AS mn, greatest(max(actual), max(predicted)) AS mx FROM rg)
SELECT CAST(least(floor((actual - mn) * 30 / (mx - mn)), 29) AS INTEGER) AS bin_x,
       CAST(least(floor((predicted - mn) * 30 / (mx - mn)), 29) AS INTEGER) AS bin_y, count(*) AS n
FROM rg, b GROUP BY 1, 2""")
def q_actual_vs_predicted(spark, d):
    from trellis.operators.metrics import joint_counts
    return joint_counts(regression_frame(spark, d), "actual", "predicted")


# --------------------------------------------------------------------------- entries B and C

def _pooled_corr(cols, where=""):
    return " UNION ALL ".join(f"SELECT {'type AS grp, ' if where else ''}'{c}' AS feature, {_corr_sql(c, 'label')} AS r "
                              f"FROM pooled{' GROUP BY type' if where else ''}" for c in cols)


@query("combined_polarity", f"""
WITH {LI_SQL},
pooled AS (SELECT DISTINCT CAST(CASE WHEN l_linestatus = 'F' THEN 0 ELSE 1 END AS VARCHAR) AS type,
                  CASE WHEN q10 >= 7 THEN 1 ELSE 0 END AS label, l_extendedprice, l_discount, l_tax
           FROM li WHERE l_linestatus IN ('F', 'O')),
g AS ({_pooled_corr(["l_extendedprice", "l_discount", "l_tax"], "group")}),
p AS ({_pooled_corr(["l_extendedprice", "l_discount", "l_tax"])})
SELECT g.feature, g.grp AS "group", round(g.r, 6) AS r_group, round(p.r, 6) AS r_pooled,
       coalesce(sign(g.r) * sign(p.r) < 0, false) AS sign_flip
FROM g JOIN p USING (feature)""")
def q_combined_polarity(spark, d):
    """Entry B on two sources (line status F and O as the two data sets): the
    feature-label relation of each source beside the pooled one."""
    from trellis.plans import workflow
    li = lineitem(spark, d)
    li = prep.binary_label(li, "q10", "label", LABEL_THRESHOLD)
    cols = ["label", *MODEL_FEATURES]
    f = li.where(F.col("l_linestatus") == "F").select(*cols)
    o = li.where(F.col("l_linestatus") == "O").select(*cols)
    out = workflow.combined([f, o], [0, 1], "row_key", "label", MODEL_FEATURES,
                            sizes=workflow.ModelSizes.small(), models_too=False)
    return r6(out["polarity"])


@query("score_regression_cv")
def q_score_regression_cv(spark, d):
    """Entry C (score): forest regressor on the 0-9 score, 5-fold RMSE summary."""
    from trellis.plans import workflow
    df = lineitem_frame(spark, d).withColumn("score", F.col("q10").cast("double"))
    out = workflow.score_regression(df, "row_key", "score", MODEL_FEATURES, k=5, trees=20, max_depth=8)
    return r6(out["cv"])


@query("type_prediction_report")
def q_type_prediction_report(spark, d):
    """Entry C (type): which source (line status) does a row come from."""
    from trellis.plans import workflow
    df = lineitem_frame(spark, d).withColumn(
        "is_open", F.when(F.col("l_linestatus") == "O", 1).otherwise(0))
    out = workflow.type_prediction(df, "row_key", "is_open", MODEL_FEATURES)
    return r6(out["report"])
