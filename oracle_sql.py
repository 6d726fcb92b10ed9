"""DuckDB oracle SQL for the registered queries.

Fixture CTEs mirror ``foldspark.sources.fixtures``; every query reads the
driver tables (pre-registered as views) and nothing else.
"""

from __future__ import annotations

FIXTURE_SQL = {
    "customer_churn": """
customer_churn AS (
  WITH hist AS (
    SELECT o.*, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
    FROM orders o WHERE o_orderdate < TIMESTAMP '2000-09-15 00:00:00'),
  agg AS (
    SELECT o_custkey, count(*) AS n_orders, sum(o_totalprice) AS total, avg(o_totalprice) AS avg_order,
           min(o_orderdate) AS first_ts, max(CASE WHEN rn = 1 THEN o_orderpriority END) AS last_priority
    FROM hist GROUP BY o_custkey),
  fut AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2000-09-15 00:00:00')
  SELECT c_name AS customerID, c_mktsegment AS Segment, n_name AS Nation, r_name AS Region,
         CAST(c_custkey % 6 = 0 AS INT) AS SeniorFlag,
         CAST(CASE WHEN n_orders IS NULL THEN 0 ELSE 2000*12+9 - (year(first_ts)*12+month(first_ts)) END AS INT) AS tenure,
         CAST(coalesce(n_orders, 0) AS BIGINT) AS n_orders,
         c_acctbal AS AcctBal, avg_order AS AvgOrder,
         CASE WHEN n_orders IS NULL THEN ' ' ELSE CAST(CAST(total AS DECIMAL(18,2)) AS VARCHAR) END AS TotalCharges,
         last_priority AS LastPriority,
         CASE WHEN f.o_custkey IS NULL THEN 'Yes' ELSE 'No' END AS Churn
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN agg a ON a.o_custkey = c_custkey LEFT JOIN fut f ON f.o_custkey = c_custkey)""",
    "customer_churn_raw": """
customer_churn_raw AS (
  SELECT customerID, Segment, Nation, Region, SeniorFlag, tenure, n_orders, AcctBal, AvgOrder,
         CASE WHEN CAST(substr(customerID, 10) AS INT) % 50 = 1 THEN '12d'
              WHEN CAST(substr(customerID, 10) AS INT) % 50 = 2 THEN 'NaN'
              WHEN CAST(substr(customerID, 10) AS INT) % 50 = 3 THEN '1,000' ELSE TotalCharges END AS TotalCharges,
         LastPriority,
         CASE WHEN CAST(substr(customerID, 10) AS INT) % 40 = 5 THEN NULL
              WHEN CAST(substr(customerID, 10) AS INT) % 40 = 6 THEN 'Maybe' ELSE Churn END AS Churn
  FROM customer_churn
  UNION ALL
  SELECT customerID, Segment, Nation, Region, SeniorFlag, tenure, n_orders, AcctBal, AvgOrder, TotalCharges, LastPriority, Churn
  FROM customer_churn WHERE CAST(substr(customerID, 10) AS INT) % 30 = 7)""",
    "scored_orders": """
scored_orders AS (
  WITH b AS (SELECT o_orderkey AS row_id, CAST(o_orderstatus = 'F' AS INT) AS label,
    CAST((row_number() OVER (PARTITION BY o_orderstatus = 'F' ORDER BY md5(concat('42|', CAST(o_orderkey AS VARCHAR)))) - 1) % 5 AS INT) AS fold FROM orders),
  m AS (SELECT model, CAST(w AS DOUBLE) AS w FROM (VALUES ('ExtraTrees', 0.20), ('RandomForest', 0.22), ('XGBoost', 0.25), ('LightGBM', 0.25)) AS v(model, w))
  SELECT model, fold, row_id, label,
    round(w*label + (1-w)*(('0x'||substr(md5(concat(model,'|',CAST(row_id AS VARCHAR))),1,8))::BIGINT/4294967296.0::DOUBLE), 3) AS proba
  FROM b CROSS JOIN m)""",
    "doc_quality": """
doc_quality AS (
  SELECT d.doc_id AS row_id, lang, source, n_chars,
    CAST(length(text)-length(replace(text,' ',''))+1 AS BIGINT) AS n_words,
    CAST(list_unique(string_split(text,' ')) AS DOUBLE)/(length(text)-length(replace(text,' ',''))+1) AS uniq_ratio,
    CAST(length(regexp_replace(text,'[^A-Za-z]','','g')) AS DOUBLE)/greatest(length(text),1) AS alpha_ratio,
    1-quality AS label, toxic
  FROM documents d JOIN labels l ON d.doc_id=l.doc_id)""",
    "embedding_binary": """
embedding_binary AS (SELECT vec_id AS row_id, embedding, CAST(label = 0 AS INT) AS label FROM embeddings)""",
    "contributions": """
contributions AS (
  SELECT customerID AS row_id, 'num__AcctBal' AS feature, 'AcctBal' AS original_feature, 0.0001 * CAST(1 AS DOUBLE) * AcctBal AS contribution FROM customer_churn
  UNION ALL SELECT customerID, 'num__tenure', 'tenure', CAST(-0.02 AS DOUBLE) * tenure FROM customer_churn
  UNION ALL SELECT customerID, concat('cat__Segment_', Segment), 'Segment', CAST(0.3 AS DOUBLE) FROM customer_churn
  UNION ALL SELECT customerID, concat('cat__Region_', Region), 'Region', CAST(CASE WHEN SeniorFlag = 1 THEN 0.1 ELSE -0.05 END AS DOUBLE) FROM customer_churn)""",
}

# fixture -> fixtures it reads
FIXTURE_DEPS = {
    "customer_churn_raw": ["customer_churn"],
    "contributions": ["customer_churn"],
}


def with_fixtures(body: str, *names: str) -> str:
    """Prefix ``body`` with the CTEs of the named fixtures (and their inputs)."""
    order: list[str] = []

    def add(n):
        for d in FIXTURE_DEPS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    ctes = ",\n".join(FIXTURE_SQL[n].strip() for n in order)
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


# name -> (fixtures used, body)
_BODIES: dict[str, tuple[tuple[str, ...], str]] = {}


def register(name: str, fixtures: tuple[str, ...], body: str) -> None:
    _BODIES[name] = (fixtures, body)


def queries() -> dict[str, str]:
    return {n: (with_fixtures(b, *f) if f else b.strip()) for n, (f, b) in _BODIES.items()}


# Fixed value: the accepted numeric text (same pattern as foldspark.functions.cast).
NUM_RE = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|inf|Infinity)\s*$"


def to_number(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, '{NUM_RE}') THEN TRY_CAST(trim({c}) AS DOUBLE) END"


def _clean_cte(name: str, src: str) -> str:
    return f"""
{name} AS (
  SELECT customerID AS row_id, CASE WHEN Churn = 'Yes' THEN 1 WHEN Churn = 'No' THEN 0 END AS label,
         Segment, Nation, Region, SeniorFlag, tenure, n_orders, AcctBal, AvgOrder,
         {to_number('TotalCharges')} AS TotalCharges, LastPriority
  FROM {src} WHERE Churn IN ('No', 'Yes'))"""


FIXTURE_SQL["churn_clean"] = _clean_cte("churn_clean", "customer_churn")
FIXTURE_SQL["churn_raw_clean"] = _clean_cte("churn_raw_clean", "customer_churn_raw")
FIXTURE_DEPS["churn_clean"] = ["customer_churn"]
FIXTURE_DEPS["churn_raw_clean"] = ["customer_churn_raw"]

# folds of churn_clean: K=5, md5('42|row_id') order within label
FIXTURE_SQL["churn_folds"] = """
churn_folds AS (
  SELECT *, CAST((row_number() OVER (PARTITION BY label ORDER BY md5(concat('42|', row_id)), row_id) - 1) % 5 AS INT) AS fold
  FROM churn_clean)"""
FIXTURE_DEPS["churn_folds"] = ["churn_clean"]

# ---------------------------------------------------------------- B, C
register("audit_summary", ("customer_churn_raw",), f"""
SELECT count(*) AS n_rows, 12 AS n_cols,
       CAST(count_if(({to_number('TotalCharges')}) IS NULL) AS BIGINT) AS missing_TotalCharges,
       CAST(count_if(Churn IS NULL) AS BIGINT) AS missing_label,
       count(*) - count(DISTINCT customerID) - coalesce(max(CAST(customerID IS NULL AS INT)), 0) AS duplicate_keys
FROM customer_churn_raw""")

register("target_distribution", ("customer_churn_raw",), """
SELECT Churn AS label_value, count(*) AS n,
       round(count(*) / sum(count(*)) OVER (), 4) AS ratio
FROM customer_churn_raw WHERE Churn IS NOT NULL GROUP BY Churn""")

register("target_distribution_with_missing", ("customer_churn_raw",), """
SELECT Churn AS label_value, count(*) AS n,
       round(count(*) / sum(count(*)) OVER (), 4) AS ratio
FROM customer_churn_raw GROUP BY Churn""")

register("lenient_cast", ("customer_churn_raw",), f"""
SELECT customerID, TotalCharges, {to_number('TotalCharges')} AS TotalCharges_num FROM customer_churn_raw""")

register("encode_label", ("churn_raw_clean",), "SELECT * FROM churn_raw_clean")

register("drop_null_labels", ("customer_churn_raw",), f"""
SELECT customerID AS row_id, CASE WHEN Churn = 'Yes' THEN 1 WHEN Churn = 'No' THEN 0 END AS label, Segment, Nation, Region, SeniorFlag,
       tenure, n_orders, round(AcctBal, 6) AS AcctBal, round(AvgOrder, 6) AS AvgOrder, round({to_number('TotalCharges')}, 6) AS TotalCharges,
       LastPriority
FROM customer_churn_raw WHERE Churn IS NOT NULL""")

_CONTENT = ", ".join(f"coalesce(CAST({c} AS VARCHAR), chr(0))" for c in (
    "customerID", "Segment", "Nation", "Region", "SeniorFlag", "tenure", "n_orders", "TotalCharges", "LastPriority", "Churn"))
register("generated_row_ids", ("customer_churn_raw",), f"""
WITH k AS (SELECT *, md5(concat_ws('|', {_CONTENT})) AS content FROM customer_churn_raw),
ids AS (SELECT content || '-' || CAST(row_number() OVER (PARTITION BY content) AS VARCHAR) AS row_id, customerID,
               CASE WHEN Churn = 'Yes' THEN 1 ELSE 0 END AS label FROM k WHERE Churn IN ('Yes', 'No'))
SELECT row_id, label, customerID, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5(concat('42|', row_id)), row_id)
         <= round(0.2 * count(*) OVER (PARTITION BY label)) THEN 'test' ELSE 'train' END AS split FROM ids""")

register("fold_slice", ("churn_folds",), """
SELECT CASE WHEN fold = 2 THEN 'val' ELSE 'train' END AS part, row_id, label, fold FROM churn_folds""")

register("schema_roles", ("churn_clean",), """
WITH c AS (SELECT count(SeniorFlag) a, count(tenure) b, count(n_orders) c, count(AcctBal) d, count(AvgOrder) e,
                  count(TotalCharges) f, count(Segment) g, count(Nation) h, count(Region) i, count(LastPriority) j
           FROM churn_clean)
SELECT * FROM (
  SELECT 'SeniorFlag' AS "column", 'numeric' AS role, 0 AS position, a AS non_null FROM c
  UNION ALL SELECT 'tenure', 'numeric', 1, b FROM c
  UNION ALL SELECT 'n_orders', 'numeric', 2, c FROM c
  UNION ALL SELECT 'AcctBal', 'numeric', 3, d FROM c
  UNION ALL SELECT 'AvgOrder', 'numeric', 4, e FROM c
  UNION ALL SELECT 'TotalCharges', 'numeric', 5, f FROM c
  UNION ALL SELECT 'Segment', 'categorical', 0, g FROM c
  UNION ALL SELECT 'Nation', 'categorical', 1, h FROM c
  UNION ALL SELECT 'Region', 'categorical', 2, i FROM c
  UNION ALL SELECT 'LastPriority', 'categorical', 3, j FROM c)""")

register("model_selection", ("scored_orders",), """
SELECT model, count(*) AS n_predictions FROM scored_orders
WHERE model IN ('XGBoost', 'ExtraTrees') GROUP BY model""")

# ---------------------------------------------------------------- D
_HOLDOUT = """
SELECT row_id, label,
       CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5(concat('42|', row_id)), row_id)
                 <= round(0.2 * count(*) OVER (PARTITION BY label)) THEN 'test' ELSE 'train' END AS split
FROM churn_clean"""

register("stratified_holdout", ("churn_clean",), _HOLDOUT)

register("split_shape", ("churn_clean",), f"""
SELECT split, label, count(*) AS n FROM ({_HOLDOUT}) s GROUP BY split, label""")

register("stratified_kfold", ("churn_folds",), "SELECT row_id, label, fold FROM churn_folds")

register("kfold_unshuffled", ("churn_clean",), """
WITH r AS (SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY row_id) - 1 AS i,
                  count(*) OVER (PARTITION BY label) AS n FROM churn_clean),
p AS (SELECT *, n // 5 AS q, n % 5 AS rem FROM r)
SELECT row_id, label,
       CAST(CASE WHEN i < (q + 1) * rem THEN i // (q + 1) ELSE rem + (i - (q + 1) * rem) // q END AS INT) AS fold
FROM p""")

register("fold_expansion", ("churn_folds",), """
SELECT row_id, label, fold, CAST(f.fold_id AS INT) AS fold_id,
       CASE WHEN fold = f.fold_id THEN 'val' ELSE 'train' END AS role
FROM churn_folds, (SELECT unnest(range(0, 5)) AS fold_id) f""")

register("nested_holdout", ("churn_folds",), """
WITH t AS (SELECT CAST(f.fold_id AS INT) AS fold_id, row_id, label
           FROM churn_folds, (SELECT unnest(range(0, 5)) AS fold_id) f WHERE fold <> f.fold_id)
SELECT fold_id, row_id, label,
       CASE WHEN row_number() OVER (PARTITION BY fold_id, label
                                    ORDER BY md5(concat(CAST(42 + fold_id AS VARCHAR), '|', row_id)), row_id)
                 <= round(0.2 * count(*) OVER (PARTITION BY fold_id, label)) THEN 'test' ELSE 'train' END AS inner_split
FROM t""")

# ---------------------------------------------------------------- H
def metric_sql(tn="tn", fp="fp", fn="fn", tp="tp", digits=6) -> str:
    """H2-H7, H9 from confusion counts, zero-division -> 0 (as the reference)."""
    tn, fp, fn, tp = [f"CAST({c} AS DOUBLE)" for c in (tn, fp, fn, tp)]
    pos, neg = f"({tp}+{fn})", f"({tn}+{fp})"
    rec = f"(CASE WHEN {pos} > 0 THEN {tp}/{pos} ELSE 0.0 END)"
    spec = f"(CASE WHEN {neg} > 0 THEN {tn}/{neg} ELSE 0.0 END)"
    den = f"sqrt(({tp}+{fp})*({tp}+{fn})*({tn}+{fp})*({tn}+{fn}))"
    exprs = {
        "accuracy": f"({tp}+{tn})/({tp}+{tn}+{fp}+{fn})",
        "balanced_accuracy": f"CASE WHEN {pos} > 0 AND {neg} > 0 THEN ({rec}+{spec})/2 WHEN {pos} > 0 THEN {rec} WHEN {neg} > 0 THEN {spec} END",
        "precision": f"CASE WHEN {tp}+{fp} > 0 THEN {tp}/({tp}+{fp}) ELSE 0.0 END",
        "recall_sensitivity": rec,
        "specificity": spec,
        "f1": f"CASE WHEN 2*{tp}+{fp}+{fn} > 0 THEN 2*{tp}/(2*{tp}+{fp}+{fn}) ELSE 0.0 END",
        "mcc": f"CASE WHEN {den} > 0 THEN ({tp}*{tn}-{fp}*{fn})/{den} ELSE 0.0 END",
    }
    if digits is None:
        return ", ".join(f"{e} AS {k}" for k, e in exprs.items())
    return ", ".join(f"round({e}, {digits}) AS {k}" for k, e in exprs.items())


def confusion_sql(pred="proba >= 0.5") -> str:
    return (f"CAST(count_if(label = 0 AND NOT ({pred})) AS BIGINT) AS tn, CAST(count_if(label = 0 AND ({pred})) AS BIGINT) AS fp, "
            f"CAST(count_if(label = 1 AND NOT ({pred})) AS BIGINT) AS fn, CAST(count_if(label = 1 AND ({pred})) AS BIGINT) AS tp")


def auc_sql(src: str, by: str) -> str:
    """Rank-sum AUC (average ranks for ties), NULL for one class - an independent formula."""
    return f"""
SELECT {by}, CASE WHEN sum(label) > 0 AND sum(1 - label) > 0 THEN
         (sum(CASE WHEN label = 1 THEN rk END) - sum(label) * (sum(label) + 1) / 2.0) / (CAST(sum(label) AS DOUBLE) * sum(1 - label)) END AS roc_auc
FROM (SELECT {by}, label, rank() OVER (PARTITION BY {by} ORDER BY proba)
                          + (count(*) OVER (PARTITION BY {by}, proba) - 1) / 2.0 AS rk
      FROM {src} WHERE proba IS NOT NULL) r
GROUP BY {by}"""


register("confusion", ("scored_orders",), f"""
SELECT model, fold, {confusion_sql()} FROM scored_orders GROUP BY model, fold""")

register("roc_auc", ("scored_orders",), f"""
SELECT model, fold, round(roc_auc, 6) AS roc_auc FROM ({auc_sql('scored_orders', 'model, fold')}) a""")

register("metrics_by_model_fold", ("scored_orders",), f"""
WITH c AS (SELECT model, fold, {confusion_sql()} FROM scored_orders GROUP BY model, fold),
a AS ({auc_sql('scored_orders', 'model, fold')})
SELECT c.model, c.fold, tn, fp, fn, tp, {metric_sql()}, round(a.roc_auc, 6) AS roc_auc
FROM c LEFT JOIN a ON c.model = a.model AND c.fold = a.fold""")

register("roc_points", ("scored_orders",), """
WITH c AS (SELECT model, proba AS score, count_if(label = 1) AS pos, count_if(label = 0) AS neg
           FROM scored_orders WHERE proba IS NOT NULL GROUP BY model, proba),
s AS (SELECT *, sum(pos) OVER w AS cum_pos, sum(neg) OVER w AS cum_neg,
             lead(pos) OVER w2 AS next_pos, lead(neg) OVER w2 AS next_neg, row_number() OVER w2 AS rn,
             sum(pos) OVER (PARTITION BY model) AS P, sum(neg) OVER (PARTITION BY model) AS N
      FROM c
      WINDOW w AS (PARTITION BY model ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
             w2 AS (PARTITION BY model ORDER BY score DESC))
SELECT model, round(CASE WHEN N > 0 THEN cum_neg / N END, 6) AS fpr, round(CASE WHEN P > 0 THEN cum_pos / P END, 6) AS tpr,
       round(score, 6) AS threshold
FROM s WHERE rn = 1 OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg
UNION ALL
SELECT model, CASE WHEN sum(neg) > 0 THEN 0.0 END, CASE WHEN sum(pos) > 0 THEN 0.0 END, CAST(NULL AS DOUBLE)
FROM c GROUP BY model""")

_GRID = "(SELECT CAST(j AS DOUBLE) / 100.0::DOUBLE AS threshold FROM range(10, 91) t(j))"


def sweep_sql(src: str, by: str, with_auc: bool = True) -> str:
    """Brute force: every grid value scored separately (81 passes in effect)."""
    auc_join = f" LEFT JOIN ({auc_sql(src, by)}) a USING ({by})" if with_auc else ""
    auc_col = ", round(a.roc_auc, 6) AS roc_auc" if with_auc else ""
    return f"""
WITH c AS (SELECT {by}, g.threshold, {confusion_sql('proba >= g.threshold')}
           FROM {src}, {_GRID} g WHERE proba IS NOT NULL GROUP BY {by}, g.threshold)
SELECT c.*, {metric_sql()}{auc_col} FROM c{auc_join}"""


register("threshold_sweep", ("scored_orders",), sweep_sql("scored_orders", "model, fold"))


def best_sql(sweep: str, by: str, metric: str, col: str) -> str:
    return f"""
SELECT {by}, threshold, best_score, '{metric}' AS objective FROM (
  SELECT {by}, threshold, {col} AS best_score,
         row_number() OVER (PARTITION BY {by} ORDER BY {col} DESC, threshold ASC) AS rn FROM ({sweep}) s) b
WHERE rn = 1"""


register("best_threshold", ("scored_orders",), " UNION ALL ".join(
    f"({best_sql(sweep_sql('scored_orders', 'model, fold', False), 'model, fold', m, c)})"
    for m, c in (("f1", "f1"), ("balanced_accuracy", "balanced_accuracy"), ("mcc", "mcc"), ("recall", "recall_sensitivity"))))

register("default_vs_tuned", ("scored_orders",), f"""
WITH tuned AS ({best_sql(sweep_sql("(SELECT * FROM scored_orders WHERE fold <> 0)", "model", False), "model", "f1", "f1")}),
k AS (SELECT model, 'default' AS kind, 0.5 AS threshold FROM tuned UNION ALL SELECT model, 'tuned', threshold FROM tuned),
c AS (SELECT s.model, k.kind, k.threshold, {confusion_sql('proba >= k.threshold')}
      FROM scored_orders s JOIN k ON s.model = k.model WHERE s.fold = 0 GROUP BY s.model, k.kind, k.threshold),
a AS ({auc_sql("(SELECT * FROM scored_orders WHERE fold = 0)", "model")})
SELECT c.model, kind, round(threshold, 6) AS threshold, tn, fp, fn, tp, {metric_sql()}, round(a.roc_auc, 6) AS roc_auc
FROM c LEFT JOIN a ON c.model = a.model""")

register("label_tie_rule", ("scored_orders",), f"""
SELECT model, {confusion_sql('proba > 0.5')}, 'gt' AS rule FROM scored_orders GROUP BY model
UNION ALL
SELECT model, {confusion_sql('proba >= 0.5')}, 'ge' AS rule FROM scored_orders GROUP BY model""")

_METRICS_MF = f"""
m AS (SELECT c.model, c.fold, {metric_sql(digits=12)}, a.roc_auc
      FROM (SELECT model, fold, {confusion_sql()} FROM scored_orders GROUP BY model, fold) c
      LEFT JOIN ({auc_sql('scored_orders', 'model, fold')}) a ON c.model = a.model AND c.fold = a.fold),
l AS (UNPIVOT m ON accuracy, balanced_accuracy, precision, recall_sensitivity, specificity, f1, roc_auc, mcc
      INTO NAME metric VALUE value)"""

register("fold_scores_long", ("scored_orders",), f"""
WITH {_METRICS_MF}
SELECT model, fold, metric, round(value, 6) AS value FROM l""")

register("fold_scores_json", ("scored_orders",), f"""
WITH {_METRICS_MF}
SELECT model, metric, string_agg(printf('%.6f', value), ',' ORDER BY fold) AS scores FROM l GROUP BY model, metric""")

register("confusion_json", ("scored_orders",), f"""
SELECT model, tn AS actual_0_predicted_0, fp AS actual_0_predicted_1, fn AS actual_1_predicted_0, tp AS actual_1_predicted_1
FROM (SELECT model, {confusion_sql()} FROM scored_orders GROUP BY model) c""",)

register("cv_mean_std", ("scored_orders",), f"""
WITH {_METRICS_MF}
SELECT model, metric, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0.0), 6) AS std,
       count(value) AS n_folds, round(stddev_pop(value), 6) AS std_pop
FROM l GROUP BY model, metric""")

register("cv_text_table", ("scored_orders",), f"""
WITH {_METRICS_MF},
s AS (SELECT model, metric, printf('%.4f ± %.4f', avg(value), coalesce(stddev_samp(value), 0.0)) AS txt FROM l GROUP BY model, metric)
SELECT model,
  max(CASE WHEN metric = 'accuracy' THEN txt END) AS accuracy,
  max(CASE WHEN metric = 'balanced_accuracy' THEN txt END) AS balanced_accuracy,
  max(CASE WHEN metric = 'precision' THEN txt END) AS precision,
  max(CASE WHEN metric = 'recall_sensitivity' THEN txt END) AS recall_sensitivity,
  max(CASE WHEN metric = 'specificity' THEN txt END) AS specificity,
  max(CASE WHEN metric = 'f1' THEN txt END) AS f1,
  max(CASE WHEN metric = 'roc_auc' THEN txt END) AS roc_auc,
  max(CASE WHEN metric = 'mcc' THEN txt END) AS mcc
FROM s GROUP BY model""")

register("leaderboard", ("scored_orders",), f"""
WITH c AS (SELECT model, {confusion_sql()} FROM scored_orders GROUP BY model),
a AS ({auc_sql('scored_orders', 'model')})
SELECT c.model, tn, fp, fn, tp, {metric_sql()}, round(a.roc_auc, 6) AS roc_auc
FROM c LEFT JOIN a ON c.model = a.model ORDER BY roc_auc DESC, c.model LIMIT 1""")

# ---------------------------------------------------------------- E
CHURN_NUMERIC = ["SeniorFlag", "tenure", "n_orders", "AcctBal", "AvgOrder", "TotalCharges"]
CHURN_CATEGORICAL = ["Segment", "Nation", "Region", "LastPriority"]

_PREP = """
ids AS (SELECT CAST(unnest(range(0, 5)) AS INT) AS fold_id),
num AS ({num}),
cat AS ({cat}),
tr AS (SELECT ids.fold_id, num.* FROM num JOIN ids ON num.fold <> ids.fold_id),
med AS (SELECT fold_id, col_name, position, median(value) AS median FROM tr GROUP BY fold_id, col_name, position),
imp AS (SELECT tr.fold_id, tr.col_name, coalesce(tr.value, med.median) AS v FROM tr JOIN med ON tr.fold_id = med.fold_id AND tr.col_name = med.col_name),
sc AS (SELECT fold_id, col_name, avg(v) AS mean, stddev_pop(v) AS sd, count(*) AS n_train FROM imp GROUP BY fold_id, col_name),
nstat AS (SELECT med.*, sc.mean, CASE WHEN sc.sd * sc.sd <= sc.n_train * 2.220446049250313e-16 * sc.sd * sc.sd + pow(sc.n_train * 2.220446049250313e-16 * sc.mean, 2) THEN 1.0 ELSE sc.sd END AS std
          FROM med JOIN sc ON med.fold_id = sc.fold_id AND med.col_name = sc.col_name),
vt AS (SELECT ids.fold_id, col_name, position, value AS category, count(*) AS count
       FROM cat JOIN ids ON cat.fold <> ids.fold_id WHERE value IS NOT NULL GROUP BY ids.fold_id, col_name, position, value),
vocab AS (SELECT *, CAST(row_number() OVER (PARTITION BY fold_id, col_name ORDER BY category) - 1 AS INT) AS idx,
                 row_number() OVER (PARTITION BY fold_id, col_name ORDER BY count DESC, category ASC) = 1 AS is_mode FROM vt),
sizes AS (SELECT fold_id, col_name, position, count(*) AS sz FROM vocab GROUP BY fold_id, col_name, position),
offs AS (SELECT fold_id, col_name, {p} + coalesce(sum(sz) OVER (PARTITION BY fold_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM sizes),
names AS (SELECT fold_id, position AS feature_idx, 'num__' || col_name AS name, col_name AS source_column, CAST(NULL AS VARCHAR) AS category FROM nstat
          UNION ALL
          SELECT v.fold_id, CAST(o.off + v.idx AS INT), 'cat__' || v.col_name || '_' || v.category, v.col_name, v.category
          FROM vocab v JOIN offs o ON v.fold_id = o.fold_id AND v.col_name = o.col_name)""".format(
    num=" UNION ALL ".join(f"SELECT row_id, fold, '{c}' AS col_name, {i} AS position, CAST({c} AS DOUBLE) AS value FROM churn_folds"
                           for i, c in enumerate(CHURN_NUMERIC)),
    cat=" UNION ALL ".join(f"SELECT row_id, fold, '{c}' AS col_name, {i} AS position, CAST({c} AS VARCHAR) AS value FROM churn_folds"
                           for i, c in enumerate(CHURN_CATEGORICAL)),
    p=len(CHURN_NUMERIC))

register("fold_medians", ("churn_folds",), f"WITH {_PREP} SELECT fold_id, col_name, position, round(median, 6) AS median FROM med")
register("fold_modes", ("churn_folds",), f"WITH {_PREP} SELECT fold_id, col_name, category AS mode, CAST(count AS BIGINT) AS count FROM vocab WHERE is_mode")
register("fold_scaler", ("churn_folds",), f"WITH {_PREP} SELECT fold_id, col_name, round(mean, 6) AS mean, round(std, 6) AS std FROM nstat")
register("fold_vocabulary", ("churn_folds",), f"WITH {_PREP} SELECT * FROM names")
register("prep_apply_long", ("churn_folds",), f"""
WITH {_PREP},
ex AS (SELECT ids.fold_id, CASE WHEN f.fold = ids.fold_id THEN 'val' ELSE 'train' END AS role, f.row_id, f.fold FROM churn_folds f, ids),
modes AS (SELECT fold_id, col_name, category AS mode FROM vocab WHERE is_mode)
SELECT ex.fold_id, ex.role, ex.row_id, s.position AS feature_idx,
       round(coalesce((coalesce(n.value, s.median) - s.mean) / s.std, 0.0), 6) AS value
FROM ex JOIN num n ON n.row_id = ex.row_id JOIN nstat s ON s.fold_id = ex.fold_id AND s.col_name = n.col_name
UNION ALL
SELECT ex.fold_id, ex.role, ex.row_id, CAST(o.off + v.idx AS INT) AS feature_idx,
       CASE WHEN coalesce(c.value, m.mode) = v.category THEN 1.0 ELSE 0.0 END AS value
FROM ex JOIN cat c ON c.row_id = ex.row_id
JOIN vocab v ON v.fold_id = ex.fold_id AND v.col_name = c.col_name
JOIN offs o ON o.fold_id = v.fold_id AND o.col_name = v.col_name
LEFT JOIN modes m ON m.fold_id = ex.fold_id AND m.col_name = c.col_name""")

# ---------------------------------------------------------------- G: logistic regression by Newton steps
def newton_ctes(rows: str, steps: int = 8, C: float = 1.0) -> str:
    """CTEs ``w0 .. w<steps>``: coefficients (fold_id, w) of the optimum of C * log loss + |w|^2 / 2 with a free intercept.

    ``rows``: a CTE (fold_id, row_id, label, x) whose lists begin with 1.0.  Each step solves its system by Gauss-Jordan
    elimination on lists, one recursion a column (the matrix is positive definite, so no pivots are searched).
    """
    out = [f"""
cells AS MATERIALIZED (SELECT fold_id, row_id, i, v FROM (
  SELECT fold_id, row_id, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS v FROM {rows}) c WHERE v <> 0),
grid AS MATERIALIZED (SELECT fold_id, unnest(range(1, d + 1)) AS i, d FROM (SELECT fold_id, max(len(x)) AS d FROM {rows} GROUP BY fold_id)),
w0 AS MATERIALIZED (SELECT fold_id, list(0.0::DOUBLE ORDER BY i) AS w FROM grid GROUP BY fold_id)"""]
    for t in range(steps):
        out.append(f"""
p{t} AS MATERIALIZED (SELECT r.fold_id, row_id, label, 1.0 / (1.0 + exp(-list_dot_product(x, w))) AS p
       FROM {rows} r JOIN w{t} ON r.fold_id = w{t}.fold_id),
g{t} AS (SELECT c.fold_id, i, sum((p - label) * v) AS g FROM cells c JOIN p{t} p ON c.fold_id = p.fold_id AND c.row_id = p.row_id GROUP BY c.fold_id, i),
h{t} AS (SELECT a.fold_id, a.i, b.i AS j, sum(p * (1.0 - p) * a.v * b.v) AS h
       FROM cells a JOIN cells b ON a.fold_id = b.fold_id AND a.row_id = b.row_id
       JOIN p{t} p ON p.fold_id = a.fold_id AND p.row_id = a.row_id GROUP BY a.fold_id, a.i, b.i),
m{t} AS MATERIALIZED (SELECT fold_id, list(r ORDER BY i) AS m FROM (
  SELECT a.fold_id, a.i, list({C!r} * coalesce(h.h, 0.0) + CASE WHEN a.i = b.i AND a.i > 1 THEN 1.0 ELSE 0.0 END ORDER BY b.i)
         || [any_value({C!r} * coalesce(g.g, 0.0) + CASE WHEN a.i > 1 THEN w.w[a.i] ELSE 0.0 END)] AS r
  FROM grid a JOIN grid b ON a.fold_id = b.fold_id JOIN w{t} w ON w.fold_id = a.fold_id
  LEFT JOIN h{t} h ON h.fold_id = a.fold_id AND h.i = a.i AND h.j = b.i
  LEFT JOIN g{t} g ON g.fold_id = a.fold_id AND g.i = a.i GROUP BY a.fold_id, a.i) z GROUP BY fold_id),
s{t} AS (SELECT fold_id, CAST(0 AS BIGINT) AS k, m FROM m{t} UNION ALL
  SELECT fold_id, k + 1, list_transform(m, lambda r, i: CASE WHEN i = k + 1 THEN list_transform(r, lambda e: e / r[i])
         ELSE list_transform(r, lambda e, j: e - r[k + 1] * m[k + 1][j] / m[k + 1][k + 1]) END) FROM s{t} WHERE k < len(m)),
w{t + 1} AS MATERIALIZED (SELECT s.fold_id, list_transform(w.w, lambda e, i: e - m[i][len(m) + 1]) AS w
       FROM s{t} s JOIN w{t} w ON s.fold_id = w.fold_id WHERE k = len(m))""")
    return ",".join(out)


_LOGISTIC = f"""{_PREP},
ex AS (SELECT ids.fold_id, CASE WHEN f.fold = ids.fold_id THEN 'val' ELSE 'train' END AS role, f.row_id, f.fold, f.label FROM churn_folds f, ids),
modes AS (SELECT fold_id, col_name, category AS mode FROM vocab WHERE is_mode),
long AS (
  SELECT ex.fold_id, ex.role, ex.row_id, ex.label, CAST(s.position AS INT) AS feature_idx,
         coalesce((coalesce(n.value, s.median) - s.mean) / s.std, 0.0) AS value
  FROM ex JOIN num n ON n.row_id = ex.row_id JOIN nstat s ON s.fold_id = ex.fold_id AND s.col_name = n.col_name
  UNION ALL
  SELECT ex.fold_id, ex.role, ex.row_id, ex.label, CAST(o.off + v.idx AS INT),
         CASE WHEN coalesce(c.value, m.mode) = v.category THEN 1.0 ELSE 0.0 END
  FROM ex JOIN cat c ON c.row_id = ex.row_id
  JOIN vocab v ON v.fold_id = ex.fold_id AND v.col_name = c.col_name
  JOIN offs o ON o.fold_id = v.fold_id AND o.col_name = v.col_name
  LEFT JOIN modes m ON m.fold_id = ex.fold_id AND m.col_name = c.col_name),
xs AS MATERIALIZED (SELECT fold_id, role, row_id, any_value(label) AS label, [1.0] || list(value ORDER BY feature_idx) AS x
       FROM long GROUP BY fold_id, role, row_id),
train AS MATERIALIZED (SELECT * FROM xs WHERE role = 'train'),
{newton_ctes('train')},
pred AS MATERIALIZED (SELECT 'Logistic' AS model, xs.fold_id AS fold, row_id, label, 1.0 / (1.0 + exp(-list_dot_product(x, w))) AS proba
         FROM xs JOIN w8 ON xs.fold_id = w8.fold_id WHERE role = 'val')"""

register("cv_logistic_probabilities", ("churn_folds",), f"""
WITH RECURSIVE {_LOGISTIC}
SELECT model, fold, row_id, label, round(proba, 4) AS proba FROM pred""")

register("cv_logistic_summary", ("churn_folds",), f"""
WITH RECURSIVE {_LOGISTIC},
c AS (SELECT model, fold, {confusion_sql('proba > 0.5')} FROM pred GROUP BY model, fold),
a AS ({auc_sql('pred', 'model, fold')}),
m AS (SELECT c.model, c.fold, {metric_sql(digits=None)}, a.roc_auc FROM c LEFT JOIN a ON c.model = a.model AND c.fold = a.fold),
l AS (UNPIVOT m ON accuracy, balanced_accuracy, precision, recall_sensitivity, specificity, f1, roc_auc, mcc INTO NAME metric VALUE value)
SELECT model, metric, round(avg(value), 4) AS mean, round(coalesce(stddev_samp(value), 0.0), 4) AS std, count(value) AS n_folds
FROM l GROUP BY model, metric""")

# ---------------------------------------------------------------- F
FIXTURE_SQL["emb_train"] = """
emb_train AS (
  WITH ef AS (SELECT *, CAST((row_number() OVER (PARTITION BY label ORDER BY md5(concat('42|', CAST(row_id AS VARCHAR))), row_id) - 1) % 5 AS INT) AS fold
              FROM embedding_binary)
  SELECT CAST(i.fold_id AS INT) AS fold_id, row_id, label, embedding
  FROM ef, (SELECT unnest(range(0, 5)) AS fold_id) i WHERE ef.fold <> i.fold_id)"""
FIXTURE_DEPS["emb_train"] = ["embedding_binary"]


def _u(expr: str) -> str:
    return f"(('0x' || substr(md5({expr}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


_KNN = """
m AS (SELECT fold_id, row_id, embedding FROM emb_train WHERE label = 1),
pairs AS (SELECT a.fold_id, a.row_id, b.row_id AS nn_id,
                 sqrt(list_sum(list_transform(range(1, len(a.embedding) + 1),
                      lambda i: pow(CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE), 2)))) AS dist
          FROM m a JOIN m b ON a.fold_id = b.fold_id AND a.row_id <> b.row_id),
knn AS (SELECT fold_id, row_id, CAST(row_number() OVER (PARTITION BY fold_id, row_id ORDER BY dist, nn_id) AS INT) AS nn_rank, nn_id, dist
        FROM pairs QUALIFY nn_rank <= {k})"""


def _smote_sql(ratio: float, k: int) -> str:
    return f"""
WITH {_KNN.format(k=k)},
budget AS (SELECT fold_id, CAST(count_if(label = 1) AS BIGINT) AS n_minor, CAST(count_if(label <> 1) AS BIGINT) AS n_major,
                  CAST(floor({ratio} * count_if(label <> 1)) AS BIGINT) - CAST(count_if(label = 1) AS BIGINT) AS budget
           FROM emb_train GROUP BY fold_id),
s AS (SELECT fold_id, unnest(range(0, budget)) AS synth_id, n_minor, least({k}, n_minor - 1) AS kk FROM budget WHERE budget > 0),
u AS (SELECT fold_id, synth_id,
             floor({_u("concat_ws('|', '42', 'base', CAST(fold_id AS VARCHAR), CAST(synth_id AS VARCHAR))")} * n_minor) AS idx,
             CAST(floor({_u("concat_ws('|', '42', 'nn', CAST(fold_id AS VARCHAR), CAST(synth_id AS VARCHAR))")} * kk) + 1 AS INT) AS nn_rank,
             {_u("concat_ws('|', '42', 'gap', CAST(fold_id AS VARCHAR), CAST(synth_id AS VARCHAR))")} AS gap
      FROM s),
mi AS (SELECT fold_id, row_id, embedding,
              row_number() OVER (PARTITION BY fold_id ORDER BY md5(concat('42|', CAST(row_id AS VARCHAR))), row_id) - 1 AS idx FROM m),
sy AS (SELECT u.fold_id, u.synth_id, b.row_id AS base_id, k.nn_id, u.gap,
              list_transform(range(1, len(b.embedding) + 1),
                 lambda i: CAST(b.embedding[i] AS DOUBLE) + u.gap * (CAST(n.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE))) AS x
       FROM u JOIN mi b ON b.fold_id = u.fold_id AND b.idx = u.idx
       JOIN knn k ON k.fold_id = u.fold_id AND k.row_id = b.row_id AND k.nn_rank = u.nn_rank
       JOIN m n ON n.fold_id = u.fold_id AND n.row_id = k.nn_id)"""


register("smote_budget", ("emb_train",), """
SELECT fold_id, CAST(count_if(label <> 1) AS BIGINT) AS n_major, CAST(count_if(label = 1) AS BIGINT) AS n_minor,
       CAST(floor(1.0 * count_if(label <> 1)) - count_if(label = 1) AS BIGINT) AS budget
FROM emb_train GROUP BY fold_id""")

register("smote_knn", ("emb_train",), f"WITH {_KNN.format(k=5)} SELECT fold_id, row_id, nn_rank, nn_id, round(dist, 6) AS dist FROM knn")

register("smote_rows", ("emb_train",), _smote_sql(1.0, 5) + """
SELECT fold_id, synth_id, base_id, nn_id, round(gap, 6) AS gap, round(x[1], 6) AS f0, round(x[2], 6) AS f1, round(x[3], 6) AS f2,
       round(list_sum(list_transform(x, lambda v: v * v)), 6) AS norm2 FROM sy""")

register("smote_train_union", ("emb_train",), _smote_sql(0.6, 3) + """
SELECT fold_id, synthetic, label, count(*) AS n FROM (
  SELECT fold_id, false AS synthetic, label FROM emb_train
  UNION ALL SELECT fold_id, true, 1 FROM sy) t GROUP BY fold_id, synthetic, label""")


# ---------------------------------------------------------------- I, J
_LONG_RAW = f"""
m AS (SELECT c.model, c.fold, {metric_sql(digits=None)}, a.roc_auc
      FROM (SELECT model, fold, {confusion_sql()} FROM scored_orders GROUP BY model, fold) c
      LEFT JOIN ({auc_sql('scored_orders', 'model, fold')}) a ON c.model = a.model AND c.fold = a.fold),
l AS (UNPIVOT m ON accuracy, balanced_accuracy, precision, recall_sensitivity, specificity, f1, roc_auc, mcc
      INTO NAME metric VALUE value)"""


def wilcoxon_sql(target: str, metric: str, alternative: str) -> str:
    if alternative == "greater":
        stat, hit, scale = "w_plus", "s >= w_plus - 1e-9", "1.0"
    else:
        stat, hit, scale = "least(w_plus, w_minus)", "s <= least(w_plus, n * (n + 1) / 2.0 - w_plus) + 1e-9", "2.0"
    return f"""
WITH {_LONG_RAW},
lf AS (SELECT * FROM l WHERE metric = '{metric}'),
t AS (SELECT fold, value AS tv FROM lf WHERE model = '{target}'),
d AS (SELECT lf.model AS Compared_with, lf.fold, t.tv - lf.value AS d FROM lf JOIN t ON lf.fold = t.fold WHERE lf.model <> '{target}'),
r AS (SELECT *, rank() OVER (PARTITION BY Compared_with ORDER BY abs(d))
               + (count(*) OVER (PARTITION BY Compared_with, abs(d)) - 1) / 2.0 AS rk FROM d WHERE d <> 0),
g AS (SELECT Compared_with, count(*) AS n, sum(CASE WHEN d > 0 THEN rk ELSE 0.0 END) AS w_plus,
             sum(CASE WHEN d < 0 THEN rk ELSE 0.0 END) AS w_minus, list(rk ORDER BY fold) AS rks FROM r GROUP BY Compared_with),
e AS (SELECT *, list_sum(list_transform(range(1, n + 1), lambda i: CASE WHEN (mask >> (i - 1)) & 1 = 1 THEN rks[i] ELSE 0.0 END)) AS s
      FROM (SELECT *, unnest(range(0, 1 << n)) AS mask FROM g) x),
p AS (SELECT Compared_with, least(1.0, {scale} * avg(CASE WHEN {hit} THEN 1.0 ELSE 0.0 END)) AS p FROM e GROUP BY Compared_with)
SELECT c.Compared_with, '{metric}' AS metric, coalesce(g.n, 0) AS n, round(g.w_plus, 6) AS w_plus, round(g.w_minus, 6) AS w_minus,
       round({stat.replace('w_', 'g.w_')}, 6) AS wilcoxon_stat, round(p.p, 6) AS p_value,
       CASE WHEN g.n IS NULL THEN 'all differences are zero' END AS note
FROM (SELECT DISTINCT Compared_with FROM d) c LEFT JOIN g ON g.Compared_with = c.Compared_with
LEFT JOIN p ON p.Compared_with = c.Compared_with"""


register("wilcoxon_greater", ("scored_orders",), wilcoxon_sql("LightGBM", "f1", "greater"))
register("wilcoxon_two_sided", ("scored_orders",), wilcoxon_sql("LightGBM", "roc_auc", "two-sided"))

import json as _json  # noqa: E402
import math as _math  # noqa: E402

_LA, _LB = _math.log(0.2), _math.log(0.8)


def _uni(*parts: str) -> str:
    return _u("concat_ws('|', " + ", ".join(parts) + ")")


def _choice_sql(name: str, spec) -> str:
    u = _uni("'42'", f"'{name}'", "CAST(i AS VARCHAR)")
    if isinstance(spec, tuple):
        a, b = _math.log(spec[1]), _math.log(spec[2])
        return f"round(exp({a!r} + {u} * {b - a!r}), 6) AS {name}"
    values = ", ".join("'" + _json.dumps(v) + "'" for v in spec)
    return f"[{values}][CAST(floor({u} * {len(spec)}) AS INT) + 1] AS {name}"


# The search space (parameter -> choices, or a log-uniform range).
_SPACE = {
    "smote__sampling_strategy": [0.6, 0.8, 1.0],
    "smote__k_neighbors": [3, 5],
    "model__final_estimator__C": ("loguniform", 0.05, 20.0),
    "model__final_estimator__class_weight": [None, "balanced"],
    "model__passthrough": [False, True],
    "model__et__max_depth": [6, 8, 10, None],
    "model__rf__max_depth": [6, 8, 10, None],
    "model__xgb__max_depth": [3, 4, 5],
    "model__xgb__learning_rate": [0.05, 0.1, 0.2],
    "model__lgbm__learning_rate": [0.05, 0.1, 0.2],
    "model__lgbm__num_leaves": [15, 31, 63],
}
register("search_space", ("churn_clean",), f"""
SELECT CAST(i AS INT) AS iteration, {", ".join(_choice_sql(k, v) for k, v in _SPACE.items())},
       (SELECT count(*) FROM churn_clean) AS n_rows FROM range(1, 21) t(i)""")
register("feedback_search", ("churn_clean",), """
SELECT CAST(i AS INT) AS iteration, false AS failed, true AS in_range
FROM range(1, 21) t(i), (SELECT count(*) AS n FROM churn_clean) c WHERE c.n > 0""")

register("search_best_so_far", ("scored_orders",), f"""
WITH RECURSIVE cand AS (
  SELECT CAST(i AS INT) AS iteration,
         ['ExtraTrees', 'RandomForest', 'XGBoost', 'LightGBM'][CAST(floor({_uni("'42'", "'model'", "CAST(i AS VARCHAR)")} * 4) AS INT) + 1] AS model,
         exp({_LA!r} + {_uni("'42'", "'threshold'", "CAST(i AS VARCHAR)")} * {(_LB - _LA)!r}) AS threshold
  FROM range(1, 21) t(i)),
c AS (SELECT iteration, fold,
             CAST(count_if(label = 1 AND proba >= threshold) AS DOUBLE) AS tp,
             CAST(count_if(label = 0 AND proba >= threshold) AS DOUBLE) AS fp,
             CAST(count_if(label = 1 AND proba < threshold) AS DOUBLE) AS fn
      FROM scored_orders s JOIN cand ON s.model = cand.model GROUP BY iteration, fold),
hist AS (SELECT iteration, 'ok' AS status,
                avg(CASE WHEN 2*tp+fp+fn > 0 THEN 2*tp/(2*tp+fp+fn) ELSE 0.0 END) AS score FROM c GROUP BY iteration),
h AS (SELECT row_number() OVER (ORDER BY iteration) AS rn, * FROM hist),
s AS (
  SELECT rn, iteration, CASE WHEN status = 'failed' THEN 'failed' ELSE 'best' END AS status, score,
         CASE WHEN status = 'failed' THEN '-inf'::DOUBLE ELSE score END AS best, 0 AS no_improve_count
  FROM h WHERE rn = 1
  UNION ALL
  SELECT h.rn, h.iteration,
         CASE WHEN h.status = 'failed' THEN 'failed' WHEN h.score > s.best + 1e-4 THEN 'best' ELSE 'no_improvement' END,
         h.score,
         CASE WHEN h.status <> 'failed' AND h.score > s.best + 1e-4 THEN h.score ELSE s.best END,
         CASE WHEN h.status = 'failed' THEN s.no_improve_count WHEN h.score > s.best + 1e-4 THEN 0 ELSE s.no_improve_count + 1 END
  FROM s JOIN h ON h.rn = s.rn + 1 WHERE s.no_improve_count < 6)
SELECT iteration, status, round(score, 6) AS score, round(best, 6) AS best, no_improve_count FROM s""")

# ---------------------------------------------------------------- L
_TEST = """
tst AS (SELECT row_id, label, tenure, n_orders, AcctBal, Segment FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(concat('42|', row_id)), row_id) AS rk,
         count(*) OVER (PARTITION BY label) AS n FROM churn_clean) x WHERE rk <= round(0.2 * n))"""

_PLAN = """
base AS (SELECT row_id, row_number() OVER (ORDER BY md5(concat_ws('|', '42', 'base', row_id)), row_id) AS i FROM tst),
fr AS (SELECT f.feature, CAST(r.rep AS INT) AS repeat, t.row_id AS donor_id
       FROM tst t, (SELECT unnest(['tenure', 'n_orders', 'AcctBal', 'Segment']) AS feature) f,
            (SELECT unnest(range(0, 10)) AS rep) r),
pr AS (SELECT *, row_number() OVER (PARTITION BY feature, repeat ORDER BY md5(concat_ws('|', '42', feature, CAST(repeat AS VARCHAR), donor_id)), donor_id) AS i FROM fr),
plan AS (SELECT pr.feature, pr.repeat, base.row_id, pr.donor_id FROM pr JOIN base ON pr.i = base.i)"""

register("permutation_plan", ("churn_clean",), f"WITH {_TEST}, {_PLAN} SELECT * FROM plan")


def _formula(t="", seg="Segment", ten="tenure", nor="n_orders", acct="AcctBal"):
    return (f"1.0 / (1.0 + exp(-(-1.0 + 0.02 * {ten} + 0.05 * {nor} + -0.0001 * {acct} "
            f"+ CASE WHEN {seg} = 'BUILDING' THEN 0.3 ELSE 0.0 END)))")


register("permutation_importance_formula", ("churn_clean",), f"""
WITH {_TEST}, {_PLAN},
d AS (SELECT p.feature, p.repeat, p.row_id, t.label,
             CASE WHEN p.feature = 'tenure' THEN dn.tenure ELSE t.tenure END AS tenure,
             CASE WHEN p.feature = 'n_orders' THEN dn.n_orders ELSE t.n_orders END AS n_orders,
             CASE WHEN p.feature = 'AcctBal' THEN dn.AcctBal ELSE t.AcctBal END AS AcctBal,
             CASE WHEN p.feature = 'Segment' THEN dn.Segment ELSE t.Segment END AS Segment
      FROM plan p JOIN tst t ON t.row_id = p.row_id JOIN tst dn ON dn.row_id = p.donor_id),
pc AS (SELECT feature, repeat, CAST(count_if(label = 1 AND pr >= 0.42) AS DOUBLE) AS tp,
              CAST(count_if(label = 0 AND pr >= 0.42) AS DOUBLE) AS fp, CAST(count_if(label = 1 AND pr < 0.42) AS DOUBLE) AS fn
       FROM (SELECT *, {_formula()} AS pr FROM d) x GROUP BY feature, repeat),
pf AS (SELECT feature, repeat, CASE WHEN 2*tp+fp+fn > 0 THEN 2*tp/(2*tp+fp+fn) ELSE 0.0 END AS f1 FROM pc),
bc AS (SELECT CAST(count_if(label = 1 AND pr >= 0.42) AS DOUBLE) AS tp,
              CAST(count_if(label = 0 AND pr >= 0.42) AS DOUBLE) AS fp, CAST(count_if(label = 1 AND pr < 0.42) AS DOUBLE) AS fn
       FROM (SELECT *, {_formula()} AS pr FROM tst) x),
b AS (SELECT CASE WHEN 2*tp+fp+fn > 0 THEN 2*tp/(2*tp+fp+fn) ELSE 0.0 END AS baseline FROM bc)
SELECT feature, round(baseline, 6) AS baseline, round(baseline - avg(f1), 6) AS importance_mean,
       round(stddev_pop(f1), 6) AS importance_std
FROM pf, b GROUP BY feature, baseline""")

_ORIG = "CASE WHEN instr({r}, '_') > 0 THEN split_part({r}, '_', 1) ELSE {r} END"


def orig_sql(c: str) -> str:
    r = f"(CASE WHEN instr({c}, '__') > 0 THEN substr({c}, instr({c}, '__') + 2) ELSE {c} END)"
    return _ORIG.format(r=r)


register("original_feature", ("churn_folds",), f"""WITH {_PREP}
SELECT feature_idx, name, {orig_sql('name')} AS original_parsed, source_column FROM names WHERE fold_id = 0""")

register("mean_abs_contribution", ("contributions",), """
SELECT feature, original_feature, round(avg(abs(contribution)), 6) AS mean_abs_contribution
FROM contributions GROUP BY feature, original_feature""")

register("importance_by_original", ("contributions",), f"""
SELECT {orig_sql('feature')} AS original_feature, round(sum(m), 6) AS mean_abs_contribution FROM (
  SELECT feature, avg(abs(contribution)) AS m FROM contributions GROUP BY feature) x
GROUP BY 1""")

register("top_features", ("contributions",), """
SELECT feature, round(avg(abs(contribution)), 6) AS mean_abs_contribution FROM contributions
GROUP BY feature ORDER BY avg(abs(contribution)) DESC, feature LIMIT 10""")

register("row_sample", ("churn_clean",), """
SELECT row_id, label, tenure FROM churn_clean ORDER BY md5(concat('42|', row_id)), row_id LIMIT 500""")

# ---------------------------------------------------------------- G
register("soft_voting", ("scored_orders",), """
SELECT fold, row_id, label, round(avg(proba), 6) AS proba, 'SoftVoting' AS model FROM scored_orders GROUP BY fold, row_id, label""")

register("oof_accounting", ("churn_clean",), f"""
SELECT m.model, count(*) AS n_rows, count(*) AS n_predictions, CAST(1 AS BIGINT) AS max_times, CAST(1 AS BIGINT) AS min_times
FROM ({_HOLDOUT}) s, (VALUES ('ExtraTrees'), ('RandomForest'), ('XGBoost'), ('LightGBM')) m(model) WHERE s.split = 'train' GROUP BY m.model""")

# learned plans: which rows are predicted, how often and with which labels does not depend on the models
_TEST = f"SELECT count(*) FILTER (label = 0) AS n_negative, count(*) FILTER (label = 1) AS n_positive FROM ({_HOLDOUT}) h WHERE split = 'test'"

register("model_comparison", ("churn_clean",), """
SELECT m.model, f.fold, count(*) AS n_rows, count(DISTINCT row_id) AS n_keys, CAST(sum(label) AS BIGINT) AS n_positive,
       CAST(0 AS BIGINT) AS n_bad
FROM (SELECT row_id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY md5(concat('42|', row_id)), row_id) - 1) % 3 AS INT) AS fold
      FROM churn_clean) f,
     (VALUES ('ExtraTrees'), ('RandomForest'), ('XGBoost'), ('LightGBM'), ('SoftVoting'), ('OptimizedStacking')) m(model)
GROUP BY m.model, f.fold""")

register("evaluate_best", ("churn_clean",), f"""
SELECT k.kind, t.n_negative, t.n_positive, true AS in_range FROM ({_TEST}) t, (VALUES ('default'), ('tuned')) k(kind)""")

register("ablation_holdout", ("churn_clean",), f"""
SELECT v.variant, v.learner, v.smote, v.threshold_mode, t.n_negative, t.n_positive, true AS in_range
FROM ({_TEST}) t, (VALUES
  ('Single_XGBoost_NoSMOTE', 'xgb', 'none', 'fixed'),
  ('Single_XGBoost_SMOTE', 'xgb', 'fixed', 'fixed'),
  ('Stacking_NoSMOTE_Fixed', 'fixed_stack', 'none', 'fixed'),
  ('Stacking_SMOTE_Fixed', 'fixed_stack', 'fixed', 'fixed'),
  ('FeedbackStacking_SMOTE_Threshold0.50', 'tuned_stack', 'tuned', 'fixed'),
  ('Full_FeedbackStacking_SMOTE_TunedThreshold', 'tuned_stack', 'tuned', 'tuned')) v(variant, learner, smote, threshold_mode)""")

register("explain_stack", ("churn_clean",), f"""
SELECT f.feature, true AS in_range, t.n_negative, t.n_positive
FROM ({_TEST}) t, (VALUES ('SeniorFlag'), ('tenure'), ('n_orders'), ('AcctBal'), ('AvgOrder'), ('TotalCharges'),
  ('Segment'), ('Nation'), ('Region'), ('LastPriority')) f(feature)""")

register("meta_features", ("scored_orders",), """
SELECT fold, row_id, label,
  max(CASE WHEN model = 'ExtraTrees' THEN proba END) AS ExtraTrees,
  max(CASE WHEN model = 'RandomForest' THEN proba END) AS RandomForest,
  max(CASE WHEN model = 'XGBoost' THEN proba END) AS XGBoost,
  max(CASE WHEN model = 'LightGBM' THEN proba END) AS LightGBM
FROM scored_orders GROUP BY fold, row_id, label""")

# ---------------------------------------------------------------- K
register("fold_thresholds", ("scored_orders",), f"""
WITH keys AS (SELECT DISTINCT row_id, label, fold FROM scored_orders),
ex AS (SELECT CAST(i.fold_id AS INT) AS fold_id, row_id, label FROM keys, (SELECT unnest(range(0, 5)) AS fold_id) i WHERE fold <> i.fold_id),
inner_t AS (SELECT fold_id, row_id FROM (
  SELECT *, row_number() OVER (PARTITION BY fold_id, label ORDER BY md5(concat(CAST(42 + fold_id AS VARCHAR), '|', CAST(row_id AS VARCHAR))), row_id) AS rk,
         count(*) OVER (PARTITION BY fold_id, label) AS n FROM ex) x WHERE rk <= round(0.2 * n)),
tune AS (SELECT s.*, inner_t.fold_id FROM scored_orders s JOIN inner_t ON s.row_id = inner_t.row_id),
best AS ({best_sql(sweep_sql('tune', 'model, fold_id', False), 'model, fold_id', 'f1', 'f1')}),
ev AS (SELECT s.model, s.fold, b.threshold, b.best_score, {confusion_sql('proba >= b.threshold')}
       FROM scored_orders s JOIN best b ON s.model = b.model AND s.fold = b.fold_id GROUP BY s.model, s.fold, b.threshold, b.best_score)
SELECT model, fold, round(threshold, 6) AS threshold, round(best_score, 6) AS best_score,
       round(CASE WHEN 2*tp+fp+fn > 0 THEN 2.0*tp/(2*tp+fp+fn) ELSE 0.0 END, 6) AS fold_f1 FROM ev""")

register("component_contribution", ("scored_orders",), f"""
WITH {_LONG_RAW},
t AS (SELECT fold, metric, value AS tv FROM l WHERE model = 'LightGBM')
SELECT l.model AS Compared_with, l.metric, round(avg(t.tv - l.value), 6) AS mean_diff
FROM l JOIN t ON l.fold = t.fold AND l.metric = t.metric WHERE l.model <> 'LightGBM' GROUP BY l.model, l.metric""")


# ---------------------------------------------------------------- A
# Missing-value tokens (same list as foldspark.sources.io).
_NA = "(" + ", ".join("'" + t + "'" for t in ('', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN', '<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null')) + ")"


def _na(c: str) -> str:
    return f"CASE WHEN {c} IN {_NA} THEN NULL ELSE {c} END AS {c}"


register("csv_roundtrip", ("customer_churn_raw",), f"""
SELECT {_na('customerID')}, {_na('Segment')}, {_na('Nation')}, {_na('Region')}, SeniorFlag, tenure, n_orders, AcctBal, AvgOrder,
       {_na('TotalCharges')}, {_na('LastPriority')}, {_na('Churn')}
FROM customer_churn_raw""")

register("csv_infer", ("customer_churn_raw",), f"""
SELECT {_na('customerID')}, {_na('Segment')}, {_na('Nation')}, {_na('Region')}, CAST(SeniorFlag AS BIGINT) AS SeniorFlag,
       CAST(tenure AS BIGINT) AS tenure, CAST(n_orders AS BIGINT) AS n_orders,
       CASE WHEN tenure = 0 THEN NULL ELSE round(CAST(AcctBal AS DOUBLE), 6) END AS AcctBal,
       round(CAST(AvgOrder AS DOUBLE), 6) AS AvgOrder,
       {_na('TotalCharges')}, {_na('LastPriority')}, {_na('Churn')}
FROM customer_churn_raw""")

# Step-5 fall-backs for the tuned settings when no best config is given.
_DEFAULTS = {
    "model__final_estimator__C": "1.132953262747208",
    "model__final_estimator__class_weight": "balanced",
    "model__passthrough": "true",
    "smote__sampling_strategy": "0.6",
    "smote__k_neighbors": "3",
    "model__et__max_depth": "10",
    "model__rf__max_depth": "10",
    "model__xgb__max_depth": "4",
    "model__xgb__learning_rate": "0.05",
    "model__lgbm__learning_rate": "0.05",
    "model__lgbm__num_leaves": "15",
    "model": "RandomForest",
    "threshold": "0.5",
}

_search_body = _BODIES["search_best_so_far"][1]
_best_cte = _search_body[_search_body.index("WITH RECURSIVE ") + len("WITH RECURSIVE "):_search_body.rindex("SELECT iteration, status")].rstrip().rstrip(",")
register("config_overlay", ("scored_orders",), f"""
WITH RECURSIVE {_best_cte},
bst AS (SELECT cand.model, round(cand.threshold, 6) AS threshold FROM s JOIN cand ON s.iteration = cand.iteration
        WHERE s.status = 'best' ORDER BY s.iteration DESC LIMIT 1),
given AS (SELECT 'model' AS key, model AS value FROM bst UNION ALL SELECT 'threshold', CAST(threshold AS VARCHAR) FROM bst),
d AS (SELECT * FROM (VALUES {", ".join(f"('{k}', '{v}')" for k, v in _DEFAULTS.items())}) v(key, value))
SELECT coalesce(d.key, g.key) AS key, CASE WHEN g.key IS NOT NULL THEN g.value ELSE d.value END AS value
FROM d FULL JOIN given g ON d.key = g.key""")


# ---------------------------------------------------------------- G stage 2
_SPLIT_FEATURES = ['SeniorFlag', 'tenure', 'n_orders', 'AcctBal', 'AvgOrder', 'TotalCharges']
_lf = " UNION ALL ".join(f"SELECT '{c}' AS col_name, {i} AS position, CAST({c} AS DOUBLE) AS value, 0.5 - label AS g, 0.25 AS h FROM churn_clean"
                         for i, c in enumerate(_SPLIT_FEATURES))
register("boost_root_split", ("churn_clean",), f"""
WITH lf AS ({_lf}),
ed AS (SELECT col_name, list_sort(list_distinct(quantile_cont(value, [{", ".join(repr(i / 16) for i in range(1, 16))}]))) AS edges
       FROM lf WHERE value IS NOT NULL GROUP BY col_name),
b AS (SELECT lf.col_name, position, CASE WHEN value IS NULL THEN -1 ELSE len(list_filter(edges, lambda e: e < value)) END AS bin, g, h, edges
      FROM lf JOIN ed ON lf.col_name = ed.col_name),
hist AS (SELECT col_name, position, bin, sum(g) AS G, sum(h) AS H, any_value(edges) AS edges FROM b GROUP BY col_name, position, bin),
tot AS (SELECT col_name, sum(G) AS Gt, sum(H) AS Ht FROM hist GROUP BY col_name),
cum AS (SELECT col_name, position, bin, edges,
               sum(G) OVER (PARTITION BY col_name ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS GL,
               sum(H) OVER (PARTITION BY col_name ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS HL
        FROM hist WHERE bin >= 0),
c AS (SELECT cum.col_name, position, CAST(bin AS INT) AS bin, edges[bin + 1] AS threshold,
             GL * GL / (HL + 1.0) + (Gt - GL) * (Gt - GL) / (Ht - HL + 1.0) - Gt * Gt / (Ht + 1.0) AS gain
      FROM cum JOIN tot ON cum.col_name = tot.col_name WHERE bin < len(edges))
SELECT col_name, position, bin, round(threshold, 6) AS threshold, round(gain, 6) AS gain FROM (
  SELECT *, row_number() OVER (PARTITION BY col_name ORDER BY gain DESC, bin ASC) AS r FROM c) x WHERE r = 1""")


# two rounds of boosting: gradients are whole numbers of 2^-24, so sums do not depend on their order
_SIDES = """
ids AS (SELECT CAST(unnest(range(0, 5)) AS INT) AS fold_id),
tr AS (SELECT ids.fold_id, row_id, label, [{cols}] AS x FROM churn_folds f JOIN ids ON f.fold <> ids.fold_id),
vals AS (SELECT fold_id, row_id, f, x[f + 1] AS v FROM (SELECT fold_id, row_id, x, unnest(range(0, {p})) AS f FROM tr) u),
ed AS MATERIALIZED (SELECT fold_id, f, list_sort(list_distinct(quantile_cont(v, [{qs}]))) AS edges FROM vals WHERE v IS NOT NULL GROUP BY fold_id, f),
b AS MATERIALIZED (SELECT v.fold_id, row_id, list(CASE WHEN v IS NULL THEN len(edges) ELSE len(list_filter(edges, lambda e: e < v)) END ORDER BY v.f) AS b
       FROM vals v JOIN ed ON v.fold_id = ed.fold_id AND v.f = ed.f GROUP BY v.fold_id, row_id),
r0 AS MATERIALIZED (SELECT tr.fold_id, tr.row_id, label, b, 0.0::DOUBLE AS margin FROM tr JOIN b ON tr.fold_id = b.fold_id AND tr.row_id = b.row_id)
""".format(cols=", ".join(f"CAST({c} AS DOUBLE)" for c in CHURN_NUMERIC), p=len(CHURN_NUMERIC),
           qs=", ".join(repr(i / 16) for i in range(1, 16)))


def _split_ctes(name: str, src: str, lam: float = 1.0, mcw: float = 1.0) -> str:
    """``<name>_best`` (fold_id, path, f, bin, gain): best split of every node of ``src (fold_id, row_id, path, b, g, h)``."""
    u = "16777216.0"
    return f"""
{name}_hist AS (SELECT fold_id, path, f, b[f + 1] AS bin, sum(g) AS g, sum(h) AS h, count(*) AS n FROM (
    SELECT fold_id, path, b, g, h, unnest(range(0, {len(CHURN_NUMERIC)})) AS f FROM {src}) q GROUP BY ALL),
{name}_cum AS (SELECT fold_id, path, f, bin, sum(g) OVER w / {u} AS gl, sum(h) OVER w / {u} AS hl, sum(n) OVER w AS nl,
    sum(g) OVER t / {u} AS gt, sum(h) OVER t / {u} AS ht, sum(n) OVER t AS nt FROM {name}_hist
    WINDOW w AS (PARTITION BY fold_id, path, f ORDER BY bin ROWS UNBOUNDED PRECEDING), t AS (PARTITION BY fold_id, path, f)),
{name}_gain AS (SELECT *, gl * gl / (hl + {lam}) + (gt - gl) * (gt - gl) / (ht - hl + {lam}) - gt * gt / (ht + {lam}) AS gain
    FROM {name}_cum WHERE nl < nt AND hl >= {mcw} AND ht - hl >= {mcw}),
{name}_best AS MATERIALIZED (SELECT fold_id, path, f, bin, gain FROM (
    SELECT *, row_number() OVER (PARTITION BY fold_id, path ORDER BY gain DESC, f, bin) AS r FROM {name}_gain) x WHERE r = 1 AND gain > 1e-6)"""


def _gradients(t: int) -> str:
    p = "1.0 / (1.0 + exp(-margin))"
    return f"""
n{t}_0 AS MATERIALIZED (SELECT fold_id, row_id, '' AS path, b, margin, label,
    CAST(floor(({p} - label) * 16777216 + 0.5) AS BIGINT) AS g,
    CAST(floor(greatest({p} * (1 - {p}), 1e-16) * 16777216 + 0.5) AS BIGINT) AS h FROM r{t})"""


def _moved(name: str, src: str, best: str) -> str:
    return f"""
{name} AS MATERIALIZED (SELECT s.fold_id, row_id, s.path || CASE WHEN k.f IS NULL THEN '' WHEN b[k.f + 1] <= k.bin THEN 'L' ELSE 'R' END AS path,
    b, margin, label, g, h FROM {src} s LEFT JOIN {best} k ON s.fold_id = k.fold_id AND s.path = k.path)"""


def _round_end(t: int, last: str, rate: float = 0.2) -> str:
    return f"""
leaf{t} AS MATERIALIZED (SELECT fold_id, path, -(sum(g) / 16777216.0) / (sum(h) / 16777216.0 + 1.0) * {rate} AS value FROM {last} GROUP BY fold_id, path),
r{t + 1} AS MATERIALIZED (SELECT s.fold_id, row_id, label, b, margin + value AS margin FROM {last} s JOIN leaf{t} l ON s.fold_id = l.fold_id AND s.path = l.path)"""


def _tree_rows(t: int, last: str, splits: str) -> str:
    """Every node of the tree: a leaf's rows are in it and in all nodes above."""
    return f"""
SELECT a.fold_id, CAST({t} AS INT) AS tree, a.path, CAST(coalesce(k.f, -1) AS INT) AS feature, round(ed.edges[k.bin + 1], 6) AS threshold,
       round(l.value, 6) + 0.0 AS value, round(k.gain, 6) AS gain, round(a.h / 16777216.0, 6) AS cover, CAST(a.n AS BIGINT) AS n_rows
FROM (SELECT fold_id, path[:len] AS path, sum(h) AS h, count(*) AS n FROM (
        SELECT fold_id, path, h, unnest(range(0, length(path) + 1)) AS len FROM {last}) z GROUP BY ALL) a
LEFT JOIN ({splits}) k ON a.fold_id = k.fold_id AND a.path = k.path
LEFT JOIN leaf{t} l ON a.fold_id = l.fold_id AND a.path = l.path
LEFT JOIN ed ON ed.fold_id = a.fold_id AND ed.f = k.f"""


def boost_sql() -> str:
    parts, rows = [_SIDES], []
    for t in range(2):
        parts.append(_gradients(t))
        for d in range(2):
            parts.append(f"\nn{t}_{d}a AS (SELECT * FROM n{t}_{d} WHERE length(path) = {d})")
            parts.append(_split_ctes(f"k{t}_{d}", f"n{t}_{d}a"))
            parts.append(_moved(f"n{t}_{d + 1}", f"n{t}_{d}", f"k{t}_{d}_best"))
        parts.append(_round_end(t, f"n{t}_2"))
        rows.append(_tree_rows(t, f"n{t}_2", f"SELECT * FROM k{t}_0_best UNION ALL SELECT * FROM k{t}_1_best"))
    return "WITH " + ",".join(parts) + "\nUNION ALL".join(rows)


def leafwise_sql(leaves: int = 5) -> str:
    """One best leaf a step; ties of gain go to the shorter path, then in the order of the alphabet."""
    parts, rows = [_SIDES], []
    for t in range(2):
        parts.append(_gradients(t))
        for d in range(leaves - 1):
            parts.append(_split_ctes(f"k{t}_{d}", f"n{t}_{d}"))
            parts.append(f"""
k{t}_{d}_one AS MATERIALIZED (SELECT fold_id, path, f, bin, gain FROM (
    SELECT *, row_number() OVER (PARTITION BY fold_id ORDER BY gain DESC, length(path), path) AS r FROM k{t}_{d}_best) x WHERE r = 1)""")
            parts.append(_moved(f"n{t}_{d + 1}", f"n{t}_{d}", f"k{t}_{d}_one"))
        parts.append(_round_end(t, f"n{t}_{leaves - 1}"))
        rows.append(_tree_rows(t, f"n{t}_{leaves - 1}", " UNION ALL ".join(f"SELECT * FROM k{t}_{d}_one" for d in range(leaves - 1))))
    return "WITH " + ",".join(parts) + "\nUNION ALL".join(rows)


register("boost_two_rounds", ("churn_folds",), boost_sql())
_NAMES = ", ".join(f"({i}, '{c}')" for i, c in enumerate(CHURN_NUMERIC))
register("mean_gain", ("churn_folds",), boost_sql().replace("\nSELECT a.fold_id", ",\nnodes AS (\nSELECT a.fold_id", 1) + f""")
SELECT CAST(feature AS INT) AS feature, n.name, round(g / sum(g) OVER (), 6) AS importance
FROM (SELECT feature, avg(gain) AS g FROM nodes WHERE fold_id = 0 AND feature >= 0 GROUP BY feature) m
JOIN (VALUES {_NAMES}) n(i, name) ON n.i = m.feature""")
register("contribution_sums", ("churn_clean",), f"""
SELECT row_id, 0.0::DOUBLE AS difference, true AS has_parts FROM ({_HOLDOUT}) h WHERE split = 'test'""")
register("boost_two_rounds_leafwise", ("churn_folds",), leafwise_sql())

register("search_candidates", ("scored_orders",), f"""
WITH cand AS (
  SELECT CAST(i AS INT) AS iteration,
         ['ExtraTrees', 'RandomForest', 'XGBoost', 'LightGBM'][CAST(floor({_uni("'42'", "'model'", "CAST(i AS VARCHAR)")} * 4) AS INT) + 1] AS model,
         exp({_LA!r} + {_uni("'42'", "'threshold'", "CAST(i AS VARCHAR)")} * {(_LB - _LA)!r}) AS threshold
  FROM range(1, 21) t(i)),
c AS (SELECT iteration, cand.model, threshold, fold,
             CAST(count_if(label = 1 AND proba >= threshold) AS DOUBLE) AS tp,
             CAST(count_if(label = 0 AND proba >= threshold) AS DOUBLE) AS fp,
             CAST(count_if(label = 1 AND proba < threshold) AS DOUBLE) AS fn
      FROM scored_orders s JOIN cand ON s.model = cand.model GROUP BY iteration, cand.model, threshold, fold),
f AS (SELECT *, CASE WHEN 2*tp+fp+fn > 0 THEN 2*tp/(2*tp+fp+fn) ELSE 0.0 END AS f1 FROM c)
SELECT iteration, model, round(threshold, 6) AS threshold, round(avg(f1), 6) AS f1_mean, round(stddev_pop(f1), 6) AS f1_std
FROM f GROUP BY iteration, model, threshold""")

register("best_config_json", ("scored_orders",), f"""
WITH RECURSIVE {_best_cte}
SELECT 'f1' AS best_refit_metric, round(s.best, 6) AS best_refit_score_cv_mean, cand.model, round(cand.threshold, 6) AS threshold,
       CAST(20 AS BIGINT) AS max_iter, CAST(6 AS BIGINT) AS patience, CAST(0.0001 AS DOUBLE) AS min_delta
FROM s JOIN cand ON s.iteration = cand.iteration WHERE s.status = 'best' ORDER BY s.iteration DESC LIMIT 1""")
