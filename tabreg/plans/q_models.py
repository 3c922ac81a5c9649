"""Registered queries: preparation stages (S-checked) and the Spark ML pool, evaluation and explanation
(rows-only checks; closed-form properties are unit-tested in tests/)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabreg.functions.bands import driver_direction, driver_direction_sql
from tabreg.operators import explain as X
from tabreg.operators import models as M
from tabreg.operators.evaluate import regression_metrics
from tabreg.operators.prep import (DropFirstOneHot, ExactMedianImputer, PopulationScaler, feature_names,
                                   named_features, prepare_input)
from tabreg.operators.split import hash_split
from tabreg.plans.registry import query, r6, rounded
from tabreg.sources.tables import (CATEGORICAL_FEATURES, INTERACTION, LINE_SPLIT_SQL, NUMERIC_FEATURES, TARGET,
                                   bucket_sql, line_charge_split, load)

NUM = [*NUMERIC_FEATURES, INTERACTION[0]]


def _split(spark, sf_dir):
    return line_charge_split(spark, sf_dir)


def _metrics_by_side(model, data):
    return rounded(regression_metrics(M.score(model, data), label=TARGET, by=["split"]))


def _fit_one(spark, sf_dir, name):
    data = _split(spark, sf_dir)
    c = M.catalogue()[name]
    # the preparation and the fit read the train rows some ten times: the split's digests are made once
    train = data.where(F.col("split") == "train").select(*NUMERIC_FEATURES, *CATEGORICAL_FEATURES, TARGET).persist()
    try:
        model, _ = M.fit_candidate(c, train, NUMERIC_FEATURES, CATEGORICAL_FEATURES, INTERACTION, TARGET)
    finally:
        train.unpersist()
    return model, data


# Least squares in SQL: the features are made orthogonal one after another on the train rows; what is left of a feature
# is a combination of itself and those before it, so predictions and coefficients follow from simple sums.
_OLS = [*((c, f"cast({c} as double)") for c in NUMERIC_FEATURES), (INTERACTION[0], f"{INTERACTION[1]} * {INTERACTION[2]}"),
        *((f"{c}_{v}", f"case when {c} = '{v}' then 1.0 else 0.0 end::double") for c, v in (
            ("l_returnflag", "N"), ("l_returnflag", "R"), ("l_linestatus", "O")))]


def _ols_sql(final: str) -> str:
    k = len(_OLS)
    ctes = ["t0 as materialized (select row_key, split, charge as y, " + ", ".join(f"{e} as x{i}" for i, (_, e) in enumerate(_OLS, 1))
            + f" from ({LINE_SPLIT_SQL}))"]
    for i in range(1, k + 1):
        b = "".join(f", sum(z{j} * x{i}) / sum(z{j} * z{j}) as b{i}_{j}" for j in range(1, i))
        ctes.append(f"s{i} as materialized (select avg(x{i}) as m{i}, stddev_pop(x{i}) as sd{i}{b} from t{i - 1} where split = 'train')")
        rest = "".join(f" - b{i}_{j} * z{j}" for j in range(1, i))
        ctes.append(f"t{i} as materialized (select t{i - 1}.*, x{i} - m{i}{rest} as z{i} from t{i - 1}, s{i})")
    ctes.append("c as materialized (select avg(y) as ybar, " + ", ".join(f"sum(z{i} * y) / sum(z{i} * z{i}) as c{i}" for i in range(1, k + 1))
                + f" from t{k} where split = 'train')")
    ctes.append(f"p as (select row_key, split, y as label, ybar + {' + '.join(f'c{i} * z{i}' for i in range(1, k + 1))} as prediction from t{k}, c)")
    back = [f"c{i}" + "".join(f" - b{j}_{i} * w{j}" for j in range(i + 1, k + 1)) + f" as w{i}" for i in range(k, 0, -1)]
    ctes.append(f"w as materialized (select {', '.join(back)}, {', '.join(f'm{i}, sd{i}' for i in range(1, k + 1))} from c, "
                + ", ".join(f"s{i}" for i in range(1, k + 1)) + ")")
    return "with " + ", ".join(ctes) + " " + final


_METRICS_SQL = f"""select split, cast(count(*) as bigint) as n, {r6('avg(abs(label - prediction))')} as mae,
  {r6('avg((label - prediction) * (label - prediction))')} as mse,
  {r6('sqrt(avg((label - prediction) * (label - prediction)))')} as rmse,
  {r6('1 - sum((label - prediction) * (label - prediction)) / nullif(var_pop(label) * count(*), 0)')} as r2 from p group by split"""
_numeric = len(NUMERIC_FEATURES) + 1
_CONTRIBUTIONS_SQL = " union all ".join(
    f"select row_key, '{n}' as feature, " + (f"(x{i} - m{i}) / sd{i}" if i <= _numeric else f"x{i}") + f" as value, w{i} * (x{i} - m{i}) as contribution "
    f"from t0, w where split = 'test'" for i, (n, _) in enumerate(_OLS, 1))


def _ridge_sql(alpha: float, final: str) -> str:
    """Ridge as least squares with one more row per feature: sqrt(alpha) there, 0 elsewhere, label 0 (features and label centred)."""
    k = len(_OLS)
    means = ", ".join(f"avg({e}) as m{i}, stddev_pop({e}) as sd{i}" for i, (_, e) in enumerate(_OLS, 1))
    scaled = ", ".join(f"({e} - m{i})" + (f" / sd{i}" if i <= _numeric else "") + f" as x{i}" for i, (_, e) in enumerate(_OLS, 1))
    more = " union all ".join(f"select null, 'more', 0.0, 0.0, " + ", ".join(str(alpha ** 0.5 if i == j else 0.0) for i in range(1, k + 1))
                              for j in range(1, k + 1))
    ctes = [f"lc as materialized (select * from ({LINE_SPLIT_SQL}))", f"st as materialized (select avg(charge) as ybar, {means} from lc where split = 'train')",
            f"t0 as materialized (select row_key, split, charge as label, charge - ybar as y, {scaled} from lc, st union all {more})"]
    for i in range(1, k + 1):
        b = ", ".join(f"sum(z{j} * x{i}) / sum(z{j} * z{j}) as b{i}_{j}" for j in range(1, i)) or "max(1) as one"
        ctes.append(f"s{i} as materialized (select {b} from t{i - 1} where split <> 'test')")
        ctes.append(f"t{i} as materialized (select t{i - 1}.*, x{i}" + "".join(f" - b{i}_{j} * z{j}" for j in range(1, i)) + f" as z{i} from t{i - 1}, s{i})")
    ctes.append("c as materialized (select " + ", ".join(f"sum(z{i} * y) / sum(z{i} * z{i}) as c{i}" for i in range(1, k + 1)) + f" from t{k} where split <> 'test')")
    ctes.append(f"p as (select split, label, ybar + {' + '.join(f'c{i} * z{i}' for i in range(1, k + 1))} as prediction from t{k}, c, st where split <> 'more')")
    return "with " + ", ".join(ctes) + " " + final


_SQL = {"ols": _ols_sql(_METRICS_SQL), "ridge": _ridge_sql(1.0, _METRICS_SQL)}


def _model_query(key: str, name: str, doc: str):
    def fn(spark, sf_dir):
        model, data = _fit_one(spark, sf_dir, name)
        return _metrics_by_side(model, data)
    fn.__doc__ = doc
    query(key, sql=_SQL.get(key))(fn)


for _key, _name, _doc in [
    ("ols", "Linear Regression", "Least squares on scaled inputs; MAE/MSE/RMSE/R2 on train and test."),
    ("ridge", "Ridge Regression", "Ridge (alpha 1.0, penalty matched to the SSE + alpha|w|^2 objective)."),
    ("lasso", "Lasso Regression", "Lasso (alpha 0.001)."),
    ("decision_tree", "Decision Tree", "Regression tree, depth 10."),
    ("random_forest", "Random Forest", "Bootstrap forest, all features per split, no depth limit."),
    ("gbt", "Gradient Boosting", "Gradient-boosted trees, rate 0.05, depth 3."),
    ("gbt_subsampled", "gbt_subsampled", "Second-order boosted trees, depth 5, row and column shares 0.9."),
    ("gbt_wide", "gbt_wide", "Leaf-wise boosted trees, 31 leaves."),
    ("gbt_deep", "gbt_deep", "Oblivious boosted trees, depth 6, 500 rounds."),
    ("svr", "SVR", "Support vector regression on random Fourier features of a Gaussian kernel (C 100, epsilon 0.05)."),
    ("forest_subspace", "Extra Trees", "Extremely randomised trees, no depth limit."),
    ("adaboost_r2", "AdaBoost", "AdaBoost.R2 (linear loss, depth-3 trees on weighted resamples, weighted-median prediction)."),
]:
    _model_query(_key, _name, _doc)


@query("model_pool")
def q_model_pool(spark, sf_dir):
    """Fit, five-fold cross-validation and ranking of the whole catalogue with full rounds (times: README)."""
    from tabreg.operators.rank import rank_models
    results, failures, _ = M.train_all(_split(spark, sf_dir), M.catalogue(), NUMERIC_FEATURES, CATEGORICAL_FEATURES,
                                       INTERACTION, TARGET, "row_key", folds=5)
    if failed := failures.collect():  # scores and ranks depend on who is in the pool
        raise RuntimeError("; ".join(f"{r['algorithm']}: {r['failure']}" for r in failed))
    return rounded(rank_models(results).select("deployment_rank", "algorithm", "r2", "rmse", "mae", "cv_r2_mean", "cv_r2_std",
                                               "r2_gap", "generalisation", "complexity"))


@query("cross_validate_ml")
def q_cross_validate_ml(spark, sf_dir):
    """5-fold CV of the depth-10 tree; the whole preparation is refitted inside each fold."""
    data = _split(spark, sf_dir).where(F.col("split") == "train")
    c = M.catalogue()["Decision Tree"]
    return rounded(M.cross_validate(c, data, NUMERIC_FEATURES, CATEGORICAL_FEATURES, INTERACTION, TARGET,
                                    "row_key", 5))


@query("predict_batch", sql="""
  select l_orderkey, l_linenumber, true as kept, true as predicted from lineitem""")
def q_predict_batch(spark, sf_dir):
    """Validated batch scoring of every lineitem row: extra columns kept, one finite prediction per row."""
    model, _ = _fit_one(spark, sf_dir, "Linear Regression")
    li = load(spark, sf_dir, "lineitem")  # the batch carries extra columns (keys, dates) that are kept
    out = M.predict_batch(model, li, [*NUMERIC_FEATURES, *CATEGORICAL_FEATURES], INTERACTION, "predicted_charge")
    kept = all(c in out.columns for c in li.columns)
    return out.select("l_orderkey", "l_linenumber", F.lit(kept).alias("kept"),
                      (F.col("predicted_charge").isNotNull() & ~F.isnan("predicted_charge")).alias("predicted"))


@query("importance_native")
def q_importance_native(spark, sf_dir):
    """Native importances of the depth-10 tree, with percentage shares."""
    from tabreg.operators.rank import importance_share
    model, _ = _fit_one(spark, sf_dir, "Decision Tree")
    imp = X.importance_native(model.stages[-1], feature_names(model))
    return rounded(importance_share(imp, "importance"))


@query("importance_permutation")
def q_importance_permutation(spark, sf_dir):
    """Permutation importance (drop in test R2, 10 repeats) of every raw input of the linear pipeline."""
    model, data = _fit_one(spark, sf_dir, "Linear Regression")
    test = data.where(F.col("split") == "test")
    return rounded(X.importance_permutation(model, test, [*NUMERIC_FEATURES, *CATEGORICAL_FEATURES], "row_key",
                                            TARGET, repeats=10))


def _linear_contributions(spark, sf_dir):
    model, data = _fit_one(spark, sf_dir, "Linear Regression")
    names = feature_names(model)
    prepared = named_features(model, data)
    train_prepared = prepared.where(F.col("split") == "train")
    means = train_prepared.agg(*[F.avg(n).alias(n) for n in names]).first()
    lr = model.stages[-1]
    contrib = X.shap_linear(prepared.where(F.col("split") == "test"), names, lr.coefficients.toArray().tolist(),
                            "row_key", [float(means[n]) for n in names])
    return contrib


@query("shap_linear", sql=_ols_sql(f"select row_key, feature, {r6('value')} as value, {r6('round(contribution, 2)')} as contribution from ({_CONTRIBUTIONS_SQL})"))
def q_shap_linear(spark, sf_dir):
    """Exact linear contributions coef * (x - train mean) on the model's own features, test rows."""
    return rounded(_linear_contributions(spark, sf_dir).withColumn("contribution", F.round("contribution", 2)))


@query("driver_direction", sql=_ols_sql(f"""select row_key, feature, {r6('value')} as value, {r6('contribution')} as contribution,
  {driver_direction_sql('contribution')} as direction
  from (select row_key, feature, value, round(contribution, 2) as contribution from ({_CONTRIBUTIONS_SQL}))"""))
def q_driver_direction(spark, sf_dir):
    """Increases / Reduces label of every linear contribution."""
    c = _linear_contributions(spark, sf_dir).withColumn("contribution", F.round("contribution", 2))  # cents
    return rounded(c.withColumn("direction", driver_direction(F.col("contribution"))))


def _tree_contributions(spark, sf_dir):
    model, data = _fit_one(spark, sf_dir, "Decision Tree")
    train = data.where(F.col("split") == "train")
    test = data.where(F.col("split") == "test")
    return X.shap_tree(model, test, X.background_rows(train, "row_key", X.BACKGROUND), "row_key")


@query("shap_sampled")
def q_shap_sampled(spark, sf_dir):
    """Exact Shapley values of the tree for every test row against a sample of 100 background rows."""
    return rounded(_tree_contributions(spark, sf_dir))


@query("shap_global")
def q_shap_global(spark, sf_dir):
    """Mean absolute Shapley value per feature of the tree."""
    return rounded(X.shap_global(_tree_contributions(spark, sf_dir)))


@query("learning_curve")
def q_learning_curve(spark, sf_dir):
    """Train/validation R2 (mean and population std over 5 folds) at 20..100 % of the training folds."""
    from tabreg.operators.evaluate import learning_curve
    data = _split(spark, sf_dir).where(F.col("split") == "train")
    c = M.catalogue()["Linear Regression"]
    return rounded(learning_curve(c, data, NUMERIC_FEATURES, CATEGORICAL_FEATURES, INTERACTION, TARGET, "row_key"))


# ---- preparation stages: statistics from train rows only, checked against SQL ----------------------

_DOC_SPLIT_SQL = (f"(select d.doc_id, l.quality, l.toxic, case when {bucket_sql('d.doc_id', 'split42', 100)} < 20 "
                  f"then 'test' else 'train' end as split from documents d left join labels l on d.doc_id = l.doc_id)")


@query("impute_median", sql=f"""
  with t as {_DOC_SPLIT_SQL},
  m as (select quantile_cont(quality, 0.5) as mq, quantile_cont(toxic, 0.5) as mt from t where split = 'train')
  select doc_id, split, {r6('coalesce(quality, mq)')} as quality, {r6('coalesce(toxic, mt)')} as toxic from t, m""")
def q_impute_median(spark, sf_dir):
    """Exact train-only medians fill the missing label values of every document."""
    d = load(spark, sf_dir, "documents").select("doc_id")
    lab = load(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    t = hash_split(d.join(lab, "doc_id", "left"), "doc_id")
    imp = ExactMedianImputer(inputCols=["quality", "toxic"]).fit(t.where(F.col("split") == "train"))
    return rounded(imp.transform(t).select("doc_id", "split", "quality", "toxic"))


_LC = f"({LINE_SPLIT_SQL})"


@query("standard_scale", sql=f"""
  with t as {_LC},
  s as (select {', '.join(f'avg({c}) as m_{c}, stddev_pop({c}) as s_{c}' for c in NUMERIC_FEATURES)}
        from t where split = 'train')
  select row_key, {', '.join(r6(f"({c} - m_{c}) / (case when s_{c} = 0 or s_{c} is null then 1 else s_{c} end)") + f' as {c}'
                             for c in NUMERIC_FEATURES)} from t, s""")
def q_standard_scale(spark, sf_dir):
    """Population-std standardisation fitted on train rows, applied to all rows."""
    t = _split(spark, sf_dir)
    sc = PopulationScaler(inputCols=NUMERIC_FEATURES).fit(t.where(F.col("split") == "train"))
    return rounded(sc.transform(t).select("row_key", *NUMERIC_FEATURES))


def _onehot_sql():
    from tabreg.sources.tables import LINE_SPLIT_SQL as LS
    return f"""
  with t as ({LS}),
  lv as (select 'l_returnflag' as c, l_returnflag as v from t where split = 'train' group by 2
         union all select 'l_linestatus', l_linestatus from t where split = 'train' group by 2),
  kept as (select c, v from (select c, v, row_number() over (partition by c order by v) as rk from lv) where rk > 1)
  select row_key, c || '_' || v as dummy, case when (c = 'l_returnflag' and l_returnflag = v)
                                         or (c = 'l_linestatus' and l_linestatus = v) then 1.0 else 0.0 end::double as value
  from t, kept"""


@query("one_hot_drop_first", sql=_onehot_sql())
def q_one_hot_drop_first(spark, sf_dir):
    """Drop-first dummies of the two categoricals (levels sorted from train rows), in long form."""
    t = _split(spark, sf_dir)
    enc = DropFirstOneHot(inputCols=CATEGORICAL_FEATURES).fit(t.where(F.col("split") == "train"))
    out = enc.transform(t)
    return out.select("row_key", F.explode(F.array(*[
        F.struct(F.lit(n).alias("dummy"), F.col(c).alias("value"))
        for n, c in zip(enc.outputNames(), enc.outputColumns())])).alias("kv")).select(
        "row_key", "kv.dummy", "kv.value")


def _prep_sql(scale: bool) -> str:
    from tabreg.sources.tables import LINE_SPLIT_SQL as LS
    cols = NUMERIC_FEATURES + ["price_discount"]
    stats = ", ".join(f"quantile_cont({c}, 0.5) as med_{c}, avg({c}) as m_{c}, stddev_pop({c}) as s_{c}" for c in cols)
    if scale:
        exprs = [f"(coalesce({c}, med_{c}) - m_{c}) / (case when s_{c} = 0 or s_{c} is null then 1 else s_{c} end)"
                 for c in cols]
    else:
        exprs = [f"coalesce({c}, med_{c})" for c in cols]
    return f"""
  with t as (select *, l_extendedprice * l_discount as price_discount from ({LS})),
  s as (select {stats} from t where split = 'train')
  select row_key, {', '.join(r6(e) + f' as {c}' for e, c in zip(exprs, cols))},
    case when l_returnflag = 'N' then 1.0 else 0.0 end::double as l_returnflag_N,
    case when l_returnflag = 'R' then 1.0 else 0.0 end::double as l_returnflag_R,
    case when l_linestatus = 'O' then 1.0 else 0.0 end::double as l_linestatus_O
  from t, s"""


def _prep_query(spark, sf_dir, scale):
    from tabreg.operators.prep import preparation_pipeline
    t = _split(spark, sf_dir)
    pipe = preparation_pipeline(NUMERIC_FEATURES, CATEGORICAL_FEATURES, scale, INTERACTION)
    model = pipe.fit(t.where(F.col("split") == "train"))
    return rounded(named_features(model, t).select("row_key", *feature_names(model)))


@query("prep_tree", sql=_prep_sql(False))
def q_prep_tree(spark, sf_dir):
    """Tree preparation: interaction, train-median imputation, drop-first dummies (named columns)."""
    return _prep_query(spark, sf_dir, False)


@query("prep_linear", sql=_prep_sql(True))
def q_prep_linear(spark, sf_dir):
    """Linear preparation: as prep_tree plus population-std scaling of the numeric columns."""
    return _prep_query(spark, sf_dir, True)


@query("prepare_input", sql=f"select row_key, {r6('l_extendedprice * l_discount')} as price_discount from {_LC}")
def q_prepare_input(spark, sf_dir):
    """Engineer the interaction only when it is absent: applying it twice adds nothing twice."""
    t = prepare_input(prepare_input(_split(spark, sf_dir), INTERACTION), INTERACTION)
    return rounded(t.select("row_key", "price_discount"))
