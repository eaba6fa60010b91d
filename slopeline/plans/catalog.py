"""Registered queries: each is ``(spark, sf_dir) -> DataFrame`` over the tables of a data
folder, paired with DuckDB SQL that recomputes it (``ORACLE``) where SQL can.

Trainer queries run a fit (one Spark job per iteration over the whole fixture table) and
return the weights or history as a small table; the SQL side unrolls the same iterations.
Values are rounded (6 decimals for weights, 9 for losses, gradients and scores) and
``+ 0.0`` folds ``-0.0`` into ``0.0`` in both engines.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slopeline.functions import sampling
from slopeline.functions.labels import binarize
from slopeline.functions.losses import MarginLoss, resolve_loss
from slopeline.operators import metrics, scoring
from slopeline.operators.gradient import batch_sums, mean_gradient_frame
from slopeline.operators.trainers import FitResult, TrainConfig, fit
from slopeline.operators.updates import UpdateRule, penalty_value
from slopeline.operators.validate import table_facts_frame
from slopeline.operators.wide import fit_wide
from slopeline.plans import oracle as O
from slopeline.plans.experiment import run_experiment
from slopeline.session import scratch_path
from slopeline.sources import libsvm, models, tables

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def r(col, digits: int):
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c, digits) + F.lit(0.0)


def rule_weights(n: int) -> np.ndarray:
    """Fixed-rule weights for loss and gradient checks: ((j % 7) - 3) / 10."""
    j = np.arange(n)
    return ((j % 7) - 3) / 10.0


def weights_out(res: FitResult, spark: SparkSession) -> DataFrame:
    return res.weights_frame(spark).select("idx", r("weight", 6).alias("weight"))


# ------------------------------------------------------------------------------------------
# projections, sampling, validation

@register("binarize_label",
          "SELECT vec_id AS key, CAST(label AS DOUBLE) AS label, "
          "CASE WHEN label = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS binary FROM embeddings")
def q_binarize_label(spark, sf_dir):
    df = tables.embeddings_multiclass(spark, sf_dir)
    return df.select("key", "label", binarize("label", 1.0).alias("binary"))


@register("keyed_split",
          f"SELECT key, y AS label, CASE WHEN {O.md5_uniform('key', 11)} < 0.7 THEN 'train' ELSE 'test' END AS split "
          f"FROM ({O.FX1}) f")
def q_keyed_split(spark, sf_dir):
    df = tables.embeddings_binary(spark, sf_dir)
    return sampling.split_label(df, "key", 0.7, seed=sampling.SPLIT_SEED, sampler="md5").select("key", "label", "split")


_ROW_UNIFORM = O.md5_uniform("CAST(l_orderkey AS VARCHAR) || ':' || CAST(l_linenumber AS VARCHAR)", sampling.SPLIT_SEED)


@register("row_split",
          f"SELECT l_orderkey, l_linenumber, CASE WHEN {_ROW_UNIFORM} < 0.7 THEN 'train' ELSE 'test' END AS split FROM lineitem")
def q_row_split(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return sampling.split_label(rows, "l_orderkey", 0.7, seed=sampling.SPLIT_SEED, sampler="md5", salt="l_linenumber")


_MB = [(i, "batch", 0.3) for i in (1, 2, 3)] + [(i, "mean", 0.5) for i in (1, 2, 3)]


@register("keyed_minibatch", " UNION ALL ".join(
    f"SELECT {i} AS iter, '{kind}' AS sample, key FROM ({O.FX1}) f WHERE {O.md5_sample('key', 42 + i, frac)}"
    for i, kind, frac in _MB))
def q_keyed_minibatch(spark, sf_dir):
    df = tables.embeddings_binary(spark, sf_dir)
    parts = [sampling.keyed_sample(df, "key", frac, sampling.batch_seed(i), "md5")
             .select(F.lit(i).alias("iter"), F.lit(kind).alias("sample"), "key") for i, kind, frac in _MB]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("bernoulli_checks",
          "SELECT count(*) AS rows, TRUE AS subset, TRUE AS without_repeats, TRUE AS plausible_size FROM embeddings")
def q_bernoulli_checks(spark, sf_dir):
    """What holds of every Bernoulli batch: its rows are rows of the table, none twice, and as many
    as 5 standard deviations around the fraction allow (over three batches)."""
    df = tables.embeddings_binary(spark, sf_dir)
    drawn = None
    for i in (1, 2, 3):
        one = sampling.keyed_sample(df, "key", 0.3, sampling.batch_seed(i), "bernoulli").select("key", F.lit(i).alias("batch"))
        drawn = one if drawn is None else drawn.unionByName(one)
    each = drawn.groupBy("batch", "key").agg(F.count(F.lit(1)).alias("c")).withColumn("drawn", F.lit(True))
    known = df.groupBy("key").agg(F.count(F.lit(1)).alias("m"))
    met = each.join(known, "key", "left").groupBy("batch").agg(F.sum("c").alias("size"), F.max(F.col("m").isNull()).alias("foreign"), F.max(F.col("c") > F.col("m")).alias("twice"))
    n = df.agg(F.count(F.lit(1)).alias("rows"))
    off = F.abs(F.col("size") - 0.3 * F.col("rows")) < 5 * F.sqrt(F.col("rows") * 0.3 * 0.7)
    return met.crossJoin(F.broadcast(n)).groupBy("rows").agg((~F.max("foreign")).alias("subset"), (~F.max("twice")).alias("without_repeats"), (F.min(off) & (F.count(F.lit(1)) == 3)).alias("plausible_size"))


@register("bernoulli_minibatch")
def q_bernoulli_minibatch(spark, sf_dir):
    df = tables.embeddings_binary(spark, sf_dir)
    return sampling.keyed_sample(df, "key", 0.3, sampling.batch_seed(1), "bernoulli").select("key")


def _label_check_sql(name: str, src: str, valid: str) -> str:
    return (f"SELECT '{name}' AS check_name, count(*) AS rows, "
            f"CAST(sum(CASE WHEN y IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_labels, "
            f"CAST(sum(CASE WHEN y IS NOT NULL AND NOT ({valid}) THEN 1 ELSE 0 END) AS BIGINT) AS bad_labels "
            f"FROM ({src}) f")


@register("validate_labels", " UNION ALL ".join([
    _label_check_sql("fx1_binary", O.FX1, "y IN (0.0, 1.0)"),
    _label_check_sql("fx3_binary", O.FX3, "y IN (0.0, 1.0)"),
    _label_check_sql("fx3_multinomial", O.FX3, "y >= 0 AND y <= 9.0 AND y = floor(y)"),
]))
def q_validate_labels(spark, sf_dir):
    checks = [("fx1_binary", tables.embeddings_binary, "logistic", 2),
              ("fx3_binary", tables.embeddings_multiclass, "logistic", 2),
              ("fx3_multinomial", tables.embeddings_multiclass, "multinomial", 10)]
    out = None
    for name, fx, loss, k in checks:
        f = table_facts_frame(fx(spark, sf_dir), resolve_loss(loss, k), k).select(
            F.lit(name).alias("check_name"), "rows", F.col("null_labels").cast("bigint").alias("null_labels"),
            F.col("bad_labels").cast("bigint").alias("bad_labels"))
        out = f if out is None else out.unionByName(f)
    return out


def _dim_check_sql(name: str, src: str) -> str:
    return (f"SELECT '{name}' AS check_name, count(*) AS rows, CAST(min(len(x)) AS INTEGER) AS min_dim, "
            f"CAST(max(len(x)) AS INTEGER) AS max_dim, "
            f"CAST(sum(CASE WHEN x IS NULL OR list_count(x) < len(x) THEN 1 ELSE 0 END) AS BIGINT) AS null_features "
            f"FROM ({src}) f")


_DIM_FX = [("fx1", tables.embeddings_binary, O.FX1), ("fx2", tables.lineitem_returns, O.FX2),
           ("fx4", tables.lineitem_prices, O.FX4), ("fx5", tables.documents_quality, O.FX5)]


@register("validate_dims", " UNION ALL ".join(_dim_check_sql(n, s) for n, _, s in _DIM_FX))
def q_validate_dims(spark, sf_dir):
    out = None
    for name, fx, _ in _DIM_FX:
        f = table_facts_frame(fx(spark, sf_dir), resolve_loss("least_squares")).select(
            F.lit(name).alias("check_name"), "rows", "min_dim", "max_dim",
            F.col("null_features").cast("bigint").alias("null_features"))
        out = f if out is None else out.unionByName(f)
    return out


# ------------------------------------------------------------------------------------------
# losses and gradients at fixed-rule weights

def _row_loss_sql(fx: str, loss: str) -> str:
    lcol, mcol = O.loss_sql(loss, "zz.z", "b.y")
    ctes = O.fixture_ctes(fx) + [
        f"z AS (SELECT lx.rid, sum(lx.v * ({O.rule_weight('lx.j')})) AS z FROM lx GROUP BY lx.rid)"]
    return ("WITH " + ",\n".join(ctes) +
            f"\nSELECT b.key, b.y AS label, round({lcol}, 9) + 0.0 AS loss, round({mcol}, 9) + 0.0 AS mult "
            f"FROM base b JOIN z zz ON b.rid = zz.rid")


def _row_loss_query(fx_fn, loss_name: str, d: int):
    def q(spark, sf_dir):
        df = fx_fn(spark, sf_dir)
        loss = resolve_loss(loss_name)
        rl = metrics.row_loss_frame(df, rule_weights(d), loss, d)
        return rl.select("key", "label", r("loss", 9).alias("loss"), r("mult", 9).alias("mult"))
    return q


register("row_loss_logistic", _row_loss_sql("fx1", "logistic"))(_row_loss_query(tables.embeddings_binary, "logistic", 64))
register("row_loss_hinge", _row_loss_sql("fx1", "hinge"))(_row_loss_query(tables.embeddings_binary, "hinge", 64))
register("row_loss_least_squares", _row_loss_sql("fx4", "least_squares"))(
    _row_loss_query(tables.lineitem_prices, "least_squares", 3))


def _multinomial_rule_ctes() -> list[str]:
    return O.fixture_ctes("fx3") + [
        "wr AS (SELECT CAST(c.range AS INTEGER) AS c, CAST(jj.range AS INTEGER) AS j, "
        f"{O.rule_weight('(c.range - 1) * 64 + jj.range')} AS w FROM range(1, 10) c CROSS JOIN range(64) jj)",
    ] + O.multinomial_row_ctes("wr", "")


@register("row_loss_multinomial",
          "WITH " + ",\n".join(_multinomial_rule_ctes()) +
          "\nSELECT b.key, b.y AS label, round(l.loss, 9) + 0.0 AS loss FROM base b JOIN rl l ON b.rid = l.rid")
def q_row_loss_multinomial(spark, sf_dir):
    df = tables.embeddings_multiclass(spark, sf_dir)
    rl = metrics.row_loss_frame(df, rule_weights(9 * 64), resolve_loss("multinomial", 10), 64)
    return rl.select("key", "label", r("loss", 9).alias("loss"))


def _grad_sql(fx: str, loss: str) -> str:
    _, mcol = O.loss_sql(loss, "zz.z", "b.y")
    ctes = O.fixture_ctes(fx) + [
        f"z AS (SELECT lx.rid, sum(lx.v * ({O.rule_weight('lx.j')})) AS z FROM lx GROUP BY lx.rid)",
        f"rr AS (SELECT b.rid, {mcol} AS mult FROM base b "
        f"JOIN z zz ON b.rid = zz.rid)",
    ]
    return ("WITH " + ",\n".join(ctes) +
            "\nSELECT lx.j AS idx, round(sum(rr.mult * lx.v) / (SELECT count(*) FROM base), 9) + 0.0 AS grad "
            "FROM lx JOIN rr ON lx.rid = rr.rid GROUP BY lx.j")


def _grad_query(fx_fn, loss_name: str, d: int, num_classes: int = 2):
    def q(spark, sf_dir):
        df = fx_fn(spark, sf_dir)
        loss = resolve_loss(loss_name, num_classes)
        g = mean_gradient_frame(df, rule_weights(loss.slots(d)), loss, d)
        return g.select(F.col("idx").cast("int").alias("idx"), r("grad", 9).alias("grad"))
    return q


register("batch_gradient_logistic", _grad_sql("fx1", "logistic"))(_grad_query(tables.embeddings_binary, "logistic", 64))
register("batch_gradient_hinge", _grad_sql("fx1", "hinge"))(_grad_query(tables.embeddings_binary, "hinge", 64))
register("batch_gradient_least_squares", _grad_sql("fx4", "least_squares"))(
    _grad_query(tables.lineitem_prices, "least_squares", 3))
register("batch_gradient_large", _grad_sql("fx2", "logistic"))(_grad_query(tables.lineitem_returns, "logistic", 5))
register("batch_gradient_multinomial",
         "WITH " + ",\n".join(_multinomial_rule_ctes()) +
         "\nSELECT CAST((m.c - 1) * 64 + lx.j AS INTEGER) AS idx, "
         "round(sum(m.mult * lx.v) / (SELECT count(*) FROM base), 9) + 0.0 AS grad "
         "FROM lx JOIN mult m ON lx.rid = m.rid GROUP BY m.c, lx.j")(
    _grad_query(tables.embeddings_multiclass, "multinomial", 64, 10))


@register("mean_loss",
          "WITH " + ",\n".join(O.fixture_ctes("fx1") + [
              f"z AS (SELECT lx.rid, sum(lx.v * ({O.rule_weight('lx.j')})) AS z FROM lx GROUP BY lx.rid)",
              f"rl AS (SELECT {O.loss_sql('logistic', 'zz.z', 'b.y')[0]} AS loss FROM base b JOIN z zz ON b.rid = zz.rid)",
              f"pen AS (SELECT 0.5 * sum(({O.rule_weight('range')}) * ({O.rule_weight('range')})) AS reg FROM range(64))"]) +
          "\nSELECT count(*) AS rows, round(avg(loss), 9) + 0.0 AS mean_loss, round(any_value(pen.reg), 9) + 0.0 AS reg, "
          "round(avg(loss) + any_value(pen.reg), 9) + 0.0 AS objective FROM rl CROSS JOIN pen")
def q_mean_loss(spark, sf_dir):
    df = tables.embeddings_binary(spark, sf_dir)
    w = rule_weights(64)
    f = metrics.mean_loss_frame(df, w, resolve_loss("logistic"), 64, reg_value=penalty_value(w, 1.0, "l2"))
    return f.select("rows", r("mean_loss", 9).alias("mean_loss"), r("reg", 9).alias("reg"),
                    r("objective", 9).alias("objective"))


# ------------------------------------------------------------------------------------------
# trainers (unrolled in SQL)

def _trainer(name: str, fx_fn, fx: str, cfg: dict, sql_kw: dict | None = None, *, num_classes: int = 2,
             out=None, sql_select: str | None = None, initial=None, register_sql: bool = True):
    """Register a trainer query: fit with ``cfg`` and return weights (or ``out(res, spark)``)."""
    kw = dict(cfg)
    base = {k: kw[k] for k in ("loss", "method", "variant", "penalty", "step", "reg", "iters", "fraction")
            if k in kw and isinstance(kw[k], (str, int, float))}
    sql_kw = {**base, **(sql_kw or {})}
    sql = O.trainer_sql(fx, select=sql_select, **sql_kw) if register_sql else None

    def q(spark, sf_dir):
        df = fx_fn(spark, sf_dir)
        res = fit(df, TrainConfig(**{"tol": 0.0, "sampler": "md5", "sample_by": "key", **kw}), initial_weights=initial)
        return out(res, spark) if out else weights_out(res, spark)

    register(name, sql)(q)
    return q


_B = tables.embeddings_binary
_trainer("sgd_plain", _B, "fx1", dict(method="sgd", penalty="none", step=1.0, iters=3))
_trainer("sgd_l1", _B, "fx1", dict(method="sgd", penalty="l1", reg=0.01, step=1.0, iters=3))
_trainer("sgd_l2", _B, "fx1", dict(method="sgd", penalty="l2", reg=1.0, step=1.0, iters=3))
_trainer("sgd_minibatch", _B, "fx1", dict(method="sgd", penalty="l2", reg=0.1, step=1.0, iters=3, fraction=0.3))
_trainer("sgd_unbalanced", tables.documents_quality, "fx5", dict(method="sgd", penalty="l2", reg=0.1, step=1.0, iters=3))
_trainer("sgd_least_squares", tables.lineitem_prices, "fx4",
         dict(loss="least_squares", method="sgd", penalty="l2", reg=0.01, step=0.5, iters=3))
_trainer("sgd_hinge", _B, "fx1", dict(loss="hinge", method="sgd", penalty="l2", reg=0.1, step=1.0, iters=3))
_trainer("momentum", _B, "fx1", dict(method="momentum", penalty="l2", reg=0.1, step=1.0, iters=3))
_trainer("momentum_observed", _B, "fx1",
         dict(method="momentum", variant="observed", penalty="l2", reg=0.1, step=1.0, iters=3))
_trainer("adagrad", _B, "fx1", dict(method="adagrad", penalty="l2", reg=0.1, step=0.1, iters=3))
_trainer("adadelta", _B, "fx1", dict(method="adadelta", penalty="l2", reg=0.1, step=1.0, iters=3))
_trainer("adadelta_observed", _B, "fx1",
         dict(method="adadelta", variant="observed", penalty="l2", reg=0.1, step=1.0, iters=3))
_trainer("adam", _B, "fx1", dict(method="adam", penalty="l2", reg=0.1, step=0.01, iters=3))
_trainer("adam_observed", _B, "fx1", dict(method="adam", variant="observed", penalty="l2", reg=0.1, step=0.01, iters=3))
_trainer("warm_start", _B, "fx1", dict(method="sgd", penalty="l2", reg=0.1, step=1.0, iters=3),
         dict(init=O.rule_weight("j")), initial=rule_weights(64))
_trainer("empty_batch", _B, "fx1", dict(method="sgd", penalty="l2", reg=0.1, step=1.0, iters=3, fraction=1e-9),
         dict(init=O.rule_weight("j")), initial=rule_weights(64))


_trainer("sgd_intercept", _B, "fx1", dict(method="sgd", penalty="l2", reg=0.1, step=1.0, iters=3, intercept=True,
                                          penalise_bias=False), dict(intercept=True, penalise_bias=False))


def _history_out(res: FitResult, spark):
    return res.history_frame(spark).select("iter", r("loss", 9).alias("loss"), r("reg", 9).alias("reg"),
                                           r("total", 9).alias("total"), "batch_rows")


_HIST_SEL = ("SELECT iter, round(loss, 9) + 0.0 AS loss, round(reg, 9) + 0.0 AS reg, "
             "round(loss + reg, 9) + 0.0 AS total, batch_rows FROM ({}) hh")
_trainer("loss_history", _B, "fx1", dict(method="sgd", penalty="l2", reg=1.0, step=1.0, iters=3),
         out=_history_out, sql_select=_HIST_SEL.format(" UNION ALL ".join(f"SELECT * FROM h{i}" for i in (1, 2, 3))))


def _last_out(res: FitResult, spark):
    rows = [(h.iteration, float(h.total)) for h in res.history[-10:]]
    return spark.createDataFrame(rows, "iter INT, total DOUBLE").select("iter", r("total", 9).alias("total"))


_trainer("last_losses", _B, "fx1", dict(method="sgd", penalty="l2", reg=0.1, step=1.0, iters=12, fraction=0.5),
         out=_last_out, sql_select="SELECT iter, round(loss + reg, 9) + 0.0 AS total FROM (" +
         " UNION ALL ".join(f"SELECT * FROM h{i}" for i in range(1, 13)) + ") hh WHERE iter > 2")


register("sgd_multinomial",
         "WITH " + ",\n".join(O.fixture_ctes("fx3") + O.multinomial_ctes(9, 64, 3, 1.0, 0.1)) +
         "\nSELECT CAST((c - 1) * 64 + j AS INTEGER) AS idx, round(w, 6) + 0.0 AS weight FROM wc3")(
    lambda spark, sf_dir: weights_out(
        fit(tables.embeddings_multiclass(spark, sf_dir),
            TrainConfig(loss="multinomial", num_classes=10, method="sgd", penalty="l2", reg=0.1, step=1.0, iters=3,
                        tol=0.0)), spark))


# convergence: the relative change of the 2nd update is ~0.33 and of the 3rd ~0.14 on FX1 with
# these settings, so tol 0.25 stops after the third iteration, far from either boundary
_CONV_TOL = 0.25


def _conv_out(res: FitResult, spark):
    return weights_out(res, spark).select(F.lit(res.iterations).alias("iterations"), "idx", "weight")


def _conv_sql() -> str:
    ratio = ("(SELECT sqrt(sum((a.w - b.w) * (a.w - b.w))) / greatest(sqrt(sum(b.w * b.w)), 1.0) "
             "FROM w{p} a JOIN w{c} b ON a.j = b.j)")
    stop2, stop3 = ratio.format(p=1, c=2), ratio.format(p=2, c=3)
    return (f"SELECT CASE WHEN {stop2} < {_CONV_TOL} THEN 2 WHEN {stop3} < {_CONV_TOL} THEN 3 ELSE 4 END AS iterations, "
            f"w2.j AS idx, round(CASE WHEN {stop2} < {_CONV_TOL} THEN w2.w WHEN {stop3} < {_CONV_TOL} THEN w3.w "
            f"ELSE w4.w END, 6) + 0.0 AS weight FROM w2 JOIN w3 ON w2.j = w3.j JOIN w4 ON w2.j = w4.j")


register("converged_early", O.trainer_sql("fx1", select=_conv_sql(), method="sgd", penalty="l2", reg=0.1,
                                          step=1.0, iters=4))(
    lambda spark, sf_dir: _conv_out(fit(tables.embeddings_binary(spark, sf_dir),
                                        TrainConfig(method="sgd", penalty="l2", reg=0.1, step=1.0, iters=4,
                                                    tol=_CONV_TOL, sampler="md5", sample_by="key")), spark))


@register("empty_input", "SELECT CAST(range AS INTEGER) AS idx, 0.0::DOUBLE AS weight, 0 AS iterations FROM range(64)")
def q_empty_input(spark, sf_dir):
    df = tables.embeddings_binary(spark, sf_dir).where(F.col("label") > 1.0)
    res = fit(df, TrainConfig(method="sgd", penalty="l2", reg=1.0, iters=3, tol=0.0), initial_weights=np.zeros(64))
    return weights_out(res, spark).select("idx", "weight", F.lit(res.iterations).alias("iterations"))


# ------------------------------------------------------------------------------------------
# scoring, evaluation, storage (on the sgd_l2 model)

_L2 = dict(method="sgd", penalty="l2", reg=1.0, step=1.0, iters=3, tol=0.0, sampler="md5", sample_by="key")


def _l2_model(spark, sf_dir):
    df = tables.embeddings_binary(spark, sf_dir)
    return df, fit(df, TrainConfig(**_L2))


def _scores_sql(select: str) -> str:
    extra = ["sc AS (SELECT b.rid, b.key, b.y, coalesce(s.z, 0.0) AS z FROM base b LEFT JOIN "
             "(SELECT lx.rid, sum(lx.v * w3.w) AS z FROM lx JOIN w3 ON lx.j = w3.j GROUP BY lx.rid) s "
             "ON b.rid = s.rid)"]
    return O.trainer_sql("fx1", select=select, method="sgd", penalty="l2", reg=1.0, step=1.0, iters=3, extra=extra)


@register("predict_score", _scores_sql(
    "SELECT key, round(1.0 / (1.0 + exp(-z)), 9) + 0.0 AS score FROM sc"))
def q_predict_score(spark, sf_dir):
    df, res = _l2_model(spark, sf_dir)
    out = scoring.predict(df, res.model.clear_threshold(), output="score", keep=["key"])
    return out.select("key", r("score", 9).alias("score"))


def _margins_sql(loss: str, select: str, fx: str, **kw) -> str:
    extra = ["sc AS (SELECT b.rid, b.key, b.y, coalesce(s.z, 0.0) AS z FROM base b LEFT JOIN "
             "(SELECT lx.rid, sum(lx.v * w3.w) AS z FROM lx JOIN w3 ON lx.j = w3.j GROUP BY lx.rid) s "
             "ON b.rid = s.rid)"]
    return O.trainer_sql(fx, select=select, loss=loss, method="sgd", penalty="l2", iters=3, extra=extra, **kw)


@register("predict_least_squares", _margins_sql(
    "least_squares", "SELECT key, round(z, 6) + 0.0 AS prediction FROM sc", "fx4", step=0.5, reg=0.01))
def q_predict_least_squares(spark, sf_dir):
    df = tables.lineitem_prices(spark, sf_dir)
    res = fit(df, TrainConfig(loss="least_squares", method="sgd", penalty="l2", reg=0.01, step=0.5, iters=3, tol=0.0))
    return scoring.predict(df, res.model, keep=["key"]).select("key", r("prediction", 6).alias("prediction"))


@register("predict_hinge", _margins_sql(
    "hinge", "SELECT key, CASE WHEN z > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS prediction FROM sc", "fx1",
    step=1.0, reg=0.1))
def q_predict_hinge(spark, sf_dir):
    df = tables.embeddings_binary(spark, sf_dir)
    res = fit(df, TrainConfig(loss="hinge", method="sgd", penalty="l2", reg=0.1, step=1.0, iters=3, tol=0.0))
    return scoring.predict(df, res.model, keep=["key"]).select("key", "prediction")


@register("sgd_multinomial_intercept", O.trainer_sql("fx1", method="sgd", penalty="l2", reg=0.1, step=1.0, iters=3,
                                                     intercept=True))
def q_sgd_multinomial_intercept(spark, sf_dir):
    # two classes: the multinomial loss has one margin and the model an intercept
    res = fit(tables.embeddings_binary(spark, sf_dir),
              TrainConfig(loss="multinomial", num_classes=2, method="sgd", penalty="l2", reg=0.1, step=1.0, iters=3,
                          tol=0.0, intercept=True))
    if len(res.model.weights) != 64 or res.model.intercept != res.weights[-1]:
        raise AssertionError("the intercept is not split from the weights")
    return weights_out(res, spark)


@register("predict_class", _scores_sql(
    "SELECT key, CASE WHEN 1.0 / (1.0 + exp(-z)) > 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS prediction FROM sc"))
def q_predict_class(spark, sf_dir):
    df, res = _l2_model(spark, sf_dir)
    return scoring.predict(df, res.model, keep=["key"]).select("key", "prediction")


@register("auc_exact", _scores_sql(
    "SELECT round(sum(pos * (below + neg * 0.5)) / (sum(pos) * sum(neg)), 9) + 0.0 AS auc, "
    "CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(neg) AS BIGINT) AS negatives FROM ("
    "SELECT s, pos, neg, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) "
    "AS below FROM (SELECT round(1.0 / (1.0 + exp(-z)), 9) AS s, sum(CASE WHEN y = 1.0 THEN 1 ELSE 0 END) AS pos, "
    "sum(CASE WHEN y = 1.0 THEN 0 ELSE 1 END) AS neg FROM sc GROUP BY 1) g) t"))
def q_auc_exact(spark, sf_dir):
    df, res = _l2_model(spark, sf_dir)
    pairs = scoring.score_and_label(df, res.model)
    return metrics.auc_frame(pairs, digits=9).select(r("auc", 9).alias("auc"), "positives", "negatives")


_TRAIN_SPLIT = f"{O.md5_uniform('key', sampling.SPLIT_SEED)} < 0.7"


@register("holdout_auc", O.trainer_sql(
    "fx1", where=_TRAIN_SPLIT, method="sgd", penalty="l2", reg=1.0, step=1.0, iters=3,
    extra=["wl AS (SELECT list(w ORDER BY j) AS wv FROM w3)",
           f"te AS (SELECT y, round(1.0 / (1.0 + exp(-list_dot_product(x, (SELECT wv FROM wl)))), 9) AS s "
           f"FROM ({O.FX1}) f WHERE NOT ({_TRAIN_SPLIT}))"],
    select="SELECT round(sum(pos * (below + neg * 0.5)) / (sum(pos) * sum(neg)), 9) + 0.0 AS auc, "
           "CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(neg) AS BIGINT) AS negatives FROM ("
           "SELECT s, pos, neg, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
           " AS below FROM (SELECT s, sum(CASE WHEN y = 1.0 THEN 1 ELSE 0 END) AS pos, "
           "sum(CASE WHEN y = 1.0 THEN 0 ELSE 1 END) AS neg FROM te GROUP BY s) g) t"))
def q_holdout_auc(spark, sf_dir):
    df = tables.embeddings_binary(spark, sf_dir)
    train, test = sampling.keyed_split(df, "key", (0.7, 0.3), seed=sampling.SPLIT_SEED, sampler="md5")
    res = fit(train, TrainConfig(**_L2))
    pairs = scoring.score_and_label(test, res.model.clear_threshold())
    return metrics.auc_frame(pairs, digits=9).select(r("auc", 9).alias("auc"), "positives", "negatives")


@register("weight_norms", O.trainer_sql(
    "fx1", select="SELECT round(sum(abs(w)), 9) + 0.0 AS l1, round(sqrt(sum(w * w)), 9) + 0.0 AS l2, "
    "round(1.0 * sum(abs(w)), 9) + 0.0 AS reg_l1, round(0.5 * sum(w * w), 9) + 0.0 AS reg_l2 FROM w3",
    method="sgd", penalty="l2", reg=1.0, step=1.0, iters=3))
def q_weight_norms(spark, sf_dir):
    _, res = _l2_model(spark, sf_dir)
    f = metrics.weight_norms_frame(res.weights_frame(spark), 1.0)
    return f.select(*[r(c, 9).alias(c) for c in ("l1", "l2", "reg_l1", "reg_l2")])


@register("model_roundtrip", O.trainer_sql(
    "fx1", select="SELECT j AS idx, round(w, 6) + 0.0 AS weight, 64 AS num_features, 0.5::DOUBLE AS threshold FROM w3",
    method="sgd", penalty="l2", reg=1.0, step=1.0, iters=3))
def q_model_roundtrip(spark, sf_dir):
    _, res = _l2_model(spark, sf_dir)
    path = scratch_path(spark, "model")
    models.save_model(spark, res.model, path)
    loaded = models.load_model(spark, path)
    if not np.array_equal(loaded.weights, res.model.weights) or loaded.threshold != res.model.threshold:
        raise AssertionError("model did not survive the round trip")
    return models.model_frame(spark, path).select(
        F.col("idx").cast("int").alias("idx"), r("weight", 6).alias("weight"), "num_features", "threshold")


@register("predict_multiclass",
          "WITH " + ",\n".join(O.fixture_ctes("fx3") + O.multinomial_ctes(9, 64, 3, 1.0, 0.1) + [
              "zm AS (SELECT lx.rid, ww.c, sum(lx.v * ww.w) AS z FROM lx JOIN wc3 ww ON lx.j = ww.j GROUP BY lx.rid, ww.c)",
              "best AS (SELECT rid, max(z) AS mz, min(c) FILTER (WHERE z = mz2) AS c FROM "
              "(SELECT rid, c, z, max(z) OVER (PARTITION BY rid) AS mz2 FROM zm) q GROUP BY rid)"]) +
          "\nSELECT b.key, CASE WHEN bb.mz > 0 THEN CAST(bb.c AS DOUBLE) ELSE 0.0 END AS prediction "
          "FROM base b JOIN best bb ON b.rid = bb.rid")
def q_predict_multiclass(spark, sf_dir):
    df = tables.embeddings_multiclass(spark, sf_dir)
    res = fit(df, TrainConfig(loss="multinomial", num_classes=10, method="sgd", penalty="l2", reg=0.1, step=1.0,
                              iters=3, tol=0.0))
    return scoring.predict(df, res.model, keep=["key"]).select("key", "prediction")


@register("libsvm_roundtrip",
          "SELECT CASE WHEN label < 5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label, "
          "CAST(list_count(list_filter(e, lambda v: v <> 0)) AS INTEGER) AS nnz, "
          "round(list_sum(e), 6) + 0.0 AS total, round(list_sum(list_transform(e, lambda v: v * v)), 6) + 0.0 AS sumsq, "
          "round(list_sum(list_transform(range(1, 65), lambda k: e[k] * k)), 6) + 0.0 AS ranked "
          "FROM (SELECT label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) t")
def q_libsvm_roundtrip(spark, sf_dir):
    df = tables.embeddings_binary(spark, sf_dir)
    path = scratch_path(spark, "libsvm")
    libsvm.write_libsvm(df, path)
    back = libsvm.read_libsvm(spark, path, num_features=64)
    x = F.col("features")
    return back.select(
        "label",
        F.size(F.filter(x, lambda v: v != 0.0)).alias("nnz"),
        r(F.aggregate(x, F.lit(0.0), lambda a, v: a + v), 6).alias("total"),
        r(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v), 6).alias("sumsq"),
        r(F.aggregate(F.zip_with(x, F.sequence(F.lit(1), F.lit(64)), lambda v, k: v * k), F.lit(0.0),
                      lambda a, v: a + v), 6).alias("ranked"))


# ------------------------------------------------------------------------------------------
# extension points

class SquaredHingeLoss(MarginLoss):
    """A user loss given only as columns: ``max(0, 1 - z m)^2`` with ``z = 2y - 1``."""

    name = "squared_hinge"
    binary_labels = True

    def columns(self, margins, y):
        z = F.lit(2.0) * y - F.lit(1.0)
        gap = F.lit(1.0) - z * margins[0]
        active = gap > 0
        return (F.when(active, gap * gap).otherwise(F.lit(0.0)),
                [F.when(active, F.lit(-2.0) * z * gap).otherwise(F.lit(0.0))])


def sign_step(w, g, state, ctx):
    """A user update rule: step against the sign of the gradient."""
    return w - ctx.eta * np.sign(g), state


def constant_step_descent(df: DataFrame, config: TrainConfig) -> FitResult:
    """A user optimiser built from the batch-gradient operator: full-batch descent with a
    constant step and no penalty."""
    from slopeline.operators.trainers import prepare

    table = prepare(df).persist()
    try:
        d = int(table.select(F.max(F.size("features"))).collect()[0][0])
        loss = resolve_loss(config.loss)
        w = np.zeros(d)
        for _ in range(config.iters):
            sums = batch_sums(table, w, loss, d)
            if sums.count:
                w = w - config.step * sums.mean_grad
        return FitResult(model=models.LinearModel(w.copy()), weights=w, iterations=config.iters)
    finally:
        table.unpersist()


_trainer("custom_loss", _B, "fx1",
         dict(loss=SquaredHingeLoss(), method="sgd", penalty="l2", reg=0.1, step=0.1, iters=3),
         dict(loss="squared_hinge"))
_trainer("custom_update", _B, "fx1", dict(method="sgd", penalty="none", step=0.01, iters=3, update=sign_step),
         dict(method="sign_sgd"))


def _constant_sql() -> str:
    # constant-step descent written as SGD with no penalty and per-iteration steps 0.5 * sqrt(i)
    ctes = O.fixture_ctes("fx1")
    ctes += O.unrolled_ctes(loss="logistic", method="sgd", penalty="none", step=1.0, iters=0, d=64)
    for i in (1, 2, 3):
        ctes.append(f"m{i} AS (SELECT b.rid, b.y, coalesce(s.z, 0.0) AS z FROM base b LEFT JOIN "
                    f"(SELECT lx.rid, sum(lx.v * ww.w) AS z FROM lx JOIN w{i - 1} ww ON lx.j = ww.j GROUP BY lx.rid) s "
                    f"ON b.rid = s.rid)")
        ctes.append(f"g{i} AS (SELECT lx.j, sum(({O.loss_sql('logistic', 'm.z', 'm.y')[1]}) * lx.v) / "
                    f"(SELECT count(*) FROM base) AS g FROM lx JOIN m{i} m ON lx.rid = m.rid GROUP BY lx.j)")
        ctes.append(f"w{i} AS MATERIALIZED (SELECT ww.j, ww.w - 0.5 * coalesce(gg.g, 0.0) AS w, 0.0 AS s1, 0.0 AS s2, "
                    f"0.0 AS p FROM w{i - 1} ww LEFT JOIN g{i} gg ON ww.j = gg.j)")
    return "WITH " + ",\n".join(ctes) + "\nSELECT j AS idx, round(w, 6) + 0.0 AS weight FROM w3"


@register("custom_optimizer", _constant_sql())
def q_custom_optimizer(spark, sf_dir):
    res = constant_step_descent(tables.embeddings_binary(spark, sf_dir), TrainConfig(step=0.5, iters=3))
    return weights_out(res, spark)


# ------------------------------------------------------------------------------------------
# wide mode, SVRG, experiment

@register("sgd_wide", O.trainer_sql("fx1", wide=True, method="sgd", penalty="l2", reg=0.1, step=1.0, iters=3))
def q_sgd_wide(spark, sf_dir):
    entries, labels = tables.embeddings_long(spark, sf_dir)
    res = fit_wide(entries, labels, TrainConfig(method="sgd", penalty="l2", reg=0.1, step=1.0, iters=3, tol=0.0,
                                                sampler="md5"), num_features=64)
    return res.weights.select("idx", r("weight", 6).alias("weight"))


@register("sgd_wide_long", O.trainer_sql("fx1", wide=True, method="sgd", penalty="l2", reg=0.1, step=1.0, iters=8))
def q_sgd_wide_long(spark, sf_dir):
    entries, labels = tables.embeddings_long(spark, sf_dir)
    res = fit_wide(entries, labels, TrainConfig(method="sgd", penalty="l2", reg=0.1, step=1.0, iters=8, tol=0.0,
                                                sampler="md5"), num_features=64)
    return res.weights.select("idx", r("weight", 6).alias("weight"))


@register("warm_start_wide", O.trainer_sql("fx1", wide=True, method="sgd", penalty="l2", reg=0.1, step=1.0, iters=3,
                                           init=O.rule_weight("j")))
def q_warm_start_wide(spark, sf_dir):
    entries, labels = tables.embeddings_long(spark, sf_dir)
    start = spark.createDataFrame([(j, float(w)) for j, w in enumerate(rule_weights(64))], "idx INT, weight DOUBLE")
    res = fit_wide(entries, labels, TrainConfig(method="sgd", penalty="l2", reg=0.1, step=1.0, iters=3, tol=0.0,
                                                sampler="md5"), num_features=64, initial_weights=start)
    return res.weights.select("idx", r("weight", 6).alias("weight"))


@register("predict_wide", O.trainer_sql(
    "fx1", wide=True, method="sgd", penalty="l2", reg=0.1, step=1.0, iters=3,
    extra=["sc AS (SELECT b.key, coalesce(s.z, 0.0) AS z FROM base b LEFT JOIN (SELECT lx.rid, sum(lx.v * w3.w) AS z "
           "FROM lx JOIN w3 ON lx.j = w3.j GROUP BY lx.rid) s ON b.rid = s.rid)"],
    select="SELECT key, round(1.0 / (1.0 + exp(-z)), 9) + 0.0 AS score FROM sc"))
def q_predict_wide(spark, sf_dir):
    from slopeline.operators.wide import predict_wide

    entries, labels = tables.embeddings_long(spark, sf_dir)
    res = fit_wide(entries, labels, TrainConfig(method="sgd", penalty="l2", reg=0.1, step=1.0, iters=3, tol=0.0,
                                                sampler="md5"), num_features=64)
    scored = predict_wide(entries, res.weights, keys=labels, threshold=None, num_features=64, output="score")
    return scored.select("key", r("score", 9).alias("score"))


def _wide_query(method: str, step: float, fraction: float):
    def q(spark, sf_dir):
        entries, labels = tables.embeddings_long(spark, sf_dir)
        res = fit_wide(entries, labels, TrainConfig(method=method, penalty="l2", reg=0.1, step=step, iters=3, tol=0.0,
                                                    fraction=fraction, sampler="md5", sample_by="key"),
                       num_features=64)
        return res.weights.select("idx", r("weight", 6).alias("weight"))
    return q


def _wide_fit(spark, sf_dir, **cfg):
    """Wide fit of FX1 (or FX3 with several classes) in long form, three iterations."""
    entries, labels = tables.embeddings_long(spark, sf_dir)
    if cfg.get("loss") == "multinomial":
        labels = tables.embeddings_multiclass(spark, sf_dir).select("key", "label")
    base = dict(method="sgd", penalty="l2", reg=0.1, step=1.0, iters=3, tol=0.0, sampler="md5", sample_by="key")
    return entries, labels, fit_wide(entries, labels, TrainConfig(**{**base, **cfg}), num_features=64)


_MULTI = dict(loss="multinomial", num_classes=10)


@register("multinomial_wide",
          "WITH " + ",\n".join(O.fixture_ctes("fx3") + O.multinomial_ctes(9, 64, 3, 1.0, 0.1)) +
          "\nSELECT c AS class, j AS idx, round(w, 6) + 0.0 AS weight FROM wc3")
def q_multinomial_wide(spark, sf_dir):
    return _wide_fit(spark, sf_dir, **_MULTI)[2].weights.select("class", "idx", r("weight", 6).alias("weight"))


@register("predict_multiclass_wide", ORACLE["predict_multiclass"])
def q_predict_multiclass_wide(spark, sf_dir):
    from slopeline.operators.wide import predict_wide

    entries, labels, res = _wide_fit(spark, sf_dir, **_MULTI)
    return predict_wide(entries, res.weights, keys=labels, num_features=64).select("key", "prediction")


@register("sgd_wide_intercept", O.trainer_sql("fx1", method="sgd", penalty="l2", reg=0.1, step=1.0, iters=3, intercept=True,
                                              penalise_bias=False))
def q_sgd_wide_intercept(spark, sf_dir):
    res = _wide_fit(spark, sf_dir, intercept=True, penalise_bias=False)[2]
    bias = spark.createDataFrame([(64, res.intercepts[0])], "idx INT, weight DOUBLE")
    return res.weights.unionByName(bias).select("idx", r("weight", 6).alias("weight"))


def rms_step(w, g, state, ctx, ops):
    """A user rule with state: the step divided by a running root mean square of the gradient."""
    sq = 0.9 * state["sq"] + 0.1 * (g * g)
    return w - ctx.step * g / (ops.sqrt(sq) + 1e-6), {"sq": sq}


@register("custom_update_wide", O.trainer_sql("fx1", wide=True, method="rms", penalty="none", step=0.01, iters=3))
def q_custom_update_wide(spark, sf_dir):
    res = _wide_fit(spark, sf_dir, penalty="none", reg=0.0, step=0.01, update=UpdateRule(rms_step, ("sq",)))[2]
    return res.weights.select("idx", r("weight", 6).alias("weight"))


@register("wide_model_roundtrip", O.trainer_sql("fx1", wide=True, method="sgd", penalty="l2", reg=0.1, step=1.0, iters=3,
                                                select="SELECT j AS idx, round(w, 6) + 0.0 AS weight, 64 AS num_features, 0.25::DOUBLE AS threshold FROM w3"))
def q_wide_model_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "wide-model")
    models.save_wide_model(models.wide_model(_wide_fit(spark, sf_dir)[2], threshold=0.25), path)
    back = models.load_wide_model(spark, path)
    return back.weights.select("idx", r("weight", 6).alias("weight"), F.lit(back.num_features).alias("num_features"), F.lit(back.threshold).alias("threshold"))


def _svrg_wide(name: str, *, avg: bool, **kw):
    """Walks with lazy steps over sparse rows, weights as a table."""
    common = dict(step=0.1, reg=0.1, iters=3, shards=4, order="random", **kw)

    @register(name, O.svrg_sql(avg=avg, **common))
    def q(spark, sf_dir):
        res = _wide_fit(spark, sf_dir, method="svrg_avg" if avg else "svrg", shard_by="key_mod", **common)[2]
        return res.weights.select("idx", r("weight", 6).alias("weight"))


_svrg_wide("svrg_wide", avg=False, fraction=0.5)
_svrg_wide("svrg_avg_wide", avg=True, fraction=0.5, mean_fraction=0.4)
_svrg_wide("svrg_avg_wide_observed", avg=True, fraction=0.5, mean_fraction=0.4, variant="observed")

register("momentum_wide", O.trainer_sql("fx1", wide=True, method="momentum", penalty="l2", reg=0.1, step=1.0,
                                        iters=3, fraction=0.6))(_wide_query("momentum", 1.0, 0.6))
register("adam_wide", O.trainer_sql("fx1", wide=True, method="adam", penalty="l2", reg=0.1, step=0.01,
                                    iters=3, fraction=0.6))(_wide_query("adam", 0.01, 0.6))


@register("svrg", O.svrg_sql(avg=False, shards=4, step=0.1, reg=0.1, iters=3))
def q_svrg(spark, sf_dir):
    res = fit(tables.embeddings_binary(spark, sf_dir),
              TrainConfig(method="svrg", penalty="l2", reg=0.1, step=0.1, iters=3, tol=0.0, order="key",
                          shard_by="key_mod", shards=4, sampler="md5", sample_by="key"))
    return weights_out(res, spark)


@register("svrg_avg", O.svrg_sql(avg=True, shards=4, step=0.1, reg=0.1, iters=3))
def q_svrg_avg(spark, sf_dir):
    res = fit(tables.embeddings_binary(spark, sf_dir),
              TrainConfig(method="svrg_avg", penalty="l2", reg=0.1, step=0.1, iters=3, tol=0.0, order="key",
                          shard_by="key_mod", shards=4, sampler="md5", sample_by="key"))
    return weights_out(res, spark)


def _sparse_copy(spark, df: DataFrame) -> DataFrame:
    """``df`` written as LIBSVM text and read back sparse, with its keys."""
    path = scratch_path(spark, "libsvm")
    # the key travels as the label, and label and key meet again by a join
    libsvm.write_libsvm(df.select(F.col("key").cast("double").alias("label"), "features"), path)
    back = libsvm.read_libsvm(spark, path, num_features=64, sparse=True)
    back = back.select(F.col("label").cast("bigint").alias("key"), "features")
    return back.join(df.select("key", "label"), "key").select("key", "label", "features")


register("sgd_sparse", O.trainer_sql("fx1", method="sgd", penalty="l2", reg=0.1, step=1.0, iters=3, fraction=0.6))(
    lambda spark, sf_dir: weights_out(fit(_sparse_copy(spark, tables.embeddings_binary(spark, sf_dir)),
                                          TrainConfig(method="sgd", penalty="l2", reg=0.1, step=1.0, iters=3, tol=0.0,
                                                      fraction=0.6, sampler="md5", sample_by="key"), num_features=64), spark))
register("sgd_sparse_multinomial",
         "WITH " + ",\n".join(O.fixture_ctes("fx3") + O.multinomial_ctes(9, 64, 3, 1.0, 0.1)) +
         "\nSELECT CAST((c - 1) * 64 + j AS INTEGER) AS idx, round(w, 6) + 0.0 AS weight FROM wc3")(
    lambda spark, sf_dir: weights_out(
        fit(_sparse_copy(spark, tables.embeddings_multiclass(spark, sf_dir)),
            TrainConfig(loss="multinomial", num_classes=10, method="sgd", penalty="l2", reg=0.1, step=1.0, iters=3,
                        tol=0.0), num_features=64), spark))


def _svrg_query(name: str, *, avg: bool, out=None, select: str | None = None, sparse: bool = False, max_shard_bytes: int = 512 << 20, **kw):
    """A variance-reduced trainer with its own draws, sampled and in shards, against SQL; over sparse
    rows, or streamed (a bound on shards that they exceed)."""
    common = dict(step=0.1, reg=0.1, iters=3, shards=4, **kw)

    @register(name, O.svrg_sql(avg=avg, select=select, **common))
    def q(spark, sf_dir):
        df = tables.embeddings_binary(spark, sf_dir)
        res = fit(_sparse_copy(spark, df) if sparse else df,
                  TrainConfig(method="svrg_avg" if avg else "svrg", penalty="l2", tol=0.0, shard_by="key_mod",
                              sampler="md5", sample_by="key", max_shard_bytes=max_shard_bytes, **common),
                  num_features=64 if sparse else None)
        return out(res, spark) if out else weights_out(res, spark)


_SVRG_HIST = _HIST_SEL.format(" UNION ALL ".join(f"SELECT * FROM h{i}" for i in (1, 2, 3)))
_svrg_query("svrg_random", avg=False, order="random")
_svrg_query("svrg_minibatch", avg=False, order="random", fraction=0.5)
_svrg_query("svrg_history", avg=False, order="random", fraction=0.5, out=_history_out, select=_SVRG_HIST)
_svrg_query("svrg_avg_sampled", avg=True, order="random", fraction=0.5, mean_fraction=0.4)
_svrg_query("svrg_avg_observed", avg=True, order="random", fraction=0.5, mean_fraction=0.4, variant="observed")
_svrg_query("svrg_sparse", avg=False, order="random", fraction=0.5, sparse=True)
_svrg_query("svrg_avg_sparse", avg=True, order="random", fraction=0.5, mean_fraction=0.4, sparse=True)
_svrg_query("svrg_streamed", avg=False, order="random", fraction=0.5, max_shard_bytes=1000)
_svrg_query("svrg_avg_streamed", avg=True, order="random", fraction=0.5, mean_fraction=0.4, max_shard_bytes=1000)
_svrg_query("svrg_avg_streamed_sparse", avg=True, order="key", sparse=True, max_shard_bytes=1000)
_svrg_query("svrg_avg_history", avg=True, order="random", fraction=0.5, mean_fraction=0.4, out=_history_out,
            select=_SVRG_HIST)


def _experiment_sql() -> str:
    """One hold-out report row per method, recomputed: split by md5 key, 3 full-batch
    iterations with the experiment's steps and L2 weight 1, AUC on the test part."""
    from slopeline.plans.experiment import EXPERIMENT_METHODS, EXPERIMENT_STEPS

    test_rows = f"(SELECT count(*) FROM ({O.FX1}) f WHERE NOT ({_TRAIN_SPLIT}))"
    parts = []
    for method in EXPERIMENT_METHODS:
        step = EXPERIMENT_STEPS[method]
        scored = (f"te AS (SELECT y, round(1.0 / (1.0 + exp(-list_dot_product(x, (SELECT wv FROM wl)))), 9) AS s "
                  f"FROM ({O.FX1}) f WHERE NOT ({_TRAIN_SPLIT}))")
        select = (f"SELECT '{method}' AS method, round(sum(pos * (below + neg * 0.5)) / (sum(pos) * sum(neg)), 9) + 0.0 "
                  f"AS auc, (SELECT count(*) FROM base) AS train_rows, {test_rows} AS test_rows, "
                  f"(SELECT count(*) FROM embeddings) AS rows, 3 AS iterations FROM ("
                  "SELECT s, pos, neg, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 "
                  "PRECEDING), 0) AS below FROM (SELECT s, sum(CASE WHEN y = 1.0 THEN 1 ELSE 0 END) AS pos, "
                  "sum(CASE WHEN y = 1.0 THEN 0 ELSE 1 END) AS neg FROM te GROUP BY s) g) t")
        if method == "svrg_avg":
            q = O.svrg_sql(avg=True, shards=4, step=step, reg=1.0, iters=3, where=_TRAIN_SPLIT,
                           extra=["wl AS (SELECT w AS wv FROM wl3)", scored], select=select)
        else:
            q = O.trainer_sql("fx1", where=_TRAIN_SPLIT, method=method, penalty="l2", reg=1.0, step=step, iters=3,
                              extra=["wl AS (SELECT list(w ORDER BY j) AS wv FROM w3)", scored], select=select)
        parts.append(f"SELECT * FROM ({q}) q_{method}")
    return " UNION ALL ".join(parts)


@register("experiment_report", _experiment_sql())
def q_experiment_report(spark, sf_dir):
    report = run_experiment(tables.embeddings_binary(spark, sf_dir), iterations=3, tol=0.0, sampler="md5", split_by="key",
                            trainer_options=dict(shard_by="key_mod", shards=4, order="key", sample_by="key"))
    return report.select("method", r("auc", 9).alias("auc"), "train_rows", "test_rows", "rows", "iterations")


@register("experiment_report_sparse", _experiment_sql())
def q_experiment_report_sparse(spark, sf_dir):
    report = run_experiment(_sparse_copy(spark, tables.embeddings_binary(spark, sf_dir)), iterations=3, tol=0.0, sampler="md5", split_by="key",
                            trainer_options=dict(shard_by="key_mod", shards=4, order="key", sample_by="key"))
    return report.select("method", r("auc", 9).alias("auc"), "train_rows", "test_rows", "rows", "iterations")
