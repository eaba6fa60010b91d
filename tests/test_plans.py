"""Scale properties read from the physical plans: no per-iteration shuffle where none is
expected, and column pruning down to the parquet scan."""

import numpy as np
import pytest

from slopeline.functions.losses import resolve_loss
from slopeline.functions.sampling import keyed_sample
from slopeline.operators import gradient, svrg
from slopeline.operators.trainers import TrainConfig, prepare
from slopeline.sources import tables

from conftest import SF_SMALL


def _plan(df, capsys, mode=None):
    capsys.readouterr()
    df.explain(mode) if mode else df.explain()
    return capsys.readouterr().out


def test_svrg_iteration_groups_without_a_shuffle(spark, capsys):
    cfg = TrainConfig(method="svrg", fraction=0.5, shards=4)
    table = svrg.sharded_table(prepare(tables.embeddings_binary(spark, SF_SMALL), row_ids=True), cfg, 4)
    table.count()
    try:
        batch = keyed_sample(table, "key", 0.5, 43, "xxhash64", "_rid")
        kernel = svrg.svrg_kernel(np.zeros(64), resolve_loss("logistic"), 64, 0.1, 0.1, "random", 42, 1)
        plan = _plan(svrg.shard_partials(batch, kernel), capsys)
        above_cache = plan.split("InMemoryTableScan")[0]
        assert "FlatMapGroupsInArrow" in above_cache and "Exchange" not in above_cache
    finally:
        table.unpersist()


def test_arrow_gradient_is_one_stage_and_scan_is_pruned(spark, capsys):
    fx2 = prepare(tables.lineitem_returns(spark, SF_SMALL))
    partials = gradient.training_columns(fx2).mapInArrow(
        gradient.arrow_kernel(np.zeros(5), resolve_loss("logistic"), 5), gradient.SLOT_SCHEMA)
    plan = _plan(partials, capsys, "formatted")
    assert "Exchange" not in plan
    schema = plan.split("ReadSchema: ")[1].split("\n")[0]
    assert schema == ("struct<l_orderkey:bigint,l_quantity:double,l_extendedprice:double,l_discount:double,"
                      "l_tax:double,l_returnflag:string>")


def _shuffles(df) -> list[str]:
    """The shuffles of a plan, without those that filled its caches."""
    out, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if node.nodeName() == "Exchange":
            out.append(node.outputPartitioning().toString())
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
    return out


@pytest.mark.parametrize("broadcast", [True, False])
def test_wide_gradient_reuses_the_key_partitioning(spark, broadcast, monkeypatch):
    """The frames of ``fit_wide`` itself, below and above the broadcast bound of the weights."""
    from pyspark import StorageLevel
    from pyspark.sql import functions as F

    from slopeline.operators import wide

    if not broadcast:
        monkeypatch.setattr(wide, "BROADCAST_WEIGHTS_ROWS", 10)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # force the large-table plan
    try:
        entries, labels = tables.embeddings_long(spark, SF_SMALL)
        ent = entries.repartition(8, "key").persist(StorageLevel.MEMORY_AND_DISK)
        lab = labels.repartition(8, "key").persist(StorageLevel.MEMORY_AND_DISK)
        ent.count(), lab.count()
        w = spark.range(64).select(F.col("id").cast("int").alias("idx"), F.lit(0.1).alias("w"))
        per_key = wide.iteration_frames(ent, lab, w, resolve_loss("logistic"), 64)
        margins = _shuffles(per_key)
        per_key.persist()
        per_key.count()
        # broadcast weights: entries and labels stay where they are
        assert not margins if broadcast else any(m.startswith("hashpartitioning(idx") for m in margins), margins
        grad = _shuffles(wide.gradient_by_index(ent, per_key, 10))
        assert any(g.startswith("hashpartitioning(idx") for g in grad) and len(grad) == (1 if broadcast else len(grad))
        per_key.unpersist(), ent.unpersist(), lab.unpersist()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
