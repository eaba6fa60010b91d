"""Print the physical plans of the core operators (``explain("formatted")``) at one scale."""

from __future__ import annotations

import os
import sys

import numpy as np

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from slopeline.functions.losses import resolve_loss  # noqa: E402
from slopeline.functions.sampling import keyed_sample  # noqa: E402
from slopeline.operators import gradient, metrics, scoring  # noqa: E402
from slopeline.operators.trainers import prepare  # noqa: E402
from slopeline.session import local_session  # noqa: E402
from slopeline.sources import models, tables  # noqa: E402


def show(title, df):
    print(f"\n==================== {title}")
    df.explain("formatted")


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = local_session(8)
    loss = resolve_loss("logistic")
    fx2 = prepare(tables.lineitem_returns(spark, sf))
    batch = keyed_sample(fx2, "key", 0.3, 43)
    show("gradient, Arrow kernel, merged by slot (sampled lineitem)",
         gradient.gradient_frame(batch, np.zeros(5), loss, 5, kernel="arrow"))
    show("gradient, JVM sums kernel (sampled lineitem)",
         gradient.gradient_row_sums(batch, np.linspace(-0.1, 0.1, 5), loss, 5))
    model = models.LinearModel(np.linspace(-0.1, 0.1, 5))
    show("scoring", scoring.predict(fx2, model, keep=["key"]))
    show("score counts of the exact AUC", metrics.score_counts(scoring.score_and_label(fx2, model)))
    show("fixture: lineitem joined to part", tables.lineitem_prices(spark, sf))
    show("fixture: labels joined to documents", tables.documents_quality(spark, sf))
    from slopeline.operators import svrg
    from slopeline.operators.trainers import TrainConfig

    cfg = TrainConfig(method="svrg", fraction=0.5, shards=4)
    sharded = svrg.sharded_table(prepare(tables.embeddings_binary(spark, sf), row_ids=True), cfg, 4)
    sharded.count()
    walk = svrg.svrg_kernel(np.zeros(64), loss, 64, 0.1, 0.1, "random", 42, 1)
    show("SVRG walk, one iteration (table hash-partitioned by shard once per fit)",
         svrg.shard_partials(keyed_sample(sharded, "key", 0.5, 43, "xxhash64", "_rid"), walk))
    entries, labels = tables.embeddings_long(spark, sf)
    ent = entries.repartition(8, "key")
    lab = labels.repartition(8, "key")
    w = spark.range(64).select(F.col("id").cast("int").alias("idx"), F.lit(0.1).alias("w"))
    margins = ent.join(F.broadcast(w), "idx").groupBy("key").agg(F.sum(F.col("value") * F.col("w")).alias("z"))
    per_key = lab.join(margins, "key", "left").select("key", (F.coalesce("z", F.lit(0.0)) - F.col("label")).alias("mult"))
    show("wide mode gradient (entries and labels hash-partitioned by key)",
         ent.join(per_key, "key").groupBy("idx").agg(F.sum(F.col("mult") * F.col("value")).alias("g")))


if __name__ == "__main__":
    main()
