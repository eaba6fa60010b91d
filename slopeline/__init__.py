"""slopeline: stochastic gradient training of linear models as Spark jobs.

Functions of this package that run inside Python workers (Arrow kernels, shard walks)
are pickled by value, so executors need no installed copy of the package.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

from slopeline.functions.losses import (HingeLoss, LeastSquaresLoss, LogisticLoss, MarginLoss,  # noqa: E402
                                        MultinomialLoss)
from slopeline.functions.sampling import keyed_sample, keyed_split  # noqa: E402
from slopeline.operators.gradient import batch_sums  # noqa: E402
from slopeline.operators.metrics import area_under_roc, auc_frame  # noqa: E402
from slopeline.operators.scoring import predict, score_and_label  # noqa: E402
from slopeline.operators.trainers import FitResult, PreparedTable, TrainConfig, fit, prepared  # noqa: E402
from slopeline.operators.updates import UpdateRule  # noqa: E402
from slopeline.operators.wide import fit_wide, predict_wide  # noqa: E402
from slopeline.plans.experiment import run_experiment  # noqa: E402
from slopeline.sources.libsvm import read_libsvm, write_libsvm  # noqa: E402
from slopeline.sources.models import (LinearModel, WideModel, load_model, load_wide_model, save_model,  # noqa: E402
                                      save_wide_model, wide_model)



def batch_gradient(df, weights, loss="logistic", num_classes: int = 2, **kw):
    """Lazy ``(idx, grad)`` table of the mean gradient of ``loss`` at ``weights`` over ``df``
    (``key, label, features``); the feature width is ``len(weights) / outputs``."""
    import numpy as np

    from slopeline.functions.losses import resolve_loss
    from slopeline.operators.gradient import mean_gradient_frame

    lo = resolve_loss(loss, num_classes)
    w = np.asarray(weights, dtype=np.float64)
    return mean_gradient_frame(df, w, lo, len(w) // lo.outputs, **kw)


def row_loss(df, weights, loss="logistic", num_classes: int = 2, **kw):
    """Per-row ``(key, label, loss, mult...)`` table of ``loss`` at ``weights``."""
    import numpy as np

    from slopeline.functions.losses import resolve_loss
    from slopeline.operators.metrics import row_loss_frame

    lo = resolve_loss(loss, num_classes)
    w = np.asarray(weights, dtype=np.float64)
    return row_loss_frame(df, w, lo, len(w) // lo.outputs, **kw)


__all__ = [
    "batch_gradient", "row_loss",
    "TrainConfig", "fit", "fit_wide", "predict_wide", "FitResult", "batch_sums", "predict", "score_and_label",
    "area_under_roc", "auc_frame", "LinearModel", "save_model", "load_model", "read_libsvm",
    "write_libsvm", "keyed_sample", "keyed_split", "run_experiment", "MarginLoss", "LogisticLoss",
    "LeastSquaresLoss", "HingeLoss", "MultinomialLoss", "UpdateRule", "PreparedTable", "prepared",
    "WideModel", "wide_model", "save_wide_model", "load_wide_model",
]
