from fitframe.functions.arrays import dense_dot, sparse_dot, to_dense
from fitframe.functions.losses import LOGISTIC, Loss, sigmoid

__all__ = ["LOGISTIC", "Loss", "dense_dot", "sigmoid", "sparse_dot", "to_dense"]
