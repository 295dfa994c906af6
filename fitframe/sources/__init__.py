from fitframe.sources.libsvm import (
    binary_label,
    infer_num_features,
    num_features_frame,
    parse_libsvm,
    read_libsvm,
)
from fitframe.sources.tables import (
    examples_from_array,
    examples_from_arrays,
    examples_from_columns,
)

__all__ = [
    "binary_label",
    "examples_from_array",
    "examples_from_arrays",
    "examples_from_columns",
    "infer_num_features",
    "num_features_frame",
    "parse_libsvm",
    "read_libsvm",
]
