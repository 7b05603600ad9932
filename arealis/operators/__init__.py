"""Operators: DataFrames in, DataFrames out."""

from arealis.operators.clustering import Clustering, bisecting_kmeans, gaussian_mixture, kmeans, lda, power_iteration
from arealis.operators.compound import Leaf, compound, compound_join, merge
from arealis.operators.counts import count_frames, count_tables
from arealis.operators.features import (
    assemble,
    minmax_bounds,
    minmax_scale,
    prepare_features,
    train_test_split,
)
from arealis.operators.geo import points_within
from arealis.operators.grouping import (
    add_to_set,
    count_rows,
    first,
    greatest,
    group,
    last,
    least,
    mean,
    push,
    push_parts,
    rows,
    sort_by_count,
    std_pop,
    std_samp,
    total,
)
from arealis.operators.keyed import fit_by_key, for_keys, restrict_keys
from arealis.operators.metrics import regression_metrics
from arealis.operators.positions import number_rows
from arealis.operators.regression import (
    LinearParams,
    linear_metrics_by_key,
    linear_regression_by_key,
    linear_regression_with_test,
    score_by_key,
)
from arealis.operators.stages import (
    add_fields,
    bucket,
    bucket_auto,
    drop_incomplete,
    lookup,
    match,
    project,
    rename,
    replace_root,
    sample_n,
    select_features,
    sort,
    union_with,
    unwind,
)
from arealis.operators.timeseries import date_range, range_average, time_bucket_agg, time_bucket_filled, top_n_per_bucket
from arealis.operators.trees import BoostParams, ForestParams, gbt_by_key, random_forest_by_key
from arealis.operators.windows import moving_average, moving_average_docs

__all__ = [name for name in dir() if not name.startswith("_")]
