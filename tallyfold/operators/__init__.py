from .aggregates import (
    categorical_crosscount, describe_column, filter_keys_with_min_total, per_column_totals,
    running_max, share_where, sum_share, top_k, top_k_with_ties, value_counts, wide_sum,
    with_group_size, with_share,
)
from .association import association_row, binned, chi_square, contingency_table, cramers_v, phik, phik_matrix
from .bitmaps import (
    coarser_bitmaps, common_bitmaps, count_bitmaps, id_bitmaps, merge_bitmaps, number_ids,
)
from .bucketing import bucketed
from .keys import join_group_values, join_on_keys, with_row
from .outliers import (
    FLAT_TRIMS, Trim, boxplot_stats, drop_outlier_entities, flag_iqr_outliers, histogram,
    iqr_fences, iqr_null_upper, iqr_outliers, percentile_limits, percentile_trim,
)
from .profiles import TableProfile
from .quality import (
    count_duplicates, dedup_keep_first, domain_check, downcast, duplicate_groups, fill_group_mean,
    hidden_duplicates, implausible_dates, key_uniqueness, missing_share_by, missing_stats,
    missingness_rule, narrowest_types, period_completeness, row_loss_report, snake_case_columns,
    unfill_sentinel,
)
from .quantiles import (
    Histogram, column_quantiles, count_values, exact_quantiles, group_median, merge_counts,
    quantile_columns,
)
from .ranges import range_join
from .reshape import aligned_ratio, growing_keys, pivot_count, pivot_sum
from .segments import collapse_segments, size_classes, span_class

__all__ = [
    "FLAT_TRIMS", "Histogram", "TableProfile", "Trim", "aligned_ratio", "association_row", "binned", "boxplot_stats", "bucketed", "categorical_crosscount",
    "chi_square", "coarser_bitmaps", "collapse_segments", "column_quantiles", "common_bitmaps", "contingency_table",
    "count_bitmaps", "count_duplicates", "count_values",
    "cramers_v", "dedup_keep_first", "describe_column", "domain_check", "downcast", "drop_outlier_entities",
    "duplicate_groups", "exact_quantiles", "fill_group_mean", "filter_keys_with_min_total",
    "flag_iqr_outliers", "group_median", "growing_keys", "hidden_duplicates", "histogram", "id_bitmaps",
    "implausible_dates", "iqr_fences", "iqr_null_upper", "iqr_outliers", "join_group_values", "join_on_keys",
    "key_uniqueness", "merge_bitmaps", "merge_counts", "missing_share_by", "missing_stats", "missingness_rule",
    "narrowest_types", "number_ids", "percentile_limits", "percentile_trim", "per_column_totals", "period_completeness", "phik",
    "phik_matrix", "pivot_count", "pivot_sum", "quantile_columns", "range_join", "row_loss_report",
    "running_max", "share_where", "size_classes", "snake_case_columns", "span_class", "sum_share",
    "top_k", "top_k_with_ties", "unfill_sentinel", "value_counts", "wide_sum", "with_group_size",
    "with_row", "with_share",
]
