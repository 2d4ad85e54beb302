"""Cleaning, profiling and checking of tables on Spark. Every operator takes and returns a ``DataFrame``."""

from .errors import ColumnNotFound, EmptyInput, InvalidParameter, TablekitError
from .functions import math, text
from .operators.aggregate import group_by_aggregate, group_medians, group_stats, value_counts
from .operators.anomalies import find_anomalies, missing_anomalies, null_clusters, pattern_anomalies, statistical_anomalies
from .operators.arrange import duplicate_count, remove_duplicates, sort_data
from .operators.cells import (
    bad_addresses, column_slice, delete_rows, find_cells_with_value, insert_rows, inspect_data_around,
    inspect_data_around_many, lookup_cells, lookup_rows, patch_cells, patch_report, rows_from_json,
)
from .operators.correlation import get_correlation_matrix
from .operators.filters import Condition, filter_counts, filter_rows, predicate
from .operators.missing import fill_missing_values, values_filled
from .operators.outliers import detect_outliers, first_per_column, outlier_counts
from .operators.profile import get_data_summary, get_table_summary, profile_data, validate_dataframe, value_forms
from .operators.project import (
    add_column, add_column_values, change_column_type, remove_columns, rename_columns, select_columns,
)
from .operators.quality import (
    Completeness, Consistency, DataTypes, Duplicates, Outliers, QualityReport, Uniqueness, check_data_quality,
)
from .operators.statistics import get_column_statistics, get_statistics
from .operators.text import (
    extract_from_column, replace_in_column, split_column, strip_column, transform_column_case,
)
from .operators.update import (
    apply_expression, fill_column_nulls, map_values, replace_values, rows_changed, update_column,
)
from .operators.validate import ColumnRules, schema_checks, schema_summary, schema_violations
from .plans.columns import INDEX, nullify_nan
from .plans.order import renumber, with_row_index
from .settings import DEFAULTS, Thresholds
from .sources.files import parse_csv_column, preview, read_csv, read_parquet

__all__ = [name for name in dir() if not name.startswith("_")]
