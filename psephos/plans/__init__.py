"""Plans over whole datasets: the named-dataset build, ad-hoc SQL, and the query catalog."""

from psephos.plans.adhoc import UnsafeQueryError, adhoc_query, is_read_only_sql
from psephos.plans.datasets import DATASET_NAMES, build_datasets, load_datasets

__all__ = ["UnsafeQueryError", "adhoc_query", "is_read_only_sql", "DATASET_NAMES", "build_datasets", "load_datasets"]
