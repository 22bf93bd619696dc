from .tables import (  # noqa: F401
    scan_by_category, scan_csv, scan_labelled_table, scan_subset, scan_text_tree, sink_report,
    sink_table, with_categories,
)
