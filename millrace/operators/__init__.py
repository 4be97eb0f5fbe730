"""The pipeline steps, each a function from a Frame to a Frame."""

from .columns import add_column, drop_columns, drop_empty_columns, duplicate_column, extract, json_keys, json_paths, match_columns, merge_columns, pair_names, rename, reorder_columns, select_columns, split_column, structure_delimited, structure_fixed, structure_json, structure_key_values, structure_pairs, structure_pattern, structure_spaces
from .combine import compare, join
from .frame import Frame
from .reshape import aggregate, long_to_wide, wide_to_long
from .rows import dedupe, drop_empty_rows, filter_rows, promote_header, remove_repeated_headers, remove_rows, skip_rows, sort_rows, split_to_rows
from .text import change_case, clean_text, convert_numbers, fill_blank, fill_down, normalize_dates, override_cells, replace_text, rewrite, trim, typed

__all__ = [
    "Frame", "add_column", "aggregate", "change_case", "clean_text", "compare", "convert_numbers", "dedupe", "drop_columns", "drop_empty_columns", "drop_empty_rows", "duplicate_column",
    "extract", "fill_blank", "fill_down", "filter_rows", "join", "json_keys", "long_to_wide", "match_columns", "merge_columns", "normalize_dates", "override_cells", "promote_header", "remove_repeated_headers",
    "remove_rows", "rename", "reorder_columns", "replace_text", "rewrite", "select_columns", "skip_rows", "sort_rows", "split_column", "split_to_rows", "structure_delimited", "structure_fixed", "structure_json",
    "structure_key_values", "pair_names", "structure_pairs", "structure_pattern", "structure_spaces", "trim", "typed", "wide_to_long",
]
