from castlens.sources.lines import number_lines, read_quarantined
from castlens.sources.readers import (PRINCIPALS_SCHEMA, RATINGS_SCHEMA, read_csv_clean,
                                     read_csv_inferred, read_delimited, read_json,
                                     read_principals, read_ratings, read_text_positional,
                                     rows_to_dataframe, trim_strings,
                                     with_line_order)
from castlens.sources.sinks import (read_keyvalue, row_text, stage_to_parquet, write_delimited,
                                    write_keyvalue, write_text_rows)

__all__ = [
    "PRINCIPALS_SCHEMA", "RATINGS_SCHEMA", "read_csv_clean", "read_csv_inferred", "read_delimited",
    "read_json", "read_principals", "read_ratings", "read_text_positional", "rows_to_dataframe",
    "trim_strings", "with_line_order", "read_keyvalue", "row_text", "stage_to_parquet", "write_delimited",
    "write_keyvalue", "write_text_rows", "number_lines", "read_quarantined",
]
