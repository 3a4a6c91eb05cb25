from tabloom.functions.interpret import (
    has_leading_zero,
    interpreted,
    is_missing,
    marked,
    number_error,
    raw_records,
    target_labels,
    to_boolean,
    to_date,
    to_number,
    typed_view,
)
from tabloom.functions.text import visible_text

__all__ = [
    "has_leading_zero",
    "interpreted",
    "is_missing",
    "marked",
    "number_error",
    "raw_records",
    "target_labels",
    "to_boolean",
    "to_date",
    "to_number",
    "typed_view",
    "visible_text",
]
