from pagoscope.functions.numbers import (
    clamp, half_even, half_even_int, nan_to_null, parse_number, percent, ratio, thousands,
)
from pagoscope.functions.text import (
    code_family, comma_text, ellipsis, has_item, is_blank, is_email, join_codes, literal,
    literals, member, strip, upper_strip,
)
from pagoscope.functions.times import iso_text, moment, parse_timestamp

__all__ = [
    "clamp", "code_family", "comma_text", "ellipsis", "half_even", "half_even_int",
    "has_item", "is_blank", "is_email", "iso_text", "join_codes", "literal", "literals", "member", "moment",
    "nan_to_null", "parse_number", "parse_timestamp", "percent", "ratio", "strip",
    "thousands", "upper_strip",
]
