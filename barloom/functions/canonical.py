"""JSON that is the same byte for byte wherever it is written."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(fields: Column, nulls: bool = True) -> Column:
    """A struct as JSON: its fields in order, nulls written out (or left out), no blanks; in texts <, > and & and the line separators U+2028 and U+2029 are escaped as well, and escapes are in lower case."""
    out = F.to_json(fields, {"ignoreNullFields": str(not nulls).lower()})
    for c in "<>&\u2028\u2029":
        out = F.replace(out, F.lit(c), F.lit(f"\\u{ord(c):04x}"))
    # control characters: an escape stands after an even number of backslashes
    for digit in "ABCDEF":
        out = F.regexp_replace(out, r"(?<!\\)((?:\\\\)*)\\u00([01])" + digit, rf"$1\\u00$2{digit.lower()}")
    return out
