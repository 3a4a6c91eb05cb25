"""Text made safe for display; the stored cells stay as they are."""

from pyspark.sql import functions as F


def visible_text(c, limit=None):
    r"""Control characters and line separators written as \uXXXX or \UXXXXXXXX.

    With `limit`, longer text is cut to that many characters and ends with an ellipsis.
    """
    shown = c if limit is None else F.left(c, F.lit(limit))

    def escape(ch):
        code = F.hex(F.encode(ch, "UTF-32"))
        short = F.concat(F.lit("\\u"), F.lower(F.right(code, F.lit(4))))
        full = F.concat(F.lit("\\U"), F.lower(code))
        return F.when(
            ch.rlike(r"^[\p{C}\x{2028}\x{2029}]"),
            F.when(F.startswith(code, F.lit("0000")), short).otherwise(full),
        ).otherwise(ch)

    # Only text that needs escaping pays for the character array.
    escaped = F.when(
        shown.rlike(r"[\p{C}\x{2028}\x{2029}]"),
        F.array_join(F.transform(F.split(shown, ""), escape), ""),
    ).otherwise(shown)
    if limit is None:
        return escaped
    return F.when(F.char_length(c) > limit, F.concat(escaped, F.lit("…"))).otherwise(escaped)
