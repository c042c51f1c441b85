"""Public location key codec (integer ↔ six letters).

Each of the six key positions has its own 62-letter alphabet.  The lowest
base-62 digit of the id is the *offset*; it is written with alphabet 0 in
position 0, and every higher digit d (from the lowest, written right to left
in positions 5..1) is written as ``alphabet[pos][(d + offset) % 62]``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The six per-position alphabets (must equal the reference's).
KEY_ALPHABETS = [
    "jNn7uY2ETd6JUOSVkAMyhCt3qw1WcpIv5P0LK4DfXFzbl8xemrB9RHGgoiQZsa",
    "3tDL8pPwScIbnE0gsjvK2QxoVhrf17eG6yM4BJkOTXWzNduiFHZqAC9UmY5Ral",
    "JyADsUFtkjzXqLG0SMb1egmhw8Q6cETpVfI5xdl42H9vROKYuNiWonPC73rBaZ",
    "2ZTSUXQFPgK7nwOi0N5s8z1rjqC4E6VHkRypo3J9hdBImxAGltWeMvYfLuDbca",
    "8NlPjJIHE7naFyewTqmdsK5YQhU9gp6WRXBVGouMDALtr0c324bzCSfOv1iZkx",
    "OPwcLs1zy69KpNjm0hFGaEte5UIrfVBXZYQWv27S34MJHkTbdgDARlConqx8iu",
]
RADIX = 62
KEY_LEN = 6


def encode_parts(n: Column) -> tuple[Column, Column]:
    """(offset, high): lowest base-62 digit of the id and the id without it."""
    n = n.cast("bigint")
    return F.pmod(n, F.lit(RADIX)), F.floor(n / RADIX).cast("bigint")


def encode_key(n: Column, offset: Column | None = None, high: Column | None = None) -> Column:
    """Integer id → six-letter key; ids ≤ 0 (or NULL) give ''.

    ``offset``/``high`` may be columns already holding ``encode_parts(n)``
    so they are computed once per row.
    """
    n = n.cast("bigint")
    if offset is None or high is None:
        offset, high = encode_parts(n)
    letters = [F.substring(F.lit(KEY_ALPHABETS[0]), (offset + 1).cast("int"), 1)]
    for pos in range(1, KEY_LEN):
        # position `pos` carries the digit of weight 62 ** (5 - pos) of `high`;
        # operands are non-negative wherever the result is used, so plain
        # `%` (cheaper code than pmod) gives the same digits
        digit = F.floor(high / F.lit(RADIX ** (KEY_LEN - 1 - pos))) % RADIX
        idx = (digit + offset) % RADIX + 1
        letters.append(F.substring(F.lit(KEY_ALPHABETS[pos]), idx.cast("int"), 1))
    return F.when(F.coalesce(n, F.lit(0)) > 0, F.concat(*letters)).otherwise(F.lit(""))


def key_offset(key: Column) -> Column:
    """Alphabet-0 index of the first letter (-1 when unknown)."""
    return F.instr(F.lit(KEY_ALPHABETS[0]), F.substring(F.coalesce(key, F.lit("")), 1, 1)) - 1


def decode_key(key: Column, offset: Column | None = None) -> Column:
    """Six-letter key → integer id (bigint); 0 when the key is not valid.

    Wrong length or an unknown first letter gives 0; an unknown later letter
    counts as alphabet index 0.  ``offset`` may be a column already holding
    ``key_offset(key)`` so the expression is computed once per row.
    """
    k = F.coalesce(key, F.lit(""))
    offset = key_offset(key) if offset is None else offset
    value = F.lit(0).cast("bigint")
    for pos in range(1, KEY_LEN):
        idx = F.greatest(F.instr(F.lit(KEY_ALPHABETS[pos]), F.substring(k, pos + 1, 1)) - 1, F.lit(0))
        digit = (idx + RADIX - offset) % RADIX
        value = value * RADIX + digit
    value = value * RADIX + offset
    ok = (F.length(k) == KEY_LEN) & (offset >= 0)
    # never NULL: declaring it (coalesce with a literal) stops the planner
    # from inferring an `isnotnull(decoded)` join filter and pushing the
    # whole decode expression down into the scan-side filter
    return F.coalesce(F.when(ok, value), F.lit(0).cast("bigint"))


def key_is_valid(key: Column) -> Column:
    """True when the key has six letters, each from its position's alphabet."""
    k = F.coalesce(key, F.lit(""))
    ok = F.length(k) == KEY_LEN
    for pos in range(KEY_LEN):
        ok = ok & (F.instr(F.lit(KEY_ALPHABETS[pos]), F.substring(k, pos + 1, 1)) > 0)
    return ok
