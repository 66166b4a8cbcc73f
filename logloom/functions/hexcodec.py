"""Hex text <-> bytes as Spark column expressions (no Python on executors).

Rules:
* a ``0x`` / ``0X`` prefix is stripped only when present;
* fixed-width values shorter than the width are left-padded with zeros,
  longer ones are rejected (``lpad`` would silently truncate them);
* variable-width values must have an even number of hex digits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MAX_LEN = 2_147_483_647


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_prefix(c) -> Column:
    """Drop a leading ``0x``/``0X``; NULL stays NULL (plain string ops, no regex)."""
    c = _c(c)
    return F.when(F.substring(c, 1, 2).isin("0x", "0X"), F.substring(c, 3, _MAX_LEN)).otherwise(c)


def hex_digits_ok(c) -> Column:
    """True when the text (prefix stripped) has only hex digits.

    ``unhex`` yields NULL on any non-hex character (odd lengths are padded),
    so validity needs no regular expression.
    """
    c = _c(c)
    return F.when(c.isNotNull(), F.unhex(strip_prefix(c)).isNotNull())


def var_hex_ok(c) -> Column:
    """True when ``c`` is an even number of hex digits (NULL -> NULL)."""
    c = _c(c)
    digits = strip_prefix(c)
    return F.when(c.isNotNull(), (F.length(digits) % 2 == 0) & F.unhex(digits).isNotNull())


def hex_to_bytes(c, width: int | None = None) -> Column:
    """Decode hex text to ``binary``; fixed width when ``width`` is given.

    Invalid input decodes to NULL (``unhex`` of a bad digit is NULL; the
    length guards stop ``lpad`` truncating and ``unhex`` padding odd input);
    use the ``*_ok`` checks to tell invalid from absent.
    """
    digits = strip_prefix(c)
    if width is None:
        return F.when(F.length(digits) % 2 == 0, F.unhex(digits))
    return F.when(F.length(digits) <= 2 * width, F.unhex(F.lpad(digits, 2 * width, "0")))


def hex_col(c, alias: str | None = None, prefix: str = "0x") -> Column:
    """``binary`` -> ``'0x' || lower hex``; empty bytes -> ``'0x'``; NULL stays NULL."""
    name = c if isinstance(c, str) else None
    out = F.concat(F.lit(prefix), F.lower(F.hex(_c(c))))
    if alias is not None:
        return out.alias(alias)
    if name is not None:
        return out.alias(f"{name}_hex")
    return out


def bare_hex(c, alias: str | None = None) -> Column:
    """``binary`` -> lower hex without prefix (oracle comparison form)."""
    out = F.lower(F.hex(_c(c)))
    name = alias if alias is not None else (c if isinstance(c, str) else None)
    return out.alias(name) if name else out


def hex_literal(value: str, width: int | None = None) -> Column:
    """A request parameter as a binary literal; Catalyst folds it to a constant."""
    return hex_to_bytes(F.lit(value), width)
