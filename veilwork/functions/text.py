"""Text clean-up, previews and stable hash buckets, as SQL expressions."""

from __future__ import annotations

from veilwork.functions.sqltext import let, lit

# What is to go, and the last place where one of these ends.  Behind that place
# nothing is dropped, so an opening that is never closed stays as text; before
# it every opening finds an end, and the scan stays linear.
_DROPS = (
    (r"(?is)<script\b[^>]*>.*?</script[^>]*>", r"(?is)^.*</script[^>]*>"),
    (r"(?is)<style\b[^>]*>.*?</style[^>]*>", r"(?is)^.*</style[^>]*>"),
    (r"(?s)<!--.*?-->", r"(?s)^.*-->"),
    (r"<[/!?A-Za-z][^>]*>", r"(?s)^.*>"),
)


def normalize_text(text: str) -> str:
    """Drop scripts, styles, comments and tags; one space for any white space.

    What is not closed is kept.
    """
    out = text
    for pattern, closed in _DROPS:
        cleaned = f"concat(regexp_replace(h, {lit(pattern)}, ' '), substring(t, length(h) + 1))"
        out = let("t", out, let("h", f"regexp_extract(t, {lit(closed)}, 0)", f"IF(h = '', t, {cleaned})"))
    return f"trim(regexp_replace({out}, {lit(r'[ \t\r\n\f]+')}, ' '))"


def preview(text: str, n: int) -> str:
    """The first ``n`` characters and three dots, for logs."""
    return f"concat(substring({text}, 1, {int(n)}), '...')"


def hash_number(key: str, salt: str = "") -> str:
    """A stable number from 0 to 2**32 - 1, the same in batch and stream."""
    return f"CAST(conv(substring(md5(concat('{salt}', CAST({key} AS string))), 1, 8), 16, 10) AS bigint)"


def hash_bucket(key: str, salt: str = "") -> str:
    """A stable number from 0 to 9999, the same in batch and stream."""
    return f"pmod({hash_number(key, salt)}, 10000)"
