"""SQL fragments for oracle strings (DuckDB dialect)."""

from __future__ import annotations


def split_ws(t: str) -> str:
    """X01 in DuckDB: Java String.split('\\s+') of lower(t)."""
    r = f"regexp_replace(lower({t}), '\\s+$', '')"
    return (f"(CASE WHEN {r} = '' AND length({t}) > 0 THEN []::VARCHAR[] "
            f"ELSE string_split_regex({r}, '\\s+') END)")


def ratio(num: str, den: str) -> str:
    return f"(CASE WHEN {den} > 0 THEN round(CAST({num} AS DOUBLE) / {den}, 4) ELSE 0.0 END)"


def letters_tokens(t: str) -> str:
    """X10 in DuckDB."""
    return (f"list_filter(string_split(regexp_replace(lower({t}), '[^a-z]+', ' ', 'g'), ' '), lambda x: x <> '')")


def collapse_ws(t: str) -> str:
    return f"trim(regexp_replace({t}, '\\s+', ' ', 'g'))"
