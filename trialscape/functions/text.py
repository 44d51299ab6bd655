"""Text that came out of HTML, and strings inside nested values (TXT-2, TXT-3, DOC-10)."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialscape.functions.scalar import col


@F.pandas_udf(T.StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else html.unescape(x) for x in texts], dtype=object)


def unescape(c: Column | str) -> Column:
    """HTML entities as characters. Only texts with an ampersand are sent to Python."""
    text = col(c)
    return F.coalesce(_unescape(F.when(F.contains(text, F.lit("&")), text)), text)


def strip_markup(c: Column | str) -> Column:
    """Line breaks for ``<br>``, tags removed, white space squeezed, edges trimmed; empty is null."""
    text = F.replace(col(c), F.lit("\u00a0"), F.lit(" "))
    for pattern, value in (
        (r"<br[^>]*>", "\n"),
        (r"<[^>]+>", ""),
        (r"(?U)\s+\n", "\n"),
        (r"(?U)\n\s+", "\n"),
        (r"[ \t]+", " "),
        (r"(?U)^\s+|\s+$", ""),
    ):
        text = F.regexp_replace(text, pattern, value)
    return F.nullif(text, F.lit(""))


def html_to_text(c: Column | str) -> Column:
    """TXT-2. Entities become characters before tags are removed, so an escaped tag goes too."""
    return strip_markup(unescape(c))


def slice_between(c: Column | str, start: str, end: str, keep_start: bool = True) -> Column:
    """Text from the first ``start`` up to the next ``end`` (or to the end of the text);
    '' when ``start`` does not occur."""
    text = col(c)
    if not keep_start or not (start.startswith(end) or end.startswith(start)):
        # the text is named twice only: each further naming makes it anew where it is an expression
        before = F.length(F.substring_index(text, start, 1))
        tail = F.substr(text, before + (1 if keep_start else 1 + len(start)))
        return F.coalesce(F.substring_index(tail, end, 1), F.lit(""))
    at = F.locate(start, text)
    tail = F.substr(text, at)
    stop = F.locate(end, tail, 2)
    found = F.when(stop > 0, F.substr(tail, F.lit(1), stop - 1)).otherwise(tail)
    return F.when(at > 0, found).otherwise(F.lit(""))


def html_section(c: Column | str, anchor: str) -> Column:
    """TXT-3: from a named anchor to the next section title."""
    return slice_between(c, f'name="{anchor}"', '<div class="title-wrapper">')


def html_section_until(c: Column | str, anchor: str, end_anchor: str) -> Column:
    """TXT-3: from one named anchor to another."""
    return slice_between(c, f'name="{anchor}"', f'name="{end_anchor}"')


def trim_tree(c: Column, data_type: T.DataType) -> Column:
    """DOC-10: every string of a nested value trimmed; map keys stay."""
    if isinstance(data_type, T.StringType):
        return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    if isinstance(data_type, T.ArrayType):
        return F.transform(c, lambda x: trim_tree(x, data_type.elementType))
    if isinstance(data_type, T.MapType):
        return F.transform_values(c, lambda _, v: trim_tree(v, data_type.valueType))
    if isinstance(data_type, T.StructType):
        parts = [trim_tree(c[f.name], f.dataType).alias(f.name) for f in data_type.fields]
        return F.when(c.isNotNull(), F.struct(*parts))
    return c


def lines_of(c: Column | str) -> Column:
    """Lines of a text; every line break counts and a last empty line does not."""
    text = F.regexp_replace(col(c), r"\r\n|[\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]", "\n")
    return F.split(F.regexp_replace(text, "\n$", ""), "\n")


def trim_blank_edges(c: Column) -> Column:
    """A joined text without blank lines at its edges; all blank gives ''."""
    front = F.regexp_replace(c, r"^(?:[^\S\n]*\n)+", "")
    both = F.regexp_replace(front, r"(?:\n[^\S\n]*)+$", "")
    return F.when(F.rlike(both, F.lit(r"\S")), both).otherwise(F.lit(""))
