"""Expressions over the free-form text a generator returned."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.functions.binding import bind
from feedloom.functions.text import strip


def without_echo(output: Column, prompt: Column) -> Column:
    """Drop the prompt from the front of the output, then strip; outputs that
    do not start with the prompt stay as they are."""
    return F.when(
        F.startswith(output, prompt), strip(F.substring(output, F.length(prompt) + 1, F.length(output)))
    ).otherwise(output)


def json_slice(text: Column, close: str = "first") -> Column:
    """From the first ``{`` to the first or last ``}``.

    Without such a span the result never parses: it is a lone ``}`` when the
    text has no ``{`` and its chosen ``}`` ends the text, else empty.
    """
    size = F.length(text)
    start = F.locate("{", text)
    if close == "first":
        end = F.locate("}", text)
    elif close == "last":
        from_right = F.locate("}", F.reverse(text))
        end = F.when(from_right > 0, size - from_right + 1).otherwise(0)
    else:
        raise ValueError(f"close must be 'first' or 'last', not {close!r}")
    return (
        F.when((start > 0) & (end > start), F.substring(text, start, end - start + 1))
        .when((start == 0) & (end > 0) & (end == size), F.lit("}"))
        .when(text.isNotNull(), F.lit(""))
    )


def json_document(text: Column) -> Column:
    """The text as one JSON value, a VARIANT; null unless it is exactly one.

    Parsing it as the only element of an array makes trailing text an error.
    """
    wrapped = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))

    def only_element(elements: Column) -> Column:
        single = F.try_variant_get(elements, "$[1]", "variant").isNull()
        return F.when(single, F.try_variant_get(elements, "$[0]", "variant"))

    return bind(wrapped, only_element)


def string_list(document: Column, field: str) -> Column:
    """A field of a JSON object as ARRAY<STRING>; null unless the field is a
    list and each of its elements is a string."""

    def texts(value: Column) -> Column:
        # The schema of an empty list and of a list of nulls is ARRAY<VOID>.
        listed = F.schema_of_variant(value).isin("ARRAY<STRING>", "ARRAY<VOID>")
        items = F.when(listed, F.try_variant_get(value, "$", "array<string>"))
        return bind(items, lambda read: F.when(~F.exists(read, lambda item: item.isNull()), read))

    return bind(F.try_variant_get(document, f"$.{field}", "variant"), texts)


def normalised(queries: Column) -> Column:
    """Lower-cased, without duplicates, sorted."""
    return F.sort_array(F.array_distinct(F.transform(queries, F.lower)))
