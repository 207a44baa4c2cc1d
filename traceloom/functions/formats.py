"""Text forms of events, durations and values, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shortened(text: Column, most: int = 30, mark: str = "...") -> Column:
    """text, cut to `most` characters with a mark at its end; arguments take 30, errors 50, results 200."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - len(mark)), F.lit(mark)))


def preview(text: Column, most: int = 80) -> Column:
    """One line of at most `most` characters."""
    return shortened(F.regexp_replace(F.trim(text), "\n", " "), most, "…")


def number(value: Column) -> Column:
    """Six significant digits, without trailing zeros."""
    size = lambda v: F.when(v == 0, 0).otherwise(F.floor(F.log10(F.abs(v))).cast("int"))
    scale = F.pow(F.lit(10.0), 5 - size(value))
    rounded = F.round(value * scale) / scale
    digits = size(rounded)
    bare = lambda t: F.regexp_replace(F.regexp_replace(t, "(\\.[0-9]*?)0+$", "$1"), "\\.$", "")
    mantissa = bare(F.format_string("%.5f", rounded / F.pow(F.lit(10.0), digits)))
    exponent = F.concat(F.when(digits < 0, "e-").otherwise("e+"), F.lpad(F.abs(digits).cast("string"), 2, "0"))
    return F.when((digits < -4) | (digits >= 6), F.concat(mantissa, exponent)).otherwise(bare(F.format_string("%.12f", rounded)))


def cost(costs: Column) -> Column:
    """`{tokens=12 usd=0.5}` for a map of numbers, in the order of its entries."""
    parts = F.transform(F.map_entries(costs), lambda e: F.concat(e["key"], F.lit("="), number(e["value"])))
    return F.concat(F.lit("{"), F.array_join(parts, " "), F.lit("}"))


def progress_bar(done: Column, total: Column, width: int = 10) -> Column:
    full = F.when(total != 0, F.floor(done * width / total)).otherwise(0).cast("int")
    return F.concat(F.lit("["), F.lit("█" * width).substr(F.lit(1), full), F.lit("░" * width).substr(F.lit(1), F.lit(width) - full), F.lit("]"))


def trace_line(msg: Column, state: Column, progress: Column, costs: Column, attributes: Column, bar: bool = True) -> Column:
    """A trace event on one line: bar, message, (done/total), [state], {cost}, (attributes); absent parts leave no gap."""
    done, total = F.get(progress, 0), F.get(progress, 1)
    has = progress.isNotNull() & (F.size(progress) > 0)
    shown = F.array_join(F.transform(F.map_entries(attributes), lambda e: F.concat(e["key"], F.lit("="), e["value"])), " ")
    parts = [
        F.when(has, progress_bar(done, total)) if bar else F.lit(None),
        F.when(msg != "", msg),
        F.when(has, F.concat(F.lit("("), done.cast("string"), F.lit("/"), total.cast("string"), F.lit(")"))),
        F.when(state != "", F.concat(F.lit("["), state, F.lit("]"))),
        F.when(F.size(costs) > 0, cost(costs)),
        F.when(F.size(attributes) > 0, F.concat(F.lit("("), shown, F.lit(")"))),
    ]
    return F.concat_ws(" ", *[p.cast("string") for p in parts])


def level_colour(level: Column) -> Column:
    return F.when(level == "error", "red").when(level == "warn", "yellow").otherwise("dim")


def coloured(text: Column, colour: Column) -> Column:
    code = F.when(colour == "red", "31").when(colour == "yellow", "33").otherwise("2")
    return F.concat(F.lit("\x1b["), code, F.lit("m"), text, F.lit("\x1b[0m"))


def duration(seconds: Column) -> Column:
    return F.when(seconds < 1, F.concat(F.format_string("%.0f", seconds * 1000), F.lit("ms"))).otherwise(F.concat(F.format_string("%.1f", seconds), F.lit("s")))


def duration_suffix(own: Column, cached: Column) -> Column:
    extra = F.coalesce(cached, F.lit(0.0))
    return F.when(own.isNull(), "").when(extra > 0, F.concat(duration(own + extra), F.lit(" ("), duration(extra), F.lit(" cached)"))).otherwise(duration(own))


def age(seconds: Column) -> Column:
    whole = lambda c: F.floor(c).cast("string")
    return F.when(seconds < 60, F.concat(whole(seconds), F.lit("s"))).when(seconds < 3600, F.concat(whole(seconds / 60), F.lit("m"))).otherwise(F.concat(whole(seconds / 3600), F.lit("h")))


def safe_name(name: Column) -> Column:
    """A name fit for a file: slashes and backslashes to dots, blanks to underscores."""
    return F.translate(name, "/\\ ", ".._")


def flattened_content(content: Column) -> Column:
    """The text of a JSON value that is a string or an array of blocks: text blocks' text, other blocks as JSON, one a line."""
    blocks = F.from_json(content, "array<string>")
    line = lambda b: F.when(F.get_json_object(b, "$.type") == "text", F.coalesce(F.get_json_object(b, "$.text"), F.lit(""))).otherwise(b)
    text = F.get_json_object(F.concat(F.lit('{"v":'), content, F.lit("}")), "$.v")
    return F.when(F.substring(F.ltrim(content), 1, 1) == "[", F.array_join(F.transform(blocks, line), "\n")).otherwise(text)


def page_title(html: Column) -> Column:
    return F.regexp_extract(html, "<title>([^<]*)</title>", 1)


def page_links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))


def page_price(html: Column) -> Column:
    """The figure after `price=`, with or without a dollar sign; `0` without one."""
    found = F.regexp_extract(html, "price=\\$?([0-9.]+)", 1)
    return F.when(found == "", "0").otherwise(found)


def page_stock(html: Column) -> Column:
    found = F.regexp_extract(html, "stock=([0-9]+)", 1)
    return F.when(found == "", "0").otherwise(found)


def styled_trace(msg: Column, state: Column, progress: Column, costs: Column, attributes: Column, level: Column) -> Column:
    """A trace event as text without a bar, in its level's colour."""
    return coloured(trace_line(msg, state, progress, costs, attributes, bar=False), level_colour(level))
