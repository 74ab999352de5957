"""Text helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: within a lambda, an expression named twice would be evaluated twice."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def stripped(c: Column) -> Column:
    """Without white space at both ends, as Unicode knows it."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def words(c: Column) -> Column:
    """Pieces between white space; none for blank and null text."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def blank(c: Column) -> Column:
    return F.coalesce(stripped(c), F.lit("")) == ""


def joined(lines: Column, sep: str = " ") -> Column:
    return F.array_join(F.transform(lines, lambda x: x["text"]), sep)


def basename(path: Column) -> Column:
    return F.regexp_replace(path, r"^.*/", "")


def stem(path: Column) -> Column:
    """File name without folder and last ending."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r".(\.[^.]*)$", 1))


def digest(c: Column) -> Column:
    return F.sha2(c, 256)


def truncated_at_space(text: Column, n: Column) -> Column:
    """First n characters, cut at the last space where the text is longer."""
    head = F.substring(text, F.lit(1), n)
    return F.when(F.length(text) <= n, text).otherwise(F.coalesce(F.nullif(F.regexp_replace(head, r"\s\S*$", ""), F.lit("")), head))


def wrapped(text: Column, width: Column | int) -> Column:
    """Greedy word wrap to lines of at most ``width`` characters; a longer word has a line of its own."""
    width = F.lit(width) if isinstance(width, int) else width
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(s: Column, w: Column) -> Column:
        fits = F.length(s["now"]) + F.length(w) + 1 <= width
        return (
            F.when(s["now"] == "", F.struct(s["done"].alias("done"), w.alias("now")))
            .when(fits, F.struct(s["done"].alias("done"), F.concat_ws(" ", s["now"], w).alias("now")))
            .otherwise(F.struct(F.concat(s["done"], F.array(s["now"])).alias("done"), w.alias("now")))
        )

    return F.aggregate(words(text), empty, step, lambda s: F.when(s["now"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["now"]))))


def sentences(text: Column) -> Column:
    """Sentences of 5 to 500 characters; header lines starting with == are left out."""
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), stripped), lambda x: (x != "") & ~x.startswith("=="))
    parts = F.flatten(F.transform(lines, lambda x: F.split(x, r"(?<=[.!?])\s+(?=[A-Z\"'])")))
    return F.filter(F.transform(parts, stripped), lambda x: F.length(x).between(5, 500))


def uniform(*keys: Column) -> Column:
    """A number in [0, 1) that depends on the keys alone."""
    return F.pmod(F.xxhash64(*keys), F.lit(1 << 52)).cast("double") / float(1 << 52)
