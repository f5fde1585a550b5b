"""Reading fields of a record held as VARIANT, strict about JSON types.

A field of another type than asked for counts as missing. Missing strings are '' and
missing numbers 0, as records are full of fields that only some sensors fill.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _variant(record: Column, path: str) -> Column:
    return F.try_variant_get(record, f"$.{path}", "variant")


def _text(record: Column, path: str) -> Column:
    """The string at path, null for all else: of JSON's values only strings can be read as bytes."""
    return F.try_variant_get(record, path, "binary").cast("string")


def text_of(value: Column) -> Column:
    """A VARIANT as text; '' if it isn't a string."""
    return F.coalesce(_text(value, "$"), F.lit(""))


def text(record: Column, path: str) -> Column:
    """The string at path; '' if there is none or it isn't a string."""
    return F.coalesce(_text(record, f"$.{path}"), F.lit(""))


def first_of(*texts: Column) -> Column:
    """The first of these texts that isn't empty or null; '' if none is."""
    return F.coalesce(*[F.when(t != "", t) for t in texts], F.lit(""))


def first_text(*values: Column) -> Column:
    """The first of these VARIANTs that is a string and not empty; '' if none is."""
    return first_of(*map(text_of, values))


def number_of(value: Column) -> Column:
    """A VARIANT's number cut to a whole one, or its string of digits as one; else 0."""
    kind, raw = F.schema_of_variant(value), _text(value, "$")
    digits = F.when(raw.rlike("^[0-9]+$"), raw.try_cast("bigint"))
    whole = F.try_variant_get(value, "$", "double").try_cast("bigint")
    return F.coalesce(F.when(kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL"), whole).otherwise(digits), F.lit(0).cast("bigint"))


def number(record: Column, path: str) -> Column:
    """The number at path cut to a whole one, or a string of digits as one; else 0."""
    return number_of(_variant(record, path))


def first_number(*values: Column) -> Column:
    """The first of these VARIANTs that is a number other than 0; 0 if none is."""
    return F.coalesce(*[F.nullif(number_of(v), F.lit(0)) for v in values], F.lit(0).cast("bigint"))


def items_of(value: Column) -> Column:
    """A VARIANT's items, if it is an array; else none."""
    return F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array().cast("array<variant>"))


def plain(texts: list[str], others: list[str]) -> set[str]:
    """Of the paths of texts, those that no other path is equal to, goes on from or ends on the way to."""
    every = {*texts, *others}
    return {p for p in set(texts) - set(others) if not any(q.startswith(f"{p}.") or p.startswith(f"{q}.") for q in every)}


def tree(paths: list[str], texts: set[str] = frozenset()) -> str:
    """The struct type that takes all values at these dotted paths out of a VARIANT at once, each still a VARIANT; those of ``texts`` as bytes, null if they aren't strings."""
    inner: dict[str, list[str]] = {}
    for path in sorted(set(paths)):
        name, _, rest = path.partition(".")
        inner.setdefault(name, []).append(rest)
    under = lambda name: {t.partition(".")[2] for t in texts if t.partition(".")[0] == name}
    kind = lambda name, rest: tree(rest, under(name)) if all(rest) else "binary" if name in texts else "variant"
    return f"struct<{','.join(f'{n}:{kind(n, r)}' for n, r in inner.items())}>"


def at(column: str, path: str, paths: list[str]) -> Column:
    """The VARIANT at path of a column of type tree(paths): where a shorter path ends on the way, it is looked up from there."""
    names = path.split(".")
    for k in range(1, len(names)):
        if ".".join(names[:k]) in paths:
            return _variant(F.col(".".join([column, *names[:k]])), ".".join(names[k:]))
    return F.col(f"{column}.{path}")


def text_at(column: str, path: str, paths: list[str], texts: set[str]) -> Column:
    """The text at path of a column of type tree(paths, texts); '' or null if it isn't a string."""
    value = at(column, path, paths)
    return value.cast("string") if path in texts else text_of(value)


def texts_of(value: Column) -> Column:
    """The strings of a VARIANT array, or the one string that it is, as an array."""
    strings = F.transform(F.filter(items_of(value), lambda x: F.schema_of_variant(x) == "STRING"), lambda x: F.try_variant_get(x, "$", "string"))
    return F.when(F.schema_of_variant(value) == "STRING", F.array(text_of(value))).otherwise(strings)


def has(record: Column, path: str) -> Column:
    """Whether path holds something other than null."""
    value = _variant(record, path)
    return value.isNotNull() & ~F.is_variant_null(value)


def timestamp(value: Column) -> Column:
    """An RFC 3339 instant, or one with an offset without a colon; null for all else."""
    shaped = value.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d([.,]\d{1,9})?(Z|[+-]\d\d:?\d\d)\z")
    # a cast reads what is shaped so, of the fraction its first six digits, but for the comma
    plain = F.when(value.contains(","), F.replace(value, F.lit(","), F.lit("."))).otherwise(value)
    return F.when(shaped, plain.try_cast("timestamp"))


def vlans_of(value: Column) -> Column:
    """Tags of 1 to 4095 in a flat VARIANT array."""
    numeric = F.filter(items_of(value), lambda x: F.schema_of_variant(x).isin("BIGINT", "DOUBLE") | F.schema_of_variant(x).startswith("DECIMAL"))
    values = F.transform(numeric, lambda x: F.try_variant_get(x, "$", "double"))
    return F.transform(F.filter(values, lambda x: (x > 0) & (x < 4096)), lambda x: x.cast("int"))
