"""Canonical forms: JSON text, identities, quantities with units."""

from __future__ import annotations

import json
import math
import re
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class CanonicalError(ValueError):
    """An argument has no canonical form."""


#: unit -> (dimension, scale, offset): value in the base unit is value * scale + offset
UNITS = {
    "K": ("temperature", 1.0, 0.0), "C": ("temperature", 1.0, 273.15), "F": ("temperature", 5 / 9, 273.15 - 32 * 5 / 9),
    "m": ("length", 1.0, 0.0), "km": ("length", 1e3, 0.0), "cm": ("length", 1e-2, 0.0), "mm": ("length", 1e-3, 0.0), "ft": ("length", 0.3048, 0.0), "in": ("length", 0.0254, 0.0), "mi": ("length", 1609.344, 0.0),
    "kg": ("mass", 1.0, 0.0), "g": ("mass", 1e-3, 0.0), "mg": ("mass", 1e-6, 0.0), "lb": ("mass", 0.45359237, 0.0),
    "s": ("time", 1.0, 0.0), "ms": ("time", 1e-3, 0.0), "min": ("time", 60.0, 0.0), "h": ("time", 3600.0, 0.0),
    "Pa": ("pressure", 1.0, 0.0), "kPa": ("pressure", 1e3, 0.0), "bar": ("pressure", 1e5, 0.0), "atm": ("pressure", 101325.0, 0.0),
}
_QUANTITY = re.compile(r"([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)\s*°?([A-Za-z]+)")


def canon_json(value) -> str:
    """JSON with sorted keys, no spaces, plain UTF-8; numbers that aren't finite are refused."""
    try:
        return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    except ValueError as e:
        raise CanonicalError(str(e)) from None


def number_text(x: float) -> str:
    """Ten significant digits, without trailing zeros or a negative zero."""
    out = f"{x:.10g}"
    return "0" if out == "-0" else out


def convert(value: float, unit: str, to: str) -> float:
    if unit not in UNITS or to not in UNITS or UNITS[unit][0] != UNITS[to][0]:
        raise CanonicalError(f"{unit} can't be given in {to}")
    _, scale, offset = UNITS[unit]
    _, to_scale, to_offset = UNITS[to]
    return (value * scale + offset - to_offset) / to_scale


def quantity(text: str, to: str) -> str:
    """A quantity such as "100 C" in the unit asked for."""
    m = _QUANTITY.fullmatch(text.strip())
    if not m:
        raise CanonicalError(f"{text!r} is no quantity")
    return number_text(convert(float(m[1]), m[2], to)) + to


def canonical_args(args: list, units: dict | None = None) -> list:
    """Strings stripped; positions that units names in its unit."""
    out = []
    for i, a in enumerate(args):
        to = (units or {}).get(str(i))
        if to is not None:
            a = quantity(str(a), to)
        elif isinstance(a, str):
            a = a.strip()
        elif isinstance(a, float) and not math.isfinite(a):
            raise CanonicalError("argument isn't finite")
        out.append(a)
    return out


def fact_key(pred: str, args: list) -> str:
    return "fact:" + sha256(canon_json([pred, list(args)]).encode()).hexdigest()[:32]


def context_signature(ctx: dict | None) -> str | None:
    """The same for the same key-value pairs in any order; None without any."""
    return sha256(canon_json(sorted([str(k), str(v)] for k, v in ctx.items())).encode()).hexdigest() if ctx else None


def strings_json(strings: Column) -> Column:
    """canon_json() of an array of strings, or of arrays of them, in the JVM. Spark writes control characters with capital hex digits, which become small ones here."""
    out = F.replace(F.to_json(strings), F.lit("\\\\"), F.lit("\x01"))  # an escaped backslash isn't the beginning of an escape
    for code in (0x0B, 0x0E, 0x0F, *range(0x1A, 0x20)):
        out = F.replace(out, F.lit(f"\\u{code:04X}"), F.lit(f"\\u{code:04x}"))
    return F.replace(out, F.lit("\x01"), F.lit("\\\\"))


def fact_key_of(pred: Column | str, args: Column | str) -> Column:
    """fact_key() of (pred, arguments as strings); null if either is."""
    pred, args = (F.col(c) if isinstance(c, str) else c for c in (pred, args))
    name = F.regexp_extract(strings_json(F.array(pred)), r"(?s)^\[(.*)\]$", 1)
    text = F.concat(F.lit("["), name, F.lit(","), strings_json(args), F.lit("]"))
    return F.when(pred.isNotNull(), F.concat(F.lit("fact:"), F.substring(F.sha2(text.cast("binary"), 256), 1, 32)))


def context_signature_of(ctx: Column | str) -> Column:
    """context_signature() of a map of strings."""
    ctx = F.col(ctx) if isinstance(ctx, str) else ctx
    pairs = F.array_sort(F.transform(F.map_entries(ctx), lambda e: F.array(e["key"], F.coalesce(e["value"], F.lit("None")))))
    return F.when(F.size(ctx) > 0, F.sha2(strings_json(pairs).cast("binary"), 256))


def quantity_udf(to: str):
    """Quantities in one unit; null for what is none."""

    @F.pandas_udf(T.StringType())
    def run(text: pd.Series) -> pd.Series:
        def one(t):
            try:
                return quantity(t, to) if t is not None else None
            except CanonicalError:
                return None

        return pd.Series([one(t) for t in text], dtype="object")

    return run
