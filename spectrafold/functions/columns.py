"""Column functions in built-in expressions: quantisation, Elias-Fano parts, tokens, text forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PEAK_FLOOR = 0.01
MIN_PEAKS = 10
READS_PER_BATCH = 512


def mz_steps(precision: float) -> tuple[float, bool]:
    """The one rule of m/z steps: a factor to multiply by where 1 / precision is whole, else the precision to divide by."""
    if not 0 < precision < float("inf"):
        raise ValueError(f"the precision must be a positive number, not {precision}")
    factor = round(1 / precision)
    return (float(factor), True) if factor and abs(factor * precision - 1) < 1e-12 else (float(precision), False)


def mz_quantize(mz: Column, precision: float = 0.001) -> Column:
    """m/z as a whole number of precision steps, half away from zero."""
    step, whole = mz_steps(precision)
    return F.round(mz * F.lit(step) if whole else mz / F.lit(step)).cast("long")


def mz_dequantize(q: Column, precision: float = 0.001) -> Column:
    step, whole = mz_steps(precision)
    return q / F.lit(step) if whole else q * F.lit(step)


def sqrt_quantize(intensity: Column) -> Column:
    return F.round(F.sqrt(intensity)).cast("long")


def sqrt_dequantize(d: Column) -> Column:
    return d * d


def baseline_sqrt(intensity: Column, floor: Column) -> Column:
    return F.round(F.sqrt((intensity - floor) * 10000.0)).cast("long")


def baseline_linear(intensity: Column, floor: Column) -> Column:
    return F.round((intensity - floor) * 100000.0).cast("long")


def keeps_peak(intensity: Column) -> Column:
    """Zero-intensity filter: 0.01 and NaN stay."""
    return (intensity >= PEAK_FLOOR) | F.isnan(intensity)


def keeps_scan(peaks: Column, ms_level: Column) -> Column:
    """Minimum peak count, on raw counts; an unset level (null or -1) drops the scan."""
    return (peaks >= MIN_PEAKS) & (F.coalesce(ms_level, F.lit(-1)) != -1)


def ef_width(n: Column, last: Column) -> Column:
    """Width of low parts: 0 if last <= n, else ceil(log2(last / n))."""
    return F.when(last <= n, 0).otherwise(F.ceil(F.log2(last / n))).cast("int")


def ef_high(x: Column, width: Column) -> Column:
    return F.floor(x / F.pow(F.lit(2.0), width)).cast("long")


def ef_low(x: Column, width: Column) -> Column:
    return (x - ef_high(x, width) * F.pow(F.lit(2.0), width).cast("long")).cast("long")


def plain_base64(data: Column) -> Column:
    """base64 without line breaks."""
    return F.regexp_replace(F.base64(data), "[\r\n]", "")


def id_tokens(identifier: Column) -> Column:
    tokens = F.split(F.replace(identifier, F.lit(" "), F.lit(":\t:")), ":", -1)
    return F.when(F.element_at(tokens, -1) == "", F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0)))).otherwise(tokens)


def is_digits(text: Column) -> Column:
    return text.rlike("^[0-9]*$")


def attribute(tag: Column, name: str) -> Column:
    """Value of name="..." in a tag, empty if there is none."""
    return F.regexp_extract(tag, rf'\b{name}="([^"]*)"', 1)


def file_suffix(path: Column) -> Column:
    """Lower-case text after the last dot of the file name."""
    return F.lower(F.regexp_extract(path, r"\.([^./\\]*)$", 1))


def file_stem(path: Column) -> Column:
    """File name up to its last dot."""
    name = F.regexp_extract(F.translate(path, "\\", "/"), r"([^/]*)$", 1)
    return F.regexp_replace(name, r"\.[^.]*$", "")


def key_values(line: Column) -> Column:
    """First key and value of a `key: value` line without braces, quotes and commas."""
    clean = F.translate(line, '{}", ', "")
    return F.split(clean, ":", 2)


def duration_text(seconds: Column) -> Column:
    return F.format_string("PT%.2fS", seconds.cast("double"))


def two_bit_code(letter: Column) -> Column:
    """A, T, G, C as 0 to 3, others as 0."""
    return F.coalesce(F.when(letter == "T", 1).when(letter == "G", 2).when(letter == "C", 3), F.lit(0))


def ms_level_of(kind: Column) -> Column:
    """Frame kind 0 is level 1; 2, 8 and 9 are level 2; others are unset."""
    return F.when(kind == 0, 1).when(kind.isin(2, 8, 9), 2).otherwise(-1)
