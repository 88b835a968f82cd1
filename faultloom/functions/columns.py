"""Column expressions. All run inside the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .categories import CATEGORY_IDS, UNKNOWN_CATEGORY

# Fixed values.
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"
MESSAGE_DELIMITER = "|"
UNLABELLED = -1
NUM_CLASSES = 4

# Characters a Python-style strip removes (Spark's trim removes blanks only).
_WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


# --- time -----------------------------------------------------------------

def parse_timestamp(col: Column, tolerant: bool = False) -> Column:
    """Strict parse of ``yyyy-MM-dd HH:mm:ss``; ``tolerant`` gives null instead
    of an error for malformed text."""
    if tolerant:
        return F.try_to_timestamp(col, F.lit(TIME_FORMAT)).cast("timestamp_ntz")
    return F.to_timestamp_ntz(col, F.lit(TIME_FORMAT))


def epoch_seconds(col: Column) -> Column:
    """Whole seconds since 1970 of a zone-free timestamp, without any zone rule."""
    days = F.datediff(col.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return days * 86400 + F.hour(col) * 3600 + F.minute(col) * 60 + F.second(col)


def epoch_micros(col: Column) -> Column:
    """Microseconds since 1970 of a zone-free timestamp."""
    # zone offsets are whole seconds, so the fraction is the same in any zone
    fraction = F.pmod(F.unix_micros(col.cast("timestamp")), F.lit(1000000))
    return epoch_seconds(col) * 1000000 + fraction


def fault_id(sn: Column, fault_time_ts: Column, label: Column) -> Column:
    """Display identity of a fault. Grouping always uses the three columns."""
    return F.concat(sn, fault_time_ts.cast("string"), label.cast("string"))


# --- messages ---------------------------------------------------------------

def strip_delimiter(msg: Column) -> Column:
    """Remove the field delimiter; the blanks around it stay."""
    return F.replace(msg, F.lit(MESSAGE_DELIMITER), F.lit(""))


def category_token(msg: Column) -> Column:
    """First blank-separated token of the stripped message."""
    return F.split(F.btrim(msg, F.lit(_WHITESPACE)), " ")[0]


def dictionary_encode(
    token: Column, mapping: Mapping[str, int] = CATEGORY_IDS, default: int = UNKNOWN_CATEGORY
) -> Column:
    """Token -> id through a literal map; unknown tokens get ``default``."""
    entries = [F.lit(part) for pair in mapping.items() for part in pair]
    return F.coalesce(F.try_element_at(F.create_map(*entries), token), F.lit(default))


def category_id(msg: Column) -> Column:
    return dictionary_encode(category_token(msg))


def word_count(msg: Column) -> Column:
    """Number of blank-separated pieces; empty pieces count."""
    return F.size(F.split(msg, " "))


def char_count(msg: Column) -> Column:
    """Length in code points."""
    return F.char_length(msg)


def flag(condition: Column) -> Column:
    """0/1 flag; a null condition is 0."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


# --- class-probability arrays -----------------------------------------------

def softmax(logits: Column) -> Column:
    """Softmax of an array; shifted by its maximum, so it cannot overflow."""
    exps = F.transform(logits, lambda x: F.exp(x.cast("double") - F.array_max(logits).cast("double")))
    return normalise(exps)


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def normalise(values: Column) -> Column:
    """Scale a non-negative array to sum 1."""
    return F.transform(values, lambda x: x / array_sum(values))


def sigmoid(logits: Column) -> Column:
    return F.transform(logits, lambda x: 1.0 / (1.0 + F.exp(-x.cast("double"))))


def one_hot(label: Column, classes: int = NUM_CLASSES) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: (i == label).cast("int")
    )


def argmax(values: Column) -> Column:
    """Index of the first largest element."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def round_half_even(col: Column, digits: int = 0) -> Column:
    """Banker's rounding, as numeric libraries do it."""
    return F.rint(col) if digits == 0 else F.bround(col, digits)


def array_total(arrays: Sequence[Column]) -> Column:
    """Element-wise sum of several arrays."""
    return reduce(lambda total, part: F.zip_with(total, part, lambda a, b: a + b), arrays)


def blend(probs: Sequence[Column], weights: Sequence[float]) -> Column:
    """Weighted element-wise sum of probability arrays."""
    if len(probs) != len(weights):
        raise ValueError("one weight per probability column")

    def scaled(prob: Column, weight: float) -> Column:
        return F.transform(prob, lambda x: x * F.lit(float(weight)))

    return array_total([scaled(p, w) for p, w in zip(probs, weights)])


def blend_mean(probs: Sequence[Column]) -> Column:
    """Element-wise mean of probability arrays."""
    return F.transform(array_total(probs), lambda x: x / F.lit(float(len(probs))))


def ordinal_vote(probs: Sequence[Column]) -> Column:
    """Rounded mean of the predicted class ids (an average of ids, no majority)."""
    total = sum((argmax(p) for p in probs[1:]), argmax(probs[0]))
    return round_half_even(total / F.lit(float(len(probs))))
