"""Sizes, counts and paths as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Multipliers of size suffixes: decimal for k/kb, binary for ki/kib. Fixed values.
SUFFIXES = {"": 1, "b": 1} | {f"{p}{s}": base**i for i, p in enumerate("kmgtp", 1) for s, base in (("", 1000), ("b", 1000), ("i", 1024), ("ib", 1024))}


def parse_size(text: Column) -> Column:
    """Bytes of texts like ``1.5 GiB``; null where the text isn't a size."""
    number = F.regexp_extract(F.lower(F.trim(text)), r"^(\d+(?:\.\d+)?)\s*([a-z]*)$", 1)
    suffix = F.regexp_extract(F.lower(F.trim(text)), r"^(\d+(?:\.\d+)?)\s*([a-z]*)$", 2)
    table = F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair])
    return F.floor(number.try_cast("double") * F.try_element_at(table, suffix))


def format_bytes(n: Column) -> Column:
    """``512 B``, ``1.5 KiB`` and so on, up to PiB; a tie of the last digit goes to the even one, and a negative size keeps its sign."""
    signed, n = n.cast("long"), F.abs(n.cast("long"))
    out = F.concat(n.cast("string"), F.lit(" B"))
    for i, unit in enumerate(("KiB", "MiB", "GiB", "TiB", "PiB"), 1):
        # the rest below a unit can be 50 bits long, and ten times it 54
        rest = n % 1024**i * 10
        tenths, left = F.shiftright(n, 10 * i) * 10 + F.shiftright(rest, 10 * i), rest % 1024**i * 2
        tenths = tenths + ((left > 1024**i) | ((left == 1024**i) & (tenths % 2 == 1))).cast("long")
        text = tenths.cast("string")
        out = F.when(n >= 1024**i, F.concat(text.substr(F.lit(1), F.length(text) - 1), F.lit("."), F.right(text, F.lit(1)), F.lit(" " + unit))).otherwise(out)
    return F.when(signed < 0, F.concat(F.lit("-"), out)).otherwise(out)


def format_count(n: Column) -> Column:
    """``494.0M``: thousands, millions and milliards with one digit."""
    size, out = F.abs(n.cast("long")), F.abs(n.cast("long")).cast("string")
    for unit, letter in ((10**3, "K"), (10**6, "M"), (10**9, "B")):
        out = F.when(size >= unit, F.format_string(f"%.1f{letter}", size / unit)).otherwise(out)
    return F.when(n < 0, F.concat(F.lit("-"), out)).otherwise(out)


def format_duration(seconds: Column) -> Column:
    """``0.4s``, ``12s``, ``1m 35s`` or ``1h 2m``."""
    whole = F.floor(seconds)
    pair = lambda unit, big, small: F.concat(F.floor(whole / unit).cast("string"), F.lit(big), F.floor(whole % unit / (unit // 60)).cast("string"), F.lit(small))
    return F.when(seconds < 1, F.format_string("%.1fs", seconds.cast("double"))).when(seconds < 60, F.format_string("%.0fs", seconds.cast("double"))).when(whole < 3600, pair(60, "m ", "s")).otherwise(pair(3600, "h ", "m"))


#: Seconds of the units that ages are told in. Fixed values.
AGES = ((60, "minute"), (3600, "hour"), (86_400, "day"), (604_800, "week"), (2_592_000, "month"), (31_536_000, "year"))


def format_age(moment: Column, now: Column) -> Column:
    """``3 days ago``, in the largest unit that fits; ``just now`` below a minute, ``in the future`` beyond now."""
    age = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(moment.cast("timestamp"))
    out = F.lit("just now")
    for unit, name in AGES:
        count = F.floor(age / unit)
        out = F.when(age >= unit, F.concat(count.cast("string"), F.lit(f" {name}"), F.when(count == 1, "").otherwise("s"), F.lit(" ago"))).otherwise(out)
    return F.when(age < 0, "in the future").otherwise(out)


def shorten_path(path: Column, longest: int = 60) -> Column:
    """A path of at most ``longest`` characters: where it is longer, a third of that from its beginning, three dots, and the rest from its end."""
    head = (longest - 3) // 3
    return F.when(F.length(path) > longest, F.concat(F.left(path, F.lit(head)), F.lit("..."), F.right(path, F.lit(longest - 3 - head)))).otherwise(path)


def segments(path: Column) -> Column:
    """Parts of a path between slashes, empty ones left out."""
    return F.filter(F.split(path, "/"), lambda s: s != "")


def drive(path: Column) -> Column:
    """The host of a URL, the letter of a drive, or the first folder."""
    return F.coalesce(
        F.nullif(F.regexp_extract(path, r"^[a-z]+://([^/?#]*)", 1), F.lit("")), F.nullif(F.upper(F.regexp_extract(path, r"^([A-Za-z]:)", 1)), F.lit("")),
        F.concat(F.lit("/"), F.element_at(segments(path), 1)),
    )


def ancestors(path: Column, itself: bool = False) -> Column:
    """All folders above a path of the form a/b/c, outermost first."""
    parts = F.split(path, "/")
    count = F.size(parts) - (0 if itself else 1)
    return F.when(count >= 1, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


def alias_key(name: Column) -> Column:
    """Case, blanks and underscores don't matter in names of categories."""
    return F.lower(F.translate(F.trim(name), "_ ", "--"))


def strings(values) -> Column:
    """An array of literal strings, as one expression: many literals one by one take longer to plan than to evaluate."""
    quoted = ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values)
    return F.expr(f"array({quoted})") if quoted else F.array().cast("array<string>")


def built_once(make: Callable) -> Callable:
    """``make`` for hashable arguments, its expressions kept for the session's JVM: rules don't depend on data, and building many takes seconds."""
    kept: dict[tuple, object] = {}

    @wraps(make)
    def build(*args):
        key = (id(SparkContext._gateway), *args)
        if key not in kept:
            kept[key] = make(*args)
        return kept[key]

    return build


#: Rows that are dealt to one task, about, where it holds a table of all its keys.
TASK_ROWS = 1 << 18


def dealt(frame: DataFrame, key: str, by: DataFrame | None = None) -> DataFrame:
    """``frame`` by its key over tasks whose number grows with the rows (of ``by``, which is cheaper to count), so that what one task holds doesn't."""
    least = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return frame.repartition(max(least, -(-(frame if by is None else by).count() // TASK_ROWS)), key)
