"""Field tokens: one name space over columns, attribute keys, mapped fields and virtual time parts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The event table.
EVENT_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("event_id", "case_id", "source_id", "source_file", "content_hash", "file_hash")]
    + [T.StructField("byte_offset", T.LongType()), T.StructField("line_number", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in ("parser_name", "parser_version")]
    + [T.StructField("ingest_time", T.TimestampType()), T.StructField("message", T.StringType()), T.StructField("timestamp", T.TimestampType())]
    + [T.StructField(c, T.StringType()) for c in ("timestamp_desc", "artifact", "artifact_long", "display_name")]
    + [T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("attributes", T.MapType(T.StringType(), T.StringType()))]
    + [T.StructField(c, T.StringType()) for c in ("embedding_model", "embedding_config_hash")]
)
#: Columns that a token may name.
TEXT_COLUMNS = ("event_id", "case_id", "source_id", "source_file", "content_hash", "file_hash", "parser_name", "parser_version", "message", "timestamp_desc", "artifact", "artifact_long", "display_name")
#: Columns that free text is looked for in.
SEARCHED = ("message", "timestamp_desc", "artifact", "artifact_long", "display_name", "source_file")
#: Virtual time fields, each zero-padded text, in UTC; the bounded ones have a full domain.
TIME_FIELDS = ("hour_of_day", "day_of_week", "day_of_month", "week_of_year", "month", "date", "year_month")
TIME_DOMAINS = {
    "time:hour_of_day": [f"{i:02d}" for i in range(24)],
    "time:day_of_week": [str(i) for i in range(1, 8)],
    "time:day_of_month": [f"{i:02d}" for i in range(1, 32)],
    "time:week_of_year": [f"{i:02d}" for i in range(1, 54)],
    "time:month": [f"{i:02d}" for i in range(1, 13)],
}
#: A decimal number; casts also take `12f` and the like, which are none.
NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"

Mappings = Mapping[str, Sequence[str]]


def text_of(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def attribute(key: str) -> Column:
    return F.coalesce(F.col("attributes")[key], F.lit(""))


def effective_time(offsets: Mapping[str, float] | None = None, ts: Column | None = None) -> Column:
    """The time shifted by its source's clock offset in seconds; undated rows stay null, storage is unchanged."""
    ts = F.col("timestamp") if ts is None else ts
    if not offsets:
        return ts
    table = F.create_map(*[F.lit(x) for pair in offsets.items() for x in pair])
    shift = F.coalesce(table[F.col("source_id")].cast("double"), F.lit(0.0))
    return F.timestamp_millis(F.unix_millis(ts) + F.round(shift * 1000).cast("long"))


def time_part(part: str, offsets: Mapping[str, float] | None = None) -> Column:
    ts = effective_time(offsets)
    parts = {
        "hour_of_day": lambda: F.date_format(ts, "HH"),
        "day_of_week": lambda: (F.weekday(ts) + 1).cast("string"),
        "day_of_month": lambda: F.date_format(ts, "dd"),
        "week_of_year": lambda: F.lpad(F.weekofyear(ts).cast("string"), 2, "0"),
        "month": lambda: F.date_format(ts, "MM"),
        "date": lambda: F.date_format(ts, "yyyy-MM-dd"),
        "year_month": lambda: F.date_format(ts, "yyyy-MM"),
    }
    if part not in parts:
        raise ValueError(f"no time field {part!r}")
    return F.coalesce(parts[part](), F.lit(""))


def mapped(canonical: str, raws: Sequence[str]) -> Column:
    """The stored canonical key, or else the first raw key that is not blank."""
    return F.coalesce(*[F.nullif(F.col("attributes")[k], F.lit("")) for k in (canonical, *raws)], F.lit(""))


def resolve(token: str, mappings: Mappings | None = None, offsets: Mapping[str, float] | None = None) -> Column:
    """A token's value as text, '' where absent.

    Order: `time:` part, `attr:` (the map, always), mapped field, template, column, attribute key.
    """
    if token.startswith("time:"):
        return time_part(token[5:], offsets)
    if token.startswith("attr:"):
        return attribute(token[5:])
    if mappings and token in mappings:
        return mapped(token, mappings[token])
    if token == "template_id":
        return F.hex(F.xxhash64(template(F.col("message"))))
    if token in TEXT_COLUMNS:
        return text_of(F.col(token))
    if token == "tags":
        return F.array_join("tags", ",")
    return attribute(token)


def check_mappings(mappings: Mappings) -> None:
    """Refuses mappings that are too many, reserved, empty, or claim a raw key twice."""
    if len(mappings) > 64:
        raise ValueError("at most 64 canonical fields")
    seen: set[str] = set()
    for canonical, raws in mappings.items():
        if not canonical or canonical.startswith(("attr:", "time:")) or canonical in TEXT_COLUMNS:
            raise ValueError(f"{canonical!r} cannot be a canonical field")
        if not raws or len(raws) > 16:
            raise ValueError(f"{canonical!r} needs 1 to 16 raw keys")
        for raw in raws:
            if raw in seen or not raw:
                raise ValueError(f"raw key {raw!r} is empty or mapped twice")
            seen.add(raw)


def number(text: Column, finite: bool = True) -> Column:
    """Text as double, null if it is no decimal number; with finite, also if it overflows."""
    value = F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value) if finite else value


#: Masks of variable parts of a message, applied in this order.
TEMPLATE_MASKS = (
    (r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:?\d{2})?", "<TS>"),
    (r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "<UUID>"),
    (r"([0-9a-fA-F]{2}:){5}[0-9a-fA-F]{2}", "<MAC>"),
    (r"\b([0-9a-fA-F]{1,4}:){2,7}[0-9a-fA-F]{1,4}\b", "<IP6>"),
    (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "<IP>"),
    (r"\b(0[xX])?[0-9a-fA-F]{8,}\b", "<HEX>"),
    (r"\d+", "<NUM>"),
)


def template(text: Column) -> Column:
    """A message with times, ids, addresses and numbers masked."""
    for pattern, mask in TEMPLATE_MASKS:
        text = F.regexp_replace(text, pattern, mask)
    return text


def search_blob() -> Column:
    """Lower-cased text of all searched columns, tags and attribute values."""
    return F.lower(F.concat_ws(" ", *[F.col(c) for c in ("message", "artifact", "display_name", "timestamp_desc")], F.array_join("tags", " "), F.array_join(F.map_values("attributes"), " ")))
