"""Row identity and cleaning: ids, hashes, times, tags, attributes, addresses."""

from __future__ import annotations

import ipaddress
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Name space of event ids.
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "eventlens:case")
IDENTITY = ("case_id", "source_id", "file_hash", "byte_offset", "content_hash", "parser_name", "parser_version")


def uuid5(name: Column, namespace: uuid.UUID = NAMESPACE) -> Column:
    """RFC 4122 version 5 of a name, by built-in functions."""
    h = F.substring(F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8"))), 1, 32)
    variant = F.element_at(F.array(*map(F.lit, "89ab")), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1)
    cut = lambda a, n: F.substring(h, a, n)
    return F.concat(cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-5"), cut(14, 3), F.lit("-"), variant, cut(18, 3), F.lit("-"), cut(21, 12))


def event_id(columns: tuple[str, ...] = IDENTITY) -> Column:
    """The same id whenever the same record of the same file is read again."""
    return uuid5(F.concat_ws("\n", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))


def content_hash(raw: Column) -> Column:
    return F.sha2(raw, 256)


def parse_time(text: Column) -> Column:
    """ISO-8601 (naive is UTC), three absolute formats, or an epoch of 10, 13 or 16 to 17 digits; else null."""
    t = F.trim(text)
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?\s*(Z|[+-]\d{2}:?\d{2})?)?$"), F.regexp_replace(F.regexp_replace(t, r"([+-]\d{2})(\d{2})$", "$1:$2"), r"\s+(Z|[+-]\d{2}:)", "$1").try_cast("timestamp"))
    formats = ["dd/MMM/yyyy:HH:mm:ss Z", "yyyy/MM/dd HH:mm:ss", "MM/dd/yyyy HH:mm:ss"]
    digits = F.when(t.rlike(r"^\d{10,17}$"), t.cast("long"))
    epoch = F.when(F.length(t) == 10, F.timestamp_seconds(digits)).when(F.length(t) == 13, F.timestamp_millis(digits)).when(F.length(t) >= 16, F.timestamp_micros(digits))
    return F.date_trunc("millisecond", F.coalesce(iso, epoch, *[F.try_to_timestamp(t, F.lit(f)) for f in formats]))


def split_tags(text: Column) -> Column:
    """A JSON or Python list, or else text split on commas, or on bars, or one tag; trimmed, blanks dropped."""
    t = F.trim(F.coalesce(text, F.lit("")))
    listed = F.when(t.startswith("[") & t.endswith("]"), F.coalesce(F.from_json(t, "array<string>"), F.from_json(F.regexp_replace(t, "'", '"'), "array<string>")))
    plain = F.when(t.contains(","), F.split(t, ",")).when(t.contains("|"), F.split(t, r"\|")).otherwise(F.array(t))
    return F.filter(F.transform(F.coalesce(listed, plain), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))


def clean_attributes(attributes: Column) -> Column:
    return F.map_filter(attributes, lambda k, v: v.isNotNull() & (v != ""))


def last_key_wins(df: DataFrame) -> DataFrame:
    """df, after its session is told that of equal map keys the last one counts, as in JSON parsers at large.

    Spark's own setting stops the whole job at one record with a repeated or case-clashing key.
    """
    df.sparkSession.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    return df


def json_map(text: Column) -> Column:
    """A JSON object's keys and values as text; null for other text. Of repeated keys the last one counts, where last_key_wins holds.

    from_json keeps repeated keys of a map side by side; putting the map together again drops the earlier ones.
    """
    return F.map_from_entries(F.map_entries(F.from_json(text, "map<string,string>")))


IPV4 = r"^((25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$"


@F.pandas_udf(T.StringType())
def _canonical_ip(values: pd.Series) -> pd.Series:
    def one(v):
        try:
            return str(ipaddress.ip_address(v))
        except ValueError:
            return ""

    known = {v: one(v) for v in values.dropna().unique()}
    return values.map(known).fillna("")


def normalize_ip(text: Column) -> Column:
    """Canonical text of an IPv4 or IPv6 address, or ''. IPv4 stays in the JVM."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return F.when(t.rlike(IPV4), t).when(t.contains(":"), _canonical_ip(t)).otherwise("")


def ipv4_number(text: Column) -> Column:
    """An IPv4 address as a number, else null."""
    p = F.split(text, r"\.")
    n = sum((F.get(p, i).cast("long") * (1 << (24 - 8 * i)) for i in range(1, 4)), F.get(p, 0).cast("long") * (1 << 24))
    return F.when(text.rlike(IPV4), n)


#: IPv4 addresses among the IPv6 ones.
MAPPED = "00000000000000000000ffff"


def ipv4_digits(number: Column) -> Column:
    """32 hex digits of an IPv4 address's number, in its mapped form."""
    return F.concat(F.lit(MAPPED), F.lower(F.lpad(F.hex(number.cast("long")), 8, "0")))
