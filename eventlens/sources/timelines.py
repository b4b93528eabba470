"""Generic timeline files: CSV, JSON lines, interchange Parquet."""

from __future__ import annotations

import csv
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalize import clean_attributes, json_map, last_key_wins, parse_time, split_tags
from ..functions.storage import carried_last, materialize, running_sums, small
from .text import read_with_offsets

#: Header names (lower case) and the event columns they fill; the later of two wins.
KNOWN = {"message": "message", "msg": "message", "timestamp": "timestamp", "datetime": "timestamp", "timestamp_desc": "timestamp_desc", "tag": "tags", "tags": "tags", "artifact": "artifact", "data_type": "artifact", "artifact_long": "artifact_long", "display_name": "display_name"}
DELIMITERS = ",;\t|"
#: Bytes after which an opening quote that nothing has closed is plain text.
LONGEST_FIELD = 1 << 20
INTERCHANGE = {
    "source_file": "string", "file_hash": "string", "byte_offset": "bigint", "content_hash": "string", "message": "string", "timestamp": "timestamp", "timestamp_desc": "string",
    "artifact": "string", "artifact_long": "string", "display_name": "string", "tags": "array<string>", "attributes": "map<string,string>",
}
PROVENANCE = ("source_file", "file_hash", "byte_offset", "content_hash")


def _columns(pairs: list[tuple[str, Column]]) -> dict[str, Column]:
    """Event columns and attributes from named text columns in file order."""
    found: dict[str, Column] = {}
    rest: list[tuple[str, Column]] = []
    for name, value in pairs:
        target = KNOWN.get(name.strip().lower())
        if target:
            found[target] = value
        else:
            rest.append((name.strip(), value))
    text = lambda c: F.coalesce(found[c], F.lit("")) if c in found else F.lit("")
    attributes = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in rest]), lambda p: p["value"].isNotNull() & (p["value"] != ""))) if rest else F.create_map().cast("map<string,string>")
    return {"timestamp": parse_time(text("timestamp")), "tags": split_tags(text("tags")), "attributes": attributes, **{c: text(c) for c in ("message", "timestamp_desc", "artifact", "artifact_long", "display_name")}}


def sniff(header: str) -> str:
    """The delimiter that a header line has most of."""
    return max(DELIMITERS, key=lambda d: (header.count(d), -DELIMITERS.index(d)))


def _headers(lines: DataFrame) -> DataFrame:
    """(source_file, sep, at, rest): of each file with a first line its delimiter, the place of each event column and the other names with their places."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for file, raw in zip(pdf["source_file"], pdf["raw"], strict=True):
                header = raw.lstrip("\ufeff")
                sep = sniff(header)
                names = [n.strip() for n in next(csv.reader([header], delimiter=sep), [])]
                at = {KNOWN[n.lower()]: i for i, n in enumerate(names) if n.lower() in KNOWN}
                out.append((file, sep, at, [(n, i) for i, n in enumerate(names) if n.lower() not in KNOWN], len(names)))
            if out:
                yield pd.DataFrame(out, columns=["source_file", "sep", "at", "rest", "width"])

    first = lines.where("byte_offset = 0").select("source_file", "raw")
    return first.mapInPandas(read, "source_file string, sep string, at map<string, int>, rest array<struct<name: string, at: int>>, width int")


#: A field in quotes, from its beginning or from inside it, with what stands between its closing quote and the next delimiter.
QUOTED, INSIDE = '(^|{0})"[^"]*(?:""[^"]*)*"(?!")[^{0}]*', '^[^"]*(?:""[^"]*)*"(?!")[^{0}]*'


def _ends_inside(text: Column, sep: str) -> Column:
    """Whether text that begins outside of quotes ends inside: without its whole quoted fields, a field begins with a quote. Other quotes are plain text."""
    return F.regexp_replace(text, QUOTED.format(sep), "$1").rlike(f'(^|{sep})"')


def _quotes(raw: Column, sep: Column, used: Sequence[str]) -> tuple[Column, Column]:
    """Whether a line ends inside quotes if it begins outside, and if it begins inside."""
    out, inside = F.lit(False), F.lit(True)
    for d in used:
        c = rf"\{d}" if d == "|" else d
        closes = raw.rlike(INSIDE.format(c))
        rest = F.concat(F.lit("x"), F.regexp_replace(raw, INSIDE.format(c), ""))
        out = F.when(sep == d, _ends_inside(raw, c)).otherwise(out)
        inside = F.when(sep == d, ~closes | _ends_inside(rest, c)).otherwise(inside)
    some = raw.contains('"')
    return F.when(some, out).otherwise(False), F.when(some, inside).otherwise(True)


def _records(lines: DataFrame, used: Sequence[str], longest: int) -> DataFrame:
    """CSV records (source_file, sep, byte_offset, line_number, raw) from lines: one goes on while a quoted field is open.

    A line turns the state (outside or inside of quotes) into another: it keeps it, turns it round or sets it. So the state
    before a line follows from the last line that sets it and the number of turns since, both carried over blocks of
    offsets; a file is no one task's. An opening quote that no line closes within `longest` bytes is plain text.
    """
    from_out, from_in = _quotes(F.col("raw"), F.col("sep"), used)
    file, at = ["source_file"], ["byte_offset"]
    # Each step reads the marks before it twice, so they are written after each, without the lines' text.
    marks = lines.select(*file, *at, F.floor(F.col("byte_offset") / (8 << 20)).alias("_block"), from_out.alias("_open"), from_in.alias("_stay"))
    marks = materialize(marks, "csv-marks")
    # Looking back from the file's end: the next line at which an open quote would be closed.
    marks = carried_last(marks, file, "_block", at, {"_closed": F.when(~F.col("_stay"), F.col("byte_offset"))}, before=True, backwards=True)
    marks = marks.withColumn("_open", F.col("_open") & F.coalesce(F.col("_closed") - F.col("byte_offset") <= longest, F.lit(False)))
    marks = materialize(marks.drop("_closed"), "csv-quotes")
    turn = F.col("_open") & ~F.col("_stay")
    fixed = F.when(F.col("_open") == F.col("_stay"), F.col("_open").cast("int"))
    marks = materialize(running_sums(marks, file, "_block", at, {"_turns": turn.cast("long")}), "csv-turns")
    marks = carried_last(marks, file, "_block", at, {"_set": F.when(fixed.isNotNull(), F.struct(fixed.alias("to"), F.col("_turns").alias("turns")))}, before=True)
    state = F.coalesce((F.col("_set.to") + F.col("_turns") - F.col("_set.turns")) % 2, F.col("_turns") % 2)
    begins = state == 0
    ends = ~F.when(begins, F.col("_open")).otherwise(F.col("_stay"))
    # Lines that are no whole record, and where each one's record begins.
    parts = materialize(marks.select(*file, *at, "_block", begins.alias("_begins"), ends.alias("_ends")).where("NOT (_begins AND _ends)"), "csv-open")
    keep = ["source_file", "sep", "byte_offset", "line_number", "raw"]
    if parts.isEmpty():
        return lines.select(*keep)
    parts = carried_last(parts, file, "_block", at, {"_record": F.when(F.col("_begins"), F.col("byte_offset"))})
    lines = lines.join(small(materialize(parts.select(*file, *at, "_record"), "csv-parts")), [*file, *at], "left")
    whole = lines.where("_record IS NOT NULL").groupBy("source_file", "sep", "_record").agg(F.array_sort(F.collect_list(F.struct("byte_offset", "line_number", "raw"))).alias("p"))
    joined = F.array_join(F.transform("p", lambda x: x["raw"]), "\n")
    whole = whole.select("source_file", "sep", F.col("p")[0]["byte_offset"].alias("byte_offset"), F.col("p")[0]["line_number"].alias("line_number"), joined.alias("raw"))
    return materialize(lines.where("_record IS NULL").select(*keep).unionByName(whole.select(*keep)), "csv-records")


def read_csv(spark: SparkSession, path: str, longest: int = LONGEST_FIELD) -> DataFrame:
    """Timeline CSVs: a file, or a folder of files, each with a header of its own; doubled quotes, quoted line breaks kept.

    Each row has its record's source_file, byte_offset, line_number and raw text. A file's first line says its delimiter and
    the order of its columns. Blank records are dropped; of repeated column names the last one counts. A quote inside
    an unquoted field is plain text, and so is an opening quote that nothing closes within `longest` bytes: it costs its own line, not the
    rest of the file.
    """
    lines = materialize(read_with_offsets(spark, path), "csv-lines")  # the text is cut into lines once
    headers = materialize(_headers(lines), "csv-headers")
    width, used = headers.agg(F.max("width"), F.array_sort(F.collect_set("sep"))).first()  # one number, and four delimiters at most
    if width is None:
        return last_key_wins(lines).withColumns(_columns([]))
    records = _records(lines.join(small(headers.select("source_file", "sep")), "source_file"), used, longest)
    records = last_key_wins(records).where((F.col("byte_offset") > 0) & (F.trim("raw") != "")).drop("sep").join(small(headers.drop("width")), "source_file")
    schema = ", ".join(f"c{i} string" for i in range(width))
    rows, cells = records, F.array().cast("array<string>")
    for i, d in enumerate(used):  # a record is cut by its own file's delimiter
        cut = F.from_csv("raw", F.lit(schema), {"sep": d, "quote": '"', "escape": '"', "mode": "PERMISSIVE"})
        rows = rows.withColumn(f"_s{i}", F.when(F.col("sep") == d, cut))
        cells = F.when(F.col("sep") == d, F.array(*[F.col(f"_s{i}.c{j}") for j in range(width)])).otherwise(cells)
    rows = rows.withColumn("_c", cells)
    text = lambda c: F.coalesce(F.get("_c", F.try_element_at("at", F.lit(c))), F.lit(""))
    pairs = F.transform("rest", lambda r: F.struct(r["name"].alias("key"), F.get("_c", r["at"]).alias("value")))
    pairs = F.filter(pairs, lambda p: p["value"].isNotNull() & (p["value"] != ""))
    made = {"timestamp": parse_time(text("timestamp")), "tags": split_tags(text("tags")), "attributes": F.map_from_entries(pairs), **{c: text(c) for c in ("message", "timestamp_desc", "artifact", "artifact_long", "display_name")}}
    return rows.withColumns(made).drop("_c", "sep", "at", "rest", *[f"_s{i}" for i in range(len(used))])


def from_json_lines(lines: DataFrame) -> DataFrame:
    """Lines (raw) that are JSON objects; nested values stay JSON text; others are dropped. Of equal keys the last one counts."""
    rows = last_key_wins(lines).withColumn("m", json_map(F.col("raw"))).where("m IS NOT NULL AND ltrim(raw) LIKE '{%'")
    lower = F.map_from_entries(F.transform(F.map_entries("m"), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))
    rows = rows.withColumn("l", lower)
    get = lambda *names: F.coalesce(*[F.nullif(F.col("l")[n], F.lit("")) for n in names], F.lit(""))
    return rows.select(
        *[c for c in lines.columns],
        parse_time(get("datetime", "timestamp")).alias("timestamp"), split_tags(get("tags", "tag")).alias("tags"), get("message", "msg").alias("message"), get("timestamp_desc").alias("timestamp_desc"),
        get("artifact", "data_type").alias("artifact"), get("artifact_long").alias("artifact_long"), get("display_name").alias("display_name"),
        clean_attributes(F.map_filter("m", lambda k, v: ~F.lower(k).isin(*KNOWN))).alias("attributes"),
    )


def require(rows: DataFrame, columns: tuple[str, ...] = ("message", "timestamp_desc", "timestamp")) -> DataFrame:
    """Rows of an arbitrary timeline that have all mandatory values."""
    out = rows
    for c in columns:
        out = out.where(F.col(c).isNotNull() & (F.col(c).cast("string") != ""))
    return out


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Interchange Parquet: all columns with their types, no null provenance; a null time is undated."""
    rows = spark.read.parquet(path)
    have = dict(rows.dtypes)
    wrong = {c: have.get(c) for c, t in INTERCHANGE.items() if have.get(c) not in (t, {"timestamp": "timestamp_ntz", "bigint": "decimal(20,0)"}.get(t))}
    if wrong:
        raise ValueError(f"not interchange Parquet: {wrong}")
    bad = rows.where(" OR ".join(f"{c} IS NULL" for c in PROVENANCE))
    if not bad.isEmpty():
        raise ValueError("provenance is null")
    return rows.select(*[F.col(c).cast(t).alias(c) for c, t in INTERCHANGE.items()])
