"""File sources and sinks: CSV landing files, delimiter and header detection,
dataset-kind detection, per-dataset quality counts, web-export scan
(O-1.1, O-1.2, O-1.5, O-1.7 .. O-1.12, O-2.12).

Files are read as text with ``_metadata.file_path``; a file's first record is
found without reading it whole: rows of the split that starts at byte 0,
first by a partition-local monotonically increasing id.
"""

from __future__ import annotations

import hashlib
import os
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..functions import rules
from ..session import shared_path
from .csv_scan import csv_records

BOM = "﻿"
QUOTED = r'"(?:[^"]|"")*"'


def _accent_table() -> tuple[str, str]:
    """Latin letters whose NFKD form is one ASCII letter plus marks (a rule,
    generated here rather than listed)."""
    src, dst = [], []
    for cp in range(0x00C0, 0x0250):
        ch = chr(cp)
        base = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))
        if len(base) == 1 and base.isascii() and base != ch:
            src.append(ch)
            dst.append(base)
    return "".join(src), "".join(dst)


_ACC_SRC, _ACC_DST = _accent_table()


def canonical_header(h: Column) -> Column:
    """O-1.10: trim, lower, strip accents, ``_``/``-`` -> space, collapse
    spaces, alias table, else non-alphanumerics -> ``_`` trimmed."""
    x = F.lower(F.trim(h))
    x = F.translate(x, _ACC_SRC, _ACC_DST)
    x = F.regexp_replace(x, r"[\p{M}]", "")
    x = F.regexp_replace(x, "[_-]+", " ")
    x = F.regexp_replace(x, r"\s+", " ")
    alias = F.try_element_at(C.literal_map(rules.DETECTION_HEADER_ALIASES), x)
    fallback = F.regexp_replace(F.regexp_replace(x, "[^a-z0-9]+", "_"), "^_|_$", "")
    return F.coalesce(alias, fallback)


def detect_dataset(keys: Column) -> Column:
    """O-1.9: ordered rules over the canonical header array."""
    out = None
    for dataset, alternatives in rules.DATASET_HEADER_RULES:
        cond = None
        for req in alternatives:
            c = None
            for col in req:
                t = F.array_contains(keys, col)
                c = t if c is None else (c & t)
            cond = c if cond is None else (cond | c)
        out = F.when(cond, F.lit(dataset)) if out is None else out.when(cond, F.lit(dataset))
    return out.otherwise(F.lit(rules.NEEDS_IDENTIFICATION))


def count_unquoted(line: Column, ch: str) -> Column:
    stripped = F.regexp_replace(line, QUOTED, "")
    return F.length(stripped) - F.length(F.replace(stripped, F.lit(ch), F.lit("")))


def detect_delimiter(first: Column) -> Column:
    """O-1.7: ';' when it occurs unquoted more often than ',' in the first record."""
    return F.when(count_unquoted(first, ";") > count_unquoted(first, ","), F.lit(";")).otherwise(F.lit(","))


def text_lines(spark: SparkSession, folders) -> DataFrame:
    """Physical lines with file path, split start and a partition-local order
    id; the BOM of a file's first line removed (O-1.8).  ``folders``: one path
    or a list of paths."""
    paths = [folders] if isinstance(folders, str) else list(folders)
    t = spark.read.option("recursiveFileLookup", True).text(paths)
    start = F.col("_metadata.file_block_start")
    # Only a file's first line can begin with one; elsewhere it is content.
    bom = (start == 0) & F.col("value").startswith(BOM)
    first = F.col("pos") == F.min("pos").over(Window.partitionBy("file_path", "pos_block"))
    t = t.select("value", F.col("_metadata.file_path").alias("file_path"), start.alias("block_start"), bom.alias("bom"),
                 F.monotonically_increasing_id().alias("pos"))
    # Lines that begin with the mark are rare: only they are looked at together.
    marked = t.filter("bom").withColumn("pos_block", F.lit(0)).filter("block_start = 0").withColumn("first", first)
    line = F.when(F.col("bom") & F.col("first"), F.substring("value", 2, 1 << 30)).otherwise(F.col("value"))
    rest = t.filter("not bom").withColumn("first", F.lit(False))
    return marked.drop("pos_block").unionByName(rest).select(line.alias("line"), "file_path", "block_start", "pos")


def first_records(lines: DataFrame) -> DataFrame:
    """First non-blank record of each file."""
    return (lines.filter((F.col("block_start") == 0) & (F.trim("line") != ""))
            .groupBy("file_path").agg(F.min_by(F.struct("line", "pos"), F.col("pos")).alias("f"))
            .select("file_path", F.col("f.line").alias("first_line"), F.col("f.pos").alias("first_pos")))


def file_headers(lines: DataFrame) -> DataFrame:
    """Per file: delimiter, raw and canonical headers, dataset kind.  A
    delimiter inside quotes does not split."""
    fr = first_records(lines).withColumn("delimiter", detect_delimiter(F.col("first_line")))
    outside = r'(?=(?:[^"]*"[^"]*")*[^"]*$)'
    raw = F.transform(F.split(F.col("first_line"), F.concat(F.lit("["), F.col("delimiter"), F.lit("]" + outside))),
                      lambda h: F.trim(F.replace(F.regexp_replace(F.trim(h), '^"|"$', ""), F.lit('""'), F.lit('"'))))
    fr = fr.withColumn("headers", raw)
    fr = fr.withColumn("canonical", F.transform("headers", canonical_header))
    return fr.withColumn("dataset", detect_dataset(F.col("canonical")))


def dataset_quality(lines: DataFrame) -> DataFrame:
    """O-2.12 + O-2.3 per dataset folder: records (header and blank ones
    excluded), header width, duplicates and blank cells of the parsed fields,
    malformed records, and files with a quote that never closes.

    Records come from the CSV reader (quoted line breaks are content), one
    folder after the other with its own delimiter and width; the headers that
    reach the driver are one row for each folder."""
    spark = lines.sparkSession
    hdr = file_headers(lines).withColumn("path", F.regexp_extract("file_path", r"^(.*)/[^/]+$", 1))
    heads = (hdr.groupBy("path").agg(F.min_by(F.struct("delimiter", "headers", "dataset"), F.col("file_path")).alias("h"))
             .select("path", "h.delimiter", F.size("h.headers").alias("width"), "h.dataset").collect())
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    odd = (lines.groupBy("file_path").agg((F.sum(quotes) % 2).alias("odd")).filter("odd = 1")
           .groupBy(F.regexp_extract("file_path", r"^(.*)/[^/]+$", 1).alias("path")).agg(F.count("*").alias("unclosed_quotes")))
    out = None
    for h in heads:
        names = [f"c{i}" for i in range(h.width)]
        cells = [F.trim(F.coalesce(F.col(c), F.lit(""))) for c in names]
        blank = sum((F.when(c == "", 1).otherwise(0) for c in cells), F.lit(0))
        bad = F.col("_corrupt_record").isNotNull()
        rec = read_raw_csv(spark, h.path, names, sep=h.delimiter, null_tokens=("",))
        # Counted per distinct record, by a digest of it; a blank one has weight 0
        # (no filter on so many derived columns: the optimizer would infer from each of them).
        key = C.row_key(rec.select(*names))
        per = (rec.groupBy(*key, bad.alias("_bad"), blank.alias("_blank")).agg(F.count("*").alias("_n"))
               .select("_n", "_bad", "_blank")
               .withColumn("_w", F.when((F.col("_blank") < h.width) | F.col("_bad"), F.col("_n")).otherwise(F.lit(0))))
        more = F.when(F.col("_w") > 0, F.col("_w") - 1).otherwise(0)
        row = per.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(n) for x, n in (
            (F.col("_w"), "rows"), (more, "duplicate_rows"), (F.col("_blank") * F.col("_w"), "missing_values"),
            (F.when(F.col("_bad"), F.col("_w")).otherwise(0), "malformed_rows"))])
        row = row.select(F.lit(h.path).alias("path"), F.regexp_extract(F.lit(h.path), r"([^/]+)$", 1).alias("folder"), "rows",
                         F.lit(h.width).alias("column_count"), "duplicate_rows", "missing_values", "malformed_rows",
                         F.lit(h.delimiter).alias("delimiter"), F.lit(h.dataset).alias("dataset"))
        out = row if out is None else out.unionByName(row)
    if out is None:
        out = spark.createDataFrame([], "path string, folder string, rows long, column_count int, duplicate_rows long, "
                                        "missing_values long, malformed_rows long, delimiter string, dataset string")
    return (out.join(odd, "path", "left").withColumn("unclosed_quotes", F.coalesce("unclosed_quotes", F.lit(0))).drop("path"))


def validate_batch(headers: DataFrame, quality: DataFrame) -> DataFrame:
    """O-1.11: >= 1 file, all identified, <= 1 per dataset kind, none malformed
    or with an unclosed quote.  ``headers``: one row per uploaded file (a landing
    folder, whose part files are one upload)."""
    h = headers.agg(F.count("*").alias("files"),
                    F.count_if(F.col("dataset") == rules.NEEDS_IDENTIFICATION).alias("unidentified"),
                    (F.count("*") - F.countDistinct("dataset")).alias("repeated_kinds"))
    j = h.select("*", quality.agg(F.coalesce(F.sum(F.col("malformed_rows") + F.col("unclosed_quotes")), F.lit(0))).scalar().alias("malformed"))
    err = (F.when(F.col("files") == 0, "no_file").when(F.col("unidentified") > 0, "unidentified_file")
           .when(F.col("repeated_kinds") > 0, "duplicate_dataset").when(F.col("malformed") > 0, "malformed_file"))
    return j.select((err.isNull()).alias("valid"), err.alias("error"), "files")


# FIXED VALUES: the text tokens pandas' CSV reader treats as missing by default.
PANDAS_NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
                    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def read_raw_csv(spark: SparkSession, path: str, columns: list[str], sep: str = ",",
                 null_tokens=PANDAS_NA_TOKENS) -> DataFrame:
    """O-1.1: all-string CSV scan with header, quotes, permissive mode and a
    corrupt-record column; pandas-like null tokens become null.  A large file is
    many tasks, whatever line breaks its cells hold (:mod:`.csv_scan`)."""
    schema = ", ".join("`" + c.replace("`", "``") + "` string" for c in [*columns, "_corrupt_record"])
    options = {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "multiLine": "true",
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "columnNameOfCorruptRecord": "_corrupt_record"}
    df = csv_records(spark, path).select(F.from_csv("record", schema, options).alias("r")).select("r.*")
    # pandas compares the whole cell (no trimming) with the token list
    return df.withColumns({c: F.when(F.col(f"`{c}`").isin(*null_tokens), F.lit(None))
                           .otherwise(F.col(f"`{c}`")) for c in columns})


#: Records of one compressed landing file: it is read back by one task.
FILE_RECORDS = 500_000


def write_csv(df: DataFrame, path: str, sep: str = ",", compression: str = "none") -> None:
    """O-1.5 CSV sink (header, overwrite).  A compressed file cannot be read in
    splits, so it holds at most ``FILE_RECORDS`` records."""
    out = df.write.mode("overwrite")
    if compression != "none":
        out = out.option("compression", compression).option("maxRecordsPerFile", FILE_RECORDS)
    (out.option("header", True).option("sep", sep).option("nullValue", "")
     .option("emptyValue", '""').option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))


def read_web_export(spark: SparkSession, path: str, columns: list[str],
                    preamble: int = rules.WEB_EXPORT_PREAMBLE_LINES) -> DataFrame:
    """O-1.2: skip the preamble lines and the header, parse the rest with
    ``from_csv``.  Exports are small reports, one task per file."""
    schema = ", ".join(f"`{c}` STRING" for c in columns)
    t = spark.read.text(path, wholetext=True)
    lines = F.split(F.regexp_replace("value", "^" + BOM, ""), r"\r?\n")
    body = F.slice(lines, preamble + 2, 1 << 30)
    rows = t.select(F.explode(body).alias("l")).filter(F.trim("l") != "")
    return rows.select(F.from_csv("l", schema).alias("r")).select("r.*")


def write_web_export(df: DataFrame, path: str, title: str, preamble: int = rules.WEB_EXPORT_PREAMBLE_LINES) -> None:
    """Write an aggregated report as one export file with a preamble (the
    report is small by construction: one row per channel / country / page)."""
    pre = [f"# {title}"] + [f"# line {i}" for i in range(2, preamble + 1)]
    header = ",".join(df.columns)
    spark = df.sparkSession
    csv_line = F.to_csv(F.struct(*[F.col(f"`{c}`").cast("string") for c in df.columns]))
    body = df.select(csv_line.alias("value"), F.lit(2).alias("_o"))
    head = spark.createDataFrame([(x, i) for i, x in enumerate(pre + [header])], "value string, _o0 int") \
        .select("value", F.lit(0).alias("_o"), F.col("_o0").alias("_k"))
    allrows = head.unionByName(body.withColumn("_k", F.lit(0)))
    allrows.coalesce(1).sortWithinPartitions("_o", "_k").select("value").write.mode("overwrite").text(path)


_landing: set[tuple[str, str, str]] = set()
_lock = __import__("threading").Lock()


def landing_folder(spark: SparkSession, sf_dir: str) -> str:
    """Shared folder for derived landing files: under the cluster's
    checkpoint directory (never a machine-local temp folder)."""
    tag = hashlib.sha1(os.path.abspath(sf_dir).encode()).hexdigest()[:12]
    return shared_path(spark, "landing", tag)


def ensure_landing(spark: SparkSession, sf_dir: str, frames: dict) -> str:
    """Write each raw export once per session, gzipped (dataset -> (function that
    gives the frame, sep)); an export that no query asked for is neither derived
    nor written."""
    folder = landing_folder(spark, sf_dir)
    with _lock:
        for name, (frame, sep) in frames.items():
            key = (spark.sparkContext.applicationId, sf_dir, name)
            if key not in _landing:
                write_csv(frame(), os.path.join(folder, name), sep, "gzip")
                _landing.add(key)
    return folder
