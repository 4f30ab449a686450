"""Official register files: ZIPs with one CSV or one JSON array, a manifest, and their checks.

A ZIP member cannot be split, so one task per archive streams it into pieces in the shared folder (CSV pieces
with the header in each, or JSON Lines); Spark then reads the pieces in parallel. No archive is held in
memory whole.
"""

from __future__ import annotations

import csv
import hashlib
import io
import json
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provena.sources.shared import new_path

PIECE = 64 << 20
REQUIRED = ["basic", "reports", "activity"]
#: File names of the official open data.
LINK_PATTERNS = {
    "basic": r"ettevotja_rekvisiidid__lihtandmed\.csv\.zip$",
    "general": r"ettevotja_rekvisiidid__yldandmed\.json\.zip$",
    "shareholders": r"ettevotja_rekvisiidid__osanikud\.json\.zip$",
    "reports": r"1\.aruannete_yldandmed_kuni_[0-9]{8}\.zip$",
    "activity": r"2\.EMTAK_myygitulu_kuni_[0-9]{8}\.zip$",
    "indicators": r"4\.[0-9]{4}_aruannete_elemendid_kuni_[0-9]{8}\.zip$",
}
STAGED = "path string, piece string, n_rows long"


def _uri(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


class Pieces:
    """Writes text into numbered pieces of bounded size; a repeated task replaces its own pieces."""

    def __init__(self, folder: str, name: str, head: str = ""):
        self.fs, self.root = _uri(folder)
        self.fs.create_dir(self.root, recursive=True)
        self.name, self.head, self.out, self.done = name, head, None, []
        self.rows = self.size = 0

    def start(self) -> None:
        path = f"{self.root}/{self.name}-{len(self.done):05d}"
        self.out, self.rows, self.size = self.fs.open_output_stream(path), 0, 0
        self.out.write(self.head.encode())
        self.done.append([path, 0])

    def add(self, text: str) -> None:
        if self.out is None:
            self.start()
        data = text.encode()
        self.out.write(data)
        self.rows += 1
        self.size += len(data)
        self.done[-1][1] = self.rows
        if self.size >= PIECE:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


#: Characters that one record or element may have; a longer one is a damaged file, such as one with a stray quote.
LONGEST = 1 << 26
MARKS = re.compile(r'\\.|["\[\]{},]', re.S)


def csv_records(lines: Iterator[str], longest: int = LONGEST) -> Iterator[str]:
    """Records of a CSV file; a record may hold line breaks within quotes. Only whether quotes are open is carried from line to line."""
    held, size, is_open = [], 0, False
    for line in lines:
        held.append(line)
        size += len(line)
        is_open ^= line.count('"') % 2 == 1
        if not is_open:
            record = "".join(held)
            yield record if record.endswith("\n") else record + "\n"
            held, size = [], 0
        elif size > longest:
            raise ValueError(f"a CSV record of over {longest} characters: quotes are not closed")
    if held:
        raise ValueError("the CSV ends within quotes")


def json_elements(text: io.TextIOBase, size: int = 1 << 20, longest: int = LONGEST) -> Iterator[object]:
    """Elements of a top-level JSON array, one at a time; an error if it is none, ends early or has an element that is none.

    Every character is looked at once, for where an element ends; the element is decoded then.
    """
    held, length, depth, quoted = [], 0, 0, False
    while part := text.read(size):
        while part.endswith("\\") and (more := text.read(1)):  # an escape is not cut in two
            part += more
        begin = 0
        for mark in MARKS.finditer(part):
            c = mark.group()
            if quoted or c == '"':
                quoted ^= c == '"'
            elif c in "[{":
                if depth == 0:
                    if c == "{" or "".join([*held, part[begin : mark.start()]]).strip():
                        raise ValueError("not a JSON array")
                    held, length, begin = [], 0, mark.end()
                depth += 1
            elif depth == 0:
                raise ValueError("not a JSON array")
            else:
                depth -= c in "]}"
                if depth == 0 and c == "}":
                    raise ValueError("not a JSON array")
                if depth == 0 or c == "," and depth == 1:
                    element = "".join([*held, part[begin : mark.start()]])
                    held, length, begin = [], 0, mark.end()
                    if element.strip():
                        yield json.loads(element)
                    if depth == 0:
                        return
        held.append(part[begin:])
        length += len(held[-1])
        if length > longest:
            raise ValueError(f"a JSON element of over {longest} characters")
    raise ValueError("the JSON array is empty or ends early")


def stage_zip(path: str, folder: str, kind: str) -> list[list]:
    """Stream the one CSV or JSON member of a ZIP into pieces below folder; [piece, rows] of each."""
    fs, at = _uri(path)
    name = hashlib.sha1(path.encode()).hexdigest()[:12]
    with fs.open_input_file(at) as raw, zipfile.ZipFile(raw) as z:
        members = [m for m in z.namelist() if m.lower().endswith(f".{kind}")]
        if len(members) != 1:
            raise ValueError(f"{path} holds {len(members)} {kind} files, not one")
        with z.open(members[0]) as f:
            text = io.TextIOWrapper(f, "utf-8-sig", newline="")
            if kind == "csv":
                records = csv_records(text)
                head = next(records, None)
                if head is None:
                    raise ValueError(f"{path} has no header")
                pieces = Pieces(folder, name, head)
                for record in records:
                    pieces.add(record)
                if not pieces.done:
                    pieces.start()
            else:
                pieces = Pieces(folder, name)
                for element in json_elements(text):
                    pieces.add(json.dumps(element, ensure_ascii=False) + "\n")
            pieces.close()
    return pieces.done


def stage(spark: SparkSession, paths: list[str], kind: str, folder: str | None = None) -> tuple[str, DataFrame]:
    """(folder, pieces written): one task an archive."""
    folder = folder or new_path(spark, f"staged-{kind}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                done = stage_zip(path, folder, kind)
                yield pa.RecordBatch.from_pydict({"path": [path] * len(done), "piece": [d[0] for d in done], "n_rows": [d[1] for d in done]})

    one_each = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    report = new_path(spark, "staged")
    one_each.mapInArrow(run, STAGED).write.parquet(report)
    return folder, spark.read.parquet(report)


def read_csv_zip(spark: SparkSession, paths: list[str], columns: list[str], sep: str = ";") -> DataFrame:
    """All rows as text, with the wanted columns by name; missing ones are null."""
    folder, _ = stage(spark, paths, "csv")
    # Pieces are of bounded size and end between records, so reading each whole keeps line breaks within quotes.
    rows = spark.read.option("sep", sep).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(folder)
    return rows.select(*[F.col(f"`{c}`") if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns])


def read_json_zip(spark: SparkSession, paths: list[str], schema: T.StructType | str) -> DataFrame:
    """Elements of the archives' JSON arrays, as far as the schema names them."""
    folder, _ = stage(spark, paths, "json")
    return spark.read.schema(schema).json(folder)


def export_zips(rows: DataFrame, folder: str, kind: str, sep: str = ";") -> list[str]:
    """Write rows as register files, one ZIP a partition with one CSV or JSON array; the paths. Columns are written as text."""
    names = rows.columns

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _uri(folder)
        fs.create_dir(root, recursive=True)
        path = f"{root}/part-{TaskContext.get().partitionId():05d}.zip"
        n = 0
        with fs.open_output_stream(path) as raw, zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z, z.open(f"data.{kind}", "w", force_zip64=True) as f:
            text = io.TextIOWrapper(f, "utf-8", newline="", write_through=True)
            out = csv.writer(text, delimiter=sep, lineterminator="\n")
            if kind == "csv":
                out.writerow(names)
            else:
                text.write("[")
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if kind == "csv":
                        out.writerow(row)
                    else:
                        text.write((", " if n else "") + json.dumps(dict(zip(names, row, strict=True)), ensure_ascii=False))
                    n += 1
            if kind != "csv":
                text.write("]")
            text.flush()
            text.detach()
        yield pa.RecordBatch.from_pydict({"path": [path], "n": [n]})

    written = new_path(rows.sparkSession, "exported")
    whole = rows if kind != "csv" else rows.select([F.col(c).cast("string") for c in names])
    whole.mapInArrow(write, "path string, n long").write.parquet(written)
    # An empty JSON array is an error to readers of register files: archives without rows are left out.
    return [r["path"] for r in rows.sparkSession.read.parquet(written).where("n > 0").orderBy("path").collect()]


def wanted_files(links: DataFrame, years: list[int], always: tuple[int, ...] = (2024, 2025)) -> DataFrame:
    """Of links(url, kind, year) those an import of `years` takes: every kind, and indicators of these years and those in `always`.

    Of several files of a kind and year the last by url (the names end in the date of issue).
    """
    wanted = sorted({*years, *always})
    known = links.where((F.col("kind") != "indicators") | F.col("year").isin(wanted))
    return known.groupBy("kind", "year").agg(F.max("url").alias("url"))


def checksums(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, n_bytes, sha256), streamed file by file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, at = _uri(path)
                digest, n = hashlib.sha256(), 0
                with fs.open_input_stream(at) as f:
                    while part := f.read(1 << 20):
                        digest.update(part)
                        n += len(part)
                yield pa.RecordBatch.from_pydict({"path": [path], "n_bytes": [n], "sha256": [digest.hexdigest()]})

    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths))).mapInArrow(run, "path string, n_bytes long, sha256 string")


def verified(manifest: DataFrame, found: DataFrame, url_prefix: str) -> DataFrame:
    """manifest(path, url, n_bytes, sha256) with `problems`: size, hash or origin that do not match."""
    f = found.select("path", F.col("n_bytes").alias("_n"), F.col("sha256").alias("_h"))
    problems = F.array_compact(
        F.array(
            F.when(F.col("_n").isNull(), F.lit("file missing")), F.when(F.col("_n") != F.col("n_bytes"), F.lit("size differs")), F.when(F.col("_h") != F.col("sha256"), F.lit("hash differs")),
            F.when(~F.coalesce(F.col("url").startswith(url_prefix), F.lit(False)), F.lit("not an official address")),
        )
    )
    return manifest.join(f, "path", "left").withColumn("problems", problems).drop("_n", "_h")


def missing_datasets(kinds: list[tuple[str, int | None]], years: list[int]) -> list[str]:
    """What an import lacks: each required kind, and indicators of every year."""
    have = set(kinds)
    return [k for k in REQUIRED if not any(x == k for x, _ in have)] + [f"indicators {y}" for y in sorted(years) if ("indicators", y) not in have]


def discover_links(pages: DataFrame, html: str = "html") -> DataFrame:
    """(url, kind, year) of dataset links on download pages."""
    url = F.explode(F.regexp_extract_all(F.col(html), F.lit(r'href="([^"]+\.zip)"'), F.lit(1)))
    links = pages.select(url.alias("url"))
    kind = F.when(F.lit(False), "")
    for name, pattern in LINK_PATTERNS.items():
        kind = kind.when(F.col("url").rlike(pattern), name)
    year = F.nullif(F.regexp_extract("url", r"/4\.([0-9]{4})_", 1), F.lit("")).cast("int")
    return links.select("url", kind.alias("kind"), year.alias("year")).where("kind is not null").distinct()


def indicator_years(wanted: list | None, offered: list[int]) -> list[int]:
    """The years asked for, in order and once each; all that are offered if none is asked for, an error for others."""
    years = sorted({int(y) for y in wanted or offered})
    unknown = [y for y in years if y not in offered]
    if unknown:
        raise ValueError(f"no indicators of {', '.join(map(str, unknown))}; offered are {min(offered)} to {max(offered)}")
    return years
