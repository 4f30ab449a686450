"""CSV extracts of many sources: encoding and delimiter are probed, headers are mapped to canonical names."""

from __future__ import annotations

import codecs
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.errors import PythonException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.sources.register_files import Pieces, csv_records
from provena.sources.shared import new_path

PROBE = 4096
DELIMITERS = ",;\t"


def decode(data: bytes) -> str:
    """UTF-8 with or without a mark, else Windows-1252, else an error."""
    for encoding in ("utf-8-sig", "cp1252"):
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            continue
    raise ValueError("neither UTF-8 nor Windows-1252")


def delimiter_of(head: str) -> str:
    """The delimiter that splits the header line, outside of quotes, into most fields; a comma if none does."""
    line, quoted, counts = head[:PROBE].split("\n", 1)[0], False, dict.fromkeys(DELIMITERS, 0)
    for c in line:
        quoted ^= c == '"'
        if not quoted and c in counts:
            counts[c] += 1
    best = max(DELIMITERS, key=lambda d: counts[d])
    return best if counts[best] else ","


def renames(header: list[str], mapping: dict[str, str], canonical: list[str]) -> dict[str, str]:
    """Header -> canonical name, by the source's mapping (case-insensitive), else by name."""
    by_lower = {k.lower().strip(): v for k, v in mapping.items()}
    return {h: by_lower.get(h.lower().strip(), h.lower().strip()) for h in header if by_lower.get(h.lower().strip(), h.lower().strip()) in canonical}


def _encoding_of(fs: pafs.FileSystem, path: str) -> str:
    """As decode, reading the file once in parts."""
    decoder = codecs.getincrementaldecoder("utf-8")()
    with fs.open_input_stream(path) as f:
        try:
            while part := f.read(1 << 20):
                decoder.decode(part)
            decoder.decode(b"", final=True)
            return "utf-8-sig"
        except UnicodeDecodeError:
            return "cp1252"


def stage_extract(path: str, folder: str) -> str:
    """Copy one CSV into UTF-8 pieces of bounded size below folder, each with the header; its delimiter."""
    fs, at = pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    with fs.open_input_stream(at) as raw:
        text = io.TextIOWrapper(io.BufferedReader(raw, 1 << 20), _encoding_of(fs, at), newline="")
        records = csv_records(text)
        head = next(records, "")
        if not head.strip():
            raise ValueError("the file is empty or has no header")
        pieces = Pieces(folder, hashlib.sha1(path.encode()).hexdigest()[:12], head)
        for record in records:
            pieces.add(record)
        if not pieces.done:
            pieces.start()
        pieces.close()
    return delimiter_of(head)


def read_extract(spark: SparkSession, path: str | list[str], mapping: dict[str, str], canonical: list[str]) -> tuple[DataFrame, list[str]]:
    """(rows as text under canonical names, ignored headers) of an uploaded CSV, or of several with one header; a task streams each into pieces."""
    paths = [path] if isinstance(path, str) else path
    folder, report = new_path(spark, "extract"), new_path(spark, "staged")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for each in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_pydict({"sep": [stage_extract(each, folder)]})

    try:
        spark.createDataFrame([(p,) for p in paths], "path string").repartition(len(paths)).mapInArrow(run, "sep string").write.parquet(report)
    except PythonException as e:
        if "the file is empty or has no header" in str(e):
            raise ValueError("the file is empty or has no header") from e
        raise
    found = [r["sep"] for r in spark.read.parquet(report).distinct().collect()]
    if len(found) != 1:
        raise ValueError("the files differ in their delimiters")
    sep = found[0]
    rows = spark.read.option("sep", sep).option("header", True).option("multiLine", True).option("escape", '"').csv(folder)
    names = renames(rows.columns, mapping, canonical)
    kept = rows.select(*[F.nullif(F.trim(F.col(f"`{h}`")), F.lit("")).alias(n) for h, n in names.items()])
    return kept.withColumn("row_number", F.monotonically_increasing_id() + 1), [h for h in rows.columns if h not in names]
