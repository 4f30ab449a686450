"""Token counts as delta-maintained rollups.

State lives in one folder all executors share. `deltas` holds the signed rows of every batch per document, in directories by
batch and by a hash of the document, and `rollup` their sums by source, language and tokenizer version. Totals are the
sum of all committed rollups, so they are additive and never recounted.

A batch is committed by a row in `commits` under the next number, written after its data. A batch that is already committed is
not applied again; what a batch wrote that was cut off before its commit is never read. A writer whose number was taken
meanwhile by another one starts over, since the other may have booked the same documents. (Two writers that commit within the
same moment need a store that refuses to create what exists.)

A batch holds inserts (+n), deletes (-n of what the ledger has for the document) and revisions (-old, +new). What the
ledger has is the sum of the committed signed rows of the document; only the directories of documents in the batch are read. An
insert of a document that the ledger has under that tokenizer is left out: changes are revisions.

Counting: byte-level BPE never merges over the borders of the tokenizer's pre-token pattern, so a text has
as many tokens as its pre-tokens have together; counts of pre-tokens are kept in a cache of bounded size. All vocabularies
are counted in one pass; the files (about a megabyte each) go to the tasks with the function.

Defined results: a null or empty text has no tokens but counts as a document; null ids, sources and languages are values like others;
rows of a batch that repeat an id count each and are deleted or revised together; a delete or revision of what the ledger does
not have takes nothing back; an empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

import base64
import hashlib
import importlib.util
import uuid
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provena.llm.common import WORD, materialise, new_path

VOCABULARIES = ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken")
CACHE = 1 << 18
BUCKETS = 32
DIMENSIONS = ["source", "lang", "tokenizer"]
COMMITS = "number long, batch string, part string"
#: Counts of several vocabularies are added as one number, so many bits apart.
APART = 40


def vocabulary_dir() -> str:
    """Where the public vocabulary files are, as installed."""
    spec = importlib.util.find_spec("public_tokenizers")
    return str(Path(spec.origin).parent) if spec and spec.origin else "/opt/tokenizers"


def pretoken_pattern() -> str:
    """Contractions, letters, digits and other marks with a space before each, and white space (fixed value)."""
    return r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoder(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in vocabulary.splitlines() if line.strip())}
    return tiktoken.Encoding(hashlib.sha256(vocabulary).hexdigest(), pat_str=pretoken_pattern(), mergeable_ranks=ranks, special_tokens={})


def version_of(path: str) -> str:
    """Name and content hash of a vocabulary file: another file is another version."""
    return f"{Path(path).stem}@{hashlib.sha256(Path(path).read_bytes()).hexdigest()[:12]}"


@lru_cache(maxsize=4)
def _counter(vocabularies: tuple[bytes, ...]):
    import regex

    bpes, pieces, known = [encoder(v) for v in vocabularies], regex.compile(pretoken_pattern()), {}

    def learn(piece: str) -> int:
        n = sum(len(bpe.encode_ordinary(piece)) << APART * k for k, bpe in enumerate(bpes))
        if len(known) >= CACHE:
            known.clear()
        if len(piece) <= 64:
            known[piece] = n
        return n

    def count(text: str) -> list[int]:
        total = 0
        for piece in pieces.findall(text):
            n = known.get(piece)
            total += learn(piece) if n is None else n
        return [total >> APART * k & (1 << APART) - 1 for k in range(len(bpes))]

    return count


def token_counts(text: Column, paths: list[str]) -> Column:
    """An array with the number of tokens of the text under each vocabulary file."""
    vocabularies = tuple(Path(p).read_bytes() for p in paths)

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def run(texts: pa.Array) -> pa.Array:
        count = _counter(vocabularies)
        return pa.array([count(t) if t else [0] * len(vocabularies) for t in texts.to_pylist()], pa.list_(pa.int64()))

    return run.asNondeterministic()(text.cast("string"))


class Ledger:
    """Signed deltas and their rollups in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str | None = None, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder or new_path(spark, "ledger"), buckets

    def commits(self) -> list:
        """(number, batch, part) of all committed batches in order."""
        try:
            found = self.spark.read.schema(COMMITS).option("recursiveFileLookup", "true").parquet(f"{self.folder}/commits")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e.getCondition()):
                raise
            return []
        return found.orderBy("number").collect()

    def committed(self) -> list[str]:
        return [c["batch"] for c in self.commits()]

    def _read(self, kind: str, parts: list[str], schema: T.StructType | None = None) -> DataFrame:
        reader = self.spark.read.schema(T.StructType([*schema.fields, T.StructField("part", T.StringType())])) if schema else self.spark.read
        return reader.parquet(f"{self.folder}/{kind}").where(F.col("part").isin(parts))

    def _signed(self, changes: DataFrame, parts: list[str]) -> DataFrame:
        """The signed rows of a batch, given what the parts committed so far hold."""
        booked = ["bucket", "doc_id", *DIMENSIONS, "n_tokens", "n_docs"]
        added = changes.where("op in ('insert', 'revise')").withColumn("n_docs", F.lit(1).cast("long"))
        if not parts:
            return added.select(booked)
        asked = changes.select(F.col("bucket").alias("_b"), F.col("doc_id").alias("_d"), F.col("tokenizer").alias("_t"), (F.col("op") != "insert").alias("gone"))
        asked = materialise(asked.groupBy("_b", "_d", "_t").agg(F.max("gone").alias("gone")), "asked")
        touched = [r["_b"] for r in asked.select("_b").distinct().collect()]  # at most self.buckets numbers
        same = (F.col("bucket") == F.col("_b")) & F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("tokenizer").eqNullSafe(F.col("_t"))
        had = self._read("deltas", parts, added.select(booked).schema).where(F.col("bucket").isin(touched)).join(asked, same)
        left = had.groupBy("bucket", "doc_id", *DIMENSIONS, "gone").agg(F.sum("n_tokens").alias("n_tokens"), F.sum("n_docs").alias("n_docs")).where("n_docs <> 0 or n_tokens <> 0")
        left = materialise(left, "booked")
        back = left.where("gone").withColumn("n_tokens", -F.col("n_tokens")).withColumn("n_docs", -F.col("n_docs"))
        held = left.select(F.col("bucket").alias("_b"), F.col("doc_id").alias("_d"), F.col("tokenizer").alias("_t")).distinct()
        twice = (F.col("op") == "insert") & same
        return added.join(held, twice, "left_anti").select(booked).unionByName(back.select(booked))

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commit changes(doc_id, op, source, lang, tokenizer, n_tokens); False if the batch is committed already.

        op is insert, delete or revise. A delete or revision takes back what the ledger has for the
        (doc_id, tokenizer), wherever it was booked; a revision books n_tokens under its own source and language.
        """
        known = self.commits()
        if batch in [c["batch"] for c in known]:
            return False
        part = f"p-{uuid.uuid4().hex}"
        keyed = materialise(changes.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(self.buckets)).cast("int")), "changes")
        # Rebalanced by bucket: a file or few a directory, and a bucket with a third of the rows is several tasks.
        signed = self._signed(keyed, [c["part"] for c in known]).hint("rebalance", "bucket")
        signed.write.partitionBy("bucket").parquet(f"{self.folder}/deltas/part={part}")
        delta = self._read("deltas", [part], signed.schema)  # a batch without rows leaves no file to take it from
        rollup = delta.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("n_tokens"), F.sum("n_docs").alias("n_docs"))
        rollup.write.parquet(f"{self.folder}/rollup/part={part}")
        number = len(known)
        try:
            self.spark.createDataFrame([(number, batch, part)], COMMITS).write.mode("error").parquet(f"{self.folder}/commits/{number:08d}")
        except AnalysisException as e:
            if "PATH_ALREADY_EXISTS" not in str(e.getCondition()):
                raise
            return self.apply(batch, changes)
        return True

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens) over all committed batches."""
        parts = [c["part"] for c in self.commits()]
        if not parts:
            return self.spark.createDataFrame([], "source string, lang string, tokenizer string, n_docs long, n_tokens long")
        sums = self._read("rollup", parts).groupBy(*DIMENSIONS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 or n_tokens <> 0")


def changes(
    docs: DataFrame, paths: list[str], op: str = "insert", doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang"
) -> DataFrame:
    """Changes that insert or revise every row of docs, counted with each vocabulary of paths; deletes carry no counts."""
    versions = F.array(*[F.lit(version_of(p)) for p in paths])
    counts = token_counts(F.col(text), paths) if op != "delete" else F.array_repeat(F.lit(None).cast("long"), len(paths))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.lit(op).alias("op"), F.col(source).alias("source"), F.col(lang).alias("lang"), counts.alias("counts"))
    each = rows.select("doc_id", "op", "source", "lang", F.explode(F.arrays_zip(versions.alias("tokenizer"), F.col("counts").alias("n_tokens"))).alias("c"))
    return each.select("doc_id", "op", "source", "lang", F.col("c.tokenizer").alias("tokenizer"), F.col("c.n_tokens").alias("n_tokens"))


#: What the query's revision masks.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"


def maintained(ledger: Ledger, docs: DataFrame, paths: list[str]) -> DataFrame:
    """Totals of documents(doc_id, text, source, lang) after a history of batches that all of them go through.

    All rows are inserted; those with e-mail addresses are revised to the text with the addresses masked; documents
    without a word are deleted; then the first and second batch are sent again, which changes nothing.
    """
    masked = docs.withColumn("text", F.regexp_replace("text", EMAIL, "<email>")).where(F.col("text").contains("<email>"))
    batches = {
        "load": changes(docs, paths),
        "mask": changes(masked, paths, "revise"),
        "empty": changes(docs.where(~F.coalesce(F.col("text").rlike(WORD), F.lit(False))), paths, "delete"),
    }
    for name in ("load", "mask", "empty", "load", "mask"):
        ledger.apply(name, batches[name])
    return ledger.totals()
