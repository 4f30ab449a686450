"""Import sink: accepted and rejected rows of a run, published together, and a purge that keeps what must stay.

Every run writes into its own directories below the store and is published by one file in `published`, written last. Readers
take the rows of published runs only, so a run that was cut off leaves nothing to see and may be repeated under the same name.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.sources.versioned import create_once

PUBLISHED = "run string, part string, n_accepted long, n_rejected long"


def published(spark: SparkSession, store: str) -> DataFrame:
    """(run, part, n_accepted, n_rejected) of the published runs."""
    try:
        return spark.read.schema(PUBLISHED).json(f"{store}/published")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e.getCondition()):
            raise
        return spark.createDataFrame([], PUBLISHED)


def publish(built: DataFrame, store: str, run: str) -> dict[str, int]:
    """Write the rows of built (with `errors`) as accepted and rejected ones and publish both; a published run is not written again.

    The row that publishes a run is a file under the run's name that can be created once: of two writers of a run one publishes, and the rows
    of the other are read by nobody.
    """
    spark = built.sparkSession
    done = published(spark, store).where(F.col("run") == run).collect()
    if done:
        return {"accepted": done[0]["n_accepted"], "rejected": done[0]["n_rejected"], "repeated": 1}
    part = uuid.uuid4().hex
    good = F.size("errors") == 0
    # One pass over the rows: both kinds go to directories of one table.
    built.withColumn("kind", F.when(good, "accepted").otherwise("rejected")).write.partitionBy("kind").parquet(f"{store}/rows/part={part}")
    kinds = spark.read.schema(_schema(built)).parquet(f"{store}/rows").where(F.col("part") == part).groupBy("kind").count().collect()
    counts = {r["kind"]: r["count"] for r in kinds}
    row = {"run": run, "part": part, "n_accepted": counts.get("accepted", 0), "n_rejected": counts.get("rejected", 0)}
    name = hashlib.sha256(run.encode()).hexdigest()[:32]
    if not create_once(f"{store}/published/{name}.json", json.dumps(row).encode()):
        return publish(built, store, run)
    return {"accepted": row["n_accepted"], "rejected": row["n_rejected"], "repeated": 0}


def _schema(built: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in built.schema.fields) + ", kind string, part string"


def rows_of(spark: SparkSession, store: str, kind: str, like: DataFrame) -> DataFrame:
    """Accepted or rejected rows of all published runs, with the columns of `like` and the run."""
    parts = published(spark, store).select("run", "part")
    return spark.read.schema(_schema(like)).parquet(f"{store}/rows").where(F.col("kind") == kind).join(parts, "part").drop("part", "kind")


#: Tables that a purge empties, parents last, and those that it keeps.
DERIVED = [
    "company_financials", "registered_addresses", "contacts", "company_facts", "company_identifiers", "duplicate_candidates", "ingestion_records", "source_snapshots", "ingestion_runs",
    "companies",
]
KEPT = ["audit_events", "contact_suppressions"]


def purge(tables: dict[str, DataFrame], configured: list[str], actor: str, at: str) -> dict[str, DataFrame]:
    """The tables after a purge: derived ones empty, unlisted sources gone, audit and suppressions whole with one more audit row.

    The caller writes the result as a new version; counts of what went are in the audit row's details as JSON.
    """
    gone = {name: tables[name].count() for name in DERIVED if name in tables}
    after = {name: df.limit(0) if name in gone else df for name, df in tables.items()}
    if "sources" in tables:
        listed = F.col("source_id").isin(configured)
        gone["sources"] = tables["sources"].where(~listed).count()
        after["sources"] = tables["sources"].where(listed)
    audit = tables["audit_events"]
    counts = F.to_json(F.struct(*[F.lit(n).alias(name) for name, n in gone.items()]))
    row = audit.sparkSession.range(1).select(F.lit(actor).alias("actor"), F.lit("maintenance.purge").alias("action"), counts.alias("details"), F.lit(at).cast("timestamp").alias("at"))
    after["audit_events"] = audit.unionByName(row, allowMissingColumns=True)
    return after
