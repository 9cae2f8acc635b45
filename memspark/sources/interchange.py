"""Dumps and interchange bundles: JSON dumps, folders of Markdown files with a block of fields, and versioned snapshots."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.functions import chunking as C

FACT = "id string, entity_id string, title string, body string, confidence string, source_type string, updated_at long, links array<string>"
#: What a file gives when a field is missing or unknown.
DEFAULTS = {"confidence": "tentative", "source_type": "user_stated"}
KNOWN = {"confidence": {"certain", "inferred", "tentative"}, "source_type": {"user_stated", "librarian_inferred", "user_confirmed", "immutable_document"}}
PATH = r"entities/([^/]+)/facts/([^/]+)\.md$"


def export_dump(facts: DataFrame, path: str) -> None:
    """One JSON line for each entity's fact, partitioned by entity; no entity is gathered into one row."""
    facts.write.mode("overwrite").partitionBy("entity_id").json(path)


def import_dump(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def bundle_files(facts: DataFrame) -> DataFrame:
    """(path, content) of a Markdown file for each fact."""
    quote = lambda c: F.to_json(F.struct(F.col(c).alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col(c).alias("v")))) - 6)
    fields = F.concat(F.lit("---\n"), *[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit("\n")) for c in ("id", "confidence", "source_type", "updated_at")], F.lit("title: "), quote("title"), F.lit("\n---\n"))
    path = F.concat(F.lit("entities/"), F.col("entity_id"), F.lit("/facts/"), F.col("id"), F.lit(".md"))
    return facts.select(path.alias("path"), F.concat(fields, F.coalesce("body", F.lit(""))).alias("content"))


def parse_bundle(files: DataFrame) -> DataFrame:
    """Facts of (path, content) files; files elsewhere are ignored, unknown values take their defaults, relative links are kept."""

    def run(frames):
        for f in frames:
            rows = []
            for entity, name, content in zip(f["entity_id"], f["name"], f["content"]):
                fields, body = C.frontmatter(content)
                title = fields.get("title")
                if isinstance(title, str):
                    try:
                        title = json.loads(f'"{title}"')
                    except ValueError:
                        pass
                row = {k: fields.get(k) if fields.get(k) in KNOWN[k] else v for k, v in DEFAULTS.items()}
                at = fields.get("updated_at")
                rows.append(row | {"id": name, "entity_id": entity, "title": None if title is None else str(title), "body": body, "updated_at": at if isinstance(at, int) else None, "links": [b for _, b in C.markdown_links(body)]})
            yield pd.DataFrame(rows, columns=["id", "entity_id", "title", "body", "confidence", "source_type", "updated_at", "links"]).astype({"updated_at": "Int64"})

    named = files.select(F.regexp_extract("path", PATH, 1).alias("entity_id"), F.regexp_extract("path", PATH, 2).alias("name"), "content").filter("name <> ''")
    return named.mapInPandas(run, FACT)


def read_bundle(spark: SparkSession, root: str) -> DataFrame:
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(f"{root}/entities")
    return parse_bundle(files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")))


class Snapshots:
    """Copy-on-write versions of a table: each write is a new folder, the newest that is complete is current."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def versions(self) -> list[int]:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        names = [s.getPath() for s in fs.listStatus(path)]
        return sorted(int(p.getName()[1:]) for p in names if p.getName().startswith("v") and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def write(self, df: DataFrame) -> int:
        version = (self.versions() or [0])[-1] + 1
        df.write.mode("overwrite").parquet(f"{self.root}/v{version}")
        return version

    def read(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/v{version or self.versions()[-1]}")
