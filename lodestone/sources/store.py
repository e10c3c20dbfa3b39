"""Tables kept as Parquet by project, with explicit schemas.

Every change goes through lodestone.sources.commits: a change of a project's rows writes that
project's rows alone, readers see one snapshot, and of writers at the same time none is lost.
Replacing several tables at once goes through a run folder: all are written first, then one small
pointer file says which run counts. Pointers are numbered and appear by a rename, and the highest
counts, so readers see a whole run at any time, the old one or the new one.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import fixed as K
from lodestone.sources.commits import Commits, claim, hadoop

SCHEMAS = {
    "projects": "id string, name string, local_path string, branch string, commit_sha string, status string, languages string, created_at timestamp, updated_at timestamp",
    "code_entities": "id string, project_id string, name string, entity_type string, file_path string, start_line int, end_line int, signature string, language string",
    "relationships": "id string, project_id string, source_file string, source_symbol string, target_file string, target_symbol string, relationship_type string",
    "documents": "id string, project_id string, section_name string, content string, confidence double, created_at timestamp, updated_at timestamp",
    "conversations": "id string, project_id string, title string, created_at timestamp",
    "messages": "id string, conversation_id string, role string, content string, citations_json string, created_at timestamp",
    "analysis_checkpoints": "id string, project_id string, commit_sha string, chunk_hash string, file_path string, result_json string, created_at timestamp",
    "embeddings": "project_id string, vector array<float>, file_path string, language string, start_line int, end_line int, symbol_name string, content string",
}
PART = {"projects": "id", "messages": "conversation_id"}


@dataclass
class Store:
    spark: SparkSession
    base: str

    def path(self, table: str) -> str:
        return f"{self.base}/{table}"

    def _part(self, table: str) -> str:
        return PART.get(table, "project_id")

    def commits(self, table: str) -> Commits:
        return Commits(self.spark, self.path(table), SCHEMAS[table], self._part(table))

    def read(self, table: str) -> DataFrame:
        """The newest snapshot of the table, empty if nothing was ever written."""
        return self.commits(table).read()

    def append(self, table: str, rows: DataFrame) -> None:
        self.commits(table).append(rows)

    def scan(self, table: str, key: str | None = None) -> DataFrame:
        """Rows of one project (or conversation); the filter prunes partitions."""
        t = self.read(table)
        return t if key is None else t.where(F.col(self._part(table)) == key)

    def get(self, table: str, **key) -> DataFrame:
        """The row with this key; more than one raises when it is read."""
        t = self.read(table)
        for k, v in key.items():
            t = t.where(F.col(k) == v)
        t = t.withColumn("_rows", F.count(F.lit(1)).over(_everything()))
        names = [c for c in t.columns if c != "_rows"]
        return t.where(F.when(F.col("_rows") > 1, F.raise_error(F.lit(f"{table}: several rows for {key}")).cast("boolean")).otherwise(F.lit(True))).select(names)

    def delete(self, table: str, key: str) -> int:
        """Remove one project's rows; how many they were."""
        found = []

        def gone(now: DataFrame) -> DataFrame:
            found.append(now.count())
            return now.limit(0)

        self.commits(table).change([key], gone)
        return found[-1]

    def replace(self, tables: dict[str, DataFrame], projects: list[str]) -> None:
        """Give these projects (or keys of the table) the new rows alone, table by table, leaving all others.

        A project without new rows has none afterwards; rows of other projects are not written.
        """
        for name, df in tables.items():
            self.commits(name).change(projects, lambda now, df=df, key=self._part(name): df.where(F.col(key).isin(projects)))

    def set_status(self, project: str, status: str, expected: list[str] | None = None) -> bool:
        """Compare and set: the project's new status if the present one is expected; whether it was set."""

        def put(now: DataFrame) -> DataFrame | None:
            found = now if expected is None else now.where(F.col("status").isin(expected))
            return now.withColumns({"status": F.lit(status), "updated_at": F.current_timestamp()}) if found.limit(1).count() else None

        return self.commits("projects").change([project], put) is not None

    def replace_run(self, tables: dict[str, DataFrame], run: str) -> None:
        """Write all tables of a run, then point to it."""
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.base}/_runs/{run}/{name}")
        folder, fs = hadoop(self.spark, f"{self.base}/_pointers")
        fs.mkdirs(folder)
        new = f"{self.base}/_pointers/.{uuid.uuid4().hex}"
        out = fs.create(hadoop(self.spark, new)[0])
        out.write(bytearray(run.encode()))
        out.close()
        # A taken number is not claimed, so two writers get two numbers.
        n = max(self._pointers(), default=0) + 1
        while not claim(self.spark, new, f"{self.base}/_pointers/{n:012d}"):
            n += 1

    def _pointers(self) -> list[int]:
        folder, fs = hadoop(self.spark, f"{self.base}/_pointers")
        if not fs.exists(folder):
            return []
        return [int(s.getPath().getName()) for s in fs.listStatus(folder) if s.getPath().getName().isdigit()]

    def current_run(self) -> str:
        """The run that the highest pointer names."""
        numbers = self._pointers()
        if not numbers:
            raise FileNotFoundError(f"{self.base} has no run")
        p, fs = hadoop(self.spark, f"{self.base}/_pointers/{max(numbers):012d}")
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def read_run(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.base}/_runs/{self.current_run()}/{table}")

    def upsert_sections(self, rows: DataFrame) -> None:
        """Sections by (project, name): content, confidence and time are updated, or the row is added."""
        on = ["project_id", "section_name"]
        self.commits("documents").change(rows.select("project_id"), lambda now: merge_sections(now, rows, on))

    def merge_checkpoints(self, rows: DataFrame) -> None:
        """Checkpoints by (project, chunk hash): the first one stays."""
        self.commits("analysis_checkpoints").change(rows.select("project_id"), lambda now: merge_checkpoints(now, rows))


def _everything():
    from pyspark.sql.window import Window

    return Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def merge_sections(old: DataFrame, new: DataFrame, on: list[str]) -> DataFrame:
    new = new.groupBy(*on).agg(*(F.max_by(c, F.coalesce("updated_at", F.lit("1970-01-01").cast("timestamp"))).alias(c) for c in old.columns if c not in on)).select(old.columns)
    born = old.select(*on, F.col("id").alias("_id"), F.col("created_at").alias("_born"))
    new = new.join(born, on, "left").withColumn("id", F.coalesce("_id", "id")).withColumn("created_at", F.coalesce("_born", "created_at"))
    return old.join(new.select(*on), on, "left_anti").select(old.columns).unionByName(new.select(old.columns))


def merge_checkpoints(old: DataFrame, new: DataFrame) -> DataFrame:
    on = ["project_id", "chunk_hash"]
    add = new.join(old.select(*on), on, "left_anti").groupBy(*on).agg(*(F.min_by(c, "id").alias(c) for c in old.columns if c not in on))
    return old.unionByName(add.select(old.columns))


def with_status(projects: DataFrame, project: str, status: str) -> DataFrame:
    return projects.withColumn("status", F.when(F.col("id") == project, status).otherwise(F.col("status")))


def newest_first(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("created_at"))


def embed_rows(chunks: DataFrame) -> DataFrame:
    """Chunks that are worth a vector: ten estimated tokens or more, cut to the limit."""
    from lodestone.functions.text import estimate_tokens

    return chunks.where(estimate_tokens(F.col("content")) >= K.MIN_EMBED_TOKENS).withColumn("content", F.substring("content", 1, K.MAX_CHUNK_TOKENS * K.CHARS_PER_TOKEN))
