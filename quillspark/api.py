"""The service's verbs as functions over one workspace folder: download, status, search, knowledge base."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import graph, pages as pg, search, store
from quillspark.operators.lineage import settled
from quillspark.sources import index

LESSON = "_key string, problem string, solution string, context string, example string, tags array<string>, severity string, role string, task string, phase string, timestamp timestamp, embedding array<float>"
EDGE = "_key string, _from string, _to string, type string, rationale string, timestamp timestamp, attrs map<string,string>"
STATUS = "download_id string, status string, message string, start_time timestamp, end_time timestamp, error_details string"


@dataclass
class DownloadRequest:
    """What to fetch: a site by its address or a checkout by its repository."""

    source_type: str
    source_location: str
    download_id: str = ""
    depth: int = 5
    doc_path: str | None = None
    extra: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.source_type not in ("git", "website", "playwright"):
            raise ValueError(f"unknown source type {self.source_type}")
        if self.source_type == "git" and not self.doc_path:
            raise ValueError("a git source needs doc_path")
        if self.source_type != "git" and not re.match("https?://", self.source_location):
            raise ValueError("a site needs an http address")
        if self.depth < 0:
            raise ValueError("depth must be 0 or more")
        self.download_id = re.sub(r"[^A-Za-z0-9_\-]+", "_", self.download_id or self.source_location)


class Workspace:
    """State as DataFrames; each change gives the next state, settled, so that plans stay short and times and keys stay put."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        make = lambda schema: spark.createDataFrame([], schema)
        self.lessons, self.edges, self.jobs, self.pages = make(LESSON), make(EDGE), make(STATUS), make("page_id long, url string, html string, download_id string")

    # Jobs

    def _set(self, job: str, status: str, **more) -> None:
        row = {"download_id": job, "status": status, "message": None, "start_time": None, "end_time": None, "error_details": None} | more
        change = self.spark.createDataFrame([tuple(row[c] for c in self.jobs.columns)], STATUS)
        if status == "running":
            change = change.withColumn("start_time", store.now())
        elif status != "pending":
            began = self.status(job).select("start_time").first()
            change = change.withColumns({"start_time": F.lit(began and began[0]).cast("timestamp"), "end_time": store.now()})
        self.jobs = settled(store.upsert(self.jobs, change, "download_id"))

    def status(self, job: str) -> DataFrame:
        return store.get(self.jobs, "download_id", job)

    def download(self, request: DownloadRequest, fetched: DataFrame) -> None:
        """Take a fetched set (page_id, url, html) in; a running job is refused, one that breaks off is failed."""
        now = self.status(request.download_id).select("status").first()
        if now is not None and now[0] == "running":
            raise RuntimeError(f"{request.download_id} is running")
        self._set(request.download_id, "pending")
        self._set(request.download_id, "running")
        try:
            rows = fetched.select("page_id", "url", "html").withColumn("download_id", F.lit(request.download_id))
            pages = settled(self.pages.where(F.col("download_id") != request.download_id).unionByName(rows))
            pages.count()  # where rows are only kept, they are read here
        except Exception as e:
            self._set(request.download_id, "failed", message="the fetched rows can't be read", error_details=str(e)[:1000])
            raise
        self.pages = pages
        self._set(request.download_id, "completed")

    def index(self, job: str) -> DataFrame:
        return index.records(self.pages.where(F.col("download_id") == job).withColumn("fetch_status", F.lit("success")))

    def search_pages(self, job: str, scan_keywords, selector: str, extract_keywords=None, limit: int = 10) -> DataFrame:
        state = self.status(job).select("status").first()
        if state is None:
            raise KeyError(job)
        if state[0] != "completed":
            raise RuntimeError(f"{job} is {state[0]}")
        return pg.search(self.pages.where(F.col("download_id") == job), scan_keywords, selector, extract_keywords, limit)

    def health(self) -> dict:
        return {"status": "ok", "spark": self.spark.version}

    # Knowledge base

    def add_lesson(self, rows: DataFrame) -> None:
        self.lessons = settled(store.insert(self.lessons, rows))

    def get_lesson(self, key: str) -> DataFrame:
        return store.get(self.lessons, "_key", key)

    def update_lesson(self, changes: DataFrame) -> None:
        self.lessons = settled(store.update(self.lessons, changes, "_key"))

    def delete_lesson(self, keys: DataFrame) -> None:
        """Lessons go with all their relationships; unknown keys change nothing."""
        self.edges = settled(store.cascade(self.edges, keys, "_key"))
        self.lessons = settled(store.delete(self.lessons, keys, "_key"))

    def add_relationship(self, rows: DataFrame) -> None:
        self.edges = settled(store.insert_edges(self.edges, rows))

    def delete_relationship(self, keys: DataFrame) -> None:
        self.edges = settled(store.delete(self.edges, keys, "_key"))

    def traverse(self, start: str, least: int = 1, most: int = 1, direction: str = "OUTBOUND") -> DataFrame:
        starts = self.spark.createDataFrame([(start,)], "start string")
        return graph.traverse(self.edges, starts, least, most, direction, "_from", "_to", "_key")

    def search_bm25(self, query: str, **how) -> DataFrame:
        return search.bm25(self.lessons, query, "_key", ("problem", "solution", "context", "example"), **how)

    def search_semantic(self, vector, **how) -> DataFrame:
        return search.semantic(self.lessons, vector, "_key", **how)

    def search_hybrid(self, query: str, vector, **how) -> DataFrame:
        return search.hybrid(self.lessons, self.lessons, query, vector, "_key", fields=("problem", "solution", "context"), **how)

    def search_keyword(self, keywords, **how) -> DataFrame:
        return search.keyword_search(self.lessons, keywords, ("problem", "solution", "context"), "_key", **how)

    def search_tag(self, tags, **how) -> DataFrame:
        return search.tag_search(self.lessons, tags, "_key", **how)
