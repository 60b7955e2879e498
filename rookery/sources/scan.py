"""Scans of stored boards: a data source with a partition a file, whose rows are postings and, for each board, how its reading went.

A file holds JSON lines, one a board: {board, provider, url, status, message, body, incomplete}. What a provider does is a `Provider`: it may recognise a board's address,
and makes postings of an answer. A board that fails, has no provider or isn't an answer gives its outcome row and no posting; the job goes on. Files go through pyarrow's file systems, so they may lie
wherever all executors reach; a task that is lost reads its file again. Lines that aren't JSON count as failed boards without a name.

    spark.dataSource.register(BoardFiles)
    spark.read.format("board_files").load(folder)
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from rookery.functions.text import clean
from rookery.functions.urls import unit_key
from rookery.operators.titles import has_term
from rookery.sources.boards import day

#: place is null in a board's outcome row and counts its postings in the others.
SCHEMA = "board string, provider string, url string, place int, outcome string, status int, message string, records long, posting struct<title:string,url:string,company:string,location:string,posted_at:string,description:string>"
POSTING = ("title", "url", "company", "location", "posted_at", "description")
BATCH = 1_000
MOST_MESSAGE = 300


class Incomplete(list):
    """Postings of a board whose later pages are missing."""


@dataclass(frozen=True)
class Provider:
    """`fetch(entry, body)` gives dicts with POSTING's fields (others are dropped, missing ones null), an `Incomplete` list of them, or raises; `detect(url)` says whether a board's address is its own."""

    id: str
    fetch: Callable[[dict, str], list[dict]]
    detect: Callable[[str], bool] = lambda url: False


def on_host(*hosts: str) -> Callable[[str], bool]:
    return lambda url: (urlsplit(url).hostname or "") in hosts


def _greenhouse(entry, body):
    return [{"title": j.get("title"), "url": j.get("absolute_url"), "location": (j.get("location") or {}).get("name"), "posted_at": j.get("first_published"), "description": j.get("content")} for j in json.loads(body)["jobs"]]


def _lever(entry, body):
    return [{"title": j.get("text"), "url": j.get("hostedUrl"), "location": (j.get("categories") or {}).get("location"), "posted_at": j.get("createdAt"), "description": j.get("descriptionPlain")} for j in json.loads(body)]


def _ashby(entry, body):
    return [{"title": j.get("title"), "url": j.get("jobUrl"), "location": j.get("location"), "posted_at": j.get("publishedAt"), "description": j.get("descriptionPlain")} for j in json.loads(body)["jobs"]]


PROVIDERS = (
    Provider("greenhouse", _greenhouse, on_host("boards.greenhouse.io", "job-boards.greenhouse.io")),
    Provider("lever", _lever, on_host("jobs.lever.co")),
    Provider("ashby", _ashby, on_host("jobs.ashbyhq.com")),
)


def resolve(entry: dict, providers: tuple[Provider, ...]) -> Provider | None:
    """The provider that an entry names, else the first that recognises its address."""
    if entry.get("provider"):
        return next((p for p in providers if p.id == entry["provider"]), None)
    return next((p for p in providers if p.detect(entry.get("url") or "")), None)


def read_board(line: str, providers: tuple[Provider, ...]) -> Iterator[tuple]:
    """A board's outcome row, then its postings."""
    try:
        entry = json.loads(line)
        if not isinstance(entry, dict):
            raise ValueError("no entry")
    except ValueError as error:
        yield None, None, None, None, "failed", None, f"{error}"[:MOST_MESSAGE], 0, None
        return
    board, url, status = (entry.get(k) for k in ("board", "url", "status"))
    row = lambda outcome, message, records, provider: (board, provider, url, None, outcome, status, message, records, None)
    provider = resolve(entry, providers)
    if provider is None:
        yield row("unsupported", f"unknown provider {entry.get('provider') or ''}".strip(), 0, entry.get("provider"))
        return
    if entry.get("body") is None or (status is not None and status >= 400):
        yield row("failed", (entry.get("message") or "no answer")[:MOST_MESSAGE], 0, provider.id)
        return
    try:
        answer = provider.fetch(entry, entry["body"])
        found = [{k: None if j.get(k) is None else str(j[k]) for k in POSTING} for j in answer]
    except Exception as error:  # one board's trouble is its own, whatever a provider raises
        yield board, provider.id, url, None, "failed", getattr(error, "status", None), (f"{error}" or type(error).__name__)[:MOST_MESSAGE], 0, None
        return
    partial = isinstance(answer, Incomplete) or bool(entry.get("incomplete"))
    yield row("partial" if partial else "complete", "provider returned a partial board" if partial else None, len(found), provider.id)
    for place, posting in enumerate(found):
        yield board, provider.id, url, place, None, None, None, None, posting


class _File(InputPartition):
    def __init__(self, uri: str):
        super().__init__(uri)


class BoardReader(DataSourceReader):
    def __init__(self, folder: str, schema, providers: tuple[Provider, ...]):
        self.folder, self.schema, self.providers, self.only = folder, schema, providers, None

    def pushFilters(self, filters: list[Filter]):
        """A provider asked for is left to its own boards before they are parsed; every other filter is Spark's."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("provider",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = wanted if self.only is None else self.only & wanted
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        fs, root = pafs.FileSystem.from_uri(self.folder)
        files = fs.get_file_info(pafs.FileSelector(root, recursive=True))
        return [_File(f.path) for f in sorted(files, key=lambda f: f.path) if f.type == pafs.FileType.File and f.size and not f.base_name.startswith((".", "_"))]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(self.folder)
        kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.struct([(k, pa.string()) for k in POSTING])]
        names = [f.name for f in self.schema.fields]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        held = []
        with fs.open_input_stream(partition.value) as stream:
            for line in _lines(stream):
                for row in read_board(line, self.providers):
                    if self.only is None or row[1] in self.only:
                        held.append(row)
                    if len(held) == BATCH:
                        yield batch(held)
                        held = []
        if held:
            yield batch(held)


def _lines(stream, size: int = 1 << 20) -> Iterator[str]:
    rest = b""
    while piece := stream.read(size):
        *whole, rest = (rest + piece).split(b"\n")
        yield from (w.decode("utf-8", "replace") for w in whole if w.strip())
    if rest.strip():
        yield rest.decode("utf-8", "replace")


class BoardFiles(DataSource):
    """The source `board_files`; a subclass with `providers` of its own adds vendors."""

    providers = PROVIDERS

    @classmethod
    def name(cls) -> str:
        return "board_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BoardReader:
        return BoardReader(self.options["path"], schema, self.providers)


def error_class(status: Column, message: Column) -> Column:
    """What kind of failure a status and a message are; the first that fits."""
    said = F.coalesce(message, F.lit(""))
    return (
        F.when(status == 404, "not_found").when(status == 429, "rate_limit").when(said.rlike("(?i)timeout|aborted|AbortError|deadline"), "timeout")
        .when(said.rlike("(?i)cannot derive|unknown provider|unsupported"), "unsupported").when(status >= 500, "http_5xx")
        .when(status.isNotNull(), F.concat(F.lit("http_"), status.cast("string"))).otherwise("fetch_error")
    )


#: What the answer of a provider cannot tell, whatever its outcome.
LIMITS = {"hackernews": "only the thread of the current month; earlier threads are not enumerated"}


def judged(rows: DataFrame, roles: list[str], since: Column, until: Column) -> DataFrame:
    """The postings of a scan, each with why it is left out: its title names no role ('title'), or its day lies outside the window ('window'); null if it stays. Undated ones stay."""
    p = F.col("posting")
    posted = day(p["posted_at"])
    outside = ~F.coalesce(posted.between(since, until), F.lit(True))
    why = F.when(~has_term(p["title"], roles), "title").when(outside, "window") if roles else F.when(outside, "window")
    return rows.filter("place IS NOT NULL").select("board", "provider", "place", clean(p["title"]).alias("title"), p["url"].alias("url"), p["location"].alias("location"), posted.alias("posted_at"), why.alias("reason"))


def units(rows: DataFrame, until: Column, kind: str = "board") -> DataFrame:
    """A coverage row a board: its outcome, what kind of error, how many records it gave, and up to when it is covered, which only a complete one is. A board listed twice has its worst outcome."""
    o = rows.filter("place IS NULL")
    rank = F.array_position(F.array(*map(F.lit, ("complete", "partial", "unsupported", "failed"))), F.col("outcome"))
    worst = F.max_by(F.struct("provider", "outcome", "status", "message"), F.struct(rank, "message", "status"))
    one = o.groupBy("board").agg(worst.alias("o"), F.sum("records").alias("records"))
    bad = F.col("o.outcome").isin("failed", "unsupported")
    limits = F.element_at(F.create_map(*(F.lit(x) for kv in LIMITS.items() for x in kv)), F.col("o.provider"))
    return one.select(
        unit_key(F.lit(kind), F.col("board")).alias("key"), "board", F.col("o.provider").alias("provider"), F.col("o.outcome").alias("status"), F.when(bad, error_class(F.col("o.status"), F.col("o.message"))).alias("error"),
        F.col("o.message").alias("message"), "records", F.when(F.col("o.outcome") == "complete", until).alias("covered_through"), limits.alias("limitation"),
    )


def scan(spark: SparkSession, folder: str, source: type[BoardFiles] = BoardFiles) -> DataFrame:
    """The rows of all stored boards below a folder. The session's pushing of filters to Python sources is switched on, as the reader takes them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source)
    return spark.read.format(source.name()).load(folder)
