"""Pages of JSON as a Spark data source, read by one task each, in batch or as a stream.

``path`` has ``{page}`` where a page's number goes: a file or folder of a shared store, or an address; or it has
``{shelf}``, a folder of tables of a thousand pages each (``land_pages``).  A page
is an object with its events under ``data`` or ``events``, and ``next`` or ``has_more`` where others follow.
A page that cannot be read after ``tries`` attempts is an empty one that ends the feed, as one without events
does; how many there are is not known before, so all up to the cap are asked for at once and ``bounded`` keeps
those up to the end.  How many pages a landed feed has is known from its folders: with ``whole`` all of them are
read, a folder by one task, and no cap holds.
"""

from __future__ import annotations

import itertools
import json
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from skein.operators.storage import stored

#: Fixed value: pages that are asked for at most.
CAP = 100
#: Fixed value: pages that share a folder of a landed feed.
SHELF = 1000
#: event is null in the row of a page without events.
ROW = "page int, place int, more boolean, failed boolean, event string"


class Page(InputPartition):
    def __init__(self, number: int):
        super().__init__(number)
        self.number = number


class Shelf(Page):
    """All pages of one folder of a landed feed."""


def _listed(path: str) -> tuple:
    """The file system of ``path``, its type there, and its files: of a folder those without a mark before their names."""
    from pyarrow.fs import FileSelector, FileSystem, FileType

    fs, at = FileSystem.from_uri(path if "://" in path else f"file://{path}")
    found = fs.get_file_info(at)
    if found.type == FileType.Directory:
        return fs, found.type, sorted(f.path for f in fs.get_file_info(FileSelector(at)) if f.is_file and not f.base_name.startswith(("_", ".")))
    return fs, found.type, [at]


def _fetch(template: str, number: int) -> bytes:
    path = template.replace("{page}", str(number)).replace("{shelf}", str(number // SHELF))
    if path.startswith(("http://", "https://")):
        import urllib.request

        with urllib.request.urlopen(path, timeout=30) as answer:
            return answer.read()
    import pyarrow.dataset
    from pyarrow.fs import FileType

    fs, kind, files = _listed(path)
    if kind == FileType.NotFound:
        raise FileNotFoundError(path)
    if "{shelf}" in template:
        page = pyarrow.dataset.field("page") == number
        values = pyarrow.dataset.dataset(files, filesystem=fs, format="parquet").to_table(columns=["value"], filter=page)["value"].to_pylist() if files else []
        if not values:
            raise FileNotFoundError(f"page {number} of {path}")
        return "".join(values).encode()
    parts = []
    for f in files:
        with fs.open_input_stream(f) as stream:
            parts.append(stream.read())
    return b"".join(parts)


def _shelves(template: str) -> int:
    """The number of the last folder of a landed feed, 0 if there is none."""
    from pyarrow.fs import FileSelector, FileSystem

    folder, _, prefix = template.partition("{shelf}")[0].rpartition("/")
    fs, at = FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
    said = [f.base_name.removeprefix(prefix) for f in fs.get_file_info(FileSelector(at, allow_not_found=True)) if f.base_name.startswith(prefix)]
    return max((int(n) for n in said if n.isdigit()), default=0)


def shelf_rows(template: str, shelf: int) -> Iterator[tuple]:
    """The rows of all pages of one folder; one that is not there ends the feed.

    A folder that cannot be read is an error, as more than a page would be missing.
    """
    import pyarrow.dataset
    from pyarrow.fs import FileType

    fs, kind, files = _listed(template.replace("{shelf}", str(shelf)))
    wanted = max(1, shelf * SHELF)
    if kind != FileType.NotFound and files:
        table = pyarrow.dataset.dataset(files, filesystem=fs, format="parquet").to_table(columns=["page", "value"]).sort_by("page")
        found = zip(table["page"].to_pylist(), table["value"].to_pylist(), strict=True)
        for number, parts in itertools.groupby(found, lambda r: r[0]):
            if number > wanted:
                yield wanted, 0, False, True, None
            try:
                said = json.loads("".join(value for _, value in parts))
            except ValueError:
                said = None
            yield from _said_rows(number, said)
            wanted = number + 1
    if wanted < (shelf + 1) * SHELF:
        yield wanted, 0, False, True, None


def page_rows(template: str, number: int, tries: int, gap: float) -> Iterator[tuple]:
    """The rows of one page."""
    said: object = None
    for attempt in range(tries):
        try:
            said = json.loads(_fetch(template, number))
            break
        except (OSError, ValueError):  # what a feed may do; the page is marked as failed
            if attempt + 1 < tries:
                time.sleep(gap)
    yield from _said_rows(number, said)


def _said_rows(number: int, said: object) -> Iterator[tuple]:
    """The rows of a page that says ``said``; what is no object is a page that failed."""
    if not isinstance(said, dict):
        yield number, 0, False, True, None
        return
    events = said.get("data") or said.get("events") or []
    more = bool(events) and bool(said.get("next") or said.get("has_more"))
    if not events:
        yield number, 0, False, False, None
    for place, event in enumerate(events):
        yield number, place, more, False, json.dumps(event)


class _Reader(DataSourceReader):
    def __init__(self, template: str, cap: int, tries: int, gap: float, whole: bool):
        self.template, self.cap, self.tries, self.gap, self.whole = template, cap, tries, gap, whole

    def partitions(self) -> list[Page]:
        if self.whole:
            return [Shelf(n) for n in range(_shelves(self.template) + 1)]
        return [Page(n) for n in range(1, self.cap + 1)]

    def read(self, partition: Page) -> Iterator[tuple]:
        if isinstance(partition, Shelf):
            yield from shelf_rows(self.template, partition.number)
        else:
            yield from page_rows(self.template, partition.number, self.tries, self.gap)


class _StreamReader(DataSourceStreamReader):
    """Offsets are page numbers; each batch has the pages that came since, ``cap`` at most."""

    def __init__(self, template: str, cap: int, tries: int, gap: float):
        self.template, self.cap, self.tries, self.gap, self.next = template, cap, tries, gap, 1

    def initialOffset(self) -> dict:
        return {"page": 1}

    def latestOffset(self) -> dict:
        stop = self.next + self.cap
        while self.next < stop:
            try:
                _fetch(self.template, self.next)
            except OSError:
                break
            self.next += 1
        return {"page": self.next}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        return [Page(n) for n in range(start["page"], end["page"])]

    def read(self, partition: Page) -> Iterator[tuple]:
        yield from page_rows(self.template, partition.number, self.tries, self.gap)

    def commit(self, end: dict) -> None:
        self.next = max(self.next, end["page"])


class PageSource(DataSource):
    """``spark.read.format("pages")``; options: path, cap (100), tries (3), gap (seconds between attempts, 0.2), whole (false; all pages of a landed feed, in batch)."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return ROW

    def _given(self) -> tuple[str, int, int, float]:
        given = lambda k, d: self.options.get(k, d)
        return given("path", ""), min(CAP, int(given("cap", CAP))), int(given("tries", 3)), float(given("gap", 0.2))

    def reader(self, schema) -> _Reader:
        whole = self.options.get("whole", "false").lower() == "true"
        if whole and "{shelf}" not in self.options.get("path", ""):
            raise ValueError("only a landed feed can be read as a whole: how many pages another one has is not known")
        return _Reader(*self._given(), whole)

    def streamReader(self, schema) -> _StreamReader:
        return _StreamReader(*self._given())


def read_pages(spark: SparkSession, template: str, **options) -> DataFrame:
    """All events of a paginated feed: page, place, event (JSON); each page is asked for once."""
    spark.dataSource.register(PageSource)
    return bounded(stored(spark.read.format("pages").options(path=template, **options).load(), "pages"))


def stream_pages(spark: SparkSession, template: str, **options) -> DataFrame:
    """The same as a stream of pages as they come."""
    spark.dataSource.register(PageSource)
    return spark.readStream.format("pages").options(path=template, **options).load().filter("event is not null").select("page", "place", "event")


def bounded(pages: DataFrame) -> DataFrame:
    """Rows up to the first page that says that no others follow."""
    end = pages.filter(~F.col("more")).agg(F.min("page")).first()[0]  # one number
    kept = pages if end is None else pages.filter(F.col("page") <= end)
    return kept.filter("event is not null").select("page", "place", "event")


def sport_counts(events: DataFrame) -> DataFrame:
    """Sport (upper case, underscores), n; events without one are left out."""
    said = lambda c: F.get_json_object("event", f"$.{c}")
    sport = F.coalesce(F.when(said("_sport") != "", said("_sport")), said("sport"))
    named = events.select(F.replace(F.upper(sport), F.lit(" "), F.lit("_")).alias("sport")).filter("sport <> ''")
    return named.groupBy("sport").agg(F.count("*").alias("n"))


def land_pages(events: DataFrame, page: str, folder: str) -> str:
    """Writes ``events`` as pages of a feed, all of them, ``SHELF`` to a folder, which one task writes; gives the template of their paths."""
    rest = F.struct(*[c for c in events.columns if c != page])
    last = events.agg(F.max(page)).first()[0]
    body = events.groupBy(page).agg(F.sort_array(F.collect_list(rest)).alias("data")).select(F.col(page).alias("page"), F.to_json(F.struct("data", (F.col(page) < F.lit(last)).alias("has_more"))).alias("value"))
    shelved = body.withColumn("shelf", F.floor(F.col("page") / SHELF))
    shelved.repartition("shelf").sortWithinPartitions("shelf", "page").write.mode("append").partitionBy("shelf").parquet(folder)
    return f"{folder}/shelf={{shelf}}"
