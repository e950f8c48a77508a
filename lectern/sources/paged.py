"""A paged JSON listing as a Spark data source: one partition for each listing.

``spark.read.format("paged_json").option("path", folder).schema(...)`` reads
``<folder>/<listing>/<page>.json`` files; a page is ``{"items": [...], "next": "<page>"}``,
and a listing ends where no next page is named, or names one that was read before.  A
reader for a remote service differs in ``send`` only.

A listing that is forbidden, missing, broken or out of its time fails the job; where the
schema has a column ``error``, it ends in a row that says why, and the others go on.  A
reader that is signed out fails in any case.  Options: ``seconds`` a listing may take,
waits included, ``tries`` a request, ``pages`` to read of a listing at most (a last row
with the error ``more_pages`` says that it has more, if there is such a column), and
``cursor``: where in the schema, the page that a row is of, to go on from with ``first``.

``spark.readStream`` takes pages as they appear, numbered from 1: at most
``pages_per_trigger`` in a batch, shared out over the listings, and goes on from the
checkpoint's offset, the number of pages read of each listing.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import date, datetime

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from lectern.sources.patience import TRIES, Answer, Patience, Refused

SECONDS, PAGES_PER_TRIGGER = 600.0, 100


class Listing(InputPartition):
    def __init__(self, folder: str, first: int = 0, last: int = 0) -> None:
        self.folder, self.first, self.last = folder, first, last


class PagedJson(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "listing string, item string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagedReader(self.options, schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return PagedStream(self.options, schema)


class Pages:
    """What the readers of tables and of streams share."""

    def __init__(self, options: dict, schema: StructType) -> None:
        self.root, self.schema = options["path"], schema
        self.first, self.envelope = options.get("first", "1"), options.get("envelope", "items")
        self.seconds, self.tries = float(options.get("seconds", SECONDS)), int(options.get("tries", TRIES))
        self.most, self.each = int(options.get("pages", 0)), int(options.get("pages_per_trigger", PAGES_PER_TRIGGER))
        self.tells = "error" in schema.fieldNames()

    def _system(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.root)

    def listings(self) -> list[str]:
        system, root = self._system()
        found = system.get_file_info(fs.FileSelector(root))
        return sorted(f.base_name for f in found if f.type == fs.FileType.Directory)

    def send(self, listing: str, page: str) -> Answer:
        """One request for a page."""
        system, root = self._system()
        try:
            with system.open_input_stream(f"{root}/{listing}/{page}.json") as file:
                return Answer(body=file.read())
        except FileNotFoundError:
            return Answer(404)
        except PermissionError:
            return Answer(403)

    def patience(self) -> Patience:
        return Patience(self.seconds, self.tries)

    def fetch(self, listing: str, page: str, patience: Patience) -> dict:
        body = patience.json(lambda: self.send(listing, page))
        if not isinstance(body, dict):
            raise Refused("failed", "no page")
        return body

    def walk(self, listing: str) -> Iterator[tuple]:
        """The rows of a listing, page after page as each names the next."""
        page, seen, patience = self.first, set(), self.patience()
        while page and page not in seen and "/" not in page:
            if self.most and len(seen) >= self.most:
                if self.tells:
                    yield self._row(listing, page, {}, "more_pages")
                return
            seen.add(page)
            try:
                body = self.fetch(listing, page, patience)
            except Refused as e:
                yield self._told(listing, page, e)
                return
            for item in body.get(self.envelope) or []:
                yield self._row(listing, page, item)
            page = str(body["next"]) if body.get("next") else ""

    def _told(self, listing: str, page: str, why: Refused) -> tuple:
        if not self.tells or why.kind == "signed_out":
            raise why
        return self._row(listing, page, {}, why.kind)

    def _row(self, listing: str, page: str, item: dict, error: str | None = None) -> tuple:
        own = {"listing": listing, "cursor": page, "error": error, "item": None if error else json.dumps(item, sort_keys=True)}
        out = []
        for column in self.schema.fields:
            value = own[column.name] if column.name in own else item.get(column.name)
            kind = column.dataType.simpleString()
            if value is not None and kind == "timestamp":
                value = datetime.fromisoformat(str(value).replace("Z", "+00:00"))
            elif value is not None and kind == "date":
                value = date.fromisoformat(str(value)[:10])
            out.append(value)
        return tuple(out)


class PagedReader(Pages, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return [Listing(name) for name in self.listings()]

    def read(self, partition: Listing) -> Iterator[tuple]:
        return self.walk(partition.folder)


class PagedStream(Pages, DataSourceStreamReader):
    """Offsets are ``{listing: pages read}``; the driver looks at names only, tasks read pages."""

    position: dict[str, int] | None = None

    def initialOffset(self) -> dict:
        return {}

    def _pages(self) -> dict[str, int]:
        """How many pages, numbered from 1 without a gap, each listing has."""
        system, root = self._system()
        found = {}
        for listing in self.listings():
            names = {f.base_name for f in system.get_file_info(fs.FileSelector(f"{root}/{listing}"))}
            found[listing] = next(n for n in range(len(names) + 1) if f"{n + 1}.json" not in names)
        return found

    def latestOffset(self) -> dict:
        position = dict(self.position or {})
        fresh = {name: n - position.get(name, 0) for name, n in self._pages().items() if n > position.get(name, 0)}
        left = self.each
        for nth, name in enumerate(sorted(fresh, key=lambda n: (fresh[n], n))):
            take = min(fresh[name], max(1, left // (len(fresh) - nth)), left)
            position[name] = position.get(name, 0) + take
            left -= take
        self.position = {name: n for name, n in sorted(position.items()) if n}
        return self.position

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if self.position is None:  # after a restart, the last planned batch says where to go on
            self.position = dict(end)
        return [Listing(name, start.get(name, 0) + 1, last) for name, last in end.items() if last > start.get(name, 0)]

    def commit(self, end: dict) -> None:
        if self.position is None:
            self.position = dict(end)

    def read(self, partition: Listing) -> Iterator[tuple]:
        """Rows of the pages; one that is refused fails the batch, or is a row that says so."""
        patience = self.patience()
        for page in map(str, range(partition.first, partition.last + 1)):
            try:
                body = self.fetch(partition.folder, page, patience)
            except Refused as e:
                yield self._told(partition.folder, page, e)
                continue
            for item in body.get(self.envelope) or []:
                yield self._row(partition.folder, page, item)
