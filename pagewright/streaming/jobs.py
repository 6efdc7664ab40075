"""Per-job streams with state and timers: status events, discovery in batches, and throttled activity.

Each is a stateful processor over one job's rows. Time is event time: rows carry `at`, in milliseconds, and timers fire as
the watermark passes them, so a replayed stream gives the same events whatever its micro-batches are. Within a batch a
job's rows are taken in the order of (at, seq); a row that is `late_ms` or more behind the latest one of the batches before
is dropped as late. State is small numbers and strings, and one entry for each page or URL in
map state, which stays in the state store and is read by key, so a large job isn't held in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pagewright.functions import urls
from pagewright.schemas import PAGE_STATUSES

HEARTBEAT_MS, BATCH, LIMIT, WRITE_MS = 15_000, 25, 5_000, 1_000
COUNTS = ", ".join(f"{s} long" for s in PAGE_STATUSES)
STATUS_EVENT = f"job_id string, n long, at long, event string, mapping string, {COUNTS}"
DISCOVERED = "job_id string, n long, event string, phase string, urls array<string>"
WRITE = "job_id string, n long, at long, phase string, lastUrl string, fetchErrors long, lastError string"
# Rows that processors give out must carry names.
StatusRow, DiscoveredRow, WriteRow = (Row(*(field.split()[0] for field in schema.split(", "))) for schema in (STATUS_EVENT, DISCOVERED, WRITE))


class Timed(StatefulProcessor):
    """A processor with a value `job` and at most one timer, whose time is the value's last field."""

    fields: str
    start: tuple

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", self.fields)

    def load(self) -> list:
        return list(self.job.get()) if self.job.exists() else list(self.start)

    def store(self, value: list, timer: int | None) -> None:
        if value[-1] is not None and value[-1] != timer:
            self.handle.deleteTimer(value[-1])
        if timer is not None and timer != value[-1]:
            self.handle.registerTimer(timer)
        value[-1] = timer
        self.job.update(tuple(value))

    def close(self) -> None:
        pass


def in_order(rows: Iterator[Row]) -> list[Row]:
    return sorted(rows, key=lambda r: (r.at, r.seq))


class StatusStream(Timed):
    """Events of a job: its first snapshot, then one for each change, `ping` every `heartbeat_ms` meanwhile, and `done` when
    the mapping has ended and no page is being scraped. After that the job is closed and further rows are ignored.

    Rows: job_id, at, seq, mapping, slug, status; a row changes the mapping's status, a page's status or both, null leaves
    them. An initial state (job_id, at, mapping, pages as a map) gives the snapshot that comes first.
    """

    fields = "mapping string, " + COUNTS + ", n long, next_ping long, sent boolean, closed boolean, timer long"
    start = (None, *[0] * len(PAGE_STATUSES), 0, None, False, False, None)
    MAPPING, COUNT, N, PING, SENT, CLOSED = 0, 1, len(PAGE_STATUSES) + 1, len(PAGE_STATUSES) + 2, len(PAGE_STATUSES) + 3, len(PAGE_STATUSES) + 4

    def __init__(self, heartbeat_ms: int = HEARTBEAT_MS):
        self.heartbeat_ms = heartbeat_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.pages = handle.getMapState("pages", "slug string", "status string")

    def _set_page(self, v: list, slug: str, status: str) -> bool:
        before = self.pages.getValue((slug,))[0] if self.pages.exists() and self.pages.containsKey((slug,)) else None
        if before == status or status not in PAGE_STATUSES:
            return False
        if before is not None:
            v[self.COUNT + PAGE_STATUSES.index(before)] -= 1
        v[self.COUNT + PAGE_STATUSES.index(status)] += 1
        self.pages.updateValue((slug,), (status,))
        return True

    def _event(self, job: str, v: list, at: int, event: str) -> Row:
        v[self.N] += 1
        held = [v[self.MAPPING], *v[self.COUNT : self.N]] if event == "status" else [None] * (len(PAGE_STATUSES) + 1)
        return StatusRow(job, v[self.N], at, event, *held)

    def _pings(self, job: str, v: list, until: int) -> Iterator[Row]:
        while not v[self.CLOSED] and v[self.PING] is not None and v[self.PING] <= until:
            yield self._event(job, v, v[self.PING], "ping")
            v[self.PING] += self.heartbeat_ms

    def _status(self, job: str, v: list, at: int) -> Iterator[Row]:
        yield self._event(job, v, at, "status")
        if not v[self.SENT]:
            v[self.SENT], v[self.PING] = True, at + self.heartbeat_ms
        if v[self.MAPPING] != "mapping" and not v[self.COUNT + PAGE_STATUSES.index("scraping")]:
            yield self._event(job, v, at, "done")
            v[self.CLOSED], v[self.PING] = True, None
            self.pages.clear()

    def _next(self, v: list) -> int | None:
        return None if v[self.CLOSED] else v[self.PING]

    def handleInitialState(self, key, initialState, timerValues):
        v = self.load()
        v[self.MAPPING] = initialState.mapping
        for slug, status in dict(initialState.pages or {}).items():  # pairs, as the engine hands it over
            self._set_page(v, slug, status)
        v[self.PING] = initialState.at  # the snapshot is due then, with or without rows
        self.store(v, initialState.at)

    def _first(self, job: str, v: list, until: int) -> Iterator[Row]:
        """The snapshot of an initial state, once its time has come."""
        if not v[self.SENT] and v[self.PING] is not None and v[self.PING] <= until:
            yield from self._status(job, v, v[self.PING])

    def handleInputRows(self, key, rows, timerValues):
        v, out = self.load(), []
        for r in in_order(rows):
            out += [*self._first(key[0], v, r.at), *self._pings(key[0], v, r.at)]
            if v[self.CLOSED]:
                break
            changed = r.mapping is not None and r.mapping != v[self.MAPPING]
            if changed:
                v[self.MAPPING] = r.mapping
            if r.slug is not None and r.status is not None:
                changed |= self._set_page(v, r.slug, r.status)
            if changed or not v[self.SENT]:
                out += self._status(key[0], v, r.at)
        self.store(v, self._next(v))
        yield from out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        v, now = self.load(), timerValues.getCurrentWatermarkInMs()
        v[-1] = None  # a timer that has fired is gone
        out = [*self._first(key[0], v, now), *self._pings(key[0], v, now)]
        self.store(v, self._next(v))
        yield from out


class Discovery(Timed):
    """Batches of a job's new URLs: each once, in order, BATCH at a time, up to `limit`.

    Rows: job_id, at, seq, type, url, with canonical URLs of the job's own host: `url` rows for the root and the sitemaps'
    URLs, `phase` with `crawl` for the change to links, `links` rows for what crawled pages link to, `round` after a
    group of crawled pages, and `end`. While sitemaps are read a batch goes out as soon as it is full; in the crawl it goes
    out after a round, whole. At the limit, and at the end, the rest goes out and the job is closed.
    """

    fields = "phase string, found long, n long, waiting long, closed boolean, timer long"
    start = ("sitemap", 0, 0, 0, False, None)

    def __init__(self, batch: int = BATCH, limit: int = LIMIT):
        self.batch, self.limit = batch, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.seen = handle.getMapState("seen", "url string", "first boolean")
        self.buffer = handle.getListState("buffer", "url string")

    def handleInputRows(self, key, rows, timerValues):
        phase, found, n, waiting, closed, _ = self.load()
        buffer = [r[0] for r in self.buffer.get()] if waiting else []
        held, out = len(buffer), []

        def flush(force: bool) -> None:
            nonlocal n, buffer
            if buffer and (force or len(buffer) >= self.batch):
                n += 1
                out.append(DiscoveredRow(key[0], n, "batch", phase, buffer))
                buffer = []

        for r in in_order(rows):
            if closed:
                break
            if r.type == "phase":
                n, phase = n + 1, r.url
                out.append(DiscoveredRow(key[0], n, "phase", phase, None))
            elif r.type in ("url", "links") and r.url is not None:
                if not (self.seen.exists() and self.seen.containsKey((r.url,))):
                    self.seen.updateValue((r.url,), (True,))
                    buffer.append(r.url)
                    found += 1
                if r.type == "url":
                    flush(False)
            elif r.type == "round":
                flush(False)
            if found >= self.limit or r.type == "end":
                flush(True)
                closed = True
                self.seen.clear()
        if buffer or held:
            self.buffer.put([(u,) for u in buffer]) if buffer else self.buffer.clear()
        self.store([phase, found, n, len(buffer), closed, None], None)
        yield from out


class Throttle(Timed):
    """Writes of a job's activity, at most one in `every_ms`, at once for a change of phase or a failed fetch.

    Rows: job_id, at, seq, type, phase, url, message. What is held back is written with the next row that may be written;
    with `trailing`, a timer writes it as soon as the interval has passed.
    """

    fields = "phase string, lastUrl string, fetchErrors long, lastError string, n long, written long, timer long"
    start = (None, None, 0, None, 0, None, None)

    def __init__(self, every_ms: int = WRITE_MS, trailing: bool = False):
        self.every_ms, self.trailing = every_ms, trailing

    def _write(self, job: str, v: list, at: int) -> Row:
        v[4], v[5] = v[4] + 1, at
        return WriteRow(job, v[4], at, *v[:4])

    def handleInputRows(self, key, rows, timerValues):
        v, out = self.load(), []
        due = v[-1]
        for r in in_order(rows):
            if due is not None and due <= r.at:
                out.append(self._write(key[0], v, due))
                due = None
            if r.type == "phase":
                v[0] = r.phase
            elif r.type == "fetching":
                v[1] = r.url
            elif r.type == "fetch-error":
                v[2], v[3] = v[2] + 1, f"{r.url}: {r.message}"
            else:
                continue
            if r.type != "fetching" or v[5] is None or r.at - v[5] >= self.every_ms:
                out.append(self._write(key[0], v, r.at))
                due = None
            elif self.trailing:
                due = v[5] + self.every_ms
        self.store(v, due)
        yield from out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        v = self.load()
        at, v[-1] = v[-1], None
        out = [self._write(key[0], v, at)] if at is not None else []
        self.store(v, None)
        yield from out


def _by_job(rows: DataFrame, processor: StatefulProcessor, schema: str, late_ms: int, initial=None) -> DataFrame:
    timed = rows.withColumn("time", F.timestamp_millis("at")).withWatermark("time", f"{late_ms} milliseconds")
    return timed.groupBy("job_id").transformWithState(processor, schema, "Append", "EventTime", initial)


def status_stream(changes: DataFrame, initial: DataFrame | None = None, heartbeat_ms: int = HEARTBEAT_MS, late_ms: int = 1) -> DataFrame:
    """A stream of status events from a stream of changes, and a table of the jobs' states before it."""
    return _by_job(changes, StatusStream(heartbeat_ms), STATUS_EVENT, late_ms, initial.groupBy("job_id") if initial is not None else None)


def discovery_stream(found: DataFrame, batch: int = BATCH, limit: int = LIMIT, late_ms: int = 1) -> DataFrame:
    """A stream of URL batches and phase changes from a stream of found URLs. URLs are put into canonical form."""
    own = found.withColumn("url", F.when(F.col("type").isin("url", "links"), F.coalesce(urls.canonicalize(F.col("url")), F.col("url"))).otherwise(F.col("url")))
    return _by_job(own, Discovery(batch, limit), DISCOVERED, late_ms)


def throttled_activity(events: DataFrame, every_ms: int = WRITE_MS, trailing: bool = False, late_ms: int = 1) -> DataFrame:
    """A stream of activity writes from a stream of crawl events."""
    return _by_job(events, Throttle(every_ms, trailing), WRITE, late_ms)
