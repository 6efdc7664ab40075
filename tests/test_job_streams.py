"""Status, discovery and activity streams against plain loops over the same rows, whatever the micro-batches."""

import random

import pytest
from pyspark.sql import Row

from pagewright.schemas import PAGE_STATUSES
from pagewright.streaming import jobs

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def replay(spark, tmp_path, name, rows, schema, make, files):
    """Rows as a stream of `files` micro-batches in order of time, through the engine."""
    rows = sorted(rows, key=lambda r: (r[1], r[2]))
    for i in range(files):
        part = rows[i * len(rows) // files : (i + 1) * len(rows) // files]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}/in")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
        run = make(stream).writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/{name}/out").option("checkpointLocation", f"{tmp_path}/{name}/c").trigger(availableNow=True).start()
        assert run.awaitTermination(240)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.parquet(f"{tmp_path}/{name}/out").collect()


class Store:
    """State and timers of one key in plain Python, for a processor without the engine."""

    def __init__(self):
        self.values, self.timers = {}, set()
        self.registerTimer, self.deleteTimer = self.timers.add, self.timers.remove

    def getValueState(self, name, schema):
        return Value(self.values, name)

    getMapState = lambda self, name, key, value: Map()
    getListState = lambda self, name, schema: List()


class Value:
    def __init__(self, values, name):
        self.values, self.name = values, name

    def exists(self):
        return self.name in self.values

    def get(self):
        return self.values[self.name]

    def update(self, value):
        self.values[self.name] = value


class Map:
    def __init__(self):
        self.held = {}

    exists = lambda self: bool(self.held)
    containsKey = lambda self, k: k in self.held
    getValue = lambda self, k: self.held[k]
    updateValue = lambda self, k, v: self.held.__setitem__(k, v)
    clear = lambda self: self.held.clear()


class List:
    def __init__(self):
        self.held = []

    get = lambda self: iter(self.held)
    put = lambda self, v: setattr(self, "held", list(v))
    clear = lambda self: self.held.clear()


class Clock:
    def __init__(self, at):
        self.getCurrentWatermarkInMs = lambda: at


def drive(make, rows, names, cuts, initial=None, until=None):
    """Feed a processor one job's rows in batches; between batches the watermark passes what came, and timers fire."""
    store, processor, out = Store(), make(), []
    processor.init(store)
    row = Row(*names)
    if initial is not None:
        processor.handleInitialState((initial.job_id,), initial, Clock(0))

    def fire(watermark):
        while due := sorted(t for t in store.timers if t <= watermark):
            store.timers.discard(due[0])
            out.extend(processor.handleExpiredTimer(("j",), Clock(watermark), None))

    rows = sorted(rows, key=lambda r: (r[1], r[2]))
    bounds = [0, *sorted(cuts), len(rows)]
    for a, b in zip(bounds, bounds[1:]):
        if a < b:
            batch = [row(*r) for r in rows[a:b]]
            random.Random(a).shuffle(batch)
            out.extend(processor.handleInputRows(("j",), iter(batch), Clock(0)))
            assert len(store.timers) <= 1
            fire(rows[b - 1][1])
    if until:
        fire(until)
    return [tuple(r) for r in out], store


# Status

CHANGE = "job_id string, at long, seq long, mapping string, slug string, status string"
CHANGES = ["job_id", "at", "seq", "mapping", "slug", "status"]


def changes(seed, n=120, job="j"):
    rng = random.Random(seed)
    rows, at = [(job, 1000, 0, "mapping", None, None)], 1000
    for i in range(1, n):
        at += rng.choice([0, 10, 400, 9_000, 40_000])
        slug, status = (f"p{rng.randrange(12)}", rng.choice([*PAGE_STATUSES, "scraping"])) if rng.random() < 0.9 else (None, None)
        rows.append((job, at, i, "mapped" if i == n // 2 else None, slug, status))
    return rows


def plain_status(rows, heartbeat=15_000, initial=None, until=None):
    out, pages, mapping, ping, closed = [], {}, None, None, False

    def status(at):
        nonlocal ping, closed
        counts = tuple(sum(s == x for s in pages.values()) for x in PAGE_STATUSES)
        out.append((at, "status", mapping, counts))
        if ping is None:
            ping = at + heartbeat
        if mapping != "mapping" and not counts[PAGE_STATUSES.index("scraping")]:
            out.append((at, "done", None, None))
            closed = True

    def pings(upto):
        nonlocal ping
        while ping is not None and ping <= upto and not closed:
            out.append((ping, "ping", None, None))
            ping += heartbeat

    if initial:
        at, mapping, pages = initial[0], initial[1], dict(initial[2])
        status(at)
    for _, at, _, new, slug, state in sorted(rows, key=lambda r: (r[1], r[2])):
        if closed:
            break
        pings(at)
        before = (mapping, dict(pages))
        mapping = new or mapping
        if slug:
            pages[slug] = state
        if before != (mapping, pages) or not any(e[1] == "status" for e in out):
            status(at)
    if until and not closed:
        pings(until)
    return [("j", i + 1, at, event, m, *(c or [None] * len(PAGE_STATUSES))) for i, (at, event, m, c) in enumerate(out)]


@pytest.mark.parametrize("seed", range(12))
def test_status_events_equal_a_plain_fold(seed):
    rows, rng = changes(seed), random.Random(seed)
    end = rows[-1][1] + 50_000
    want = plain_status(rows, until=end)
    for cuts in ([], rng.sample(range(1, 119), 5), range(1, 119)):
        got, store = drive(jobs.StatusStream, rows, CHANGES, cuts, until=end)
        assert got == want
    if want[-1][3] == "done":
        assert not store.timers  # a closed job has no heartbeat
    first = Row(job_id="j", at=500, mapping="mapping", pages={"p1": "pending", "p99": "scraping"})
    want = plain_status(rows, initial=(500, "mapping", first.pages), until=end)
    assert drive(jobs.StatusStream, rows, CHANGES, rng.sample(range(1, 119), 3), first, end)[0] == want
    quiet, _ = drive(jobs.StatusStream, [], CHANGES, [], first, 40_000)
    assert quiet == plain_status([], initial=(500, "mapping", first.pages), until=40_000)
    ended = Row(job_id="j", at=500, mapping="mapped", pages={"p1": "pending"})
    assert [e[3] for e in drive(jobs.StatusStream, rows, CHANGES, [], ended, end)[0]] == ["status", "done"]


def test_status_stream_through_the_engine(spark, tmp_path):
    rows = changes(3, 60)
    initial = spark.createDataFrame([("j", 500, "mapping", {"p1": "pending"}), ("k", 600, "mapped", {"x": "failed"})], "job_id string, at long, mapping string, pages map<string,string>")
    got = replay(spark, tmp_path, "status", rows, CHANGE, lambda s: jobs.status_stream(s, initial), 3)
    want = plain_status(rows, initial=(500, "mapping", {"p1": "pending"}))
    found = sorted((tuple(r) for r in got if r.job_id == "j"), key=lambda r: r[1])
    assert found[: len(want)] == want and {r[3] for r in found[len(want) :]} <= {"ping"}
    assert [(r.event, r.failed) for r in sorted((r for r in got if r.job_id == "k"), key=lambda r: r.n)] == [("status", 1), ("done", None)]


# Discovery

FOUND = ["job_id", "at", "seq", "type", "url"]


def found_rows(seed, n=300):
    rng = random.Random(seed)
    rows = [("j", 1, 0, "url", "https://a.de/")] + [("j", i, i, "url", f"https://a.de/{rng.randrange(90)}") for i in range(1, n // 2)] + [("j", n // 2, n // 2, "phase", "crawl")]
    for i in range(n // 2 + 1, n):
        rows.append(("j", i, i, "links", f"https://a.de/{rng.randrange(250)}") if i % 9 else ("j", i, i, "round", None))
    return [*rows, ("j", n, n, "end", None), ("j", n + 1, n + 1, "links", "https://a.de/late")]


def plain_discovery(rows, batch=25, limit=5000):
    out, seen, buffer, phase = [], set(), [], "sitemap"

    def flush(force=False):
        nonlocal buffer
        if buffer and (force or len(buffer) >= batch):
            out.append(("batch", phase, buffer))
            buffer = []

    for _, _, _, kind, url in rows:
        if kind == "phase":
            phase = url
            out.append(("phase", phase, None))
        elif kind in ("url", "links") and url not in seen:
            seen.add(url)
            buffer.append(url)
        if kind in ("url", "round"):
            flush()
        if len(seen) >= limit or kind == "end":
            flush(True)
            break
    return [("j", i + 1, *e) for i, e in enumerate(out)]


@pytest.mark.parametrize("limit", [5000, 60, 110, 1])
def test_discovery_batches_equal_a_plain_loop(limit):
    for seed in range(6):
        rows, rng = found_rows(seed), random.Random(seed)
        want = plain_discovery(rows, limit=limit)
        for cuts in ([], rng.sample(range(1, 299), 7), range(1, 300)):
            assert drive(lambda: jobs.Discovery(limit=limit), rows, FOUND, cuts)[0] == want
        sizes = [len(e[4]) for e in want if e[2] == "batch" and e[3] == "sitemap"]
        assert all(n == 25 for n in sizes[:-1]) and sum(len(e[4] or []) for e in want) == min(limit, len({r[4] for r in rows[:-2] if r[3] in ("url", "links")}))


def test_discovery_stream_through_the_engine(spark, tmp_path):
    rows = found_rows(1, 120)
    got = replay(spark, tmp_path, "found", rows, "job_id string, at long, seq long, type string, url string", lambda s: jobs.discovery_stream(s, limit=70), 3)
    assert [tuple(r) for r in sorted(got, key=lambda r: r.n)] == plain_discovery(rows, limit=70)


# Activity

EVENTS = ["job_id", "at", "seq", "type", "phase", "url", "message"]


def activity_rows(seed, n=150):
    rng, at, rows = random.Random(seed), 1, []
    for i in range(n):
        at += rng.choice([0, 1, 90, 300, 999, 1000, 4000])
        kind = rng.choices(["fetching", "fetch-error", "phase", "other"], [30, 2, 1, 2])[0]
        rows.append(("j", at, i, kind, "crawl" if kind == "phase" else None, f"u{i}", "HTTP 500" if kind == "fetch-error" else None))
    return rows


def plain_writes(rows, every=1000, trailing=False, until=None):
    out, state, last, dirty = [], [None, None, 0, None], None, False
    for _, at, _, kind, phase, url, message in [*rows, (None, until or 0, None, "stop", None, None, None)]:
        if trailing and dirty and at >= last + every:
            last, dirty = last + every, False
            out.append((last, *state))
        if kind == "phase":
            state[0] = phase
        elif kind == "fetching":
            state[1] = url
        elif kind == "fetch-error":
            state[2], state[3] = state[2] + 1, f"{url}: {message}"
        else:
            continue
        dirty = True
        if kind != "fetching" or last is None or at - last >= every:
            last, dirty = at, False
            out.append((at, *state))
    return [("j", i + 1, *e) for i, e in enumerate(out)]


@pytest.mark.parametrize("trailing", [False, True])
def test_throttled_writes_equal_a_plain_loop(trailing):
    for seed in range(8):
        rows, rng = activity_rows(seed), random.Random(seed)
        end = rows[-1][1] + 5000
        want = plain_writes(rows, trailing=trailing, until=end)
        for cuts in ([], rng.sample(range(1, 149), 6), range(1, 149)):
            assert drive(lambda: jobs.Throttle(trailing=trailing), rows, EVENTS, cuts, until=end)[0] == want
        forced = {r[1] for r in rows if r[3] in ("phase", "fetch-error")}
        assert all(b - a >= 1000 or b in forced for a, b in zip([e[2] for e in want], [e[2] for e in want[1:]]))


def test_throttled_activity_through_the_engine(spark, tmp_path):
    rows = activity_rows(2, 80)
    schema = "job_id string, at long, seq long, type string, phase string, url string, message string"
    got = replay(spark, tmp_path, "writes", rows, schema, lambda s: jobs.throttled_activity(s, trailing=True), 3)
    want = plain_writes(rows, trailing=True, until=rows[-1][1] - 1)
    assert [tuple(r) for r in sorted(got, key=lambda r: r.n)] == want
