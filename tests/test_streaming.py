"""Following a log through appends, rotation and restarts."""

import datetime as dt
import gzip
import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from netquarry.operators import fold
from netquarry.sources import events
from netquarry.sources.landing import landed
from netquarry.streaming import state, tail, watch


def read_between(reader, start, end):
    """Lines of the ranges between two offsets, each read by itself, in the order of their places."""
    rows = [row for part in reader.partitions(start, end) for row in reader.read(part)]
    assert [seq for _, seq in rows] == sorted({seq for _, seq in rows})
    return [line for line, _ in rows]


def read_all(reader, offset):
    end = json.loads(json.dumps(reader.latestOffset()))
    return read_between(reader, offset, end), end


@pytest.fixture
def log(tmp_path):
    return str(tmp_path / "eve.json")


def write(path, text, mode="a"):
    with open(path, mode, newline="") as file:
        file.write(text)


def test_appends_partial_lines_and_line_ends(log):
    reader = tail.TailReader({"path": log})
    got, at = read_all(reader, reader.initialOffset())
    assert got == []
    write(log, "one\r\ntwo\nthr")
    got, at = read_all(reader, at)
    assert got == ["one", "two"]
    assert read_all(reader, at) == ([], at)
    write(log, "ee\n")
    got, after = read_all(reader, at)
    assert got == ["three"]
    assert read_between(reader, at, after) == ["three"]


def test_rename(log):
    reader = tail.TailReader({"path": log})
    write(log, "a\nb\n")
    _, at = read_all(reader, reader.initialOffset())
    write(log, "c\n")
    os.rename(log, log + ".1")
    time.sleep(0.02)
    write(log, "d\n")
    got, after = read_all(reader, at)
    assert got == ["c", "d"]
    assert read_between(reader, at, after) == ["c", "d"]
    write(log, "e\n")
    assert read_all(reader, after)[0] == ["e"]


@pytest.mark.parametrize("most", ["5", "12", "30", "40", "1000"])
@pytest.mark.parametrize("packed", [(), (1,), (2, 3, 4)])
def test_several_rotations(log, most, packed):
    """Files between the one that was read and the current one are read whole, in parts, empty or compressed."""
    reader = tail.TailReader({"path": log, "rangebytes": most})
    write(log, "a\nb\n")
    _, at = read_all(reader, reader.initialOffset())
    want = [*(f"first {k}" for k in range(3)), *(f"middle {k}" for k in range(9)), "end without", "x" * 60, "last", "now"]
    for name, text in ((".4", "a\nb\n" + "".join(f"first {k}\n" for k in range(3))), (".3", "".join(f"middle {k}\n" for k in range(9)) + "end without"), (".2", ""), (".1", "x" * 60 + "\nlast\n"), ("", "now\n")):
        write(log + name, text, "w")
        time.sleep(0.02)
    for k in packed:
        changed = os.stat(f"{log}.{k}").st_mtime_ns
        with open(f"{log}.{k}", "rb") as file, gzip.open(f"{log}.{k}.gz", "wb") as out:
            out.write(file.read())
        os.remove(f"{log}.{k}")
        os.utime(f"{log}.{k}.gz", ns=(changed, changed))
    write(f"{log}.3.gz", "not yet whole") if 3 not in packed else None
    got = []
    for _ in range(40):
        rows, after = read_all(reader, at)
        assert read_between(reader, at, after) == rows
        got, at = got + rows, after
    assert got == want
    write(log, "more\n")
    assert read_all(reader, at)[0] == ["more"]


def test_truncated_in_place(log):
    reader = tail.TailReader({"path": log})
    write(log, "first line\nsecond line\n")
    _, at = read_all(reader, reader.initialOffset())
    write(log, "new\n", "w")
    assert read_all(reader, at)[0] == ["new"]


def test_missing_for_a_while(log):
    reader = tail.TailReader({"path": log})
    write(log, "x\n")
    _, at = read_all(reader, reader.initialOffset())
    os.remove(log)
    got, at = read_all(reader, at)
    assert got == []
    write(log, "y\nz\n")
    assert read_all(reader, at)[0] == ["y", "z"]


def test_batches_and_long_lines(log, monkeypatch):
    monkeypatch.setattr(tail, "LINE_BYTES", 50)
    write(log, "".join(f"line {k}\n" for k in range(30)) + "y" * 60 + "\nend\n")
    reader, got, at = tail.TailReader({"path": log, "rangebytes": "100"}), [], None
    at = reader.initialOffset()
    for _ in range(10):
        rows, at = read_all(reader, at)
        got += rows
    assert got == [f"line {k}" for k in range(30)] + ["end"]


def flow(src, dest, hour, **more):
    return json.dumps({"timestamp": f"2026-07-30T{hour:02d}:00:00Z", "event_type": "flow", "src_ip": src, "dest_ip": dest, "dest_port": 22, "proto": "TCP", **more}) + "\n"


def test_watch(spark, tmp_path, log):
    """Rotated files are taken in, a restart counts nothing twice, changes are told once, silent devices go."""
    now = dt.datetime(2026, 7, 30, 12, tzinfo=dt.UTC)
    state, changes, snap, page = (str(tmp_path / n) for n in ("state", "changes.jsonl", "snap.json", "report.html"))
    out = watch.Outputs(html=page, snapshot=snap, changes=changes, on_change=f"cat > {tmp_path}/told")
    write(log + ".1", flow("10.0.0.1", "10.0.0.2", 1))
    write(log, flow("10.0.0.1", "10.0.0.3", 9) * 3)
    run = lambda: watch.Watch(spark, state).run(log, out, once=True, clock=lambda: now).awaitTermination()
    run()
    first = json.load(open(snap))
    assert [d["ip"] for d in first["devices"]] == ["10.0.0.1", "10.0.0.2", "10.0.0.3"] and first["events"] == 4
    assert not os.path.exists(changes) and "10.0.0.3" in open(page).read()
    write(log, flow("10.0.0.1", "10.0.0.4", 10))
    run()
    assert json.load(open(snap))["events"] == 5
    told = [json.loads(x) for x in open(changes)]
    assert [d["ip"] for d in told[0]["appeared"]] == ["10.0.0.4"] and len(told) == 1
    assert "10.0.0.4" in open(tmp_path / "told").read()
    run()  # nothing came: nothing is written or told
    assert len(open(changes).readlines()) == 1
    kept = watch.Watch(spark, state, retain=dt.timedelta(hours=5)).inventory(now)
    assert sorted(r["ip"] for r in kept.devices.collect()) == ["10.0.0.1", "10.0.0.3", "10.0.0.4"]
    with open(f"{state}/manifest-000000999999.json", "w") as file:
        file.write('{"version": 99}')
    with pytest.raises(watch.StateError):
        watch.Watch(spark, state)
    with pytest.raises(ValueError):
        watch.Watch(spark, str(tmp_path / "other")).run(log, watch.Outputs())


def test_ranges_read_by_executors(spark, tmp_path, log):
    """The source as Spark runs it: many ranges a batch, rotation between two runs, a restart in between."""
    write(log, "".join(f"line {k}\n" for k in range(500)) + "half")
    got = []

    def run(size):
        lines = tail.follow(spark, log, tail.begin(log), size)
        lines.writeStream.foreachBatch(lambda df, n: got.append((df.rdd.getNumPartitions(), [r["line"] for r in df.orderBy("seq").collect()]))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()

    run(100)
    assert got[0][0] > 8 and got[0][1] == [f"line {k}" for k in range(500)]
    write(log, " more\nlast")
    os.rename(log, log + ".1")
    time.sleep(0.02)
    write(log, "new\n")
    run(1 << 20)
    assert got[1][1] == ["half more", "last", "new"] and len(got) == 2


def test_turns(log):
    """Renamed, cut off in place, both between two polls, and neither."""
    reader = tail.TailReader({"path": log})
    write(log, "a" * 300 + "\n")
    start = reader.initialOffset()
    first = reader.latestOffset()
    assert tail.turns(start, first) == (0, 0)
    write(log, "b\n")
    second = reader.latestOffset()
    assert tail.turns(first, second) == (0, 0)
    os.rename(log, log + ".1")
    time.sleep(0.02)
    write(log, "c" * 300 + "\n")
    third = reader.latestOffset()
    assert tail.turns(second, third) == (1, 0)
    write(log, "d\n", "w")
    fourth = reader.latestOffset()
    assert tail.turns(third, fourth) == (0, 1)
    write(log, "d" * 400 + "\n", "w")
    os.rename(log, log + ".0")
    time.sleep(0.02)
    write(log, "e" * 300 + "\n")
    os.rename(log, log + ".00")
    time.sleep(0.02)
    write(log, "f\n")
    assert tail.turns(fourth, reader.latestOffset()) == (2, 0)


def test_renamed_before_the_first_poll(log):
    """What is renamed between the listing of old files and the first poll is read."""
    write(log, "one\ntwo\n")
    start = tail.begin(log)
    os.rename(log, log + ".1")
    time.sleep(0.02)
    write(log, "three\n")
    assert read_all(tail.TailReader({"path": log, "begin": json.dumps(start)}), start)[0] == ["one", "two", "three"]


def sample(rng, n):
    """Events of all kinds of facts: presence, names, services, findings, crossings, counters, certificates."""
    hosts = [f"10.0.{rng.randrange(3)}.{k}" for k in range(12)]
    out = []
    for _ in range(n):
        a, b = rng.choice(hosts), rng.choice([*hosts, "8.8.8.8", "9.9.9.9"])
        head = {"timestamp": f"2026-07-{rng.randrange(26, 31)}T{rng.randrange(24):02d}:{rng.randrange(60):02d}:00Z", "src_ip": a, "dest_ip": b}
        kind = rng.choice(["flow", "flow", "dhcp", "tls", "http", "krb5", "stats", "snmp", "alert", "smb", "mystery"])
        more = {
            "flow": {"dest_port": rng.choice([22, 80, 443]), "proto": rng.choice(["TCP", "UDP"]), "app_proto": rng.choice(["ssh", "http", "failed", ""])},
            "dhcp": {"dhcp": {"assigned_ip": a, "client_mac": f"00:80:77:31:01:{rng.randrange(4):02x}", "hostname": rng.choice(["BRN1", "pc-2"])}},
            "tls": {"tls": {"subject": "CN=x", "issuerdn": rng.choice(["CN=x", "CN=y"]), "notafter": rng.choice(["2026-08-11T00:00:00", "2026-01-01"]), "version": rng.choice(["TLSv1", "TLS 1.3"]), "ja4": "t10d1516h2_a_b"}},
            "http": {"http": {"http_user_agent": rng.choice(["Mozilla (Windows NT 6.1)", "curl"]), "hostname": "h.example"}},
            "krb5": {"krb5": {"cname": rng.choice(["Ann", "Bob", "PC$"]), "encryption": "rc4-hmac"}},
            "stats": {"stats": {"uptime": rng.randrange(9), "capture": {"kernel_packets": rng.choice([0, 100, 1000]), "kernel_drops": rng.randrange(30)}}},
            "snmp": {"snmp": {"sysdescr": rng.choice(["Cisco IOS", "HP x"]), "version": "2c", "community": ["public"]}},
            "alert": {"alert": {"severity": 1, "signature": rng.choice(["Bad", "Worse"])}},
            "smb": {"smb": {"ntlmssp": {"user": "Ann", "host": "WS"}, "dialect": "2.1", "share": "c"}},
        }.get(kind, {})
        out.append(json.dumps(head | {"event_type": kind} | more))
    return out


def gold(found):
    """All gold tables as comparable rows."""
    found.devices, found.findings = (landed(getattr(found, n), n) for n in ("devices", "findings"))
    one = lambda df: sorted((json.dumps(r.asDict(recursive=True), default=str, sort_keys=True) for r in df.collect()))
    return {n: one(getattr(found, n)) for n in ("devices", "findings", "identities", "event_counts", "extent", "sensor_health", "winners")}


NOW = dt.datetime(2026, 7, 31, tzinfo=dt.UTC)


def facts_of(spark, rows):
    made = landed(events.events(events.records(spark.createDataFrame(rows, "line string, seq bigint"))), "events")
    return made, landed(watch.facts_of(made).coalesce(1), "facts")


def test_merged_is_recomputed(spark, tmp_path):
    """Twenty batches in any order, read back by another run in between, against all events at once."""
    rng = random.Random(3)
    whole, facts = facts_of(spark, [(line, k) for k, line in enumerate(sample(rng, 400))])
    parts, order = watch.Watch(spark, str(tmp_path / "parts")), rng.sample(range(20), 20)
    for k, batch in enumerate(order):
        some = facts.where(F.col("seq").between(batch * 20, batch * 20 + 19))
        assert parts.kept.add(f"batch {batch}", some, 20, 0)
        if k in (4, 17):
            parts = watch.Watch(spark, str(tmp_path / "parts"))  # another run goes on with what this one kept
            assert not parts.kept.add(f"batch {batch}", some, 20, 0)
    assert len(parts.kept.manifest["batches"]) == 4  # the others were merged
    plain = watch.Inventory(None, NOW)
    plain.folded, plain.events = landed(fold.fold(facts.where(~F.col("fact").isin(*fold.COMMON))), "folded"), whole
    assert gold(parts.inventory(NOW)) == gold(plain)
    assert parts.counts()["total"] == 400


def test_state_of_numbered_batches(spark, tmp_path):
    kept = state.State(spark, str(tmp_path / "s"))
    _, one = facts_of(spark, [(flow("10.0.0.1", "10.0.0.2", 1), 0)])
    assert kept.add("new-0", one) and kept.add("new-1", one) and not kept.add("new-1", one) and not kept.add("new-0", one)
    other = state.State(spark, str(tmp_path / "s"))
    assert other.has("new-1") and not other.has("new-2") and other.folded().where("fact = 'service'").first()["n"] == 2
    assert kept.add("new-2", one)
    with pytest.raises(state.StateError):  # of two writers one fails
        other.add("new-2", one)
    os.makedirs(tmp_path / "old")
    with open(tmp_path / "old" / "meta.json", "w") as file:
        file.write('{"version": 1}')
    with pytest.raises(state.StateError):
        state.State(spark, str(tmp_path / "old"))


def test_retention_on_disk(spark, tmp_path):
    """Days and silent devices go from disk; what stays is what a model of all would keep; a reader that began before sees one version."""
    rng = random.Random(8)
    rows = [(line, k) for k, line in enumerate(sample(rng, 300))]
    rows += [(flow("10.0.2.200", "10.0.2.201", 3).replace("07-30", "07-26"), 400 + k) for k in range(50)]
    kept, (_, facts) = state.State(spark, str(tmp_path / "s")), facts_of(spark, rows)
    for low, high in ((0, 150), (150, 420), (420, 500)):
        kept.add(f"b{low}", facts.where(F.col("seq").between(low, high - 1)))
    kept.compact()
    before, reader = dt.datetime(2026, 7, 29, 7, 30, tzinfo=dt.UTC), kept.folded()
    had, parts = reader.count(), set(kept.manifest["parts"])
    keys = lambda df: sorted(map(str, df.select(*fold.KEYS, "n", "first_ts", "last_ts").collect()))
    want = keys(fold.retained(kept.folded(), before))
    assert kept.retain(before) >= 2 and keys(kept.folded()) == want
    assert reader.count() == had
    assert not [p for p in set(kept.manifest["parts"]) & parts if p[0] == "d" and int(p[1:]) < 20663] and not kept.folded().where("ip = '10.0.2.200'").count()
    size = kept.store.size()
    for _ in range(state.MANIFESTS):
        kept.set_baseline("x")
    assert kept.store.size() < size and keys(state.State(spark, str(tmp_path / "s")).folded()) == want
    assert kept.retain(before) == 0 and keys(kept.folded()) == want


def test_clock(spark, tmp_path, log, monkeypatch):
    """One line, then silence: the report comes within its time, the change within its own; nothing is rewritten after that."""
    out, seen, told = watch.Outputs(snapshot="x"), watch.Watch(spark, str(tmp_path / "state")), []
    monkeypatch.setattr(seen, "inventory", lambda now: None)
    monkeypatch.setattr(seen, "refresh", lambda now, *_: told.append("write"))
    monkeypatch.setattr(seen, "report", lambda now, *_: told.append("notify"))
    at = [dt.datetime(2026, 7, 30, 12, tzinfo=dt.UTC)]
    write(log, flow("10.0.0.1", "10.0.0.2", 9))
    query = seen.run(log, out, every=60, poll=0.2, notify=600, clock=lambda: at[0])

    def wait(until, seconds=120):
        end = time.time() + seconds
        while not until() and time.time() < end:
            time.sleep(0.1)
        return until()

    assert wait(lambda: told == ["write", "notify"])
    write(log, flow("10.0.0.1", "10.0.0.3", 10) + "not a record\n")
    assert wait(lambda: seen.counts()["total"] == 3) and told == ["write", "notify"]  # not due yet
    at[0] += dt.timedelta(seconds=61)
    assert wait(lambda: told == ["write", "notify", "write"])
    at[0] += dt.timedelta(seconds=600)
    assert wait(lambda: told == ["write", "notify", "write", "notify"])
    at[0] += dt.timedelta(hours=5)
    time.sleep(1.5)
    assert len(told) == 4 and seen.counts() == {"total": 3, "skipped": 1, "rotations": 0, "truncations": 0}
    os.rename(log, log + ".1")
    time.sleep(0.02)
    write(log, flow("10.0.0.1", "10.0.0.4", 11))
    assert wait(lambda: seen.counts()["rotations"] == 1)
    write(log, "\n", "w")
    assert wait(lambda: seen.counts()["truncations"] == 1)
    assert query.isActive
    seen.stop(query, log, out, at[0])
    assert seen.counts()["total"] == 4


def test_catch_up_by_content(spark, tmp_path, log):
    """A catch-up that broke off counts no file twice, whatever became of the others' places."""
    write(log + ".1", flow("10.0.0.1", "10.0.0.2", 1))
    time.sleep(0.02)
    write(log + ".2", flow("10.0.0.1", "10.0.0.3", 2))
    seen = watch.Watch(spark, str(tmp_path / "state"))
    assert seen.catch_up(log) == []
    os.remove(log + ".1")
    assert watch.Watch(spark, str(tmp_path / "state")).catch_up(log) == []
    assert watch.Watch(spark, str(tmp_path / "state")).counts()["total"] == 2
