"""The stream of files: bounded batches, restarts, replays, late and replaced files."""

import os
import struct
from pathlib import Path

from paceline.sources import fit
from paceline.streaming import ingest
from test_activities import fit_file


def file_of(heart_rate, n=3):
    rows = [(20, [(253, "I", 0x86, 1000 + k), (3, "B", 2, heart_rate)]) for k in range(n)]
    return fit_file([*rows, (18, [(253, "I", 0x86, 1000 + n), (2, "I", 0x86, 1000), (5, "B", 0, 1)])])


def rates(spark, target):
    found, failed = ingest.current(spark, target)
    out = {}
    for r in found.records.collect():
        out.setdefault(r["activity_id"].rsplit("/", 1)[1], []).append(r["heart_rate_bpm"])
    return out, {r["activity_id"].rsplit("/", 1)[1]: r["problem"]["kind"] for r in failed.collect()}


def test_ingest(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    os.mkdir(source)
    put = lambda name, data: Path(source, name).write_bytes(data)
    go = lambda: ingest.ingest(spark, source, target, checkpoint, files=2).awaitTermination(120)
    assert ingest.ledger(spark, target).count() == 0
    for k in range(4):
        put(f"{k}.fit", file_of(100 + k))
    put("bad.fit", b"no fit file")
    put("note.txt", b"x")
    go()
    first = {f"{k}.fit": [100 + k] * 3 for k in range(4)}, {"bad.fit": "no_header"}
    assert rates(spark, target) == first
    sizes = sorted(r["count"] for r in ingest.ledger(spark, target).groupBy("batch").count().collect())
    assert sizes == [1, 2, 2]  # two files of a trigger at most

    go()  # nothing is new
    assert ingest.ledger(spark, target).count() == 5 and ingest.refresh(spark, source, target) == 0

    last = max(Path(checkpoint, "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for p in (last, last.parent / f".{last.name}.crc"):
        p.unlink(missing_ok=True)
    go()  # the last batch is run again, as after a crash before its commit
    assert rates(spark, target) == first and ingest.ledger(spark, target).count() == 5

    put("late.FIT", file_of(90, 1))
    put("2.fit", file_of(150, 2))
    put("bad.fit", file_of(60))
    put("1.fit", b"broken now")
    for name in ("2.fit", "bad.fit", "1.fit"):
        os.utime(Path(source, name), (2_000_000_000, 2_000_000_000))
    go()
    assert rates(spark, target)[0]["late.FIT"] == [90] and rates(spark, target)[0]["2.fit"] == [102] * 3  # replaced files are no news to the stream
    assert ingest.refresh(spark, source, target, files=2) == 3 and ingest.refresh(spark, source, target) == 0
    assert rates(spark, target) == ({"0.fit": [100] * 3, "2.fit": [150] * 2, "3.fit": [103] * 3, "bad.fit": [60] * 3, "late.FIT": [90]}, {"1.fit": "no_header"})
    assert ingest.ledger(spark, target).count() == 9  # six files, three of them twice

    # a batch that ended before its part of the ledger isn't read
    a = fit.read_activities(spark, f"{source}/3.fit")[0]
    a.records.write.parquet(f"{target}/records/batch=s999999999999")
    assert rates(spark, target)[0]["3.fit"] == [103] * 3
