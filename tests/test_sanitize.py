"""Rewritten FIT files decode to the allowed messages with moved times."""

import struct

import pytest

from paceline.sources import errors, fit, sanitize
from test_activities import fit_file

ROWS = [
    (0, [(0, "B", 0, 4), (3, "I", 0x8C, 12345), (4, "I", 0x86, 1000)]), (18, [(253, "I", 0x86, 1100), (2, "I", 0x86, 1000), (5, "B", 0, 1), (200, "B", 2, 7)]), (99, [(0, "B", 0, 1)]),
    (20, [(253, "I", 0x86, 1001), (0, "i", 0x85, 55), (3, "B", 2, 150)]), (20, [(253, "I", 0x86, 0xFFFFFFFF), (3, "B", 2, 151)]),
]


def test_sanitize_bytes():
    data, kept, removed, fields = sanitize.sanitize(fit_file(ROWS), 5000)
    assert (kept, removed, fields) == (4, 1, 2)
    found = list(fit.decode(data))
    assert [m for m, _, _ in found] == ["session", "record", "record"]
    assert (found[0][1]["timestamp"], found[0][1]["start_time"], found[1][1]["timestamp"], found[1][1]["position_lat"]) == (5100, 5000, 5001, 55)
    assert "timestamp" not in found[2][1] and b"\x39\x30\x00\x00" not in data
    with pytest.raises(ValueError):
        sanitize.sanitize(fit_file([(20, [(3, "B", 2, 1)])]), 5000)
    with pytest.raises(ValueError):
        sanitize.Policy(remove_developer=False)


def test_compressed_timestamps():
    body = struct.pack("<BBBHB", 0x40, 0, 0, 20, 2) + bytes([253, 4, 0x86, 3, 1, 2]) + b"\0" + struct.pack("<IB", 1000, 140)
    body += struct.pack("<BBBHB", 0x41, 0, 0, 20, 1) + bytes([3, 1, 2]) + bytes([0x80 | 1 << 5 | (1003 & 0x1F), 141])
    head = struct.pack("<BBHI4s", 14, 16, 2100, len(body), b".FIT")
    head += struct.pack("<H", fit.crc16(head))
    data = sanitize.sanitize(head + body + struct.pack("<H", fit.crc16(head + body)), 2000)[0]
    assert [(n["timestamp"], n["heart_rate"]) for _, n, _ in fit.decode(data)] == [(2000, 140), (2003, 141)]


def test_sanitized_files(spark, tmp_path):
    (tmp_path / "a.fit").write_bytes(fit_file(ROWS))
    (tmp_path / "b.fit").write_bytes(b"bad")
    found = {r["path"][-5:]: r for r in sanitize.sanitized(spark, str(tmp_path), 5000).collect()}
    assert found["a.fit"]["messages_kept"] == 4 and found["a.fit"]["error"] is None and found["b.fit"]["error"].startswith("invalid")


def body(*parts):
    """A file of definitions (local, number, fields as number, size, base) and data (header byte, packed bytes)."""
    data = b"".join(struct.pack("<BBBHB", 0x40 | p[0], 0, 0, p[1], len(p[2])) + b"".join(map(bytes, p[2])) if isinstance(p[1], int) else bytes([p[0]]) + p[1] for p in parts)
    head = struct.pack("<BBHI4s", 14, 16, 2100, len(data), b".FIT")
    head += struct.pack("<H", fit.crc16(head))
    return head + data + struct.pack("<H", fit.crc16(head + data))


def test_compressed_headers_stay_byte_for_byte():
    plain, packed = [(253, 4, 0x86), (3, 1, 2)], [(3, 1, 2)]
    stamp = lambda t, hr: struct.pack("<IB", t, hr)
    source = body((0, 20, plain), (0, stamp(1000, 140)), (1, 20, packed), (0x80 | 1 << 5 | 1003 & 31, b"\x8d"), (0x80 | 1 << 5 | 1034 & 31, b"\x8e"), (0x80 | 1 << 5 | 1034 & 31, b"\x8f"), (0x80 | 1 << 5 | 1040 & 31, b"\x90"))
    # moved by 1,017 s the five bits are others and roll over elsewhere
    expected = body((0, 20, plain), (0, stamp(2017, 140)), (1, 20, packed), (0x80 | 1 << 5 | 2020 & 31, b"\x8d"), (0x80 | 1 << 5 | 2051 & 31, b"\x8e"), (0x80 | 1 << 5 | 2051 & 31, b"\x8f"), (0x80 | 1 << 5 | 2057 & 31, b"\x90"))
    assert sanitize.sanitize(source, 2017) == (expected, 5, 0, 0)


def test_compressed_headers_become_plain_where_their_time_is_gone():
    plain, packed = [(253, 4, 0x86), (3, 1, 2)], [(3, 1, 2)]
    # the first time is in a message that is dropped; later a dropped one is more than 31 s ahead of the copy's time
    source = body((0, 99, [(253, 4, 0x86)]), (0, struct.pack("<I", 1000)), (1, 20, packed), (0xA0 | 1005 & 31, b"\x8c"), (0xA0 | 1009 & 31, b"\x8d"), (0, struct.pack("<I", 1090)), (0xA0 | 1091 & 31, b"\x8e"), (0xA0 | 1092 & 31, b"\x8f"))
    late = [(3, 1, 2), (253, 4, 0x86)]
    value = lambda t, hr: struct.pack("<BI", hr, t)
    expected = body((1, 20, late), (1, value(2000, 140)), (1, 20, packed), (0xA0 | 2004 & 31, b"\x8d"), (1, 20, late), (1, value(2086, 142)), (1, 20, packed), (0xA0 | 2087 & 31, b"\x8f"))
    data, kept, removed, fields = sanitize.sanitize(source, 2000)
    assert data == expected and (kept, removed, fields) == (4, 2, 0)
    assert [n["timestamp"] for _, n, _ in fit.decode(data)] == [2000, 2004, 2086, 2087]
    with pytest.raises(ValueError):
        sanitize.sanitize(body((1, 20, packed), (0xA0 | 5, b"\x8c")), 2000)
    assert not sanitize.packs(1000, 1032) and sanitize.packs(1000, 1031) and not sanitize.packs(1000, 999) and not sanitize.packs(None, 5)


def damaged(folder):
    whole = fit_file(ROWS)
    bent = bytearray(body((0, 20, [(3, 1, 2)]), (0, b"\x01"), (7, b"\x01")))
    several = fit_file([ROWS[1], ROWS[1]])
    files = {
        "no_header": b"not a fit file at all", "empty_body": struct.pack("<BBHI4s", 14, 16, 2100, 0, b".FIT") + b"\0\0\0\0", "truncated": whole[:-9], "wrong_checksum": whole[:40] + bytes([whole[40] ^ 1]) + whole[41:],
        "malformed": bytes(bent), "several_sessions": several, "no_messages": body((0, 99, [(0, 1, 2)]), (0, b"\x01")),
    }
    for name, data in files.items():
        (folder / f"{name}.fit").write_bytes(data)
    (folder / "truncated2.fit").write_bytes(whole[:30])
    (folder / "sound.fit").write_bytes(whole)


def test_read_errors_have_kinds(spark, tmp_path):
    damaged(tmp_path)
    found, failed = fit.read_activities(spark, str(tmp_path))
    rows = {r["activity_id"].rsplit("/", 1)[1][:-4]: r for r in failed.collect()}
    assert {name: r["problem"]["kind"] for name, r in rows.items()} == {n: n.rstrip("2") for n in [*errors.INVALID[:6], "several_sessions", "truncated2"]}
    size = len(fit_file(ROWS))
    assert (rows["truncated"]["problem"]["offset"], rows["truncated"]["error"]) == (size - 9, f"invalid: truncated, 9 bytes are missing at byte {size - 9}")
    assert rows["several_sessions"]["error"] == "unsupported: several sessions" and rows["malformed"]["problem"]["offset"] == 26
    assert {(r["kind"], r["error_class"], r["n"]) for r in errors.counted(failed).collect()} == {(k, "unsupported" if k in errors.UNSUPPORTED else "invalid", 2 if k == "truncated" else 1) for k in {r["problem"]["kind"] for r in rows.values()}}
    assert found.sessions.count() == 1
    copies = {r["path"].rsplit("/", 1)[1][:-4]: r["problem"] and r["problem"]["kind"] for r in sanitize.sanitized(spark, str(tmp_path), 5000).collect()}
    assert copies == {"sound": None, "several_sessions": None, "no_messages": "no_time"} | {n: n.rstrip("2") for n in [*errors.INVALID[:5], "truncated2"]}


def test_command_never_overwrites_a_source(spark, tmp_path, capsys):
    from paceline.__main__ import run

    source = tmp_path / "in"
    source.mkdir()
    (source / "a.fit").write_bytes(fit_file(ROWS))
    (source / "b.FIT").write_bytes(fit_file(ROWS))
    before = {p.name: p.read_bytes() for p in source.iterdir()}
    (tmp_path / "link").symlink_to(source)
    (tmp_path / "half").mkdir()
    (tmp_path / "half" / "b.FIT").symlink_to(source / "b.FIT")
    (tmp_path / "hard.fit").hardlink_to(source / "a.fit")
    for what, out in [("in/a.fit", "in/a.fit"), ("in/a.fit", "link/a.fit"), ("in/a.fit", "hard.fit"), ("in", "in"), ("in", "in/../in/"), ("in", "link"), ("link", "in"), ("in", "half")]:
        assert run(["sanitize", str(tmp_path / what), "-o", f"{tmp_path}/{out}"], spark) == 2
        assert "overwrite" in capsys.readouterr().err
    assert {p.name: p.read_bytes() for p in source.iterdir()} == before
    assert run(["sanitize", str(source), "-o", str(tmp_path / "out")], spark) == 0
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.fit", "b.FIT"] and {p.name: p.read_bytes() for p in source.iterdir()} == before
    damaged(source)
    assert run(["sanitize", str(source), "-o", str(tmp_path / "out")], spark) == 1
    assert "invalid: truncated: 2 files" in capsys.readouterr().err


def test_command_from_another_folder(tmp_path):
    """Workers find the package although neither their folder nor PYTHONPATH leads to it."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    (tmp_path / "a.fit").write_bytes(fit_file(ROWS))
    code = f"import sys; sys.path.insert(0, {str(Path(__file__).resolve().parent.parent)!r}); from paceline.__main__ import run; sys.exit(run(['sanitize', 'a.fit', '-o', 'b.fit']))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=env | {"PYSPARK_PYTHON": sys.executable}, timeout=300)
    assert [m for m, _, _ in fit.decode((tmp_path / "b.fit").read_bytes())] == ["session", "record", "record"]
