"""The listing of files against a plain walk, and what becomes of files that aren't whole."""

from __future__ import annotations

import os

import pytest

from tidewell.sources import files
from tidewell.sources.listing import listing

HEAD = "startTimestamp,type,longValue"


def make(root, contents):
    for name, data in contents.items():
        at = root / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(data if isinstance(data, bytes) else data.encode())


@pytest.mark.parametrize("group", (1, 3, 64))
@pytest.mark.parametrize("scheme", ("", "file:", "file://"))
def test_listing_against_walk(spark, tmp_path, group, scheme):
    make(tmp_path, {f"user_id={u}/{d}/part-{k}.csv": "x" * (u * k) for u in range(5) for d in ("a", "b/c") for k in range(3)} | {"top.csv": "t", "_SUCCESS": "", ".x/y.csv": "1", "user_id=1/.part.crc": "1", "user_id=1/_temporary/p.csv": "1"})
    want = {}
    for folder, below, names in os.walk(tmp_path):
        below[:] = [b for b in below if b[0] not in "_."]
        for n in names:
            if n[0] not in "_.":
                want[os.path.relpath(os.path.join(folder, n), tmp_path)] = os.path.getsize(os.path.join(folder, n))
    got = listing(spark, scheme + str(tmp_path), group=group).collect()
    assert len(got) == len(want) == 31 and {r.name: r.bytes for r in got} == want
    assert {r.problem for r in got if not r.bytes} == {"no bytes"} and not any(r.header for r in got)


def test_listing_of_an_empty_folder(spark, tmp_path):
    assert listing(spark, str(tmp_path)).count() == 0
    assert files.file_status(spark, str(tmp_path)).count() == 0


def test_first_lines(spark, tmp_path):
    make(tmp_path, {"a": "x,y\r\n1,2\r\n", "b": "﻿x,y\n", "c": b"x,\xff\n1,2\n", "d": "\n1\n", "e": "x" * 20000 + "\n1\n", "f": "z" * ((1 << 20) + 9000), "g": "only", "h": ""})
    got = {r.name: (r.header, r.problem) for r in listing(spark, str(tmp_path), headers=True).collect()}
    assert got == {"a": ("x,y", None), "b": ("x,y", None), "c": (None, "not text"), "d": (None, "first line blank"), "e": ("x" * 20000, None), "f": (None, "first line too long"), "g": ("only", None), "h": (None, "no bytes")}


def test_status_of_each_kind(spark, tmp_path):
    make(tmp_path, {
        "u=1/a b+c%20.csv": f"{HEAD}\n5,3000,61\n6,3000,bad\n,,\n", "u=2/q.csv": '﻿note,longValue,"startTimestamp",type\r\n"a, b",70,9,3001\r\n', "u=3/h.csv": f"{HEAD}\n", "u=3/i.csv": f"{HEAD}\n\n\n",
        "u=4/m.csv": "startTimestamp,type\n1,2\n", "u=5/z.csv": "", "u=6/n.csv": f"{HEAD}\n,,\nx,y,z\n", "u=7/b.csv": b"\xff\xfe\x00\n1,2\n", "u=8/w.csv": "\n\n", "u=9/text.csv": f"{HEAD}\nsource,type,longValue\n7,8,9\n",
    })
    got = {r.file: (r.status, r.rows, r.valid) for r in files.file_status(spark, str(tmp_path)).collect()}
    assert got == {
        "u=1/a b+c%20.csv": ("ok", 3, 1), "u=2/q.csv": ("ok", 1, 1), "u=3/h.csv": ("header_only", 0, 0), "u=3/i.csv": ("header_only", 0, 0), "u=4/m.csv": ("missing_required_columns", 1, 0),
        "u=5/z.csv": ("unreadable", 0, 0), "u=6/n.csv": ("no_valid_core_event", 2, 0), "u=7/b.csv": ("unreadable", 0, 0), "u=8/w.csv": ("unreadable", 0, 0), "u=9/text.csv": ("ok", 2, 1),
    }


def test_listing_needs_a_path(spark):
    listing(spark, "/tmp")
    with pytest.raises(Exception, match="needs a path"):
        spark.read.format("file_listing").load().count()
