"""Zip archives by ranges of members."""

from __future__ import annotations

import zipfile

import pytest

from lexweave.sources import files, zips


def test_members_of_large_archives_are_dealt_to_tasks(spark, tmp_path):
    for a in range(2):
        with zipfile.ZipFile(tmp_path / f"part-{a}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("empty/", b"")
            for k in range(50):
                z.writestr(f"m/{k}.txt", f" line {k} of {a} \r\n\n é{'x' * k}\n" * 20)
    with zipfile.ZipFile(tmp_path / "none.zip", "w"):
        pass
    (tmp_path / "other.txt").write_text("no archive")
    got = files.read_zip_members(spark, str(tmp_path), most=500)
    assert got.rdd.getNumPartitions() > 6
    want = files.read_zips(spark, str(tmp_path / "*.zip"))
    rows = lambda df: sorted((r.archive.rpartition("/")[2], r.member, r.text) for r in df.collect())
    assert rows(got) == rows(want) and got.count() == 100
    assert rows(files.read_zip_members(spark, str(tmp_path), lines=True)) == rows(files.read_zips(spark, str(tmp_path / "*.zip"), lines=True))
    with pytest.raises(ValueError, match="no file system"):
        monkey = zips.SCHEMES
        try:
            zips.SCHEMES = ("hdfs",)
            zips.read_members(spark, str(tmp_path))
        finally:
            zips.SCHEMES = monkey
