"""Archives packed by tasks and joined in the store."""

import zipfile

import pytest

from lexweave.plans import jobs
from lexweave.sources import archives, readers


def test_members(spark, tmp_path, monkeypatch):
    """Members of several blocks, empty ones and names of other scripts; the wide form of the format, forced."""
    contents = {f"m {i} é.bin": bytes([i % 251]) * (i * 1000) + bytes(range(i % 256)) for i in range(40)} | {"large": bytes(range(256)) * 20_000, "none": b""}
    (tmp_path / "in").mkdir()
    for name, data in contents.items():
        (tmp_path / "in" / name).write_bytes(data)
    files = spark.createDataFrame([(p,) for p in archives.store.listed(spark, f"file://{tmp_path}/in")], "path string").selectExpr("path", "concat('in/', regexp_extract(path, '([^/]*)$', 1)) AS name")
    for wide in (archives.WIDE, 1000):
        target = f"file://{tmp_path}/a{wide}.zip"
        if wide == archives.WIDE:
            assert archives.write_archive(files, target) == len(contents)
        else:  # tasks know the usual limit and tell local sizes by it; the directory is made by the other
            rows = archives.store.stored(archives.packed_members(files, f"file://{tmp_path}/parts"), "packed").orderBy("name").collect()
            monkeypatch.setattr(archives, "WIDE", wide)
            monkeypatch.setattr(archives, "_local", lambda name, crc, packed, size: bytes(30 + len(name)))
            archives.writers.write_file(spark, f"file://{tmp_path}/directory", archives._directory(rows))
            archives.writers.write_file(spark, target, [p for r in rows for p in (r["head"], r["data"])] + [f"file://{tmp_path}/directory"])
        with zipfile.ZipFile(f"{tmp_path}/a{wide}.zip") as z:
            assert z.testzip() is None and {n.removeprefix("in/"): z.read(n) for n in z.namelist()} == contents
        found = archives.member_digests(spark.createDataFrame([(target,)], "path string"))
        assert found.exceptAll(archives.file_digests(files)).count() == 0 and found.count() == len(contents)


def test_empty_and_named_files(spark, tmp_path):
    for name in ("a", "b/c", "b/_no", "b/d/e"):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(b"" if name == "b/c" else name.encode())
    root = f"{tmp_path}/in"
    assert jobs.build_archive(spark, [f"{root}/a", f"{root}/b"], f"file://{tmp_path}/z.zip", root=root) == 3
    assert {r["name"]: bytes(r["content"]) for r in readers.read_archive(spark, f"{tmp_path}/z.zip").collect()} == {"a": b"a", "b/c": b"", "b/d/e": b"b/d/e"}
    with pytest.raises(ValueError, match="missing files: none"):
        jobs.build_archive(spark, [f"{root}/a", f"{root}/none"], f"file://{tmp_path}/y.zip")
