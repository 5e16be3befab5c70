"""Copies by tasks, and versions behind a pointer through every failure."""

import hashlib

import pytest

from circuitscope.sources import copies, writers


def files(folder, **contents):
    folder.mkdir(exist_ok=True)
    for name, data in contents.items():
        (folder / f"{name}.bin").write_bytes(data)
    return str(folder)


def seen(spark, target):
    """What a reader finds: names, and whether every file is what the manifest says."""
    out = {}
    for r in copies.published(spark, target).collect():
        data = open(r.path.removeprefix("file://"), "rb").read()
        assert (len(data), hashlib.sha256(data).hexdigest()) == (r.n_bytes, r.sha256)
        out[r.name] = data
    return out


def test_versions_change_as_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(copies, "CHUNK_BYTES", 1000)
    target = f"file://{tmp_path}/out"
    assert seen(spark, target) == {} and copies.current_version(spark, target) is None and copies.drop_old_versions(spark, target) == []
    old = files(tmp_path / "a", x=b"1" * 5000, y=b"", z=bytes(range(256)) * 20)
    first = copies.publish_set(spark, f"file://{old}", target, "*.bin")
    whole = {"x.bin": b"1" * 5000, "y.bin": b"", "z.bin": bytes(range(256)) * 20}
    assert seen(spark, target) == whole and copies.current_version(spark, target) == first
    new = files(tmp_path / "b", x=b"2" * 3000)

    def fail(*_):
        raise RuntimeError("crash")

    for step in ("_switch", "replace_file", "copied"):
        with monkeypatch.context() as m:
            m.setattr(copies, step, fail)
            with pytest.raises(RuntimeError):
                copies.publish_set(spark, f"file://{new}", target)
        assert seen(spark, target) == whole, "the old set is whole whatever failed"
    second = copies.publish_set(spark, f"file://{new}", target)
    assert seen(spark, target) == {"x.bin": b"2" * 3000}
    assert second not in copies.drop_old_versions(spark, target, keep=0) and seen(spark, target) == {"x.bin": b"2" * 3000}
    assert [p.name for p in (tmp_path / "out" / "versions").iterdir()] == [second]
    with pytest.raises(FileNotFoundError):
        copies.publish_set(spark, f"file://{new}", target, "*.none")
    assert copies.current_version(spark, target) == second


def test_inventory_reads_chunks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(copies, "CHUNK_BYTES", 7)
    folder = files(tmp_path / "a", x=b"abc" * 100, y=b"")
    got = {r.name: r.sha256 for r in writers.file_inventory(spark, folder, "*.bin", "x*").collect()}
    assert got == {"x.bin": hashlib.sha256(b"abc" * 100).hexdigest(), "y.bin": hashlib.sha256(b"").hexdigest()}
