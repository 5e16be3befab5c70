"""Archives read by many tasks, against the library that wrote them."""

import zipfile

import pytest

from circuitscope.sources import archives, readers


@pytest.fixture
def archive(tmp_path):
    path = tmp_path / "all.zip"
    with zipfile.ZipFile(path, "w") as z:
        for n in range(40):
            z.writestr(f"set/{n}.qasm", f"// {n}\n" + "x q[0];\n" * n * 20, zipfile.ZIP_DEFLATED if n % 3 else zipfile.ZIP_STORED)
        z.writestr("set/", ""), z.writestr("notes.txt", "none"), z.writestr("empty.qasm", ""), z.writestr("größe.qasm", "// ü")
    return path


def test_one_archive_is_read_by_many_tasks(spark, archive):
    found = archives.read_members(spark, str(archive), ".qasm", range_bytes=2_000)
    assert found.rdd.getNumPartitions() > 4
    got = {r.member: (r.text, r.n_bytes) for r in found.collect()}
    with zipfile.ZipFile(archive) as z:
        assert got == {i.filename: (z.read(i).decode(), i.file_size) for i in z.infolist() if i.filename.endswith(".qasm")} and len(got) == 42
    rows = readers.scan_archive(spark, str(archive)).collect()
    assert {"0", "39", "empty", "größe"} <= {r.name for r in rows} and all("all.zip!" in r.file for r in rows)


def test_patterns_and_nothing(spark, archive, tmp_path):
    with zipfile.ZipFile(tmp_path / "two.zip", "w") as z:
        z.writestr("one.qasm", "// 1")
    assert archives.read_members(spark, str(tmp_path / "*.zip"), ".qasm").count() == 43
    assert archives.read_members(spark, str(tmp_path / "none.zip")).count() == 0
    with zipfile.ZipFile(tmp_path / "bare.zip", "w"):
        pass
    assert archives.read_members(spark, str(tmp_path / "bare.zip")).count() == 0


def test_what_is_refused(spark, archive, tmp_path):
    with pytest.raises(Exception, match="the limit is 100"):
        archives.read_members(spark, str(archive), member_bytes=100).collect()
    with zipfile.ZipFile(tmp_path / "up.zip", "w") as z:
        z.writestr("../up.qasm", "x")
    with pytest.raises(Exception, match="unsafe member"):
        archives.read_members(spark, str(tmp_path / "up.zip")).collect()
    data = bytearray(archive.read_bytes())
    data[42] ^= 1  # in the first member's bytes
    (tmp_path / "bad.zip").write_bytes(data)
    with pytest.raises(Exception, match="damaged"):
        archives.read_members(spark, str(tmp_path / "bad.zip")).collect()
    with zipfile.ZipFile(tmp_path / "lzma.zip", "w", zipfile.ZIP_LZMA) as z:
        z.writestr("a.qasm", "x")
    with pytest.raises(Exception, match="packed by a method"):
        archives.read_members(spark, str(tmp_path / "lzma.zip")).collect()


def test_pointers(spark, tmp_path):
    text = archives.POINTER_LINE + "\noid sha256:" + "ab" * 32 + "\nsize 1234\n"
    rows = spark.createDataFrame([(text,), ("OPENQASM 2.0;",), (None,)], "text string").select(archives.pointer("text").alias("p")).collect()
    assert [r.p and tuple(r.p) for r in rows] == [("ab" * 32, 1234), None, None]
    (tmp_path / "all.zip").write_text(text)
    with pytest.raises(Exception, match="large-file pointer"):
        archives.read_members(spark, str(tmp_path / "all.zip")).collect()
    with zipfile.ZipFile(tmp_path / "in.zip", "w") as z:
        z.writestr("a.qasm", text)
    with pytest.raises(Exception, match="large-file pointer"):
        readers.scan_archive(spark, str(tmp_path / "in.zip")).collect()
