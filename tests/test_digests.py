"""Digests of files that many tasks read, against plain hashing."""

import hashlib
import os
import random
import zlib

import pytest

from turnlake.operators import archive
from turnlake.operators.archive import Archive
from turnlake.sources import digests

from .test_archive import line, write


@pytest.fixture
def splits(spark):
    """Set how many bytes a split has."""
    names = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"
    before = [spark.conf.get(n) for n in names]
    yield lambda size, cost: [spark.conf.set(n, v) for n, v in zip(names, (size, cost), strict=True)]
    for n, v in zip(names, before, strict=True):
        spark.conf.set(n, v)


def plain(content: bytes) -> str:
    top, piece = hashlib.sha256(), b""
    for each in content.removesuffix(b"\n").split(b"\n"):
        piece += each + b"\n"
        if zlib.crc32(each + b"\n") % 256 == 0:
            top.update(hashlib.sha256(piece).digest())
            piece = b""
    if piece:
        top.update(hashlib.sha256(piece).digest())
    return "pieces:" + top.hexdigest()


def most_read(spark, run) -> int:
    """The most bytes of input that one task of a job took."""
    sc = spark.sparkContext
    group = os.urandom(8).hex()
    sc.setJobGroup(group, group)
    run()
    sc.setLocalProperty("spark.jobGroup.id", None)
    tracker, store = sc.statusTracker(), sc._jsc.sc().statusStore()
    read = []
    for stage in {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}:
        tasks = store.taskList(stage, 0, 10_000)
        for i in range(tasks.size()):
            metrics = tasks.apply(i).taskMetrics()
            read += [metrics.get().inputMetrics().bytesRead()] if metrics.isDefined() else []
    return max(read)


def test_no_task_reads_a_large_file_alone(spark, tmp_path, splits):
    size = 70 << 20
    with open(tmp_path / "large.parquet", "wb") as f:
        f.write(random.Random(1).randbytes(size))
    splits(8 << 20, 1 << 20)
    found = []
    assert most_read(spark, lambda: found.extend(archive.manifest(spark, str(tmp_path)).collect())) < 10 << 20
    assert [(r["path"].rsplit("/", 1)[1], r["size"]) for r in found] == [("large.parquet", size)]


def test_digests_do_not_depend_on_splits(spark, tmp_path, splits, monkeypatch):
    some = random.Random(2)
    held = {
        "random": some.randbytes(400_000),
        "ended": some.randbytes(100_000) + b"\n",
        "lines": b"".join(b"%d\r\n" % some.randrange(50_000) for _ in range(20_000)),
        "same": b"one and the same\n" * 3000,
        "short": b"".join(b"%d\n" % i for i in range(5000) if zlib.crc32(b"%d\n" % i) % 256 == 0) * 200,
        "empty lines": b"\n" * 20_000,
        "no lines": b"x" * 50_000,
        "small": b"\n" * 1000,
    }
    for name, content in held.items():
        (tmp_path / f"{name}.parquet").write_bytes(content)
    expected = {n: plain(c) if len(c) > 1000 else hashlib.sha256(c).hexdigest() for n, c in held.items()}
    for size, cost, most in ((7000, 1, 1 << 20), (64 << 10, 1, 1000), (128 << 20, 4 << 20, 1 << 20)):
        splits(size, cost)
        monkeypatch.setattr(digests, "MOST", most)
        found = archive.manifest(spark, str(tmp_path), 1000).collect()
        assert {r["path"].rsplit("/", 1)[1].removesuffix(".parquet"): r["sha256"] for r in found} == expected
        assert all(r["size"] == len(held[r["path"].rsplit("/", 1)[1].removesuffix(".parquet")]) for r in found)


def test_damage_of_large_files_is_found(spark, tmp_path, splits, monkeypatch):
    monkeypatch.setattr(digests, "WHOLE", 100)
    root = str(tmp_path / "projects")
    write(f"{root}/p/s.jsonl", *[line(f"u{i}", f"some text {i * 7919}") for i in range(300)])
    held = Archive(spark, str(tmp_path / "archive"))
    held.update(root, resolver=None)
    splits(1000, 1)
    batch = f"{held.folder}/turns/batch={held.pointer()['batches'][-1]}"
    assert all(r["sha256"].startswith("pieces:") for r in archive.manifest(spark, batch).collect()) and held.verify() == []
    victim = next(os.path.join(d, n) for d, _, names in os.walk(batch) for n in names if n.endswith(".parquet"))
    with open(victim, "r+b") as f:
        f.seek(os.path.getsize(victim) // 2)
        was = f.read(1)[0]
        f.seek(-1, 1)
        f.write(bytes([was ^ 1]))
    assert [p for _, p in held.verify()] == ["missing"]  # the file system's own checksum: can't be read
    os.remove(os.path.join(os.path.dirname(victim), f".{os.path.basename(victim)}.crc"))
    assert [p for _, p in held.verify()] == ["checksum"]


def test_manifests_with_plain_digests_of_large_files_hold(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "projects")
    write(f"{root}/p/s.jsonl", line("u1", "written before there were pieces"))
    held = Archive(spark, str(tmp_path / "archive"))
    held.update(root, resolver=None)
    monkeypatch.setattr(digests, "WHOLE", 100)
    assert held.verify() == []
