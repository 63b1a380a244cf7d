"""Following files that grow and rotate: each line once, whatever happens between two batches."""

from __future__ import annotations

import random
import shutil
from collections import Counter

import pytest

from loglens.sources import growing, lines


class Follower:
    """A query that is started anew for each look, from its checkpoint."""

    def __init__(self, spark, folder, scratch, **options):
        self.spark, self.folder, self.scratch, self.options = spark, folder, scratch, options

    def look(self) -> list[str]:
        out = str(self.scratch / "out")
        stream = lines.tail_log_stream(self.spark, str(self.folder), **self.options)
        query = (
            stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(self.scratch / "check"))
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
        return sorted(r["value"] for r in self.spark.read.schema(stream.schema).parquet(out).collect())


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "logs").mkdir()
    return tmp_path / "logs"


def _add(path, *texts, end="\n"):
    with open(path, "a", newline="") as file:
        file.write("\n".join(texts) + end)


def test_appended_rotated_restarted(spark, folder, tmp_path):
    follower = Follower(spark, folder, tmp_path, range_bytes=40)
    log = folder / "access.log"
    _add(log, *(f"first line {i}" for i in range(20)))
    _add(folder / "_hidden", "no line")
    _add(folder / "old.log.gz", "no line")
    said = [f"first line {i}" for i in range(20)]
    assert follower.look() == sorted(said)
    _add(log, "appended", "", "  ", "half a", end="")  # the last line is not whole yet
    said += ["appended"]
    assert follower.look() == sorted(said)
    _add(log, " line")
    said += ["half a line"]
    assert follower.look() == sorted(said)
    _add(log, "unread when renamed")
    log.rename(folder / "access.log.1")
    _add(log, "first of the next")
    said += ["unread when renamed", "first of the next"]
    assert follower.look() == sorted(said)
    _add(log, "unread when copied")
    shutil.copy(log, folder / "access.log.2")
    said += ["unread when copied"]
    assert follower.look() == sorted(said)  # the copy is there, the original not yet cut
    log.write_text("")
    assert follower.look() == sorted(said)
    _add(log, "after the cut")
    said += ["after the cut"]
    assert follower.look() == sorted(said)
    log.write_text("anew\n")  # shorter, other bytes
    (folder / "access.log.1").unlink()
    said += ["anew"]
    assert follower.look() == sorted(said)
    assert follower.look() == sorted(said)
    _add(folder / "access.log.2", "late")
    said += ["late"]
    assert follower.look() == sorted(said)


def test_alike_beginnings_are_told_apart(spark, folder, tmp_path):
    follower = Follower(spark, folder, tmp_path)
    banner = "banner " * 60
    _add(folder / "a.log", banner, "from a")
    _add(folder / "b.log", banner, "from b, longer")
    said = [banner.strip()] * 2 + ["from a", "from b, longer"]
    assert follower.look() == sorted(said)
    _add(folder / "a.log", "more of a", "and more")
    _add(folder / "b.log", "more of b")
    said += ["more of a", "and more", "more of b"]
    assert follower.look() == sorted(said)
    (folder / "a.log").write_text(banner + "\n" + "from the next a, which has grown longer than the last one was\n" * 3)
    said += [banner.strip()] + ["from the next a, which has grown longer than the last one was"] * 3
    assert follower.look() == sorted(said)


def test_lines_of_ranges(spark, folder, tmp_path):
    """Ranges of any size hold every line once, long lines and odd bytes included."""
    rng = random.Random(4)
    texts = ["".join(rng.choices("xyzé\r", k=rng.choice([0, 1, 5, 90]))) for _ in range(300)]
    with open(folder / "a.log", "wb") as file:
        file.write(b"".join(t.encode() + b"\n" for t in texts) + b"\xff broken \xc3\n")
    for size in (1, 7, 100, 1 << 20):
        reader = growing.GrowingLinesReader({"path": str(folder), "rangeBytes": str(size)})
        found = [
            v for part in reader.partitions(reader.initialOffset(), reader.latestOffset())
            for batch in reader.read(part) for v in batch.column("value").to_pylist()
        ]
        assert Counter(found) == Counter([t.encode().rstrip(b"\r") for t in texts] + [b"\xff broken \xc3"])
    assert "\ufffd broken \ufffd" in Follower(spark, folder, tmp_path).look()


def test_added_many_times(folder):
    """Random appends, renames and restarts against what was written."""
    rng = random.Random(9)
    offset, found, written, n = {}, Counter(), Counter(), 0
    for step in range(60):
        reader = growing.GrowingLinesReader({"path": str(folder), "rangeBytes": "64"})
        for _ in range(rng.randrange(4)):
            n += 1
            name = f"{rng.choice('ab')}.log"
            _add(folder / name, f"line {n} of {name}")
            written[f"line {n} of {name}".encode()] += 1
        if rng.random() < 0.3 and (folder / "a.log").exists():
            (folder / "a.log").rename(folder / f"a.log.{step}")
        latest = reader.latestOffset()
        for part in reader.partitions(offset, latest):
            for batch in reader.read(part):
                found.update(batch.column("value").to_pylist())
        offset = latest
    assert found == written and n > 50
