"""Archives as a format of Spark: ranges of bytes, broken archives, arrivals."""

import io
import json
import os
import zipfile

import pytest

from kindred.sources import archive_format as af
from kindred.sources.archives import list_members


def archive(path, members):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for name, content in members:
            out.writestr(zipfile.ZipInfo(name), content)


@pytest.fixture
def folder(tmp_path):
    place = tmp_path / "books"
    place.mkdir()
    archive(place / "a.zip", [(f"a{i}.fb2", os.urandom(500 + i)) for i in range(40)])
    archive(place / "b.ZIP", [("dir/", b""), ("dir/b.fb2", "текст".encode()), ("empty.fb2", b"")])
    archive(place / "none.zip", [])
    (place / "broken.zip").write_bytes(b"no archive at all" * 50)
    (place / "nothing.zip").write_bytes(b"")
    (place / "notes.txt").write_text("not an archive")
    return str(place)


def held(folder):
    want = {}
    for name in ("a.zip", "b.ZIP"):
        with zipfile.ZipFile(f"{folder}/{name}") as got:
            want |= {(name, i.filename): got.read(i) for i in got.infolist() if not i.is_dir()}
    return want


@pytest.mark.parametrize("split", [1, 700, 5_000, 1 << 30])
def test_every_member_once_whatever_the_ranges(folder, split):
    splits = af._splits(af._files({"path": folder}), {"splitBytes": str(split)})
    rows = [r for s in splits for b in af._read(s, True) for r in b.to_pylist()]
    good = [r for r in rows if r["error"] is None]
    assert {(r["archive"], r["member"]): r["content"] for r in good} == held(folder) and len(good) == 42
    assert sorted(r["archive"] for r in rows if r["error"]) == ["broken.zip", "nothing.zip"]
    pieces = [p for s in splits for p in s.pieces]
    assert len(pieces) == len(set(pieces)) and all(s.pieces for s in splits)
    if split <= 5_000:
        assert len(splits) > 4


def test_read_and_listing(spark, folder):
    rows = af.archives_under(spark, folder).collect()
    assert {(r.archive, r.member): bytes(r.content) for r in rows if r.error is None} == held(folder)
    listed = af.archives_under(spark, folder, content=False)
    assert "content" not in listed.columns
    # The same as the listing over binaryFile, broken archives included; files of no bytes are not seen there.
    columns = ["archive", "member", "size"]
    assert sorted(listed.where("archive <> 'nothing.zip'").select(columns).collect(), key=repr) == sorted(list_members(spark, folder).select(columns).collect(), key=repr)
    one = af.archives_under(spark, f"{folder}/b.ZIP").collect()
    assert {r.member for r in one} == {"dir/b.fb2", "empty.fb2"}
    assert af.archives_under(spark, folder, glob="x*.zip").count() == 0
    with pytest.raises(Exception, match="FileNotFound"):
        af.archives_under(spark, folder + "-missing").count()


def test_broken_members_and_repeated_names(spark, tmp_path):
    place = tmp_path / "one"
    place.mkdir()
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w", zipfile.ZIP_STORED) as out:
        for text in ("first text", "second text", "third text"):
            with pytest.warns() if text != "first text" else open(os.devnull):
                out.writestr(zipfile.ZipInfo("same.fb2"), text)
    raw = made.getvalue().replace(b"second text", b"sec0nd text", 1)  # the checksum tells
    (place / "x.zip").write_bytes(raw)
    rows = af.archives_under(spark, str(place)).collect()
    assert sorted(bytes(r.content) for r in rows if r.error is None) == [b"first text", b"third text"]
    assert [r.member for r in rows if r.error] == ["same.fb2"]


def test_arrivals(spark, folder, tmp_path):
    log, out, state = (str(tmp_path / n) for n in ("log", "out", "state"))

    def run():
        stream = af.archive_arrivals(spark, folder, log, content=True)
        writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
        writer.trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(out).where("error IS NULL").count()

    assert run() == 42 and run() == 42
    # An archive with an old time is new as well.
    archive(f"{folder}/late.zip", [("late.fb2", b"late")])
    os.utime(f"{folder}/late.zip", (1, 1))
    assert run() == 43 and run() == 43
    assert [len(json.load(open(f"{log}/{n}"))) for n in sorted(os.listdir(log))] == [5, 1]


def test_a_batch_that_was_written_down_but_not_run_comes_again(folder, tmp_path):
    options = {"path": folder, "log": str(tmp_path / "log")}
    one, two = af._Arrivals(options), af._Arrivals(options)
    assert one.latestOffset() == {"batch": 1} == one.latestOffset()
    assert two.latestOffset() == {"batch": 1}  # another start of the stream
    first = two.partitions(two.initialOffset(), {"batch": 1})
    assert first == one.partitions({"batch": 0}, {"batch": 1}) and two.partitions({"batch": 1}, {"batch": 1}) == []
    with pytest.raises(ValueError):
        af._Arrivals({"path": folder})
