"""Releases that are verified and swapped, and archives read by many tasks."""

import json
import zipfile

import pytest

from tallyline.sources import archives, matches, releases


@pytest.fixture()
def root(tmp_path):
    return str(tmp_path / "data")


def frame(spark, n):
    return spark.range(n).selectExpr("id", "cast(id * 2 as string) as text")


def test_a_release_is_verified_swapped_and_taken_back(spark, root):
    assert releases.current(spark, root) is None
    with pytest.raises(releases.ReleaseError):
        releases.load(spark, root, "a")
    releases.publish({"a": frame(spark, 100).repartition(3), "b": frame(spark, 5)}, root, "one", {"built": "2024"}, rows_a_file=20)
    assert releases.faults(spark, root, "one").count() == 0 and releases.current(spark, root) is None
    assert releases.install(spark, root, "one") == 1
    before = releases.load(spark, root, "a")
    releases.publish({"a": frame(spark, 7)}, root, "two")
    assert releases.load(spark, root, "a").count() == 100
    releases.install(spark, root, "two")
    assert releases.load(spark, root, "a").count() == 7 and before.count() == 100
    assert releases.go_back(spark, root) == "one" and releases.load(spark, root, "a").count() == 100
    held = releases.info(spark, root, "one")
    assert held["facts"] == {"built": "2024"} and held["tables"] == ["a", "b"] and "| a | 100 | id bigint, text string |" in held["card"]
    with pytest.raises(releases.ReleaseError):
        releases.publish({"a": frame(spark, 1)}, root, "one")


def test_damaged_releases_are_refused_and_readers_keep_the_old_one(spark, root, tmp_path):
    releases.publish({"a": frame(spark, 50).repartition(2)}, root, "one")
    releases.install(spark, root, "one")
    for version, harm, fault in (("cut", lambda f: f.write_bytes(f.read_bytes()[:-1]), "changed"), ("turned", lambda f: f.write_bytes(b"x" + f.read_bytes()[1:]), "changed"), ("gone", lambda f: f.unlink(), "missing"), ("more", lambda f: (f.parent / "part-x.parquet").write_bytes(b"?"), "not listed")):
        releases.publish({"a": frame(spark, 60).repartition(2)}, root, version)
        harm(sorted((tmp_path / "data" / "versions" / version / "a").glob("part-*.parquet"))[0])
        for crc in (tmp_path / "data" / "versions" / version / "a").glob(".*.crc"):
            crc.unlink()
        assert [r["fault"] for r in releases.faults(spark, root, version).collect()] == [fault]
        with pytest.raises(releases.ReleaseError):
            releases.install(spark, root, version)
        assert releases.current(spark, root) == "one" and releases.load(spark, root, "a").count() == 50
    with pytest.raises(releases.ReleaseError):
        releases.install(spark, root, "never")


def test_of_two_writers_one_wins(spark, root):
    for v in ("one", "two", "three"):
        releases.publish({"a": frame(spark, 1)}, root, v)
    seen = releases.install(spark, root, "one")
    releases.install(spark, root, "two", after=seen)
    with pytest.raises(releases.ReleaseError):
        releases.install(spark, root, "three", after=seen)
    assert releases.current(spark, root) == "two"
    with pytest.raises(releases.ReleaseError):
        releases.go_back(spark, root + "x")


def match(k):
    return json.dumps({"info": {"match_type": "T20", "gender": "male", "dates": ["2024-01-01"], "teams": ["A", f"B{k}"]}, "innings": []})


def test_one_archive_is_read_by_several_tasks(spark, tmp_path):
    where = tmp_path / "z"
    where.mkdir()
    with zipfile.ZipFile(where / "all.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for k in range(200):
            z.writestr(f"folder/{k}.json", match(k))
        z.writestr("readme.txt", "no match")
        z.writestr("bad.json", b"\xff\xfe{")
        z.writestr("broken.json", "{no json")
    with zipfile.ZipFile(where / "empty.zip", "w"):
        pass
    found = archives.documents(spark, str(where), partition_bytes=2000)
    assert found.rdd.getNumPartitions() > 5
    plain = matches.zipped(spark, str(where / "all.zip"))
    ids = lambda df: sorted(r["match_id"] for r in df.select("match_id").collect())
    assert ids(found) == ids(plain) == sorted(str(k) for k in range(200))
    assert matches.matches(found).count() == 200
    assert archives.entries(spark, f"file://{where}/all.zip", "").count() == 203
    assert archives.documents(spark, str(where / "empty.zip")).count() == 0
