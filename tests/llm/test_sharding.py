import pytest

from evidara.llm import sharding
from tests.llm.helpers import documents, empty, odd


def test_round_trip_and_tiers(spark, tmp_path):
    docs = odd(spark, wild=True).union(documents(spark, [f"text number {i} " * (1 + i % 9) for i in range(300)], wild=True)).repartition(20)
    docs = docs.withColumnsRenamed({"bucket": "arrival", "score": "__arrival"})
    total = sum(len((r.text or "").encode()) for r in docs.collect())
    store = sharding.shard(docs, str(tmp_path / "s"), arrival=total // 18, base=total // 40, target=4096, fan=3)
    assert sorted(map(tuple, store.read().collect()), key=repr) == sorted(map(tuple, docs.collect()), key=repr)
    runs = store.manifest()["runs"]
    tiers = [r["tier"] for r in runs]
    assert all(tiers.count(t) < 3 for t in tiers) and store.versions() == [max(store.versions()) - 1, max(store.versions())]
    assert sum(r["rows"] for r in runs) == docs.count() and sum(r["bytes"] for r in runs) == total
    # arrivals came one by one, and merges of merges were made
    assert max(store.versions()) > 18 and max(tiers) >= 2 and len(runs) < 18
    # once vacuumed, what was replaced is gone, and merged files are about as large as asked for
    assert store.read(max(store.versions()) - 1).count() <= docs.count()
    assert len(store.vacuum(keep=1, retain=0)) == 1
    on_disk = {f"{p.parent.name}/{p.name}" if "=" in p.name else p.name for p in (tmp_path / "s").glob("**/*") if p.is_dir() and any(p.glob("*.parquet"))}
    assert on_disk == {r["run"] for r in runs}
    for r in runs:
        if r["tier"] >= 2:
            files = [spark.read.schema(store.schema).parquet(str(f)) for f in (tmp_path / "s" / r["run"]).glob("*.parquet")]
            assert len(files) >= r["bytes"] // 4096 // 2


def test_large_scan_partitions_are_cut_to_the_target(spark, tmp_path):
    docs = documents(spark, ["x" * 100] * 400).coalesce(1)
    store = sharding.Store(spark, str(tmp_path / "s"), docs.schema, target=4000, base=1 << 20, fan=2)
    for _ in range(2):
        store.append(docs)
    store.compact()
    store.vacuum(keep=1, retain=0)
    sizes = [spark.read.parquet(str(f)).count() for f in (tmp_path / "s").glob("run-*/*.parquet")]
    assert sum(sizes) == 800 and max(sizes) <= 50


def test_locks_of_lost_writers_and_their_files(spark, tmp_path):
    import os

    docs = documents(spark, ["a", "b"])
    store = sharding.Store(spark, str(tmp_path / "s"), docs.schema, lease=100)
    runs, lost = store.write(docs), store.write(docs)
    (tmp_path / "s" / "manifests").mkdir()
    lock = tmp_path / "s" / "manifests" / ".lock000000001"
    lock.write_text("")
    with pytest.raises(sharding.Conflict):
        store.commit(0, runs)  # its writer may still be there
    os.utime(lock, (1, 1))
    store.commit(0, runs)
    assert store.versions() == [1] and store.read().count() == 2
    store.vacuum()
    assert (tmp_path / "s" / lost[0]["run"]).exists()  # may be a writer's that is about to commit
    os.utime(tmp_path / "s" / lost[0]["run"], (1, 1))
    os.utime(tmp_path / "s" / runs[0]["run"], (1, 1))
    store.vacuum()
    assert not (tmp_path / "s" / lost[0]["run"]).exists() and store.read().count() == 2


def test_arrivals_one_by_one(spark, tmp_path):
    docs = documents(spark, [f"t{i}" for i in range(60)])
    store = sharding.Store(spark, str(tmp_path / "s"), docs.schema, base=1 << 20, fan=3)
    for i in range(6):
        store.append(docs.filter(f"doc_id % 6 = {i}"))
        store.compact()
    assert sorted(r.doc_id for r in store.read().collect()) == list(range(60))
    assert len(store.manifest()["runs"]) <= 4


def test_only_one_writer_commits(spark, tmp_path):
    docs = documents(spark, ["a", "b"])
    store = sharding.Store(spark, str(tmp_path / "s"), docs.schema)
    first, second = store.write(docs.filter("doc_id = 0")), store.write(docs.filter("doc_id = 1"))
    store.commit(0, first)
    with pytest.raises(sharding.Conflict):
        store.commit(0, second)
    assert [r.doc_id for r in store.read().collect()] == [0] and store.versions() == [1]


def test_empty_tables(spark, tmp_path):
    store = sharding.shard(empty(spark), str(tmp_path / "s"))
    assert store.read().count() == 0 and store.read().columns == empty(spark).columns


def test_readers_survive_merges_until_their_version_is_dropped(spark, tmp_path):
    docs = documents(spark, [f"t{i}" for i in range(40)])
    store = sharding.Store(spark, str(tmp_path / "s"), docs.schema, base=1 << 20, fan=2, lease=1000)
    store.append(docs.filter("doc_id < 10"))
    planned, at = store.read(), max(store.versions())
    for i in range(1, 4):
        store.append(docs.filter(f"doc_id div 10 = {i}"))
        store.compact()
        store.vacuum()  # all versions are young
    assert sorted(r.doc_id for r in planned.collect()) == list(range(10)) and store.read(at).count() == 10
    counts = [store.read(v).count() for v in store.versions()]
    assert counts == sorted(counts) and counts[-1] == 40 and store.versions()[0] == 1
    left = store.vacuum(keep=2, retain=0)
    assert left == store.versions() and len(left) == 2 and all(store.read(v).count() for v in left)
    with pytest.raises(LookupError):
        store.read(at)
    assert store.vacuum(keep=0, retain=0) == left[-1:] and store.read().count() == 40
    on_disk = {p.name for p in (tmp_path / "s").glob("run-*")}
    assert on_disk == {r["run"] for r in store.manifest()["runs"]}


def test_a_slow_writer_does_not_commit_over_its_successor(spark, tmp_path, monkeypatch):
    docs = documents(spark, ["a", "b"])
    store = sharding.Store(spark, str(tmp_path / "s"), docs.schema, lease=0)
    first, second = store.write(docs.filter("doc_id = 0")), store.write(docs.filter("doc_id = 1"))
    plain, slow = sharding.Store._locked, []

    def locked(self, lock, name):
        got = plain(self, lock, name)
        if not slow:  # while this one sleeps, its lease ends and another takes the lock over
            slow.append(name)
            monkeypatch.setattr(sharding.Store, "_locked", plain)
            other = sharding.Store(spark, store.root, docs.schema, lease=-1)
            assert other._locked(lock, "other") and not self._holds(lock, name)
        return got

    monkeypatch.setattr(sharding.Store, "_locked", locked)
    with pytest.raises(sharding.Conflict):
        store.commit(0, first)
    assert store.versions() == []
    store.commit(0, second)
    assert [r.doc_id for r in store.read().collect()] == [1]
