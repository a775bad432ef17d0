"""Versions by a commit log: writers that race, readers that never see half of one."""

import threading

import pytest

from ledgerlark.sinks import commits as C
from ledgerlark.sinks import files


def rows(spark, n, first=0):
    return spark.range(first, first + n).withColumnRenamed("id", "x")


def seen(spark, root, **options):
    return sorted(r["x"] for r in C.read(spark, root, "t", **options).collect())


def test_versions_replace_and_append(spark, tmp_path):
    root = str(tmp_path / "bundle")
    assert C.newest(spark, root) is None
    with pytest.raises(FileNotFoundError):
        C.read(spark, root, "t")
    first = C.publish(spark, root, {"t": rows(spark, 5), "u": rows(spark, 1)}, {"why": "é"}, expected=0)
    assert (first.number, first.meta, seen(spark, root)) == (1, {"why": "é"}, list(range(5)))
    C.publish(spark, root, {"t": rows(spark, 3, 5)}, append=True)
    assert seen(spark, root) == list(range(8)) and C.read(spark, root, "u").count() == 1
    third = C.publish(spark, root, {"t": rows(spark, 2)}, expected=2)
    assert seen(spark, root) == [0, 1] and "u" not in third.tables and seen(spark, root, commit=first) == list(range(5))
    with pytest.raises(C.CommitConflict, match="is 3, not 2"):
        C.publish(spark, root, {"t": rows(spark, 9)}, expected=2)
    assert seen(spark, root) == [0, 1] and C.broken(spark, root, third, deep=True) == []


def race(monkeypatch, writers):
    """All writers have read the newest commit before any creates its own."""
    gate, true, first = threading.Barrier(len(writers), timeout=60), files.create, set()

    def create(spark, path, text):
        if threading.get_ident() not in first:
            first.add(threading.get_ident())
            gate.wait()
        true(spark, path, text)

    monkeypatch.setattr(files, "create", create)
    results = [None] * len(writers)

    def work(i):
        try:
            results[i] = writers[i]()
        except Exception as e:  # noqa: BLE001  compared below
            results[i] = e

    threads = [threading.Thread(target=work, args=(i,)) for i in range(len(writers))]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    return results


def test_two_writers_race_and_one_wins(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "b")
    got = race(monkeypatch, [lambda k=k: C.publish(spark, root, {"t": rows(spark, 2, 10 * k)}, expected=0) for k in (1, 2)])
    won = [g for g in got if isinstance(g, C.Commit)]
    assert len(won) == 1 and sum(isinstance(g, C.CommitConflict) for g in got) == 1
    assert seen(spark, root) in ([10, 11], [20, 21]) and C.numbers(spark, root) == [1]


def test_racing_appends_are_both_there(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "b")
    got = race(monkeypatch, [lambda k=k: C.publish(spark, root, {"t": rows(spark, 2, 10 * k)}, append=True) for k in (1, 2, 3)])
    assert sorted(g.number for g in got) == [1, 2, 3]
    assert seen(spark, root) == [10, 11, 20, 21, 30, 31]


def test_readers_take_the_newest_that_holds(spark, tmp_path):
    root = tmp_path / "b"
    for k in range(4):
        C.publish(spark, str(root), {"t": rows(spark, 4, 10 * k).coalesce(1)})
    log = root / C.LOG

    def damage(number, change):
        path = log / C._name(number)
        change(path)
        (log / f".{path.name}.crc").unlink(missing_ok=True)

    # A torn commit, one of another's content, and one whose file is gone: none is taken, nor its number.
    damage(4, lambda p: p.write_text(p.read_text()[:50]))
    assert seen(spark, str(root)) == [20, 21, 22, 23]
    third = C.load(spark, str(root), 3)
    part = next((root / third.tables["t"][0]["folder"]).glob("*.parquet"))
    kept = part.read_bytes()
    part.unlink()
    assert C.broken(spark, str(root), third) and seen(spark, str(root)) == [10, 11, 12, 13]
    part.write_bytes(kept)
    (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    assert C.newest(spark, str(root)).number == 3
    # Bytes that change without their number: found by contents only.
    part.write_bytes(kept[:20] + bytes([kept[20] ^ 1]) + kept[21:])
    assert C.newest(spark, str(root)).number == 3 and C.newest(spark, str(root), deep=True).number == 2
    assert [r["state"] for r in C.changed_files(spark, str(root), third, "t").collect()] == ["changed"]
    assert C.publish(spark, str(root), {"t": rows(spark, 1)}).number == 5 and seen(spark, str(root)) == [0]


def test_data_without_a_commit_are_not_seen(spark, tmp_path):
    root = str(tmp_path / "b")
    C.write(spark, root, {"t": rows(spark, 3)})
    assert C.newest(spark, root) is None
    C.publish(spark, root, {"t": rows(spark, 0)}, append=True)
    assert seen(spark, root) == []
