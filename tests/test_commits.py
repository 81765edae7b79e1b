"""Two writers on one corpus: both changes are there, and nothing is lost."""

import threading

import pytest

from docloom.plans import store
from docloom.plans.commits import CommitLog, Folder
from tests.test_store import doc


def test_each_number_is_taken_once(spark, tmp_path):
    log = CommitLog(Folder(spark, str(tmp_path / "log")), {"n": 0, "by": []})
    assert log.latest() == (0, {"n": 0, "by": []}) and log.update(lambda m: None) is None

    def work(name):
        for _ in range(10):
            CommitLog(Folder(spark, str(tmp_path / "log")), {"n": 0, "by": []}).update(lambda m: {"n": m["n"] + 1, "by": [*m["by"], name]})

    threads = [threading.Thread(target=work, args=(i,)) for i in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    number, state = log.latest()
    assert number == state["n"] == 40 and sorted(state["by"]) == sorted([0, 1, 2, 3] * 10)
    assert not log.folder.put_new(f"{number:020d}.json", "{}") and log.latest()[1] == state
    log.vacuum()
    assert log.numbers() == list(range(20, 41)) and [n for n in log.folder.names() if n[0] == "."] == []


def test_a_lost_race_is_run_again(spark, tmp_path):
    """Another writer commits between the read and the commit: to other buckets, then to the same."""
    one, two = (store.Store(spark, str(tmp_path / "c"), buckets=4) for _ in range(2))
    one.write({"documents": doc(spark, ("a", "1"), ("b", "1"))})
    put = one._put
    for inside in ([("c", "2"), ("d", "2"), ("e", "2"), ("f", "2")], [("a", "3"), ("b", "3")]):
        calls = []

        def slow(name, df, calls=calls, inside=inside):
            out = put(name, df)
            if not calls:
                two.write({"documents": doc(spark, *inside)})
                two.set_setting("seen", len(inside))
            calls.append(name)
            return out

        one._put = slow
        one.write({"documents": doc(spark, ("b", "own"))})
        assert len(calls) == 2  # computed again, since the other wrote to its bucket
    one._put = put
    assert sorted(map(tuple, one.table("documents").collect())) == [("a", "3"), ("b", "own"), ("c", "2"), ("d", "2"), ("e", "2"), ("f", "2")]
    assert one.setting("seen") == 2 and two.manifest == one.manifest


def test_parallel_writers(spark, tmp_path):
    def work(k):
        store.Store(spark, str(tmp_path / "c"), buckets=2).write({"documents": doc(spark, *[(f"{k}-{i}", str(k)) for i in range(5)])})

    threads = [threading.Thread(target=work, args=(k,)) for k in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    s = store.Store(spark, f"file://{tmp_path}/c", buckets=2)
    assert sorted(r.document_id for r in s.table("documents").collect()) == sorted(f"{k}-{i}" for k in range(4) for i in range(5))
    s.write({"chunks": doc(spark, ("0-0", "x"))})
    s.freeze({})
    s.vacuum()
    assert s.validate() == []
    with pytest.raises(store.FrozenCorpus):
        s.write({"documents": doc(spark, ("z", "1"))})
