"""Message streams over files: restart, bad messages, repeats."""

import json
import os
import time

import pytest

from millrace import workdir
from millrace.streaming import messages


def message(uid, ts="2024-01-05T10:00:00.000000Z", services=(("s", "web"),), **extra):
    body = {
        "name": f"app-{uid}",
        "namespace": "ns",
        "uid": uid,
        "ts": ts,
        "ExtraServices": [
            {"servicename": n, "servicetype": k, "entrypoint": "web", "serviceport": 80, "routepath": "/p"}
            for n, k in services
        ],
    }
    return json.dumps({**body, **extra})


class Folder:
    """An input folder messages arrive in, with a sink and a checkpoint."""

    def __init__(self, spark):
        self.spark = spark
        self.path, self.sink, self.checkpoint = (
            workdir.fresh_path(spark, label) for label in ("in", "sink", "checkpoint")
        )
        os.makedirs(self.path)
        self.files = 0

    def arrive(self, *lines, age=1000):
        self.files += 1
        target = os.path.join(self.path, f"{self.files:03}.txt")
        with open(target, "w") as out:
            out.write("\n".join(lines) + "\n")
        moment = time.time() - age + self.files  # files are taken in this order
        os.utime(target, (moment, moment))

    def route(self):
        stream = messages.routed(messages.read_messages(self.spark, self.path))
        messages.run_to_path(stream, self.sink, self.checkpoint, ["outcome"])
        return self.spark.read.parquet(self.sink)

    def once(self, horizon="1 hour", files_per_batch=1):
        source = messages.read_messages(self.spark, self.path, files_per_batch)
        messages.run_to_path(messages.first_delivery(source, horizon), self.sink, self.checkpoint)
        return sorted(r["uid"] for r in self.spark.read.parquet(self.sink).collect())


@pytest.fixture
def folder(spark):
    return Folder(spark)


def test_routes_and_dead_letters(folder, rows):
    folder.arrive(
        message("1", services=[("a", "web"), ("b", "tcp")]),
        '{"name": "cut',
        "not json",
        "[1, 2]",
        message("2", services=[]),
        message("3", ExtraServices=None),
        message("4", unknown="ignored"),
    )
    found = folder.route()
    assert rows(found.filter("outcome = 'routed'"), "uid", "servicename") == [
        ("1", "a"), ("1", "b"), ("4", "s"),
    ]
    assert rows(found.filter("outcome = 'dead'"), "raw") == [
        ("[1, 2]",), ("not json",), ('{"name": "cut',),
    ]


def test_wrong_types_go_to_the_dead_letters(folder, rows):
    folder.arrive(message("1", name="fine"), message("2", ExtraServices="text"))
    found = folder.route()
    assert rows(found, "outcome", "uid") == [("dead", "2"), ("routed", "1")]


def test_restart_writes_every_message_once(folder):
    folder.arrive(message("1"), message("2"))
    assert folder.route().count() == 2
    assert folder.route().count() == 2  # nothing new: nothing written again
    folder.arrive(message("3"))
    assert folder.route().count() == 3


def test_lost_commit_is_replayed_without_duplicates(folder):
    folder.arrive(message("1"), message("2"))
    folder.route()
    # As if the driver died after the sink took the batch but before its commit.
    commits = os.path.join(folder.checkpoint, "commits")
    for name in os.listdir(commits):
        os.remove(os.path.join(commits, name))
    assert folder.route().count() == 2


def test_repeats_are_dropped_across_batches_and_restarts(folder):
    folder.arrive(message("1"), message("1"), message("2"))
    folder.arrive(message("2"), message("3"))
    assert folder.once() == ["1", "2", "3"]
    folder.arrive(message("1"), message("4"), "bad")
    assert folder.once() == ["1", "2", "3", "4"]


def test_late_messages_within_the_horizon_are_kept(folder):
    folder.arrive(message("new", ts="2024-01-05T12:00:00.000000Z"))
    folder.arrive(message("old", ts="2024-01-05T11:30:00.000000Z"))
    assert folder.once(horizon="1 hour") == ["new", "old"]


def test_messages_need_a_uid_but_no_time(folder):
    plain = json.dumps({"name": "a", "namespace": "ns", "uid": "3", "ExtraServices": []})
    folder.arrive(message("1"), message(None), message("2", ts=None), plain)
    folder.arrive(plain, message("2", ts=None))
    assert folder.once() == ["1", "2", "3"]


def test_files_with_old_dates_are_not_too_late(folder):
    """A file copied with its old time, in a later batch or after a restart: its new uids come out, its repeats do not."""
    folder.arrive(message("u1"), message("u2"), age=0)
    assert folder.once(horizon="1 hour") == ["u1", "u2"]
    folder.arrive(message("u1"), message("u3"), age=2 * 3600)
    assert folder.once(horizon="1 hour") == ["u1", "u2", "u3"]
    folder.arrive(message("u4"), message("u3"), age=400 * 24 * 3600)
    folder.arrive(message("u4"), message("u5"), message("u2"), age=-3600)
    folder.arrive(message("u6"), message("u5"), age=5 * 3600)
    assert folder.once(horizon="1 hour") == ["u1", "u2", "u3", "u4", "u5", "u6"]


def test_state_is_dropped_after_the_horizon(folder):
    folder.arrive(message("u1"))
    assert folder.once(horizon="1 second") == ["u1"]
    for k in range(3):  # the clock goes on with every batch
        time.sleep(1.2)
        folder.arrive(message(f"other{k}"))
        folder.once(horizon="1 second")
    folder.arrive(message("u1"))
    assert folder.once(horizon="1 second").count("u1") == 2
