"""Records are posted once, whatever dies in between."""

import os

import pytest

from lexweave.sources import audit_sink


def posted(folder):
    return sorted(open(f"{folder}/posts").read().split()) if os.path.exists(f"{folder}/posts") else []


def poster(folder, dies_at=None, after=True):
    """A service that writes down what it gets; the first time it meets dies_at the task's process ends."""

    def post(payload):
        dies = payload == dies_at and not os.path.exists(f"{folder}/died")
        if dies:
            open(f"{folder}/died", "w").close()
            if not after:
                os._exit(1)
        with open(f"{folder}/posts", "a") as out:
            out.write(payload + "\n")
        if dies:
            os._exit(1)
        return 500 if payload.endswith("7") else 200

    return post


@pytest.mark.parametrize("after", [True, False])
def test_a_killed_task_posts_nothing_twice(spark, tmp_path, after):
    folder, ledger = str(tmp_path), f"file://{tmp_path}/ledger"
    df = spark.range(40).selectExpr("cast(id as string) key", "concat('p', id) payload").repartition(3)
    name = f"killed{after}"
    audit_sink.register_sink(spark, name, poster(folder, "p21", after), ledger)
    with pytest.raises(Exception):  # noqa: B017, PT011
        df.write.format(name).mode("append").save()
    before = posted(folder)
    assert len(before) == len(set(before))
    for _ in range(2):
        df.write.format(name).mode("append").save()
    want = {f"p{i}" for i in range(40)} - (set() if after else {"p21"})
    assert posted(folder) == sorted(want)
    rows = {r["key"]: (r["status"], r["state"]) for r in audit_sink.read_ledger(spark, ledger).collect()}
    assert len(rows) == 40 and rows["21"] == (None, "uncertain") and rows["7"] == (500, "refused") and rows["3"] == (200, "taken")
    # the service can tell of the one in doubt
    audit_sink.register_sink(spark, name + "known", poster(folder), ledger, known=lambda key: 200)
    df.write.format(name + "known").mode("append").save()
    rows = {r["key"]: r["state"] for r in audit_sink.read_ledger(spark, ledger).collect()}
    assert rows["21"] == "taken" and posted(folder) == sorted(want)


def test_payloads_are_tried_in_turn(spark, tmp_path):
    ledger = f"file://{tmp_path}/ledger"
    audit_sink.register_sink(spark, "turns", poster(str(tmp_path)), ledger, ("a", "b"))
    df = spark.createDataFrame([("x", "1", "2"), ("y", "7", "3"), ("z", "17", "27")], "key string, a string, b string")
    df.write.format("turns").mode("append").save()
    rows = {r["key"]: (r["payload"], r["status"], r["state"]) for r in audit_sink.read_ledger(spark, ledger).collect()}
    assert rows == {"x": ("a", 200, "taken"), "y": ("b", 200, "taken"), "z": (None, 500, "refused")}
    assert posted(tmp_path) == ["1", "17", "27", "3", "7"]


def test_a_stream_posts_each_record_once(spark, tmp_path):
    ledger, source = f"file://{tmp_path}/ledger", f"{tmp_path}/source"
    audit_sink.register_sink(spark, "streamed", poster(str(tmp_path)), ledger)
    for turn in range(2):
        spark.range(5 * turn, 5 * turn + 6).selectExpr("cast(id as string) key", "concat('p', id) payload").write.mode("append").json(source)
        # the checkpoint is lost between the turns, so the second one meets the first one's records again
        query = spark.readStream.schema("key string, payload string").json(source).writeStream.format("streamed").option("checkpointLocation", f"{tmp_path}/checkpoint{turn}").trigger(availableNow=True).start()
        query.awaitTermination()
    assert posted(tmp_path) == sorted(f"p{i}" for i in range(11))
    assert audit_sink.read_ledger(spark, ledger).count() == 11


def test_speculation_is_refused(tmp_path):
    class Conf:
        def get(self, name, default):
            return "true"

    class Session:
        conf = Conf()

    with pytest.raises(ValueError, match="speculation"):
        audit_sink.register_sink(Session, "x", print, f"file://{tmp_path}")
