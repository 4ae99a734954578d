"""The broadcaster over micro-batches, against a plain simulation."""

import random
from datetime import datetime, timedelta, timezone

import pytest

from vodlens.streaming import broadcast as B

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "channel string, at timestamp, seq long, op string, client string, topics array<string>, event_type string, item long, count int"


def run(spark, tmp_path, batches, **options):
    """Each list of operations is a micro-batch; rows out by batch."""
    folder = tmp_path / "in"
    out = []
    folder.mkdir()
    stream = spark.readStream.schema(SCHEMA).parquet(str(folder))
    with B.state_store(spark):
        for k, batch in enumerate(batches):
            rows = [(c, START + timedelta(seconds=t), n, op, *rest) for n, (c, t, op, *rest) in enumerate(batch, 1000 * k)]
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
            got = []
            keep = lambda df, _, got=got: got.extend(df.collect())
            q = B.broadcast(stream, **options).writeStream.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).foreachBatch(keep).start()
            q.awaitTermination()
            out.append(sorted([(r.channel, r.client, r.what, r.item, r.place) for r in got], key=repr))
    return out


def join(c, t, client, topics=None, count=0):
    return (c, t, "join", client, topics, None, None, count)


def event(c, t, item, kind="a"):
    return (c, t, "event", None, None, kind, item, None)


def take(c, t, client, count=None):
    return (c, t, "take", client, None, None, None, count)


def leave(c, t, client):
    return (c, t, "leave", client, None, None, None, None)


def test_join_topics_full_take_leave_and_expiry(spark, tmp_path):
    got = run(
        spark, tmp_path,
        [
            [event("x", 0, 1), event("x", 1, 2, "b"), join("x", 2, "ann", ["b"], 5), join("x", 3, "bob", None), event("x", 4, 3), event("y", 4, 50)],
            [event("x", 5, 4, "b"), event("x", 6, 5, "b"), event("x", 7, 6, "b"), take("x", 8, "ann", 2), event("x", 9, 7, "b"), take("x", 9, "nobody")],
            [join("x", 10, "ann", ["a"]), event("x", 11, 8, "a"), event("x", 12, 9, "b"), take("x", 13, "ann"), leave("x", 14, "bob"), event("x", 15, 10)],
            [event("x", 500, 11, "a")],
            [event("x", 501, 12, "a")],
        ],
        shards=3, capacity=3, idle_sec=100.0, delay="1 second",
    )
    assert got[0] == sorted([("x", "ann", "JOINED", None, None), ("x", "ann", "QUEUED", 2, None), ("x", "bob", "JOINED", None, None), ("x", "bob", "QUEUED", 3, None)], key=repr)
    second = [("x", "ann", "QUEUED", 4, None), ("x", "ann", "QUEUED", 5, None), ("x", "ann", "DROPPED", 6, None), ("x", "ann", "DELIVERED", 2, 0), ("x", "ann", "DELIVERED", 4, 1), ("x", "ann", "QUEUED", 7, None)]
    second += [("x", "bob", "QUEUED", 4, None), ("x", "bob", "QUEUED", 5, None), ("x", "bob", "DROPPED", 6, None), ("x", "bob", "DROPPED", 7, None)]
    assert got[1] == sorted(second, key=repr)
    third = [("x", "ann", "QUEUED", 8, None), ("x", "ann", "DELIVERED", 5, 0), ("x", "ann", "DELIVERED", 7, 1), ("x", "ann", "DELIVERED", 8, 2), ("x", "bob", "DROPPED", 8, None), ("x", "bob", "DROPPED", 9, None), ("x", "bob", "LEFT", None, 3), ("x", "ann", "QUEUED", 10, None)]
    assert got[2] == sorted(third, key=repr)
    assert ("x", "ann", "QUEUED", 11, None) in got[3]  # heard of at 13, and the watermark was at 14 when the batch began
    assert [r for r in got[3] + got[4] if r[2] == "EXPIRED"] == [("x", "ann", "EXPIRED", None, 2)] and not [r for r in got[4] if r[2] == "QUEUED"]


def simulate(ops, capacity, replay):
    clients, recent, out = {}, {}, []
    for c, _, op, client, topics, kind, item, count in ops:
        if op == "event":
            recent.setdefault(c, []).append((item, kind))
            for (channel, who), (wanted, queue) in clients.items():
                if channel == c and ("*" in wanted or kind in wanted):
                    out.append((c, who, "DROPPED" if len(queue) >= capacity else "QUEUED", item, None))
                    if len(queue) < capacity:
                        queue.append(item)
        elif op == "join":
            wanted = topics or ["*"]
            if (c, client) in clients:
                clients[c, client] = (wanted, clients[c, client][1])
            else:
                again = [i for i, k in (recent.get(c, [])[-replay:][-count:] if count else []) if "*" in wanted or k in wanted][:capacity]
                clients[c, client] = (wanted, again)
                out += [(c, client, "JOINED", None, None), *((c, client, "QUEUED", i, None) for i in again)]
        elif (c, client) in clients:
            wanted, queue = clients[c, client]
            if op == "take":
                n = len(queue) if count is None else count
                out += [(c, client, "DELIVERED", i, p) for p, i in enumerate(queue[:n])]
                clients[c, client] = (wanted, queue[n:])
            else:
                out.append((c, client, "LEFT", None, len(clients.pop((c, client))[1])))
    return sorted(out, key=repr)


@pytest.mark.parametrize("shards", [1, 4])
def test_equals_a_plain_simulation(spark, tmp_path, shards):
    r = random.Random(8)
    ops = []
    for t in range(600):
        c, who = r.choice("xy"), f"u{r.randrange(12)}"
        ops.append(r.choice([event(c, t, t, r.choice("abc")), event(c, t, t, r.choice("abc")), join(c, t, who, r.choice([None, ["a"], ["b", "c"]]), r.choice([0, 3, 30])), take(c, t, who, r.choice([None, 1, 4])), leave(c, t, who)]))
    got = run(spark, tmp_path, [ops[:250], ops[250:251], ops[251:]], shards=shards, capacity=5, replay=20, idle_sec=1e6)
    assert sorted((x for b in got for x in b), key=repr) == simulate(ops, 5, 20)
