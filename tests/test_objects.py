import threading

import pytest
from pyspark.sql import functions as F

from weftline.functions import ledger
from weftline.operators import exchange
from weftline.streaming.channel import Channel, Throttle


def ints(spark, values, pid=None):
    frame = spark.createDataFrame([(v,) for v in values], "value bigint")
    return frame if pid is None else frame.withColumn("pid", F.lit(pid))


@pytest.mark.parametrize("total", [1, 2, 5])
def test_shuffler(spark, total):
    called = []
    s = exchange.Shuffler(total, nranks=3, owner="contiguous", finished_callback=lambda: called.append(1))
    for p in range(total):
        s.insert(ints(spark, range(p * 10, p * 10 + p), p))
    with pytest.raises(RuntimeError):
        s.extract(0)
    s.insert_finished()
    with pytest.raises(RuntimeError):
        s.insert_finished()
    with pytest.raises(RuntimeError):
        s.insert(ints(spark, [1], 0))
    assert not s.finished()
    s.wait()
    s.wait()
    assert s.finished() and called == [1]
    for p in range(total):
        assert sorted(r["value"] for r in s.extract(p).collect()) == list(range(p * 10, p * 10 + p))
    assert sorted(p for r in range(3) for p in s.local_partitions(spark, r)) == list(range(total))
    with pytest.raises(IndexError):
        s.extract(total)
    s.close()
    s.close()


def test_empty_shuffler(spark):
    s = exchange.Shuffler(3)
    s.insert_finished()
    s.wait()
    assert s.extract(0) is None and s.finished()
    with pytest.raises(ValueError):
        exchange.Shuffler(0)


def test_all_gather(spark):
    g = exchange.AllGather()
    for rank in (2, 0, 1):
        for seq in (1, 0):
            g.insert(rank, seq, ints(spark, [100 * rank + 10 * seq, 100 * rank + 10 * seq + 1]))
    g.insert_finished()
    rows = g.wait_and_extract().orderBy("sequence").collect()
    assert [r["value"] for r in rows] == [100 * k + 10 * s + i for k in range(3) for s in range(2) for i in range(2)]
    assert [r["sequence"] for r in rows] == list(range(12))
    assert g.wait_and_extract(ordered=False).count() == 12
    g.close()


def test_sparse(spark):
    x = exchange.SparseAllToAll([(0, 1), (1, 0)], 2)
    for k in range(3):
        x.insert(0, 1, ints(spark, [k]))
    with pytest.raises(RuntimeError):
        x.insert(1, 1, ints(spark, [0]))
    x.insert_finished()
    with pytest.raises(RuntimeError):
        x.extract(1, 0)
    x.wait()
    assert [r["value"] for r in x.extract(1, 0).collect()] == [0, 1, 2] and x.extract(0, 1).count() == 0
    with pytest.raises(IndexError):
        exchange.SparseAllToAll([(0, 2)], 2)
    x.close()


def test_numbers():
    assert exchange.split_chunk_id(exchange.chunk_id(5, 77)) == (5, 77) and exchange.tag(3, 2) == 26
    for bad in (lambda: exchange.tag(1 << 20, 0), lambda: exchange.tag(0, 8), lambda: exchange.chunk_id(0, 1 << 38)):
        with pytest.raises(OverflowError):
            bad()


def test_ledger():
    gave = []
    spill = ledger.SpillManager()
    spill.add(lambda n: gave.append(("low", n)) or 3, priority=-1)
    first = spill.add(lambda n: gave.append(("high", n)) or 4)
    assert spill.spill(10) == 7 and gave == [("high", 10), ("low", 6)]
    assert spill.make_headroom(5, 9) == 0
    book = ledger.MemoryLedger({"DEVICE": 10, "HOST": 100}, spill)
    with book.reserve_or_fail(8) as r:
        assert (r.tier, book.reserved["DEVICE"]) == ("DEVICE", 8)
        assert book.reserve("DEVICE", 5)[0].size == 0 and book.reserve("DEVICE", 5)[1] == 3
        assert book.reserve_or_fail(8).tier == "HOST"
        book.use(r, 6)
        with pytest.raises(ledger.ReservationError):
            book.release(r, 3)
    assert (book.reserved["DEVICE"], book.available("DEVICE")) == (0, 4)
    assert book.reserve_and_spill("DEVICE", 10).size == 10
    spill.remove(first)
    with pytest.raises(ledger.ReservationError):
        book.reserve_and_spill("DEVICE", 10)
    with pytest.raises(ledger.ReservationError):
        book.reserve_or_fail(1000, ["DEVICE", "PINNED_HOST", "HOST"])


def test_statistics_book(spark):
    one, other = ledger.StatisticsBook(), ledger.StatisticsBook(enabled=False)
    one.add_stat("a", 2)
    one.add_stat("a", 5)
    other.add_stat("a", 1)
    one.add_report_entry("A", ("a",))
    one.add_report_entry("A", ("b",))
    assert vars(one.get_stat("a")) == {"count": 2, "value": 7.0, "max": 5.0} and other.names() == []
    with pytest.raises(IndexError):
        one.get_stat("b")
    merged = ledger.StatisticsBook.merge([one, ledger.StatisticsBook.deserialize(one.serialize()), other])
    assert merged.get_stat("a").count == 4 and merged.enabled and merged.entries == {"A": ("a",)}
    assert tuple(merged.frame(spark).first()) == ("a", 4, 14.0, 5.0)
    other.add_report_entry("A", ("x",))
    with pytest.raises(ValueError):
        ledger.StatisticsBook.merge([one, other])
    with pytest.raises(ValueError):
        ledger.StatisticsBook.merge([])
    one.add_stat('q"', 1)
    with pytest.raises(ValueError):
        one.to_json()
    one.clear()
    assert one.names() == [] and one.entries


def test_message_store(spark):
    store = ledger.MessageStore()
    a, b = store.insert(ints(spark, [1, 2])), store.insert(ints(spark, [3]), spillable=False)
    assert store.copy(a).count() == 2 and store.spill(a) and not store.spill(a) and not store.spill(b) and not store.spill(99)
    assert store.extract(a).count() == 2
    with pytest.raises(IndexError):
        store.extract(a)
    store.clear()


def test_channel():
    channel, got = Channel(), []
    reader = threading.Thread(target=lambda: got.extend(iter(channel.receive, None)))
    reader.start()
    assert all(channel.send(k) for k in range(50))
    channel.send_metadata("m")
    channel.drain()
    reader.join()
    assert got == list(range(50)) and channel.is_shutdown and channel.empty
    assert not channel.send(1) and channel.receive() is None and channel.receive_metadata() == "m"
    channel.shutdown()
    channel.shutdown()
    assert channel.receive_metadata() is None and not channel.send_metadata("x")
    with pytest.raises(ValueError):
        Channel().send(None)


def test_throttle():
    throttle = Throttle(Channel(10), 1)
    ticket = throttle.acquire()
    assert ticket.send("x")
    with pytest.raises(RuntimeError):
        ticket.send("y")
    assert throttle.acquire().send("z") and [throttle.channel.receive(), throttle.channel.receive()] == ["x", "z"]
    with pytest.raises(ValueError):
        Throttle(Channel(), 0)
