import random

import pyarrow as pa
from pyspark.sql import functions as F

from loomspan.operators import graphs as g
from loomspan.operators.profile import profiled


def test_lists_sent_to_many_groups_are_small(spark):
    rnd = random.Random(3)
    rows = [(rnd.randrange(3000), rnd.randrange(3000)) for _ in range(150_000)]
    e = spark.createDataFrame(rows, "src long, dst long").cache()
    e.count()
    got = []
    # some thirty groups, each of which gets nearly all lists; as arrays of longs these alone were over 10 MB
    cost = profiled(spark, [("clustering", lambda: got.append(g.clustering(e, 5_000).agg(F.sum("k").alias("k"), F.sum("links").alias("links")).first()))]).first()
    pairs = {(min(a, b), max(a, b)) for a, b in rows if a != b}
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    assert got[0].k == 2 * len(pairs) and got[0].links == sum(len(near[a] & near[b]) for a, b in pairs)
    assert cost.status == "done" and cost.shuffle_mb < 10


def test_packed_lists_are_read_back():
    lists = [[0, 1, 127, 128, 300], [], [5], [2**14, 2**21, 2**33, 2**50], [7, 8], []]
    batch = pa.record_batch([pa.array(range(6), pa.int64()), pa.array(lists, pa.list_(pa.int64()))], names=["src", "to"])
    (out,) = g._packed(iter([batch.slice(0, 6)]))
    assert out.column(1).to_pylist() == [len(x) for x in lists]
    for lo in range(6):
        sizes, to = g._unpacked(out.column(2).slice(lo))
        assert sizes.tolist() == [len(x) for x in lists[lo:]] and to.tolist() == [y for x in lists[lo:] for y in x]
    assert [at for at, _ in g._slices(out.column(2))] == [0]
