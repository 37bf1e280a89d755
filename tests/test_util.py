import pytest
from pyspark.sql import functions as F

from stemma import util


class _Cluster:
    master = "spark://somewhere:7077"

    class _Conf:
        def get(self, _):
            return None

    def getConf(self):
        return self._Conf()

    def getCheckpointDir(self):
        return None


class _Session:
    sparkContext = _Cluster()


def test_no_silent_folder_on_a_cluster():
    with pytest.raises(RuntimeError):
        util.checkpoint_root(_Session())


def test_cut_tables_go(spark):
    df, n = util.cut_counting(spark.range(10), even=F.col("id") % 2 == 0)
    assert n == {"even": 5} and df.count() == 10
    assert util.clean(spark) >= 1
    assert util.clean(spark) == 0


def test_wide_rows_are_not_broadcast(spark):
    wide = util.cut(spark.range(50).select(F.repeat(F.col("id").cast("string"), 1_000).alias("t")))
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString() or "broadcast" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(util.broadcast_if_small(wide))
    assert not hinted(util.broadcast_if_small(wide, size=100))
    assert not hinted(util.broadcast_if_small(wide, rows=49))


def test_numbers_within_groups(spark):
    rows = [("hot", i % 7, i) for i in range(500)] + [(None, None, 1), (None, 2, 2), ("x", 1, 1)]
    df = spark.createDataFrame(rows, "k string, a int, b int")
    got = sorted((r["k"] or "", r["nth"], r["a"] if r["a"] is not None else -1, r["b"]) for r in util.number_within(df, ["k"], ["a", "b"], "nth").collect())
    want = []
    for k in ("", "hot", "x"):
        mine = sorted((a if a is not None else -1, b) for kk, a, b in rows if (kk or "") == k)
        want += [(k, i + 1, a, b) for i, (a, b) in enumerate(mine)]
    assert got == sorted(want)
