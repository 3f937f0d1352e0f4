"""The driver's contract."""

import __spark_entry__ as entry


def test_each_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_flagship_runs(spark):
    assert entry.entry(spark).count() == 1


def test_own_queries_agree_with_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE VIEW lineitem AS SELECT * FROM '/root/testdata/sf0.001/lineitem.parquet'")
    for name in ("fit_trend", "channels_baseline", "tsauc_strongest", "kind_by_bin_crosstab", "two_sample_ks_w1", "split_scan", "channels_acf_wide", "rank_battery"):
        df = entry.queries()[name](spark, "/root/testdata/sf0.001")
        cols = sorted(df.columns)
        mine = sorted(map(str, (tuple(r) for r in df.select(*cols).collect())))
        quoted = ", ".join(f'"{c}"' for c in cols)
        theirs = sorted(map(str, con.execute(f"SELECT {quoted} FROM ({entry.oracle_sql()[name]})").fetchall()))
        assert mine == theirs, name
