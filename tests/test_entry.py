import __spark_entry__ as E


def test_contract_keys(spark):
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 70


def test_entry_runs(spark):
    df = E.entry(spark)
    r = df.collect()
    assert df.columns == ["acc1", "acc5", "acc10", "n_queries"] and len(r) == 1
    assert r[0]["acc1"] <= r[0]["acc5"] <= r[0]["acc10"]


def test_oracle_agreement_small(spark):
    """A few registered queries against their DuckDB oracle at sf0.001."""
    import duckdb
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings", "events", "part", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    for name in ("retrieval_topk", "pair_filter", "tag_pack", "cls_macro_f1", "early_stop", "contrastive_loss"):
        s = E.queries()[name](spark, sf)
        res = con.execute(E.oracle_sql()[name])
        cols = [d[0] for d in res.description]
        d = sorted(repr(tuple(r[cols.index(c)] for c in s.columns)) for r in res.fetchall())
        assert sorted(repr(tuple(r)) for r in s.collect()) == d, name
