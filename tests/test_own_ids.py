"""Which S1 records are targets too is read from the ids of the targets."""

from matchbook.operators import blocking as bl
from test_block_scale import records


def test_own_ids_are_read_without_keys(spark, monkeypatch):
    """Which S1 records are targets too needs the ids of the targets, not a second run of their keys."""
    plans = {}

    def written(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return real(df, name)

    real = bl.written
    monkeypatch.setattr(bl, "written", written)
    s1, tg = records(spark, "S1-", ["oak mill", "oak"]), records(spark, "S2-", ["oak mill", "oak press", "elm mill"])
    assert bl.block(s1, tg, "v4", 2).count() == 4
    assert plans["blocks-found"].count("Generate explode") == 1
