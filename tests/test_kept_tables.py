"""A ledger's days and trades come from one reading of the order lines, not one for each use."""

from alphaloom.queries import sim
from alphaloom.sources import panel as P


def test_the_gated_ledger_reads_the_lines_once(spark, data, monkeypatch):
    calls, table = [], P.table
    monkeypatch.setattr(P, "table", lambda s, d, name: calls.append(name) or table(s, d, name))
    out = sim.paper_ledger_gated(spark, data)
    assert out.count() > 0 and calls == ["lineitem"]
    rows = sim.ledger(spark, data)
    # nothing but written tables below the trades
    assert all("lineitem" not in f for f in rows.inputFiles())
