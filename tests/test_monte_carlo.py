from tallyglass.operators import simulation
from tallyglass.plans import catalog, findings, report_queries  # noqa: F401


def test_query_has_the_defaults(spark, sf, monkeypatch):
    made = []
    monkeypatch.setattr(findings, "detect_tables", lambda wide, names: made.append((wide, names)) or wide.selectExpr("source", "'x' AS detector"))
    rows = catalog.QUERIES["monte_carlo_fpr"](spark, sf).collect()
    wide, names = made[0]
    assert len(names) == 4 * len(simulation.VARIABLES) and wide.count() == 1000 * 60
    assert [(r.trials_hit, r.rate, r.trial_rate) for r in rows] == [(1000, 60.0, 1.0)]
