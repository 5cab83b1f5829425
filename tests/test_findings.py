"""Every detector has a part in the findings of the corpus."""

from quarry.plans import catalog


def test_every_detector_is_among_all_findings(spark, sf_dir):
    """What one detector's query finds stands among all findings, row by row, and none finds nothing."""
    rows = catalog.findings_all(spark, sf_dir).collect()
    for kind, own in {"god_class": catalog.god_class, "long_method": catalog.long_method, "security_hotspot": catalog.security_scan, "test_gap": catalog.test_gap}.items():
        want = sorted(own(spark, sf_dir).collect(), key=str)
        assert want and sorted((r for r in rows if r.kind == kind), key=str) == want
    assert sum(r.kind == "circular_dependency" for r in rows) == 1
