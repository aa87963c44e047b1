"""Commands over one simulated warehouse."""

import json

import pytest

from tidewater.__main__ import parser, run
from tidewater.sources import io


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("cli"))
    assert "signups: " in run(spark, ["build", "--warehouse", path])
    return path


def test_metrics(spark, built):
    rows = json.loads(run(spark, ["metrics", "spend", "signups", "--by", "channel", "--warehouse", built]))
    assert len(rows) > 2 and all(r["signups"] > 0 for r in rows)
    one = json.loads(run(spark, ["metrics", "signups", "--by", "channel", "--channel", rows[0]["channel"], "--warehouse", built]))
    assert one == [{"channel": rows[0]["channel"], "signups": rows[0]["signups"]}]
    with pytest.raises(KeyError):
        run(spark, ["metrics", "nonsense", "--warehouse", built])


def test_weekly_review(spark, built, tmp_path):
    out = tmp_path / "review.md"
    run(spark, ["weekly-review", "--warehouse", built, "--out", str(out)])
    assert out.read_text().startswith("# Weekly review")


def test_causal_report(spark):
    lines = run(spark, ["causal-report"]).splitlines()
    assert len(lines) == 5
    for x in lines[1:]:
        naive, causal, truth = map(float, x.split()[-3:])
        assert abs(causal - truth) < abs(naive - truth)


def test_missing_warehouse(spark, tmp_path):
    with pytest.raises(io.WarehouseUnavailable):
        run(spark, ["metrics", "spend", "--warehouse", str(tmp_path / "none")])
    with pytest.raises(SystemExit):
        parser().parse_args(["no-such-command"])
