"""What the registered runs of the whole study cover."""

import pytest

from flowmark.operators.tasks import Protocol
from flowmark.plans import catalog


@pytest.mark.parametrize(
    "name, method", [("experiment_metrics", "corrected"), ("experiment_metrics_paper", "paper-compatible")]
)
def test_whole_study_is_registered(spark, tmp_path, monkeypatch, name, method):
    given = {}

    def seen(flows, spec, protocol, config=catalog.run.__defaults__[0]):
        given.update(flows=flows, spec=spec, protocol=protocol, config=config)
        return {"metrics": flows}

    spark.createDataFrame(
        [(i, kind, float(i), '{"k": 7}') for i, kind in enumerate(["view", "click", "error", "purchase", "signup"])],
        "event_id long, event_type string, value double, props string",
    ).write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(catalog, "run", seen)
    catalog.QUERIES[name](spark, str(tmp_path))
    classes = {r[0] for r in given["flows"].select("label_tactic").distinct().collect()}
    assert classes == {given["spec"].benign, *given["spec"].tactics}
    assert len(given["spec"].label_mapping("Multinomial")) == 5
    assert given["config"].stages == ("minimal", "pca", "lda") and given["config"].profile == "full"
    assert given["protocol"] == Protocol.resolve(method)
