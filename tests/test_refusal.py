"""The refusal floor of best_features_fit follows its table."""

from types import SimpleNamespace

from trafficlens.operators import models
from trafficlens.plans import queries


def test_floor_is_one_more_than_the_training_sessions(spark, folder, monkeypatch):
    asked = []

    def refuse(train, config):
        asked.append((config.models.min_training_sessions, train.count()))
        raise ValueError

    monkeypatch.setattr(models, "fit_boosting_on_best", lambda train: SimpleNamespace(importances=lambda: {"x": 1.0}))
    monkeypatch.setattr(models, "fit_boosting", refuse)
    assert queries.best_features_fit(spark, folder).first()["refuses_few"] == 1
    assert [floor - rows for floor, rows in asked] == [1]
