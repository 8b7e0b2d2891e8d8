"""The rows that a model is trained on are held once."""

import pytest

from cliplens.operators import models
from cliplens.plans import models as plans
from tests.conftest import SF


@pytest.mark.parametrize("kind, fit", [("view", "fit_ridge"), ("bucket", "fit_bucket_classifier")])
def test_training_rows_are_not_cached_beside_the_blocks_of_the_fit(spark, monkeypatch, kind, fit):
    real, seen = getattr(models, fit), []

    def recorded(train):
        seen.append((train.storageLevel.useMemory, train.count()))
        return real(train) if kind == "view" else real(train, max_iter=2)

    monkeypatch.setattr(models, fit, recorded)
    data, store = plans.trained(spark, SF, kind)
    assert seen == [(False, data.where("is_train").count())]
    assert store.model(kind).numFeatures == store.features().transform(data).first()["features"].size
