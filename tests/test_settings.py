"""The registered queries train with the values of settings."""

import inspect
import os

import pytest

from rankloom import settings as S
from rankloom.operators import features as FT
from rankloom.operators import retrieval as V
from rankloom.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


class Asked(Exception):
    pass


def asked(of, *names):
    """Stands for ``of``: raises the values it is called with, without training."""
    whole = inspect.signature(of)

    def call(*args, **more):
        bound = whole.bind(*args, **more)
        bound.apply_defaults()
        raise Asked(*(bound.arguments[n] for n in names))

    return call


@pytest.mark.parametrize("name", ["gbt_train_score", "ablation_incremental", "position_removal", "ablation_pair", "serving_score", "sink_model", "gbdt_rounds", "serving_request", "rerank_model"])
def test_rankers_have_all_trees(spark, monkeypatch, name):
    monkeypatch.setattr(FT, "train_ranker", asked(FT.train_ranker, "trees"))
    with pytest.raises(Asked) as found:
        catalog.QUERIES[name](spark, SF)
    assert found.value.args == (S.TREES,)


def test_word_vectors_are_whole(spark, monkeypatch):
    monkeypatch.setattr(V, "word2vec", asked(V.word2vec, "dim", "epochs"))
    with pytest.raises(Asked) as found:
        catalog.QUERIES["word2vec_train"](spark, SF)
    assert found.value.args == (S.W2V_DIM, S.W2V_EPOCHS)
