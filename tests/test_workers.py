"""Functions of the Python workers must run where this package is not installed."""

import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle

from caseloom.functions import embedding
from caseloom.operators import layers, neighbours
from caseloom.sources import files

def _embed():
    return embedding._embed_batch(pa.array([["one", "two"], [""]]), 16).to_pylist()


def _nearest():
    items = np.array([[1.0, 0.0], [0.0, 1.0]])
    return neighbours._best_of(np.array([[1.0, 0.1]]), np.array([np.nan]), items, 1, "cosine")[1].tolist()


WORK = {
    "embed": embedding._embed_batch,
    "ask": neighbours._asking,
    "meet": neighbours._meeting,
    "cells": neighbours.Cells,
    "score": layers._score_image,
    "nodes": files._TextNodes,
}


@pytest.mark.parametrize("name", sorted(WORK))
def test_loads_without_the_package(name, tmp_path):
    path = tmp_path / "f.pkl"
    path.write_bytes(cloudpickle.dumps(WORK[name]))
    code = f"import sys; from pyspark import cloudpickle; cloudpickle.load(open({str(path)!r}, 'rb')); assert 'caseloom' not in sys.modules"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_they_work():
    assert np.isclose(np.linalg.norm(_embed()[0]), 1.0) and _embed()[1][0] == 1.0
    assert _nearest() == [0]
