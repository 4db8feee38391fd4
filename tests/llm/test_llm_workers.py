"""Models and functions for the workers must load where this package is not installed."""

import subprocess
import sys

import numpy as np
import pytest
from pyspark import cloudpickle

from caseloom.llm import bloomsketch, chat, decontaminate, langid, neardup, quality, tokenfile  # noqa: F401

SENT = {
    "items": decontaminate.Items([1], ["one two three four five six"]),
    "languages": langid.LanguageModel({"en": b"the cat"}),
    "scorer": quality.Scorer(np.zeros(8), np.zeros(8), np.zeros(8), np.ones(8), 0.0),
    "sketch": neardup._sketch,
    "grams": neardup._grams,
    "cleaner": decontaminate._cleaner(None, 0.8),
    "trace": chat._trace(chat.Costs()),
    "tokenizer": tokenfile._shared_tokenizer,
    "decode": tokenfile.TokenFile,
}


@pytest.mark.parametrize("name", sorted(SENT))
def test_loads_without_the_package(name, tmp_path):
    path = tmp_path / "f.pkl"
    path.write_bytes(cloudpickle.dumps(SENT[name]))
    code = f"import sys, pickle; pickle.load(open({str(path)!r}, 'rb')); assert 'caseloom' not in sys.modules"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
