"""What the chunked recursions leave on disk, and the likelihood alone."""

import glob

import numpy as np
import pytest

from threadloom.operators import chains
from threadloom.sources.shared import shared_dir

CHAIN = {2: (np.array([0.6, 0.4]), np.array([[0.7, 0.3], [0.2, 0.8]]))}


def test_tables_of_earlier_steps_go(spark):
    folder = shared_dir(spark).removeprefix("file:")
    there = lambda: {x for x in glob.glob(f"{folder}/**", recursive=True) if x.rsplit("/", 1)[1].startswith(("files-", "rdd-"))}
    r = np.random.default_rng(0)
    steps = spark.createDataFrame([(i, t, r.random(2).tolist()) for i in range(3) for t in range(40)], "pair_index long, pos long, e array<double>")
    old = there()
    made = []
    _, ll = chains.posteriors(steps, CHAIN, 2, made)
    assert len(there() - old) == len(made) == 3  # chunks, and products up to and from each
    old = there()
    alone = chains.likelihoods(steps, CHAIN, 2)
    assert len(there() - old) == 1
    assert {x.pair_index: x.ll for x in alone.collect()} == pytest.approx({x.pair_index: x.ll for x in ll.collect()})
    old = there()
    chains.best_paths(steps, CHAIN, 2)
    assert len(there() - old) == 3  # chunks with what enters, maps, composed maps
