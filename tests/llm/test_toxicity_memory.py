"""The chain is fitted on the driver, whose memory must not grow with rows times features."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import linear, toxicity


def test_the_fit_holds_a_block_of_rows_at_a_time(spark):
    n = 12_000
    toxic = (F.col("doc_id") % 4 == 0).cast("int")
    # a toxic text has 12 of 400 words that no other has, all have 12 of 400 common ones
    word = lambda name, k: F.concat(F.lit(name), F.substring(F.md5(F.pmod(F.xxhash64("doc_id", F.lit(name), F.lit(k)), F.lit(400)).cast("string")), 1, 8))
    words = [word("c", k) for k in range(12)] + [F.when(toxic == 1, word("t", k)) for k in range(12)]
    docs = spark.range(n).select(F.col("id").alias("doc_id")).select("doc_id", F.concat_ws(" ", *words).alias("text"))
    labels = spark.range(n).select(F.col("id").alias("doc_id")).select("doc_id", toxic.alias("toxic"), F.lit(0.0).alias("quality"))
    tracemalloc.start()
    chain = toxicity.fit(docs, labels, {"toxic": F.col("toxic")})
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert len(chain.numbers[0]) == toxicity.FEATURES
    # its matrix of all rows and features of 4 bytes
    assert most < n * toxicity.FEATURES * 4 / 1e6, most
    found = chain.held_out[:, 0] > 0
    assert (found == (chain.truth[:, 0] == 1)).mean() > 0.999


def test_blocks_of_rows_give_the_same_model():
    rng = np.random.default_rng(5)
    x = (rng.random((5001, 30)) < 0.2).astype(np.float32)
    y = (rng.random(len(x)) < linear.sigmoid(x @ rng.normal(size=30))).astype(float)
    one = np.concatenate([x, np.ones((len(x), 1), np.float32)], 1)
    w, b = linear.fit_logistic(x, y)
    for size in (1, 700, 5001, 9000):
        again, c = linear.fit_blocks(lambda i, j: one[i:j], 30, y, size=size)
        assert again == pytest.approx(w, abs=1e-4)
        assert c == pytest.approx(b, abs=1e-4)
