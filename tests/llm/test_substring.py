import numpy as np
import pytest

from tests.llm import brute
from tidegrid.llm import core, substring


@pytest.mark.parametrize("window", [5, 12, 35])
def test_against_brute_force(spark, window):
    rows = brute.awkward()
    got = substring.substring_dedup(spark.createDataFrame(rows, brute.SCHEMA), window, digest=True)
    got = [(r[0], r[1], r[2], r[3].hex()) for r in got.collect()]
    assert brute.ordered(got) == brute.ordered(brute.substring(rows, window))


def test_empty(spark):
    assert substring.substring_dedup(spark.createDataFrame([], brute.SCHEMA)).count() == 0


def test_whole_table(spark):
    docs = core.table(spark, "/root/testdata/sf0.001", "documents")
    want = brute.substring([tuple(r) for r in docs.select("doc_id", "text").collect()], 35)
    assert brute.ordered([tuple(r) for r in substring.op6(spark, "/root/testdata/sf0.001").collect()]) == brute.ordered(want)


def test_words_that_polynomials_modulo_a_power_of_two_confuse():
    t = "a"
    while len(t) < 4096:
        t += t.translate(str.maketrans("ab", "ba"))
    u = t.translate(str.maketrans("ab", "ba"))
    buf = np.frombuffer(f"{t} {u} {t}".encode(), np.uint8)
    x, y, z = core.word_hashes(buf, np.array([0, 4097, 8194]), np.array([4096, 8193, 12290])).tolist()
    assert x == z != y
