"""Rows of small sources and languages are judged by the estimate of the next larger group."""
import random

import pytest

from lexframe.llm import quality_rules

from .conftest import SCHEMA


def plain(rng, n=120):
    return " ".join(rng.choice(("river", "stone", "cloud", "meadow", "lantern", "a", "of")) + str(rng.randrange(9999)) for _ in range(n))


def junk(rng, n=120):
    return " ".join("###%%%" + str(rng.randrange(9999)) for _ in range(n))


def judged(spark, rows):
    df = spark.createDataFrame([(i, t, lang, source, len(t)) for i, (t, lang, source) in enumerate(rows)], SCHEMA).repartition(3)
    return {r.doc_id: r for r in quality_rules.judge(df).collect()}


@pytest.mark.parametrize("lang, source", [("en", "small"), ("es", "big"), ("", "big"), (None, None)])
def test_small_groups_are_judged(spark, lang, source):
    """A few rows of a small source, or of a small language, beside one large group."""
    rng = random.Random(4)
    rows = [(plain(rng), "en", "big") for _ in range(150)] + [(plain(rng), lang, source) for _ in range(5)] + [(junk(rng), lang, source)]
    got = judged(spark, rows)
    assert len(got) == 156 and not any(r.base_failed for r in got.values())
    assert not got[155].kept and all(got[i].kept for i in range(155))


def test_many_small_groups_count_all_rows_of_their_language(spark):
    """No group reaches the least size, and neither does the corpus."""
    rng = random.Random(5)
    rows = [(plain(rng), f"l{i % 4}", f"s{i % 9}") for i in range(80)] + [(junk(rng), "l1", "s1")]
    got = judged(spark, rows)
    assert not got[80].kept and all(got[i].kept for i in range(80))


def test_large_groups_keep_their_own_estimate(spark):
    """Rows that are usual in their own group stay, however far from the corpus."""
    rng = random.Random(6)
    rows = [(plain(rng), "en", "text") for _ in range(120)] + [(junk(rng), "en", "code") for _ in range(120)] + [(plain(rng), "es", "x")]
    got = judged(spark, rows)
    assert all(r.kept for r in got.values())
