"""Benchmark items at the edges of a document, up to 200 words long."""

import random

import pytest

from millrace.llm import decontaminate


@pytest.mark.parametrize("m", [5, 30, 38, 60, 100, 200])
def test_items_that_lack_words_at_an_edge(spark, m):
    rng, items, made = random.Random(m), [], []
    e = decontaminate.allowed_edits(m)
    for i in range(40):
        item = [f"t{rng.randrange(3000)}" for _ in range(m)]
        items.append((i, " ".join(item)))
        around = [f"u{rng.randrange(3000)}" for _ in range(150)]
        inside = list(item)
        for k in sorted(rng.sample(range(m), e), reverse=True):
            del inside[k]
        made += [(i, around + item[:m - e]), (i, item[e:] + around), (i, item[e:]), (i, item[:m - e]), (i, around + inside), (i, inside + around)]
    df = spark.createDataFrame([(k, " ".join(w)) for k, (_, w) in enumerate(made)], "doc_id long, text string")
    found = {(r["id"], r["item"]): r["distance"] for r in decontaminate.find_leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found == {(k, i): e for k, (i, _) in enumerate(made)}
