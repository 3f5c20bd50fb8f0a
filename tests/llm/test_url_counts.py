"""Counts of the URL models where labelled URLs have more contexts than the 2**18 slots of the former tables."""

import random

import numpy as np

from millrace.llm import urls


def test_counts_of_many_contexts_stay_apart(spark):
    rng = random.Random(3)
    said = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789-_", k=60)) for _ in range(30_000)]
    df = spark.createDataFrame([(t, "allow" if k % 2 else "block") for k, t in enumerate(said)], "said string, verdict string")
    aside = {r["said"] for r in df.selectExpr("said", "pmod(xxhash64(said), 5) AS m").collect() if r["m"] == 0}
    model = urls.fit(df)
    for side, label in ((0, 1), (1, 0)):
        texts = [t for k, t in enumerate(said) if k % 2 == label and t not in aside]
        assert all(np.all(keys[1:] > keys[:-1]) for keys, *_ in (model.contexts[side], model.grams[side]))
        counts = {}
        for t in texts:
            s = "\0" * urls.ORDER + t + "\0"
            for at in range(urls.ORDER, len(s)):
                for k in range(urls.ORDER + 1):
                    counts.setdefault(s[at - k:at], []).append(s[at])
        kept = {c: x for c, x in counts.items() if len(x) >= urls.CONTEXT_ROWS}
        assert len(counts) > 1 << 18
        keys, n, kinds = model.contexts[side]
        assert len(keys) == len(kept) and n.sum() == sum(map(len, kept.values())) and kinds.sum() == sum(len(set(x)) for x in kept.values())
        assert len(model.grams[side][0]) == kinds.sum() and model.grams[side][1].sum() == n.sum()


def test_joined_scores_are_those_of_the_arrays(spark):
    """Counts beyond the size limit: the same scores, threshold and verdicts, rows repeated or odd included."""
    from tests.llm.conftest import SF

    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url")
    odd = [(10**6, None), (10**6, None), (None, ""), (None, "nothing"), (1, "http://x.com/" + "ab" * 5000), (2, "http://unseen.org/é")] + [(3, "http://hot.example.org/a/b")] * 300
    df = pages.union(spark.createDataFrame(odd, "page_id long, url string"))
    arrays, joined = urls.judge(df).collect(), urls.judge(df, model_bytes=0).collect()
    order = lambda r: (r["id"] or -1, r["host"], r["path"])
    assert len(joined) == df.count() == len(arrays)
    for a, b in zip(sorted(arrays, key=order), sorted(joined, key=order)):
        assert (order(a), a["rule"]) == (order(b), b["rule"]) and abs(a["score"] - b["score"]) < 1e-9
        assert a["verdict"] == b["verdict"]
    assert any(r["score"] for r in arrays)
    assert urls.judge(df.limit(0), model_bytes=0).count() == 0
    one_sided = df.filter("url LIKE 'nothing%'")
    assert [r["verdict"] for r in urls.judge(one_sided, model_bytes=-1).collect()] == ["allow"]
