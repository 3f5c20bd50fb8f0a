import pytest

from tests.conftest import spark  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):  # noqa: F811
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="session")
def awkward(spark):  # noqa: F811
    """Null, empty, blank, very long and repeated texts, ties, a null id, and columns that clash with the operators' own names."""
    long = " ".join(f"word{k % 977} the of" for k in range(40_000))
    same = " ".join(f"same{k}" for k in range(80))
    texts = [(1, None), (2, ""), (3, " \t\n "), (4, long), (5, long + " more"), (6, same), (6, same), (7, "x " + same + " y"), (None, same), (8, "!!! 123"), (9, "日本語 ▁ é́   x"), (10, "one"), (11, same.upper())]
    names = "id t g h i0 n words packed kept fp component key size node label x row lang_pred score chunk ids part shard a.b `q`".split()
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c.replace('`', '``')}` string" for c in names)
    return spark.createDataFrame([(d, t, None if d in (2, None) else "en", None, None if t is None else len(t), *[None] * len(names)) for d, t in texts], schema)


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)
