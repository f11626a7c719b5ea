import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A frame of documents from (doc_id, text) or (doc_id, text, source, lang) rows."""

    def make(rows, extra=False):
        rows = [(*r, *(None, None)[len(r) - 2:]) if len(r) < 4 else r for r in rows]
        df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
        if extra:
            # names that the operators use inside
            for name in ("id", "pos", "key", "h1", "fp", "item_id", "size", "__id", "n_words"):
                df = df.selectExpr("*", f"'x' as `{name}`") if name not in df.columns else df
        return df

    return make


WORDS = [f"w{i}" for i in range(4000)]


@pytest.fixture(scope="session")
def prose():
    """Distinct prose: n words drawn with a seed."""
    import random

    def make(seed, n):
        r = random.Random(seed)
        return " ".join(r.choice(WORDS) for _ in range(n))

    return make
