from __future__ import annotations

from test_ngram_join import brute


def brute_near(texts):
    """Ids that stay when one of each group of near-duplicates does."""
    return sorted({c for _, c, _ in brute(sorted(texts.items()))})


def same(df, want):
    got = df.toPandas()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)

    def norm(x):
        return sorted(map(tuple, x[cols].astype(str).replace({"<NA>": "nan", "None": "nan"}).replace(r"\.0$", "", regex=True).values.tolist()))

    assert norm(got) == norm(want)
