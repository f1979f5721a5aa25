"""Comparing frames of two engines."""


def same_rows(got, want):
    """Compare two pandas frames without order; floats were rounded by the queries."""
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)

    def rows(df):
        clean = df[cols].astype(object).where(df[cols].notna(), None)
        return sorted(map(repr, ([x.item() if hasattr(x, "item") else x for x in r] for r in clean.itertuples(index=False, name=None))))

    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    diff = [(x, y) for x, y in zip(a, b) if x != y]
    assert not diff, diff[:3]
