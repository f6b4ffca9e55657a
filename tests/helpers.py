"""What several test modules share."""


def rows_of(df, *cols, order=None):
    d = df.select(*cols) if cols else df
    out = [tuple(r) for r in d.collect()]
    return sorted(out, key=lambda r: tuple((x is None, x) for x in r)) \
        if order is None else out
