"""Comparison of Spark results with SQL results."""


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in sorted(v.items()))
    return v


def same_as_sql(df, con, text):
    """Rows, column names and values agree, whatever the order."""
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    done = con.execute(text)
    names = [c[0] for c in done.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in done.fetchall()), key=str)
    assert got == want
