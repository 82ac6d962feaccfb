from itertools import product

from tallyglass.plans import catalog, tabular_queries


def test_all_columns_against_brute_force(spark, sf, monkeypatch):
    cells = [(s, k, c, i, float(i * i + 7 * k + (3 if s == "B" else 0))) for s in "AB" for k, c in enumerate(tabular_queries.LINE) for i in range(6)]
    frame = spark.createDataFrame(cells, "source string, col_pos int, col string, idx long, value double")
    monkeypatch.setattr(tabular_queries, "line_cells", lambda read: frame)
    value = {(s, c, i): v for s, _, c, i, v in cells}
    keys = sorted({(s, c) for s, _, c, _, _ in cells})
    place = tabular_queries.LINE.index
    want = {}
    for (x, a), (y, b) in product(keys, keys):
        if x < y or (x == y and place(a) < place(b)):
            d = {round(value[y, b, i] - value[x, a, i], 10) for i in range(6)}
            want[f"{x}|{y}", a, b] = (6, d.pop())
    got = {(r.source, r.a, r.b): (r.n, r.difference) for r in catalog.QUERIES["cross_source_difference_all"](spark, sf).collect()}
    assert got == want and len(want) == 16 + 2 * 6
