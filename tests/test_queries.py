"""Every query against its SQL counterpart; queries without one must give rows."""

import pytest
from compare import DATA, duck, rows, same

from pagewright.plans import catalog

EMPTY_HERE = {"resume_steps", "graph_mask_check"}


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, name):
    same(spark, catalog.QUERIES[name], catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_rows(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0


def test_a_wrong_oracle_is_seen(spark):
    df = catalog.QUERIES["text_filter"](spark, DATA)
    assert rows(df.columns, df.collect())[1] != duck(catalog.ORACLES["text_filter"].replace("^SFX", "^T"))[1]


def test_outcomes_have_all_branches(spark):
    assert {r["outcome"] for r in catalog.QUERIES["page_outcomes"](spark, "/root/testdata/sf0.01").collect()} == {"Translated", "Failed", "Skipped"}


def test_roles_of_equal_order_go_to_the_first_row(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    a, b = (1, 200000), (2, 100000)  # line * 100000 + part is the same
    items = [(k, line, part + i) for k, pair in ((1, (a, b)), (2, (b, a))) for i in (0, 2, 3) for line, part in pair]
    pq.write_table(pa.table(dict(zip(("l_orderkey", "l_linenumber", "l_partkey"), map(list, zip(*items, strict=True)), strict=True))), tmp_path / "lineitem.parquet")
    same(spark, catalog.QUERIES["role_resolve"], catalog.ORACLES["role_resolve"], str(tmp_path))
    assert {r["id"]: (r["ocr"], r["inpainter"]) for r in catalog.QUERIES["role_resolve"](spark, str(tmp_path)).collect()} == {1: ("p200000", "p200003"), 2: ("p100000", "p100003")}
