"""Every query of the analytics against its SQL on the small tables."""

import pytest

from labtrail.plans import catalog
from tests.compare import connect, differences


def values(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, con, name):
    found = catalog.QUERIES[name](spark, sf_dir)
    if name in catalog.SQL:
        assert differences(found, con, catalog.SQL[name]) == ""
    else:
        assert found.columns


def test_entry_point_without_the_llm_folder():
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(catalog.SQL) <= set(entry.oracle_sql())


def test_facts_of_long_lines_are_supported(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    words = [(r["doc_id"], r["text"], (r["text"] or "").split(" ")[2:3]) for r in docs]
    expected = sum(bool(w and w[0]) and any(w[0].lower() in x.lower() for x in t.split("\n")) for _, t, w in words)
    assert catalog.QUERIES["c20_supported_facts"](spark, sf_dir).count() == expected


def test_residual_holds_all_cells_and_records(spark, sf_dir):
    """No cell that ``a11_cells`` has, and no row, column or block that ``a11_records`` has, is missing."""
    whole = catalog.QUERIES["a11_residual"](spark, sf_dir).cache()
    assert {r[0] for r in whole.select("kind").distinct().collect()} == {"tables_unmapped", "tables_partial", "narrative"}
    place = ["table_id", "row_idx", "col_idx", "raw_header"]
    cells = catalog.QUERIES["a11_cells"](spark, sf_dir)
    assert cells.count() > 0 and cells.join(whole.select(*place), place, "left_anti").isEmpty()
    records = catalog.QUERIES["a11_records"](spark, sf_dir)
    tables = whole.where("col_idx is not null").selectExpr("kind", "table_id as source", "cast(if(kind = 'tables_unmapped', row_idx, col_idx) as long) as idx")
    blocks = whole.where("kind = 'narrative'").selectExpr("kind", "cast(doc_id as string)", "cast(paragraph_idx as long)", "text")
    assert values(tables.distinct()) == values(records.where("kind <> 'narrative'").select("kind", "source", "idx"))
    assert values(blocks) == values(records.where("kind = 'narrative'").select("kind", "source", "idx", "content"))


def test_no_query_is_named_twice(monkeypatch):
    monkeypatch.setattr(catalog, "PARTS", (*catalog.PARTS, catalog.PARTS[0]))
    with pytest.raises(ValueError, match="named twice"):
        catalog._all("QUERIES")


def test_a_missing_library_leaves_the_analytics(monkeypatch):
    import __spark_entry__ as entry

    def absent(name):
        raise ImportError("No module named 'tiktoken'", name="tiktoken")

    monkeypatch.setattr(entry, "import_module", absent)
    with pytest.warns(UserWarning, match="tiktoken"):
        assert set(entry.queries()) == set(catalog.QUERIES)
    with pytest.warns(UserWarning, match="tiktoken"):
        assert set(entry.oracle_sql()) == set(catalog.SQL)
