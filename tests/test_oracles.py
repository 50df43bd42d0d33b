import pytest

from metaspan.plans import registry

from .oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_oracle(spark, connection, name):
    df = registry.QUERIES[name](spark, SF)
    if name in registry.ORACLES:
        compare(df, connection, registry.ORACLES[name])
    else:
        assert df.count() >= 0
    spark.catalog.clearCache()


@pytest.fixture(scope="module")
def long_keys(tmp_path_factory):
    """The tables with order keys of seven digits, as they are at size: those that repeat look like local telephone numbers. One order lacks, so its key is unique without being a sequence."""
    folder = str(tmp_path_factory.mktemp("long_keys"))
    c = connect(SF)
    for name, key in [("orders", "o_orderkey"), ("lineitem", "l_orderkey"), *[(t, None) for t in ("region", "nation", "customer", "supplier", "part")]]:
        c.execute(f"COPY (SELECT * {f'REPLACE ({key} + 2000000 AS {key})' if key else ''} FROM {name} {'WHERE o_orderkey <> 700' if name == 'orders' else ''}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return folder


@pytest.mark.parametrize("name", ["erd_mapping", "final_mapping", "final_mapping_rules", "internal_mapping", "mapping_top3_pivot", "all_mappings"])
def test_number_keys_are_no_telephone_numbers(spark, long_keys, name):
    compare(registry.QUERIES[name](spark, long_keys), connect(long_keys), registry.ORACLES[name])


def test_types_of_all_columns(spark):
    """Every column of the tables that the query reads has a type, those of fractions and the keys of lineitem too."""
    got = sorted(r.column_name for r in registry.QUERIES["detail_type"](spark, SF).collect())
    assert got == sorted(c for t in ("customer", "part", "orders", "lineitem", "nation", "region") for c in spark.read.parquet(f"{SF}/{t}.parquet").columns)
