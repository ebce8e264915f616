"""Driver contract: entry() smoke, key sets, and a sample of oracle checks."""

import pytest

from tests.oracle_harness import compare

SF = "/root/testdata/sf0.001"


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.columns == ["drive", "archive_name", "archive_path", "file_name", "file_size", "path_in_archive"]
    assert df.count() > 0


def test_every_catalogue_query_has_an_oracle():
    import __spark_entry__ as E
    from zipledger.plans.queries import REGISTRY
    assert set(REGISTRY) <= set(E.queries()) and set(REGISTRY) <= set(E.oracle_sql())
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", ["search_combined", "search_regex", "list_entries_limit", "summary",
                                  "summary_empty", "list_archives_counts", "drive_rollup", "pick_nth",
                                  "pick_all", "merge_catalogs", "dup_by_hash", "resolve_path"])
def test_oracle_sample(spark, name):
    r = compare(spark, name, SF)
    assert r["status"] == "match", r
