"""Versions of several tables: one switch for all of them, nothing published by a failed or overtaken change."""

from __future__ import annotations

import pytest

from risemeter.plans import merge as M
from risemeter.sources.versions import VersionMoved, current_version, publish_version
from tests.test_plans import merge_tables

NAMES = ["catalog", "judgments", "links", "mentions", "votes"]


@pytest.fixture
def started(spark, folder):
    """The five tables as version 1, and the groups to merge."""
    *tables, groups = merge_tables(spark)
    first = publish_version(spark, dict(zip(["catalog", "links", "mentions", "votes", "judgments"], tables, strict=True)), folder, 0)
    return first, groups


def merged(version, groups):
    t = version.tables
    return M.merge_catalog(t["catalog"], t["links"], t["mentions"], t["votes"], t["judgments"], groups).tables()


def test_no_version_yet(spark, folder):
    assert current_version(spark, folder).number == 0
    with pytest.raises(VersionMoved):
        publish_version(spark, {"a": spark.range(3)}, folder, 4)
    assert current_version(spark, folder).tables == {}


def test_all_tables_switch_at_once(spark, rows, folder, started):
    first, groups = started
    reader = current_version(spark, folder)
    seen = []

    def check(stored):
        seen.append(current_version(spark, folder).number)  # all tables of version 2 are written, none is published
        return M.merge_problems(stored, groups)

    second = publish_version(spark, merged(first, groups), folder, first.number, check)
    assert seen == [1]
    now = current_version(spark, folder)
    assert (now.number, sorted(now.tables)) == (2, NAMES)
    assert now.rows == second.rows == {name: table.count() for name, table in now.tables.items()}
    assert rows(now.tables["judgments"], "judgment_id", "catalog_id") == [(1, 8), (2, 9)]
    # A reader that opened version 1 stays on it.
    assert reader.number == 1
    assert rows(reader.tables["judgments"], "judgment_id", "catalog_id") == [(1, 5), (2, 9)]


def test_a_failed_check_publishes_nothing(spark, rows, folder, started):
    first, groups = started
    tables = merged(first, groups)
    tables["links"] = first.tables["links"]  # still points at the removed id
    with pytest.raises(ValueError, match="fail their check"):
        publish_version(spark, tables, folder, 1, lambda t: M.merge_problems(t, groups))
    now = current_version(spark, folder)
    assert now.number == 1
    assert rows(now.tables["links"], "item_id", "catalog_id") == rows(first.tables["links"], "item_id", "catalog_id")


def test_of_two_changes_from_one_version_one_gets_through(spark, rows, folder, started):
    first, groups = started

    def overtaken(stored):
        publish_version(spark, merged(first, groups), folder, 1)
        return M.merge_problems(stored, groups)

    late = merged(first, groups) | {"votes": first.tables["votes"].limit(0)}
    with pytest.raises(VersionMoved):
        publish_version(spark, late, folder, 1, overtaken)
    now = current_version(spark, folder)
    assert (now.number, now.rows["votes"]) == (2, 2)
    # The change made anew from the version that is published now gets through.
    assert publish_version(spark, merged(now, groups), folder, 2).number == 3


def test_empty_tables(spark, folder):
    publish_version(spark, {"a": spark.range(0), "b": spark.range(5).where("id > 9")}, folder, 0)
    now = current_version(spark, folder)
    assert (now.number, now.rows, now.tables["a"].count()) == (1, {"a": 0, "b": 0}, 0)
