"""Alias files: of several files the later one by path overrules, whatever their sizes."""

from __future__ import annotations

import json

from risemeter.plans import seeding
from risemeter.sources import seeds


def body(*suggestions):
    return json.dumps({"suggestions": [{"machineId": i, "aliases": [a], "approved": ok} for i, a, ok in suggestions]})


def write(path, text):
    with open(path, "w", encoding="utf8") as out:
        out.write(text)


def applied(spark, rows, found):
    catalog = spark.createDataFrame(
        [(1, None, ["old"], None), (2, None, ["old"], None), (3, None, ["old"], None)],
        "catalog_id BIGINT, short_name STRING, aliases ARRAY<STRING>, exclude_terms ARRAY<STRING>",
    )
    return rows(seeding.apply_aliases(catalog, seeds.approved_aliases(found)), "catalog_id", "aliases")


def test_the_later_file_wins(spark, rows, folder):
    # Spark reads large files first; the order by path must not depend on that.
    write(f"{folder}/b.json", body((1, "b", True), (2, "b", False)))
    write(f"{folder}/a.json", body((1, "a", True), (2, "a", True), *[(k, "x" * 50, True) for k in range(10, 400)]))
    found = seeds.read_alias_file(spark, folder)
    assert applied(spark, rows, found) == [(1, ["b"]), (2, ["a"]), (3, ["old"])]


def test_the_later_suggestion_of_a_file_wins(spark, rows, folder):
    write(f"{folder}/a.json", body((1, "first", True), (1, "second", True)))
    assert applied(spark, rows, seeds.read_alias_file(spark, folder))[0] == (1, ["second"])


def test_a_body_per_line(spark, rows, folder):
    write(f"{folder}/a.json", body((1, "a", True)) + "\n" + body((3, "c", True)) + "\n")
    write(f"{folder}/b.json", body((3, "d", True)) + "\n")
    assert applied(spark, rows, seeds.read_alias_file(spark, folder, multi_line=False)) == [(1, ["a"]), (2, ["old"]), (3, ["d"])]
