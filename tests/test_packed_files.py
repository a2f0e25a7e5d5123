"""Intermediate files of the raw extract are written once and packed."""

import glob

from orderlens.plans import registry
from orderlens.sources import files
from orderlens.sources.star import Star

STAR_DIR = "/root/testdata/sf0.001"


def test_the_raw_csv_is_packed_and_whole(spark, monkeypatch):
    paths, plain = [], files.write_csv
    monkeypatch.setattr(files, "write_csv", lambda df, path, **options: paths.append(path) or plain(df, path, **options))
    star = Star(spark, STAR_DIR, stored=True)
    rows = registry.read_csv_raw(star)
    written = glob.glob(f"{paths[0].removeprefix('file:')}/part-*")
    assert written and all(name.endswith(".csv.gz") for name in written)
    assert rows.count() == star.raw("order_id").count()


def test_deliveries_are_the_only_copy_of_the_extract(spark, monkeypatch):
    """The extract is not stored beside its two deliveries, which hold every row once."""
    folders, plain = {}, registry.scratch_path
    monkeypatch.setattr(registry, "scratch_path", lambda s, name: folders.setdefault(name, plain(s, name)))
    monkeypatch.setattr(registry, "_SHARED", {})
    star = Star(spark, STAR_DIR, stored=True)
    found = {r["order_year"]: r["rewritten"] for r in registry.clean_refresh(star).collect()}
    assert "raw" not in folders and not registry._SHARED
    held = spark.read.parquet(folders["deliveries"])
    assert held.count() == star.raw().count()
    assert held.drop("_delivery").exceptAll(star.raw()).count() == 0
    assert any(found.values()) and not all(found.values())
