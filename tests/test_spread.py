"""Costly work on each row is dealt out, however few parts the file has."""

from pathlib import Path

import pyarrow.parquet as pq
import pytest

from basalt.plans import artifacts, ingesting, listings, searching
from basalt.sources.tables import table
from basalt.streaming import records as streaming


@pytest.mark.parametrize("made", [listings.linked_data_types, artifacts.keys_in_order, searching.documents, lambda spark, d: listings.listing_plain(spark, d), lambda spark, d: listings.broker_profiles(spark, d)])
def test_rows_of_one_part_take_many_tasks(spark, small, made):
    assert table(spark, small, "part").rdd.getNumPartitions() == 1
    sizes = made(spark, small).rdd.glom().map(len).collect()
    assert sum(n > 0 for n in sizes) >= 4 and max(sizes) < sum(sizes) / 2


def test_pages_of_one_part_are_read_by_many_tasks(spark, small):
    assert table(spark, small, "pages").rdd.getNumPartitions() == 1
    sizes = ingesting.page_records(spark, small).rdd.glom().map(len).collect()
    assert sum(n > 0 for n in sizes) >= 4 and max(sizes) < sum(sizes) / 2


@pytest.mark.parametrize("made", [ingesting.ingest_stream, ingesting.index_follows_records])
def test_batches_of_a_stream_are_written_by_many_tasks(spark, small, tmp_path, monkeypatch, made):
    monkeypatch.setattr(ingesting, "scratch", lambda _, name: f"{tmp_path}/{name}")
    if made is ingesting.index_follows_records:  # parts of one file, so that what comes is what counts
        monkeypatch.setattr(ingesting, "parts", lambda s, d: table(s, d, "part").repartition(4))
    assert made(spark, small).count() > 0
    files = [f for f in Path(tmp_path).glob("*/in/*.parquet") if pq.ParquetFile(f).metadata.num_rows]
    assert len(files) >= 6 and len(list(Path(tmp_path).glob("*/checkpoint/commits/[0-9]*"))) == 3


def test_a_load_of_many_files_is_one_batch(spark, tmp_path):
    seen = []
    loads = [spark.range(k * 10, k * 10 + 10).repartition(4) for k in range(3)]
    streaming.run_loads(loads, lambda batch, number: seen.append((number, sorted(r.id for r in batch.collect()))), str(tmp_path))
    assert seen == [(k, list(range(k * 10, k * 10 + 10))) for k in range(3)]
