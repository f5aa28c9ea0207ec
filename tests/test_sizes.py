"""Files and passes of the catalogue's queries grow with their tables, tasks do not."""

from __future__ import annotations

from wardline.catalog import files, streams, training


def test_stream_files_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(streams, "FILE_ROWS", 10)
    assert streams.file_count(spark.range(101)) == 11 and streams.file_count(spark.range(3)) == streams.FILES


def test_line_files_grow_with_the_rows(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(files, "LINES_PER_FILE", 20)
    seen, load = [], files.R.jsonl_corpus
    monkeypatch.setattr(files.R, "jsonl_corpus", lambda s, path: seen.append(len(s.read.text(path).inputFiles())) or load(s, path))
    row = files.file_line_numbers(spark, sf_dir).first()
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert (row["n_lines"], row["files_with_gaps"]) == (n, 0) and seen[0] > 4


def test_classifier_rows_are_prepared_once(spark, sf_dir, monkeypatch):
    names, write = [], training.materialise
    monkeypatch.setattr(training, "materialise", lambda df, name: names.append(name) or write(df, name))
    assert training.classifier_metrics(spark, sf_dir).count() == 3 and names == ["classifier"]
