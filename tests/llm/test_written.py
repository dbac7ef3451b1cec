from __future__ import annotations

from forja.llm import common


def test_tables_are_removed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "_roots", {})
    monkeypatch.setattr(common, "shared_dir", lambda spark: str(tmp_path))
    (tmp_path / "other").mkdir()
    assert common.written(spark, spark.range(5), "five").count() == 5
    assert len(list(tmp_path.iterdir())) == 2
    common.clear_written(spark)
    assert [x.name for x in tmp_path.iterdir()] == ["other"]
    common.clear_written(spark)
