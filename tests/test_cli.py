from kelpie.__main__ import main


def test_list_and_sql(capsys):
    assert main(["list"]) == 0 and "cohort_percentile" in capsys.readouterr().out
    assert main(["sql", "anti_todo"]) == 0 and "ANTI JOIN" in capsys.readouterr().out


def test_run_writes_rows(spark, tmp_path):
    assert main(["run", "anti_todo", "--data", "/root/testdata/sf0.001", "--out", str(tmp_path / "o")]) == 0
    assert spark.read.parquet(str(tmp_path / "o")).count() > 0
    assert main(["explain", "pricing_summary", "--data", "/root/testdata/sf0.001"]) == 0


def test_sections_and_audit(spark, capsys, tmp_path):
    assert main(["sections", "tone"]) == 0 and capsys.readouterr().out.split() == ["spectrum", "stereo"]
    from kelpie.operators import quality

    tracks = spark.createDataFrame([], quality.SCHEMA)
    tracks.write.parquet(str(tmp_path / "t"))
    assert main(["audit", str(tmp_path / "t"), "--out", str(tmp_path / "f")]) == 0
    assert main(["check", "cohort_metrics", "--data", "/root/testdata/sf0.001"]) == 0 and "cohort_metrics 46" in capsys.readouterr().out


def test_unknown_section():
    import pytest

    from kelpie.operators import headline

    with pytest.raises(ValueError, match="unknown sections: nothing"):
        headline.chosen_sections(["nothing"])
