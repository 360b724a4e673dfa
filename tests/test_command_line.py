import json

import pytest

from spectrafold.__main__ import main, parser

from .test_sources import write_reads


def test_convert_info_read(spark, tmp_path, capsys):
    want = write_reads(tmp_path / "a.fastq", 5)
    (tmp_path / "bad.fastq").write_text("@a\nAT\n+\n")
    assert main(["convert", "-i", f"{tmp_path}/a.fastq", f"{tmp_path}/bad.fastq", "-o", f"{tmp_path}/o", "-m", "json"]) == 1
    done = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert [d["status"] for d in done] == ["ok", "failed"] and "incomplete read" in done[1]["message"]
    assert main(["info", done[0]["output"]]) == 0
    info = json.loads(capsys.readouterr().out)
    assert (info["entries"], info["omics"], info["readCount"]) == (1, "Genomics", "5")
    assert main(["read", done[0]["output"], "-c", "read_id", "sequence"]) == 0
    rows = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert sorted((r["read_id"], r["sequence"]) for r in rows) == [(w[0], w[2]) for w in want]


def test_bad_arguments():
    with pytest.raises(SystemExit):
        parser().parse_args(["convert", "-i", "x"])
