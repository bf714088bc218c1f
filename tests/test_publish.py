"""Publishing that is stopped between any two steps, and what an evidence index is refused for."""

import json

import pytest

from glossmill.sources import files as I


class Stop(Exception):
    pass


def test_a_stop_between_any_two_steps_loses_nothing(spark, tmp_path):
    write = lambda text: lambda p: spark.createDataFrame([(text,)], "value string").write.text(p)
    here = lambda p: [r.value for r in spark.read.text(p).collect()]
    path = str(tmp_path / "release")
    fine = lambda p: None
    I.publish_staged(spark, write("one"), fine, path)
    I.publish_staged(spark, write("two"), fine, path)
    assert here(path) == ["two"] and sorted(p.name for p in tmp_path.iterdir()) == ["release"]

    def refuse(p):
        raise Stop

    for write_, check in ((refuse, fine), (write("bad"), refuse)):
        with pytest.raises(Stop):
            I.publish_staged(spark, write_, check, path)
        assert here(path) == ["two"] and sorted(p.name for p in tmp_path.iterdir()) == ["release"]
    # stopped after the first rename: the old output stands beside
    (tmp_path / "release").rename(tmp_path / "release._old")
    write("three")(path + "._staged")
    with pytest.raises(Stop):
        I.publish_staged(spark, refuse, fine, path)
    assert here(path) == ["two"]
    (tmp_path / "release").rename(tmp_path / "release._old")
    I.publish_staged(spark, write("three"), fine, path)
    assert here(path) == ["three"] and sorted(p.name for p in tmp_path.iterdir()) == ["release"]
    # stopped after the second rename: the last old output is still there
    write("older")(path + "._old")
    I.publish_staged(spark, write("four"), fine, path)
    assert here(path) == ["four"] and sorted(p.name for p in tmp_path.iterdir()) == ["release"]


def test_problems_of_an_evidence_index(spark, tmp_path):
    row = lambda k, ids, **more: json.dumps({"source": "s", "sourceEntryId": str(k), "headword": "h", "senses": [{"evidenceId": i} for i in ids]} | more)
    (tmp_path / "a.jsonl").write_text("\n".join([row(1, ["x", "y"]), row(2, ["z"], headword=None), "no json", row(3, [None])]))
    (tmp_path / "b.jsonl").write_text("\n".join([row(4, ["y"]), row(5, [])]))
    rows = I.read_jsonl(spark, [str(tmp_path / "a.jsonl"), str(tmp_path / "b.jsonl")], I.EVIDENCE_INDEX)
    found = sorted((r.problem, r.file, r.evidence_id) for r in I.evidence_index_problems(rows).collect())
    assert found == [("malformed row", "a.jsonl", None)] * 2 + [("repeated id", "a.jsonl", "y"), ("repeated id", "b.jsonl", "y"), ("sense without an id", "a.jsonl", None)]
    with pytest.raises(ValueError, match="malformed row in a.jsonl"):
        I.read_evidence_index(spark, [str(tmp_path / "a.jsonl")])
    good = tmp_path / "c.jsonl"
    good.write_text(row(1, ["x", "y"]) + "\n" + row(2, []))
    assert [r.evidence_id for r in I.read_evidence_index(spark, [str(good)]).collect()] == ["x", "y"]
