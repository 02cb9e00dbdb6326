"""Files written together, and passes in order."""

import os

import pytest
from pyspark.sql import functions as F

from quirework.operators import passes as P
from quirework.sources.versions import current_version, write_version


def listed(spark, root):
    return {r.name: (r.size, open(r.path, "rb").read()) for r in current_version(spark, root).collect()}


def test_versions_replace_each_other_whole(spark, tmp_path):
    root = str(tmp_path / "set")
    assert listed(spark, root) == {}
    write_version(spark.createDataFrame([("a.md", "um é"), ("images/b.bin", None)], "name string, content string").repartition(3), root)
    assert listed(spark, root) == {"a.md": (5, "um é".encode()), "images/b.bin": (0, b"")}
    write_version(spark.createDataFrame([("c.md", b"\x00")], "name string, content binary"), root)
    assert listed(spark, root) == {"c.md": (1, b"\x00")}
    write_version(spark.createDataFrame([], "name string, content string"), root)
    assert listed(spark, root) == {}


@pytest.mark.parametrize("bad", ["../x", "/x", ""])
def test_a_failed_write_leaves_the_version_before(spark, tmp_path, bad):
    root = str(tmp_path / "set")
    write_version(spark.createDataFrame([("a.md", "um")], "name string, content string"), root)
    versions = sorted(os.listdir(tmp_path / "set" / "versions"))
    rows = [(f"{k}.md", "x" * k) for k in range(40)] + [(bad, "y")]
    with pytest.raises(Exception, match="name of a file"):
        write_version(spark.createDataFrame(rows, "name string, content string").repartition(4), root)
    assert listed(spark, root) == {"a.md": (2, b"um")} and sorted(os.listdir(tmp_path / "set" / "versions")) == versions


def test_a_failure_before_the_pointer_leaves_the_version_before(spark, tmp_path, monkeypatch):
    """Whatever was written, readers see a version only once the last step has named it."""
    from quirework.sources import versions as V

    root = str(tmp_path / "set")
    write_version(spark.createDataFrame([("a.md", "um")], "name string, content string"), root)
    writer = V.Writer(root)
    messages = [writer.write(iter([{"name": "b.md", "content": b"dois"}])), None]
    assert set(listed(spark, root)) == {"a.md"}
    put = V._put
    monkeypatch.setattr(V, "_put", lambda path, data: put(path, data) if not path.endswith(V.CURRENT) else (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        writer.commit(messages)
    assert set(listed(spark, root)) == {"a.md"}
    writer.abort(messages)
    assert set(listed(spark, root)) == {"a.md"} and not os.path.exists(tmp_path / "set" / "versions" / writer.run)


def test_passes_in_a_wrong_order_raise(spark):
    right = P.course_passes(tails=spark.createDataFrame([], "doc_id long, first string, second string"), suffixes=spark.createDataFrame([], "doc_id long, suffix string"))
    assert [p.name for p in P.checked(right)] == ["emphasis", "tails", "emphasis", "spacing", "headings", "structure", "exams"]
    by_name = {p.name: p for p in right}
    with pytest.raises(ValueError, match="exams needs levels"):
        P.checked([by_name["emphasis"], by_name["spacing"], by_name["exams"], by_name["structure"]])
    with pytest.raises(ValueError, match="spacing needs emphasis"):
        P.checked([by_name["emphasis"], by_name["tails"], by_name["spacing"]])
    with pytest.raises(ValueError, match="structure needs emphasis, spacing"):
        P.checked([by_name["structure"]])
    assert P.checked([by_name["exams"]], frozenset({"levels"})) == [by_name["exams"]]


def test_course_texts_are_prepared(spark):
    text = "# QUESTÕES\n\n# 1. Tema C. Outro\n\n** 1. (Prova) **Texto da questão\n\n**final.**\n\n(A) um (B) dois\n\n# GABARITO\n\n** 1. A**"
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string").withColumn("text", F.coalesce("text", F.lit("")))
    tails = spark.createDataFrame([(1, "questão", "final")], "doc_id long, first string, second string")
    suffixes = spark.createDataFrame([(1, "C. Outro")], "doc_id long, suffix string")
    got = {r.doc_id: r.text for r in P.applied(docs, P.course_passes(tails=tails, suffixes=suffixes)).collect()}
    assert got[2] == "" and "questão **final.**" in got[1] and "## 1. Tema\n\n### C. Outro" in got[1]


def test_a_list_is_written_as_files_are(tmp_path, monkeypatch):
    import pyarrow.parquet as pq

    from quirework.sources import versions as V

    monkeypatch.setattr(V, "HELD_FILES", 10)
    writer = V.Writer(str(tmp_path))
    done = writer.write({"name": f"{k}.md", "content": "x"} for k in range(25))
    listing = pq.ParquetFile(done.listing)
    assert done.files == 25 and listing.metadata.num_row_groups == 3 and listing.read()["name"].to_pylist() == [f"{k}.md" for k in range(25)]
    assert pq.read_table(writer.write(iter(())).listing).num_rows == 0
