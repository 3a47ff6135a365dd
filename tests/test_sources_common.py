"""All adapters in one schema; the CSV corpus; datasets, grants, annotations and edges on small tables."""

import pytest

from foliant.operators.datasets import annotated, granted, tagged, with_edges
from foliant.sources.readers import DOCUMENT, common_documents, read_ocr_corpus

LONG = "A text of more than fifty characters, so that it stays in the corpus of scans."


def documents(spark, adapter, path):
    df = common_documents(spark, adapter, str(path))
    assert df.columns == DOCUMENT.names
    return {r.doc_id.rsplit("/", 1)[-1]: r for r in df.collect()}


def test_common_documents(spark, tmp_path):
    (tmp_path / "a.dat").write_text("þDOCIDþ\x14þFILENAMEþ\x14þEXTRACTED_TEXTþ\nþD1þ\x14þone.docþ\x14þhello thereþ\nþD2þ\x14þþ\x14þþ\n")
    found = documents(spark, "concordance_dat", tmp_path / "a.dat")
    assert (found["D1"].filename, found["D1"].text, found["D1"].metadata["DOCID"]) == ("one.doc", "hello there", "D1") and found["D2"].text == ""
    (tmp_path / "a.opt").write_text("P1,VOL,img/p1.tif,Y,,2\nP2,VOL,img/p2.tif,,,\n")
    found = documents(spark, "opticon", tmp_path / "a.opt")
    assert found["P1"].filename == "p1.tif" and found["P1"].text is None and found["P1"].metadata["page_count"] == "2"
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "m.eml").write_bytes(b"From: a@x.org\nTo: b@x.org\nSubject: Terms\nMessage-ID: <1@x>\n\nThe body.\n")
    mail = documents(spark, "eml", tmp_path / "x")["m.eml"]
    assert (mail.filename, mail.doc_type, mail.metadata["sender"]) == ("Terms", "email", "a@x.org") and mail.text.endswith("The body.")
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "n.txt").write_text("plain")
    assert documents(spark, "directory", tmp_path / "t")["n.txt"].text == "plain"
    with pytest.raises(ValueError, match="no adapter"):
        common_documents(spark, "none", "x")


def test_csv_corpus(spark, tmp_path):
    (tmp_path / "c.csv").write_text(f'filename,text\nTEXT/ABC_0012.txt,"{LONG}\nwith a ""second"" line"\nIMAGES/x.jpg,"{LONG}"\nTEXT/short.txt,few\n')
    found = documents(spark, "ocr_csv", tmp_path / "c.csv")
    assert list(found) == ["ABC_0012.txt"] and found["ABC_0012.txt"].text == f'{LONG}\nwith a "second" line'
    assert found["ABC_0012.txt"].metadata == {"original_path": "TEXT/ABC_0012.txt", "bates_prefix": "ABC", "bates_number": "0012", "release_source": "ABC"}
    rows = spark.createDataFrame([("ABC_7", LONG), (None, LONG), ("plain", LONG)], "filename string, text string")
    got = {r.doc_id: r.metadata.get("release_source") for r in read_ocr_corpus(rows, releases={"ABC": "first release"}).collect()}
    assert got == {"ABC_7": "first release", "": None, "plain": None}


def test_stored_tables(spark):
    tags = spark.createDataFrame([(1, "a"), (2, "b")], "doc long, tag string")
    added = spark.createDataFrame([(1, " a "), (3, "c"), (3, "c"), (None, "c"), (4, " ")], "doc long, tag string")
    assert {tuple(r) for r in tagged(tags, added, tags.filter("doc = 2")).collect()} == {(1, "a"), (3, "c")}
    grant = "dataset long, user long, role string, at int"
    new = spark.createDataFrame([(1, 1, "editor", 5), (2, 1, "viewer", None)], grant)
    got = granted(spark.createDataFrame([(1, 1, "viewer", 1), (1, 2, "viewer", 1)], grant), new, spark.createDataFrame([(1, 2)], "dataset long, user long"))
    assert {(r.dataset, r.user, r.role) for r in got.collect()} == {(1, 1, "editor"), (2, 1, "viewer")}
    note = "id long, user long, content string, at int"
    changes = spark.createDataFrame([(1, 7, "new", 5, None), (1, 7, "old", 4, None), (2, 8, "x", 5, True), (3, 9, "not mine", 5, True), (4, 1, "added", 5, None), (5, 1, "", 5, True)], f"{note}, gone boolean")
    got = annotated(spark.createDataFrame([(1, 7, "a", 1), (2, 8, "b", 1), (3, 1, "c", 1)], note), changes)
    assert {(r.id, r.user, r.content) for r in got.collect()} == {(1, 7, "new"), (3, 1, "c"), (4, 1, "added")}
    edge = "src long, dst long, relation string"
    edges, nodes = spark.createDataFrame([(1, 2, "r"), (2, 3, "r")], edge), spark.createDataFrame([(1,), (2,), (3,)], "name long")
    got = with_edges(edges, nodes, spark.createDataFrame([(1, 2, "r"), (1, 3, "s"), (1, 3, "s"), (1, 9, "s")], edge), edges.filter("src = 2"))
    assert {tuple(r) for r in got.collect()} == {(1, 2, "r"), (1, 3, "s")}
