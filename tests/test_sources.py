import json
import zipfile

from lexmill.sources import readers, sinks

BODY = "主文 被告應給付原告。" + "事實 原告主張租金。" * 10 + "理由 按民法第四百二十五條之一規定，" + "租賃物交付後，出租人將其所有權讓與第三人。" * 50


def test_statutes(spark, tmp_path):
    law = {"Laws": [{"LawName": "民法", "LawCategory": "民事", "LawArticles": [
        {"ArticleType": "C", "ArticleNo": "", "ArticleContent": "第一章"}, {"ArticleType": "A", "ArticleNo": "第 1 條", "ArticleContent": "民事，\r\n  依習慣。"},
        {"ArticleType": "A", "ArticleNo": " ", "ArticleContent": "x"}, {"ArticleType": "A", "ArticleNo": "第 2 條", "ArticleContent": ""}]},
        {"LawName": "公司法", "LawCategory": "商", "LawArticles": [{"ArticleType": "A", "ArticleNo": "第 1 條", "ArticleContent": "x"}]}]}
    (tmp_path / "laws.json").write_text("\ufeff" + json.dumps(law, ensure_ascii=False), encoding="utf-8")
    assert [tuple(r) for r in readers.statutes(spark, str(tmp_path / "laws.json")).collect()] == [("民法__第_1_條", "民法", "民事", "第 1 條", "民法 第 1 條 民事， 依習慣。", "民事， 依習慣。")]


def test_judgements_of_every_kind(spark, tmp_path):
    rec = lambda i, **x: {"JID": f"A,{i}", "JTITLE": "給付租金", "JDATE": "1110512", "JCOURT": "某地院", "JFULL": BODY, **x}
    (tmp_path / "a.json").write_text("\ufeff" + json.dumps({"data": [rec(1), 5, rec(2, JTITLE="偽造文書")]}, ensure_ascii=False), encoding="utf-8")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.JSON").write_text(json.dumps([rec(3)]), encoding="utf-8")
    (tmp_path / "bad.json").write_text("{not json", encoding="utf-8")
    (tmp_path / "c.jsonl").write_text(json.dumps(rec(4)) + "\n\nbroken{\n" + json.dumps({"case_id": "A,5", "cause": "返還租賃物", "date": "2022/05/12", "summary": BODY}) + "\n", encoding="utf-8")
    with zipfile.ZipFile(tmp_path / "d.zip", "w") as z:
        z.writestr("x.json", json.dumps(rec(6)))
        z.writestr("y.txt", "no")
        z.writestr("z.json", b"\xff\xfe\xfa")
    (tmp_path / "e.csv").write_text('\ufeffJID,JTITLE,JDATE,JFULL\n"A,7",給付租金,20220512,"' + BODY + '"\n', encoding="utf-8")
    records = readers.judgement_records(spark, str(tmp_path))
    rows = readers.judgement_chunks(records).collect()
    assert {r["case_id"] for r in rows} == {f"A,{i}" for i in (1, 3, 4, 5, 6, 7)}
    assert {r["case_date"] for r in rows} == {"2022-05-12"}
    assert {r["section"] for r in rows} == {"事實", "理由"} and all(60 <= len(r["content"]) <= 800 for r in rows)
    one = [r for r in rows if r["case_id"] == "A,1" and r["section"] == "理由"]
    assert [r["chunk_no"] for r in sorted(one, key=lambda r: r["chunk_no"])] == list(range(len(one))) and len(one) > 1
    assert one[0]["text"].startswith("[某地院 A,1 給付租金 理由] ")


def test_empty_folder(spark, tmp_path):
    (tmp_path / "x.md").write_text("no")
    assert readers.judgement_chunks(readers.judgement_records(spark, str(tmp_path))).collect() == []


def test_contracts_and_clauses(spark, tmp_path):
    (tmp_path / "a.txt").write_text("前言\n第一條 租金每月給付新臺幣一萬元整。\n第二條：押金為二個月租金之總額。\n第三條 承租人應返還房屋予出租人。\n第四條 短。", encoding="utf-8")
    (tmp_path / "b.txt").write_text("第一段文字。\n\n\n\n第二段文字。", encoding="utf-8")
    (tmp_path / "c.pdf").write_bytes(b"%PDF scanned")
    (tmp_path / "d.pdf").write_bytes(b"%PDF digital " + b"x" * 60)
    docs = readers.contracts(spark, str(tmp_path), digital=lambda b: (b.decode()[5:] if b"digital" in b else "", 1), ocr=lambda b: ("scan", 2))
    got = {r["path"].rsplit("/", 1)[1]: r for r in docs.collect()}
    assert got["c.pdf"]["source"] == "ocr" and got["d.pdf"]["source"] == "digital" and got["a.txt"]["source"] == "text"
    clauses = readers.contract_clauses(docs.where("source = 'text'").withColumnRenamed("path", "file_id")).collect()
    a = [r for r in clauses if r["file_id"].endswith("a.txt")]
    assert [r["label"] for r in a] == ["第一條", "第二條", "第三條"] and a[1]["text"] == "押金為二個月租金之總額。"
    b = [r for r in clauses if r["file_id"].endswith("b.txt")]
    assert [(r["label"], r["text"], r["char_offset"]) for r in b] == [("段1", "第一段文字。", 0), ("段2", "第二段文字。", 8)]


def test_gold_labels_and_external(spark, tmp_path):
    items = [{"id": "G1", "query": "q", "relevant_ids": ["a", "b"]}, {"id": "G2", "query": "r", "relevant_ids": []}]
    for name, text in (("l.jsonl", "\n".join(map(json.dumps, items))), ("a.json", json.dumps(items)), ("i.json", json.dumps({"items": items}))):
        (tmp_path / name).write_text(text)
        assert [r["id"] for r in readers.gold_queries(spark, str(tmp_path / name)).collect()] == ["G1", "G2"]
    sheets = tmp_path / "sheets"
    sheets.mkdir()
    (sheets / "1.csv").write_text("\ufeffSample_ID,label\nS1,ok\n")
    (sheets / "2.csv").write_text("Sample_ID,note\nS2,x\n")
    rows = readers.label_sheets(spark, str(sheets))
    assert rows.columns == ["Sample_ID", "label", "note"] and rows.count() == 2
    assert readers.pick(rows.columns, ("id", "sample_id")) == "Sample_ID" and readers.pick(["x"], ("y",)) is None
    ext = tmp_path / "ext"
    ext.mkdir()
    (ext / "c.json").write_text(json.dumps([{"law_id": "L1", "content": "t"}, {"id": "L2", "law_text": "u"}, {"id": "L3"}]))
    assert sorted(map(tuple, readers.external_corpus(spark, str(ext)).collect())) == [("L1", "t"), ("L2", "u")]
    (ext / "c.json").write_text(json.dumps([{"query_tw": "q1", "gold": "L1"}, {"question": "q2", "relevant_ids": ["L1", "L2"]}]))
    assert sorted((r["query"], tuple(r["relevant_ids"])) for r in readers.external_queries(spark, str(ext)).collect()) == [("q1", ("L1",)), ("q2", ("L1", "L2"))]


def test_guards_and_sinks(spark, tmp_path):
    import pytest

    with pytest.raises(ValueError):
        readers.guarded("/data/test/x")
    assert readers.guarded("/data/tests/x") == "/data/tests/x"
    rows = spark.createDataFrame([(1, "a|b", ["x"]), (2, None, [])], "id int, t string, l array<string>")
    assert readers.without_held_out(rows, rows.where("id = 1"), "id").count() == 1
    sinks.write_collection(rows, str(tmp_path / "c"), "laws", reset=True)
    sinks.write_collection(rows, str(tmp_path / "c"), "laws")
    assert sinks.collection_size(spark, str(tmp_path / "c"), "laws") == 4
    sinks.write_csv(rows, str(tmp_path / "csv"), single=True)
    assert next((tmp_path / "csv").glob("*.csv")).read_text().startswith("\ufeffid,t,l")
    assert "| 1 | a\\|b | ['x'] |" in sinks.markdown(rows, "T")
    sinks.write_json(rows, str(tmp_path / "json"), single=True)
    sinks.write_edges(spark.createDataFrame([("a", "b", 1), ("a", "c", 5)], "a string, b string, w int"), str(tmp_path / "e"))
    assert sinks.read_edges(spark, str(tmp_path / "e"), 5).count() == 1
