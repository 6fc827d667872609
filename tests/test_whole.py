"""Registered queries read whole texts."""

import json

from quillspark.operators import extract
from quillspark.plans import catalog


def test_section_split_reads_whole_texts(spark, tmp_path):
    texts = {1: "word " * 100 + "the end", 2: "short", 3: "a\n" * 90 + "**1.5 Own part**\ninside"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.doc_id, r.number): r for r in catalog.QUERIES["section_split"](spark, str(tmp_path)).collect()}
    assert got[1, "1"].content == texts[1] and got[2, "1"].content == "short"
    assert got[3, "1"].content == ("a\n" * 90).strip("\n") and got[3, "1.5"].content == "inside"
    assert all(got[i, "1.1"].content == "x" and got[i, "2"].content == "y" for i in texts)


def test_rare_terms_have_a_frequency(spark, tmp_path):
    spark.createDataFrame([(1, "one two two"), (2, "Two three")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = catalog.QUERIES["all_document_frequencies"](spark, str(tmp_path)).collect()
    assert {r.term: r.df for r in got} == {"one": 1, "two": 2, "three": 1}


def test_notebooks_and_mdx_in_a_folder(spark, tmp_path):
    cells = [{"cell_type": "markdown", "source": ["# Say\n", "more"]}, {"cell_type": "code", "source": "x = 1"}, {"cell_type": "code", "source": []}, {"cell_type": "code", "source": ["[1,\n", "2]"]}]
    (tmp_path / "a.ipynb").write_text(json.dumps({"cells": cells, "metadata": {}}))
    (tmp_path / "b.ipynb").write_text("not a notebook")
    (tmp_path / "c.mdx").write_text("# T\n\n```js\nf()\n```\n")
    rows = extract.extract_folder(spark, str(tmp_path))[0].orderBy("relative", "ordinal").collect()
    assert [(r.relative, r.type, r.content, r.language, r.start_line, r.end_line) for r in rows if r.relative == "a.ipynb"] == [
        ("a.ipynb", "text", "# Say\nmore", None, 1, 2),
        ("a.ipynb", "code", "x = 1", "python", 3, 3),
        ("a.ipynb", "code", "[1,\n2]", "python", 5, 6),
    ]
    assert [(r.relative, r.type, r.content.strip()) for r in rows if r.relative != "a.ipynb"] == [("b.ipynb", "text", "not a notebook"), ("c.mdx", "text", "T"), ("c.mdx", "code", "f()")]
