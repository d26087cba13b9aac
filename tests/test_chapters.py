"""Chapters of documents with odd characters and keys against their SQL."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from doclattice.plans import registry

NAME = "t13_t14_chapters"
TITLES = [
    "1 Größe und Maß", "2 ﬁnal eﬀort", "3 ᾳ ᾼ ᾶ ὐ ΐ", " 4 Behind a space", "5 Before a space ", "　Overview", "GENERALüberholung", "Systemübersicht", "Overvieẃ of it", "ſection 7",
    "Section K", "Note here:\r", "6\u000bTitle", "ABCD EFGH IJKL\u0085", "ABCDEFGH\u000bIJ KLM", "Purpoſe of it", "7 ŉ ǰ և ẖ", "8 \U00010428 \U00010d70", "ab", "9 " + "ß" * 148, "9 " + "ß" * 149,
]


def differing(spark, folder, rows):
    pq.write_table(pa.table(dict(zip(("doc_id", "source", "text"), map(list, zip(*rows)))), schema=pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("text", pa.string())])), f"{folder}/documents.parquet")
    got = registry.queries()[NAME](spark, str(folder)).select("doc_id", "title", "start_page", "end_page", "sightings").collect()
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet'")
    want = con.execute(f"select doc_id, title, start_page, end_page, sightings from ({registry.oracle_sql()[NAME]})").fetchall()
    assert want
    return set(map(tuple, got)) ^ set(want) or len(got) - len(want)


def test_odd_characters(spark, tmp_path):
    assert not differing(spark, tmp_path, [(i, "a", f"x\n{t}\nbody") for i, t in enumerate(TITLES)])


def test_keys(spark, tmp_path):
    text = "x\n1 One\nbody\ny\n2 Two\nz\n" + "q\n" * 30 + "1 One\nend"
    assert not differing(spark, tmp_path, [(-5, "a", text), (0, None, text), (None, "a", text), (3, "b", None), (4, "b", ""), (2**40, "c", text)])


def test_documents_of_one_key(spark, tmp_path):
    assert not differing(spark, tmp_path, [(7, s, f"x\n{t}\nbody\n{t}") for s, t in (("a", "1 One"), ("a", "2 Two"), ("b", "none"), ("c", "2 Two"))])
