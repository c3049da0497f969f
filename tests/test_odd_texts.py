"""Empty, null and blank texts, and texts that end in a line break, give the rows of the SQL, too."""

import duckdb
import pytest

from foliate.plans import catalog
from tests.test_oracle import plain

SF = "/root/testdata/sf0.001"
ODD = {3: "''", 16: "text || chr(10)", 29: "NULL", 42: "'  ' || chr(10) || ' '", 55: "chr(10) || chr(10) || chr(10)"}
FINDINGS = {
    "F2": "agg14_unresolved_dimensions", "F3": "agg15_scanned_documents", "F4": "arr05_asked_dimensions", "F5": "doc01_headings", "F6": "doc02_sections", "F7": "doc04_section_anchors", "F8": "doc05_profile",
    "F9": "doc09_verdicts", "F10": "doc10_merged_report", "F11": "doc11_still_asked", "F12": "doc12_refine_material", "F13": "doc13_trusted_originals", "F14": "doc16_local_report", "F15": "doc17_labelled_chunks",
}
ALIKE = ("doc06_missing_dimensions", "jn14_section_paragraphs", "lay10_page_profiles", "win07_section_bounds", "win08_first_hits")


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Documents of which one in thirteen is odd, and their folder."""
    folder = tmp_path_factory.mktemp("odd")
    con = duckdb.connect()
    case = " ".join(f"WHEN {i} THEN {text}" for i, text in ODD.items())
    con.execute(f"COPY (SELECT doc_id, CASE doc_id % 65 {case} ELSE text END AS text, lang, source, n_chars FROM '{SF}/documents.parquet') TO '{folder}/documents.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    yield con, f"file:{folder}"
    con.close()


@pytest.mark.parametrize("name", [*FINDINGS.values(), *ALIKE])
def test_rows_of_odd_texts(spark, odd, name):
    con, folder = odd
    df = catalog.QUERIES[name](spark, folder)
    found = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in found.description]
    order = [names.index(c) for c in df.columns]
    assert sorted(plain(r) for r in df.collect()) == sorted(plain(r[i] for i in order) for r in found.fetchall())
