import os

import duckdb
import pytest

from voxelspark.llm.licenses import DIGESTS, LICENSES, OP8_SQL, op8_licenses, read_licenses, scan_licenses

SHIPPED = "/usr/share/common-licenses"
#: Names of the files there by the names of licences.
NAMES = {"Artistic": "Artistic-1.0-Perl", "BSD": "BSD-3-Clause", "GFDL": "GFDL-1.3", "GPL": "GPL-3.0", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL": "LGPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-3": "LGPL-3.0"}


def test_variants_are_found_and_others_not(spark):
    mit = next(t for n, t in LICENSES if n == "MIT")
    zlib = next(t for n, t in LICENSES if n == "Zlib")
    rows = [
        (0, mit), (1, "MIT License\n\nCopyright (c) 2020 A Person\nCopyright 1999 Another\n\n" + mit.replace("\n", "\n\n")), (2, mit.upper()), (3, mit.replace('"', "”").replace("sublicense", "sub-license")), (4, zlib.replace("acknowledgment", "acknowledgement")),
        (5, mit + " more"), (6, "words and " + mit), (7, None), (8, ""), (9, " ... \nCopyright nobody"), (10, mit.replace("copyright notice and", "notice and")), (None, mit), (0, mit), (12, "x " * 60000), (13, "* (c) 2001 me\n" + zlib + "\nAll rights reserved."),
    ]
    got = scan_licenses(spark.createDataFrame([(*r, "extra") for r in rows], "doc_id long, text string, digest string")).collect()
    assert len(got) == len(rows)
    found = sorted((r.doc_id if r.doc_id is not None else -1, r.license_id) for r in got if r.license_id)
    assert found == [(-1, "MIT"), (0, "MIT"), (0, "MIT"), (1, "MIT"), (2, "MIT"), (3, "MIT"), (4, "Zlib"), (13, "Zlib")]
    digests = {r.doc_id: r.digest for r in got}
    assert digests[7] is None and digests[8] == digests[9]


def test_every_known_text_is_found(spark):
    got = scan_licenses(spark.createDataFrame([(i, "Copyright (c) 2001 A. Person\n" + t.upper()) for i, (_, t) in enumerate(LICENSES)], "doc_id long, text string"))
    assert {r.doc_id: r.license_id for r in got.collect()} == {i: name for i, (name, _) in enumerate(LICENSES)}


def test_licenses_of_a_folder(spark, tmp_path):
    long = "\n".join(f"{i}. You must honour clause {i} of this licence." for i in range(3000))
    (tmp_path / "Long-1.0.txt").write_text("The Long License\n" + long)
    (tmp_path / "Short 2").write_text("Do what you like.")
    rows = [(1, "THE LONG LICENCE\nCopyright 1999 B\n" + long.replace("honour", "honor")), (2, "do what you like"), (3, long)]
    got = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), read_licenses(spark, str(tmp_path)))
    assert {r.doc_id: r.license_id for r in got.collect()} == {1: "Long-1.0", 2: "Short 2", 3: None}


def test_empty_table(spark):
    assert scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.skipif(not os.path.exists(SHIPPED), reason="no licence texts on this system")
def test_long_licences_are_found_in_a_query(spark, tmp_path):
    """Whole texts of the system's folder, changed in case, lines, spelling and notices, and cut at the end of the terms; texts with a sentence more or less are none. By the registered query and its SQL."""
    end, rows, want = "END OF TERMS AND CONDITIONS", [], {}
    for file in sorted(os.listdir(SHIPPED)):
        text = open(f"{SHIPPED}/{file}", encoding="utf-8").read()
        cut = [text[: text.index(end) + len(end)]] if end in text else []
        for form in (text, text.upper(), "Copyright (c) 2011 Someone\n\n" + text.replace("\n", "\r\n").replace("license", "licence"), *cut):
            want[len(rows)] = NAMES.get(file, file)
            rows.append((len(rows), form))
        for other in (text + "\nOne sentence more.", text[: len(text) // 3] + " zebra " + text[len(text) // 3 :], text[: len(text) // 2]):
            want[len(rows)] = None
            rows.append((len(rows), other))
    assert {n for n, _ in DIGESTS} == {n for n in want.values() if n}
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.digest, r.license_id) for r in op8_licenses(spark, str(tmp_path)).collect()}
    assert {k: v[1] for k, v in got.items()} == want
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert {d: (h, n) for d, h, n in db.execute(OP8_SQL).fetchall()} == got
