from tests.llm.helpers import docs, with_clashes
from tidewright.llm import licenses
from tidewright.llm.license_texts import TEXTS, catalogue


def test_variants_of_a_whole_text(spark):
    mit = TEXTS["MIT"]
    variant = "Copyright (c) 2020 Somebody\nAll rights reserved.\n\n" + mit.replace("sublicense", "sub-license").replace('"', "'").replace(" ", "  ").upper()
    texts = [mit, variant, mit + " more", mit[:-40], "The text.\nLicenced under the MIT licence.\nReleased under GPLv3", None, "", "© 2020 X", "licensed under MIT", "licensed under MIT"]
    got = licenses.scan(with_clashes(docs(spark, texts, ids=[*range(9), 8])), licenses.default_licenses(spark)).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["license_id"], r["notices"], r["n_notice_lines"]))
    assert by[0] == [("MIT", [], 0)] and by[1] == [("MIT", [], 0)]
    assert by[2] == by[3] == by[5] == by[6] == by[7] == [(None, [], 0)]
    assert by[4] == [(None, ["GPL-3.0", "MIT"], 2)]
    assert by[8] == [("MIT", ["MIT"], 1)] * 2


def test_catalogue_is_consistent(spark):
    rows = licenses.known_digests(licenses.default_licenses(spark)).collect()
    assert len({r["digest"] for r in rows}) == len(rows) > 400
    assert {i for i, _ in catalogue()} >= set(TEXTS)


def test_empty_tables_and_null_ids(spark):
    known = licenses.default_licenses(spark)
    assert licenses.scan(docs(spark, ["x"]).limit(0), known).count() == 0
    one = licenses.scan(docs(spark, ["Released under the MIT License."], ids=[None]), known).first()
    assert one["doc_id"] is None and one["license_id"] == "MIT" and one["n_notice_lines"] == 1
    assert licenses.scan(docs(spark, ["x"]), known.limit(0)).first()["license_id"] is None
