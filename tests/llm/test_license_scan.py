import pytest

from weftline.llm import license_scan as L

from .conftest import docs_frame


def found(spark, texts, **options):
    return [(r["doc_id"], r["license"], r["start"], r["end"]) for r in L.scan_licenses(docs_frame(spark, texts), **options).orderBy("doc_id", "start").collect()]


def test_every_template_is_found_as_itself(spark):
    texts = [f"Words before it\n{t}\nand after." for name, some in L.TEMPLATES.items() for t in some]
    names = [name for name, some in L.TEMPLATES.items() for _ in some]
    rows = L.scan_licenses(docs_frame(spark, texts)).orderBy("doc_id", "start").collect()
    assert [r["license"] for r in rows] == names
    assert all(not r["missing"] and not r["added"] for r in rows)
    assert all(texts[r["doc_id"]][r["start"] : r["end"]].rstrip('.,"') in texts[r["doc_id"]] for r in rows)


def test_versions_and_variants_are_told_apart(spark):
    base = "This work is licensed under the GNU General Public License, version {}."
    got = found(spark, [base.format(2), base.format(3), base.format(7), "Licensed under CC BY 4.0.", "Licensed under CC BY-NC 4.0.", "licensed drivers reserved all rights to public works"])
    assert [(d, x) for d, x, _, _ in got] == [(0, "GPL-2.0"), (1, "GPL-3.0"), (3, "CC-BY-4.0"), (4, "CC-BY-NC-4.0")]


def test_small_changes_of_wording_are_listed(spark):
    row = L.scan_licenses(docs_frame(spark, ["THIS work was licensed under the GNU General Public License, version 3."])).first()
    assert (row["license"], row["missing"], row["added"]) == ("GPL-3.0", ["is"], ["was"])


def test_two_notices_in_a_long_line(spark):
    line = "lorem ipsum " * 400 + "Released under the MIT License. " + "dolor sit " * 400 + "All rights reserved. Licensed under the Apache License, Version 2.0."
    assert [x for _, x, _, _ in found(spark, [line])] == ["MIT", "proprietary", "Apache-2.0"]


def test_awkward(spark, awkward, nothing):
    assert L.scan_licenses(awkward).count() == 0 and L.scan_licenses(nothing).count() == 0
    with pytest.raises(ValueError):
        L.as_templates({"x": ("of the 4",)})


def test_differences_against_brute_force():
    template = ("a", "b", "c", "d")
    assert L.differences(template, ["x", "a", "b", "q", "d", "y"]) == (["c"], ["q"], 1, 5)
    assert L.differences(template, []) == (list(template), [], 0, 0)
