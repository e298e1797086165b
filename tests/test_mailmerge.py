"""Mail-merge schema plans: bindings and blocked states by hand."""

import pytest

from foliospark.operators import mailmerge as m

FIELDS = "doc_id int, field int, field_type string, target string, complete boolean, deleted boolean, control_ok boolean"


@pytest.fixture(scope="module")
def bound(spark):
    columns = spark.createDataFrame([(1, 0, "Name"), (1, 1, "CITY"), (1, 2, "Zip"), (1, 3, "zip"), (1, 4, "Zip"), (1, 5, "spare"), (2, 0, "Name")], "doc_id int, ordinal int, name string")
    mappings = spark.createDataFrame([(1, 1, "First", "Name"), (1, 2, "Twice", "Name"), (1, 3, "Twice", "CITY"), (1, 4, "Loose", None)], "doc_id int, mapping int, mapped_name string, source_column string")
    rows = [
        ("MERGEFIELD", "Name"), ("MERGEFIELD", "name"), ("MERGEFIELD", "city"), ("MERGEFIELD", "ZIP"), ("MERGEFIELD", "Zip"), ("MERGEFIELD", "First"), ("MERGEFIELD", "Twice"), ("MERGEFIELD", "Loose"), ("MERGEFIELD", None), ("MERGEFIELD", " "),
        ("MERGEREC", None), ("IF", "Name"), ("ADDRESSBLOCK", None), ("SKIPIF", "Name"), ("MERGEBARCODE", "gone"),
    ]
    fields = [(1, k, t, x, True, False, True) for k, (t, x) in enumerate(rows)]
    fields += [(1, 100, "NEXTIF", "Name", True, False, False), (1, 101, "NEXT", None, True, False, False), (1, 102, "MERGEFIELD", "Name", False, True, True), (2, 0, "MERGEFIELD", "NAME", True, False, True), (3, 0, "MERGEFIELD", "Name", True, False, True)]
    found = m.bindings(spark.createDataFrame(fields, FIELDS), columns, mappings).cache()
    return found, columns, spark.createDataFrame([(1,), (2,)], "doc_id int")


def test_bindings(bound):
    got = {(r.doc_id, r.field): (r.status, r.ordinal, list(r.reasons)) for r in bound[0].collect()}
    exact, loose = ("ResolvedExact", 0, []), "ResolvedCaseInsensitive"
    want = [exact, (loose, 0, []), (loose, 1, []), ("Ambiguous", None, ["source_column_ambiguous"]), ("ResolvedExact", 2, []), exact, ("Ambiguous", None, ["ambiguous_odso_mapping"]), ("Missing", None, ["source_column_missing"])]
    want += [("Missing", None, ["source_column_name_missing"])] * 2 + [("NotApplicable", None, []), ("NotApplicable", None, ["conditional_mail_merge_if_unmodeled"]), ("NotApplicable", None, ["unsupported_mail_merge_control_fields"]), exact, ("Missing", None, ["source_column_missing"])]
    assert [got[1, k] for k in range(len(want))] == want
    assert got[1, 100] == ("Missing", None, ["mail_merge_control_syntax_invalid"]) and got[1, 101] == ("NotApplicable", None, ["mail_merge_control_syntax_invalid"])
    assert got[1, 102] == ("ResolvedExact", 0, ["deleted_mail_merge_fields", "incomplete_mail_merge_fields"])
    assert got[2, 0] == (loose, 0, []) and got[3, 0] == ("Missing", None, ["source_column_missing"])


def test_plans(bound):
    got = {r.doc_id: r for r in m.plans(*bound).collect()}
    assert (got[2].can_bind, got[2].reasons, got[2].n_unused) == (True, "", 0)
    assert (got[3].can_bind, got[3].reasons, got[3].n_fields, got[3].n_unused) == (False, "mail_merge_configuration_missing,source_column_missing", 1, 0)
    assert not got[1].can_bind and {"source_schema_duplicate_column", "source_schema_case_collision", "ambiguous_odso_mapping"} <= set(got[1].reasons.split(",")) and got[1].n_unused == 3
