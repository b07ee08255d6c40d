"""Ingest from files written here: header row, blank rows, repeated keys, versions, open and closed access."""

import pytest
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import access
from corvane.sources import ingest


@pytest.fixture
def export(tmp_path):
    path = tmp_path / "catalog.csv"
    path.write_text('Catalog,,\nall rows,,\n Custom Report ,Fields,Owner\nA – B,"x; y;X",me\n,,\nnan,q,me\n"C, d",,you\n', encoding="utf-8")
    return str(path)


def test_header_is_the_third_row_and_blank_titles_go(spark, export):
    raw = ingest.load_raw(spark, export)
    assert raw.columns == ["source_row", "Custom Report", "Fields", "Owner"]
    assert [(r["source_row"], r["Custom Report"]) for r in raw.orderBy("source_row").collect()] == [(4, "A – B"), (7, "C, d")]


def test_records_keep_physical_rows_and_count_kept_ones(spark, export):
    raw = ingest.load_raw(spark, export).withColumn("row", F.col("source_row") - ingest.FIRST_DATA_ROW)
    got = ingest.row_corpus(raw, "row").orderBy("row_index").collect()
    assert [(r.report_key, r.row_index, r.title_key) for r in got] == [("R0004", 0, "a - b"), ("R0007", 1, "c, d")]
    assert [f.field_key for f in got[0].field_meta] == ["|x", "|y"] and got[1].field_meta == [] and got[1].field_link_confidence == 0.0


def test_missing_title_column_and_repeated_keys_fail(spark):
    with pytest.raises(ValueError, match="required"):
        ingest.resolve(["Fields", "Owner"])
    x = spark.createDataFrame([("R0004",), ("R0004",)], "report_key string")
    with pytest.raises(ValueError, match="R0004"):
        ingest.refuse_repeated_keys(x)


def test_row_index_spans_buckets_and_empty_tables(spark):
    x = spark.createDataFrame([(i,) for i in (0, 3, 4096, 9000, 9001)], "position long")
    assert [r.row_index for r in ingest.row_index(x).orderBy("position").collect()] == [0, 1, 2, 3, 4]
    assert ingest.row_index(x.where("position < 0")).count() == 0


def test_summary_tells_not_measured_from_none(spark):
    raw = spark.createDataFrame([(0, "a", ""), (1, "A", ""), (2, None, "f")], "row long, Report string, Fields string")
    corpus, s = ingest.build_corpus(raw, "row", "row")
    r = s.first()
    assert (r.report_rows_read, r.valid_reports_loaded, r.families, r.duplicate_identities, r.duplicate_rows, r.links, r.without_fields) == (3, 2, 1, 1, 2, 0, 2)
    f = ingest.build_corpus(raw, "row", "family")[1].first()
    assert f.families == 1 and f.valid_reports_loaded == 2 and f.links is None
    assert ingest.build_corpus(raw.where("row < 0"), "row", "row")[1].first().links == 0
    assert not set(ingest.SENSITIVE) & set(ingest.searchable(corpus).columns)


def test_source_version(spark, export):
    import hashlib

    assert ingest.source_version(spark, export) == hashlib.sha256(open(export, "rb").read()).hexdigest()[:16]
    assert ingest.source_version(spark, export + ".none") == "absent"


def test_spans_of_any_script_and_none(spark):
    x = spark.createDataFrame([("Ça va_bien, 42!",), ("",), (None,)], "t string").select(T.spans(F.col("t")).alias("s"))
    got = [[(s.surface, s.word, s.start, s.end) for s in r.s] for r in x.collect()]
    assert got == [[("Ça", "ça", 0, 2), ("va", "va", 3, 5), ("bien", "bien", 6, 10), ("42", "42", 12, 14)], [], []]


def test_header_key_equals_the_column_rule(spark):
    names = ["Report Tag(s)", "data_source", " NaN ", "", "Number of Times"]
    x = spark.createDataFrame([(n,) for n in names], "n string").select("n", T.normalize_header(F.col("n")).alias("k"))
    assert {r.n: r.k for r in x.collect()} == {n: ingest.header_key(n) for n in names}


def test_access_is_closed_unless_opened(spark):
    x = spark.range(3)
    with pytest.raises(PermissionError):
        access.allow_all(x)
    assert access.allow_all(x, opted_in=True).count() == 3
    assert access.fail_closed(x, lambda v: v.where("id > 0"), "id").count() == 2
    assert access.fail_closed(x, lambda v: v.select(F.col("nothing")), "id").count() == 0
    assert access.fail_closed(x, lambda v: v.toDF("other"), "id").count() == 0
