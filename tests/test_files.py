import json

import pytest

from tallywright.operators import coerce
from tallywright.operators.mapping import unusable_files
from tallywright.operators.uploads import profile_uploads
from tallywright.plans import reports
from tallywright.plans.intake import reports_of_uploads, store_uploads
from tallywright.sources import files


def document(rows):
    return json.loads("".join(r.text for r in sorted(rows, key=lambda r: (r.part, r.position))))


def by_file(made):
    found = {}
    for r in made.collect():
        found.setdefault(r.file.rsplit("/", 1)[1], []).append(r)
    return {file: document(rows) for file, rows in found.items()}


def write(folder, name, text):
    (folder / name).write_text(text)
    return str(folder / name)


def test_upload_to_report_and_back(spark, tmp_path):
    path = write(
        tmp_path, "sales.csv",
        'Order Date,Amt,Area,Note\n2024-01-05,10.5,NA,"two\nlines, ""quoted"""\n'
        "2024-02-05,20,EU,null\nsoon,5,EU,\n2024-02-06,x,EU,\n",
    )
    df = files.read_upload(spark, path)
    assert df.columns == ["Order Date", "Amt", "Area", "Note"]
    rows = df.collect()
    assert rows[0].Note == 'two\nlines, "quoted"' and rows[0].Area is None and rows[1].Note is None
    assert files.read_upload(spark, path, na_tokens=()).collect()[0].Area == "NA"
    mapping = {"date": "Order Date", "revenue": "Amt", "region": "Area"}
    made = reports.confirm_mapping(df, mapping, stamp=False)
    out = str(tmp_path / "out")
    files.write_reports(reports.report_json(made), out)
    body = document(spark.read.json(out).collect())
    assert body["total_revenue"] == 30.5 and body["total_orders"] == 2
    assert body["region_wise_sales"] == [{"region": "EU", "revenue": 20.0}]
    files.write_reports(made.summary, str(tmp_path / "pq"), "parquet")
    assert spark.read.parquet(str(tmp_path / "pq")).first().total_orders == 2
    with pytest.raises(ValueError):
        files.write_reports(made.summary, out, "xml")


def test_each_file_is_read_by_its_own_content(spark, tmp_path):
    write(tmp_path, "plain.csv", '\n\na,b\n1,"x"\n2,y\n')
    write(tmp_path, "broken.csv", 'a,b\n3,"x\ny"\n4,z\n')
    (tmp_path / "mixed.csv").write_bytes(b"a,b\r\n5,u\n6,v\r\n")
    found = {r.file.rsplit("/", 1)[1]: r for r in files.scan_lines(spark, str(tmp_path)).collect()}
    assert {k: (r.header, r.open_quotes) for k, r in found.items()} == {
        "plain.csv": ("a,b", False), "broken.csv": ("a,b", True), "mixed.csv": ("a,b", False),
    }
    got = files.read_upload(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [
        ("1", "x"), ("2", "y"), ("3", "x\ny"), ("4", "z"), ("5", "u"), ("6", "v"),
    ]
    headers, cells = files.read_uploads(spark, str(tmp_path))
    assert headers.count() == 6 and cells.count() == 6
    plan = files.scan_lines(spark, str(tmp_path))._jdf.queryExecution().toString()
    assert "SortAggregate" not in plan


def test_a_folder_without_a_usable_file(spark, tmp_path):
    folder = tmp_path / "uploads"
    folder.mkdir()
    write(folder, "c.csv", "note,when\nhello,2024-01-01\n")
    store_uploads(spark, str(folder), str(tmp_path / "stored"))
    made = reports_of_uploads(spark, str(tmp_path / "stored"))
    assert made.columns == ["file", "part", "position", "text"] and made.count() == 0


def test_folder_of_files(spark, tmp_path):
    write(tmp_path, "a.csv", "x,y\n1,2\n")
    write(tmp_path, "b.csv", "x,y\n3,4\n")
    write(tmp_path, "notes.txt", "not a table")
    got = files.read_upload(spark, str(tmp_path))
    assert sorted(tuple(r) for r in got.collect()) == [("1", "2"), ("3", "4")]
    write(tmp_path, "c.csv", "y,x\n5,6\n")
    with pytest.raises(Exception, match="(?i)header"):
        files.read_upload(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("name", ["a.xlsx", "a.xls", "a.CSV", "a.json", "a.txt"])
def test_other_formats_are_refused(spark, name):
    with pytest.raises(ValueError):
        files.read_upload(spark, f"/nowhere/{name}")


def test_facts_keep_the_wanted_columns_only(spark, tmp_path):
    path = write(tmp_path, "m.csv", "date,spend,junk\n2024-01-01,5,j\n")
    assert set(coerce.marketing_facts(files.read_upload(spark, path)).columns) == {"date", "spend"}


def test_folder_of_different_files_to_reports(spark, tmp_path):
    folder = tmp_path / "uploads"
    folder.mkdir()
    write(folder, "a.csv", 'Order Date,Amt,Revenue,City\n2024-01-05,1,10.5,"Paris, FR"\n2024-02-05,1,20,NA\n')
    write(folder, "b.csv", 'sku,revenue,order date\nx,5,2024-03-01\ny,"7",2024-03-02\nx,1,never\n')
    write(folder, "c.csv", "note,date\nhello,2024-01-01\n")
    write(folder, "d.csv", 'Order Date,Sales,Comment\n2024-01-05,3,"two\nlines, here"\n')
    stored = str(tmp_path / "stored")
    mapping = store_uploads(spark, str(folder), stored)
    lost = {r.file.rsplit("/", 1)[1]: r.missing for r in unusable_files(mapping).collect()}
    assert lost == {"c.csv": ["revenue"]}
    got = by_file(reports_of_uploads(spark, stored, stamp=False))
    assert set(got) == {"a.csv", "b.csv", "d.csv"}
    assert got["a.csv"]["total_revenue"] == 30.5
    assert got["a.csv"]["region_wise_sales"] == [{"region": "Paris, FR", "revenue": 10.5}]
    assert "top_products" not in got["a.csv"]
    assert got["b.csv"]["total_orders"] == 2
    assert got["b.csv"]["top_products"] == [
        {"product": "y", "revenue": 7.0}, {"product": "x", "revenue": 5.0},
    ]
    assert "region_wise_sales" not in got["b.csv"]
    assert got["d.csv"]["total_revenue"] == 3.0


def test_many_marketing_files_count_what_they_lack(spark, tmp_path):
    folder = tmp_path / "uploads"
    folder.mkdir()
    write(folder, "full.csv", "day,campaign,cost,clicks,revenue\n2024-01-05,c,2,4,5\n2024-01-06,c,2,4,5\n")
    write(folder, "short.csv", "day,campaign,cost,revenue\n2024-01-05,c,2,5\n2024-01-06,c,2,5\n")
    stored = str(tmp_path / "stored")
    store_uploads(spark, str(folder), stored, "marketing")
    made = by_file(reports_of_uploads(spark, stored, "marketing"))
    got = {file: body["campaign_performance"][0] for file, body in made.items()}
    assert got["full.csv"]["clicks"] == 8 and got["short.csv"]["clicks"] == 2
    assert got["full.csv"]["conversions"] == got["short.csv"]["conversions"] == 2
    assert got["full.csv"]["roas"] == got["short.csv"]["roas"] == 2.5


def test_corrected_mapping_domains_and_dates_of_a_folder(spark, tmp_path):
    folder = tmp_path / "uploads"
    folder.mkdir()
    write(folder, "a.csv", "Order Date,Amt,Revenue\n15.01.2024,1,10\n16.02.2024,2,20\n2024-02-17,3,30\n")
    write(folder, "b.csv", "Order Date,Revenue\n01/15/2024,5\n02/16/2024,7\n30/30/2024,9\n")
    write(folder, "c.csv", "day,campaign,cost\n2024-01-01,x,5\n")
    headers, rows = files.read_uploads(spark, str(folder))
    uri = {r.file[-5]: r.file for r in headers.select("file").distinct().collect()}
    corrections = spark.createDataFrame([(uri["a"], "revenue", "Amt")], "file STRING, field STRING, source_column STRING")
    domains = spark.createDataFrame(
        [(uri["a"], "sales"), (uri["b"], "sales"), (uri["c"], "marketing")], "file STRING, domain STRING"
    )
    stored = str(tmp_path / "stored")
    mapping = store_uploads(spark, str(folder), stored, corrections=corrections, domains=domains)
    assert {r.source_column for r in mapping.where("field = 'revenue'").collect()} == {"Amt", "Revenue"}
    got = by_file(reports_of_uploads(spark, stored, stamp=False))
    assert set(got) == {"a.csv", "b.csv"}
    assert (got["a.csv"]["total_revenue"], got["a.csv"]["total_orders"]) == (6.0, 3)
    assert (got["b.csv"]["total_revenue"], got["b.csv"]["total_orders"]) == (12.0, 2)
    about = {r.file.rsplit("/", 1)[1]: r for r in profile_uploads(headers, rows, mapping).collect()}
    assert about["b.csv"].columns_found == ["Order Date", "Revenue"] and about["b.csv"].row_count == 3
    assert about["a.csv"].suggested_mapping["revenue"] == "Amt" and len(about["a.csv"].preview) == 3
