"""Raw files, caches, role catalogues, run records and dataset recipes on small generated files."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from tenc.plans import recipes, reports
from tenc.sources import runs as R
from tenc.sources.cache import cache_or_build
from tenc.sources.catalog import load_roles, merge_roles, roles_table
from tenc.sources.delimited import names_from_dictionary, read_delimited, with_row_key


def put(folder, name, text, encoding="utf-8"):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding))
    return str(path)


def values(df):
    return [tuple(r) for r in df.collect()]


def test_null_markers_and_quotes(spark, tmp_path):
    path = put(tmp_path, "a.csv", 'a,b\n"x, ""y""",NA\nNone,nan\n ,1\n')
    assert values(read_delimited(spark, path)) == [('x, "y"', None), (None, None), (" ", "1")]


def test_latin1_tabs_and_gzip(spark, tmp_path):
    path = put(tmp_path, "a.txt", "name\tcity\ncafé\tOrléans\n", "latin1")
    assert values(read_delimited(spark, path, sep="\t", encoding="ISO-8859-1")) == [("café", "Orléans")]
    (tmp_path / "b.csv.gz").write_bytes(gzip.compress(b"a,b\n1,2\n"))
    assert values(read_delimited(spark, str(tmp_path / "b.csv.gz"))) == [("1", "2")]


def test_line_breaks_in_header_and_values(spark, tmp_path):
    path = put(tmp_path, "a.csv", '"Cocoa\nPercent",b\n70%,"two\nlines"\n')
    df = read_delimited(spark, path, multiline=True)
    assert df.columns == ["Cocoa\nPercent", "b"] and values(df) == [("70%", "two\nlines")]


def test_preamble_of_several_files(spark, tmp_path):
    for i in range(3):
        rows = "".join(f"{10 * i + j},v{j}\n" for j in range(4))
        put(tmp_path, f"d/{i}.csv", f"Report {i}\n\nsecond remark\nthird, remark\nk,\"v, w\"\n{rows}")
    df = read_delimited(spark, str(tmp_path / "d"), preamble=3)
    assert df.columns == ["k", "v, w"]
    assert sorted(int(r[0]) for r in df.collect()) == [10 * i + j for i in range(3) for j in range(4)]


def test_names_from_a_dictionary(spark, tmp_path):
    dictionary = read_delimited(spark, put(tmp_path, "d.csv", "Column Name,Meaning\nA B,x\nC,y\n"))
    names = names_from_dictionary(dictionary)
    df = read_delimited(spark, put(tmp_path, "a.txt", "1|2\n3|4\n"), sep="|", names=names)
    assert df.columns == ["A B", "C"] and values(df) == [("1", "2"), ("3", "4")]


def test_row_keys_are_unique_and_fixed(spark):
    df = with_row_key(spark.range(100).repartition(7).select((F.col("id") % 3).alias("v")))
    first = values(df.orderBy("row_id"))
    assert len({k for _, k in first}) == 100 and values(df.orderBy("row_id")) == first


def test_cache_builds_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    path = str(tmp_path / "cached")
    assert cache_or_build(spark, path, build).count() == 3
    assert cache_or_build(spark, path, build).count() == 3 and len(calls) == 1


CATALOGUE = {
    "beers": {
        "clf_type": "multiclass-clf",
        "dirtiness_type": {"name": "typos"},
        "col_action": {"name": "Special", "style": "y", "taste": "Numerical", "id": "Delete"},
    }
}


def test_role_catalogue(spark, tmp_path):
    path = put(tmp_path, "roles.json", json.dumps(CATALOGUE, indent=1))
    assert load_roles(path) == CATALOGUE
    rows = roles_table(spark, path).orderBy("position").collect()
    assert [(r.column, r.role) for r in rows] == list(CATALOGUE["beers"]["col_action"].items())
    assert {r.task for r in rows} == {"multiclass-clf"}
    own = {"beers": {"clf_type": "regression"}}
    assert merge_roles(own, CATALOGUE)["beers"] == own["beers"]
    assert merge_roles({}, CATALOGUE) == CATALOGUE


def record(dataset, encoder, params=None, scores=(0.5, 0.7)):
    n = len(scores)
    arrays = [float(i) for i in range(n)], [10.0] * n, [2.0] * n, list(scores), [0.9] * n, [1.0] * n, [2.0] * n
    return (
        dataset, 2, 1 / 3, -1, encoder, True, ("KNN", "KNN", params or {}), ["ShuffleSplit"],
        ("StandardScaler", {}), 5, 32, {"a": "y"}, "regression", arrays,
    )


def test_run_records(spark, tmp_path):
    path = str(tmp_path / "runs")
    runs = spark.createDataFrame([record("one", "e1", {"k": "5", "w": "u"}), record("two", "e2")], R.RUN_SCHEMA)
    R.write_runs(runs, path)
    R.write_runs(spark.createDataFrame([record("one", "e3")], R.RUN_SCHEMA), path)
    back = R.read_runs(spark, path)
    assert back.count() == 3
    long = R.long_results(back).where("dataset = 'one' and encoder = 'e1'").orderBy("fold").collect()
    assert [(r.fold, r.score, r.score_type, r.clf) for r in long] == [
        (0.0, 0.5, "r2 score", "KNN"), (1.0, 0.7, "r2 score", "KNN"),
    ]
    key = lambda df: {r.run_key for r in R.parameter_key(df).select("run_key").collect()}
    swapped = spark.createDataFrame(
        [record("one", "e1", {"w": "u", "k": "5"}, scores=(0.1,)), record("two", "e2")], R.RUN_SCHEMA
    )
    assert key(runs) == key(swapped) and key(runs) < key(back)


def test_reports(spark):
    rows = [("d", "e", "m", float(v)) for v in (1, 2, 3, 4, 100)]
    df = spark.createDataFrame(rows, "dataset string, encoder string, clf string, score double")
    box = reports.box_summary(df).first()
    assert (box.q1, box.median, box.q3) == (2.0, 3.0, 4.0)
    assert (box.whisker_low, box.whisker_high, box.n_outliers) == (1.0, 4.0, 1)
    runs = spark.createDataFrame([record("one", "e1"), record("two", "e2")], R.RUN_SCHEMA)
    assert reports.filter_runs(runs, {"clf": ["KN"], "dataset": "two"}).count() == 1
    reduced = df.withColumn("dimension_reduction", F.struct(F.lit("pca").alias("method"), F.lit(3).alias("size")))
    assert reports.filter_runs(reduced, {"reduction_method": "pca", "n_components": 3}).count() == 5
    assert reports.filter_runs(reduced, {"n_components": 4}).count() == 0
    name = spark.createDataFrame([("/x/Distance-3-gram_Typos-0.1_flag",)], "n string")
    parsed = name.select(reports.run_attributes(F.col("n"))).first()[0]
    assert parsed == {"Distance": "3-gram", "Typos": "0.1", "flag": ""}


def dataset(spark, tmp_path, name, catalogue=None):
    item = recipes.get_dataset(name, str(tmp_path), catalogue)
    return item, item.load(spark)


def test_adult(spark, tmp_path):
    line = "{}, Private, 1, HS, 9, Never, {}, Own, White, Male, 0, 0, 40, US, {}\n"
    text = line.format(39, "Sales", ">50K") + line.format(50, "?", "<=50K") + line.format(20, "Craft", "<=50K")
    put(tmp_path, "adult/raw/adult.data", text)
    item, df = dataset(spark, tmp_path, "adult")
    rows = {r.age: r for r in df.collect()}
    assert set(rows) == {39.0, 20.0} and item.task == "binary-clf"
    assert rows[39.0].income == 1.0 and rows[20.0].income == 0.0
    assert rows[39.0].occupation == " Sales" and rows[39.0]["education-num"] == 9.0


def test_employee_salaries(spark, tmp_path):
    head = "Gender,Current Annual Salary,Department Name,Division,Assignment Category,Employee Position Title,Date First Hired\n"
    put(tmp_path, "employee_salaries/raw/Employee_Salaries_-_2016.csv", head + "F,69222.18,Police,Tech,Fulltime,Analyst,09/22/1986\n")
    _, df = dataset(spark, tmp_path, "employee_salaries")
    row = df.first()
    assert row["Year First Hired"] == 1986.0 and row["Current Annual Salary"] == 69222.18


def test_vancouver(spark, tmp_path):
    put(
        tmp_path, "vancouver_employee/raw/2017StaffRemunerationOver75KWithExpenses.csv",
        'City\nof\nstaff\nName,Department,Title,Remuneration,Expenses\nA,Fire,Chief,"75,100",1\n',
    )
    roles = {"vancouver_employee": {"clf_type": "regression", "col_action": {
        "Name": "Delete", "Department": "OneHotEncoderDense", "Title": "Special", "Remuneration": "y"}}}
    _, df = dataset(spark, tmp_path, "vancouver_employee", roles)
    row = df.first()
    import math

    assert row.Remuneration == pytest.approx(math.log(75100)) and row.Title == "Chief"


def test_kickstarter(spark, tmp_path):
    put(
        tmp_path, "kickstarter_projects/raw/ks-projects-201612.csv",
        "ID ,category ,state ,usd pledged \n1,Café,failed,0\n2,Art,successful,10\n3,Art,live,5\n", "latin1",
    )
    roles = {"kickstarter_projects": {"clf_type": "binary-clf", "col_action": {
        "category ": "Special", "state ": "y", "usd pledged ": "Numerical"}}}
    _, df = dataset(spark, tmp_path, "kickstarter_projects", roles)
    rows = {r["category "]: r for r in df.collect()}
    assert set(rows) == {"Café", "Art"} and rows["Art"]["state "] == 1.0
    assert rows["Café"]["usd pledged "] == pytest.approx(-23.02585, abs=1e-5)


def test_colleges_and_met_objects(spark, tmp_path):
    put(
        tmp_path, "colleges/raw/Colleges.txt",
        "UNITID\tState\tPredominant Degree\tMean Earnings 6 years\tFaculty Salary\n"
        "1\tNA\tNone given\tPrivacySuppressed\t7000.9\n2\tOH\tBachelor\t30500\tx\n", "latin1",
    )
    rows = {r.UNITID: r for r in recipes.RECIPES["colleges"].table(spark, str(tmp_path)).collect()}
    assert tuple(rows["1"])[1:] == ("nan", None, None, 7000)
    assert tuple(rows["2"])[1:] == ("OH", "Bachelor", 30500, None)
    put(
        tmp_path, "met_objects/raw/MetObjects.csv",
        'Department,Object Name,State\n"Am　Wing","Co\r\nin",(none assigned)\nX,Y\x1e,|\nZ,W,NY\n',
    )
    rows = recipes.RECIPES["met_objects"].table(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in rows] == [("Am Wing", "Coin", None), ("X", "Y", None), ("Z", "W", "NY")]


def test_federal_election(spark, tmp_path):
    put(tmp_path, "federal_election/data_dict.csv", "Column Name\nOCCUPATION\nTRANSACTION_AMT\n")
    put(tmp_path, "federal_election/raw/itcont.txt", "NURSE|-10\nCLERK|1\nCOOK|0\nPILOT|0.5\n", "latin1")
    rows = recipes.RECIPES["federal_election"].table(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in rows] == [("NURSE", pytest.approx(2.302585, abs=1e-6))]


def test_road_safety(spark, tmp_path):
    put(tmp_path, "road_safety/raw/2015_Make_Model.csv", "Accident_Index,Vehicle_Reference,make,model,Age\nA,1,FORD,KA,3\nA,2,,X,4\nB,1,FIAT,UNO,5\nC,1,VW,UP,6\n")
    put(tmp_path, "road_safety/raw/Casualties_2015.csv", "Accident_Index,Vehicle_Reference,Age,Sex_of_Driver\nA,1,30,2\nA,2,31,1\nB,1,32,3\nC,1,33,1\nC,1,34,\n")
    df = recipes.RECIPES["road_safety"].table(spark, str(tmp_path))
    rows = {(r.make, r.Age_cas, r.Age_model, r.Sex_of_Driver) for r in df.collect()}
    assert rows == {("FORD", "30", "3", 1), ("VW", "33", "6", 0), ("VW", "34", "6", None)}


def test_open_payments(spark, tmp_path):
    company, amount, dispute = recipes._COMPANY, recipes._AMOUNT, recipes._DISPUTE
    names = ["Physician_Specialty", "Name_of_Associated_Covered_Drug_or_Biological1",
             "Name_of_Associated_Covered_Device_or_Medical_Supply1", company, amount, dispute]
    for name, rows in {
        "OP_RSRCH_PGYR2013": [("s", "d", "m", "Acme", "5.0", "No")] * 2,
        "OP_GNRL_PGYR2013": [("s", "d", "m", "Acme", "5.0", "No"), ("s", "d", "m", "Brill", "7.5", "No")],
        "OP_GNRL_PGYR2014": [("s", "d", "m", "Other", "1.0", "No")],
    }.items():
        spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/docs_payments/tables/{name}")
    _, df = dataset(spark, tmp_path, "open_payments")
    rows = sorted((r[company], r[amount], r.status) for r in df.collect())
    assert rows == [("Acme", 5.0, 0.0), ("Acme", 5.0, 1.0), ("Brill", 7.5, 0.0)]


@pytest.mark.parametrize(
    ("name", "path", "text", "check"),
    [
        ("beer_reviews", "beer_reviews/raw/beer_reviews.csv", "beer_name\na b\n", {"beer_name": "a b"}),
        ("traffic_violations", "traffic_violations/raw/Traffic_Violations.csv", 'Year,Make,Description\n2003.0,NONE,"a\nb"\n', {"Year": 2003, "Make": None, "Description": "ab"}),
        ("crime_data", "crime_data/raw/Crime_Data_from_2010_to_Present.csv", "Victim Age,Area Name\n30.7,X\n", {"Victim Age": 30}),
        ("public_procurement", "public_procurement/raw/TED_CAN_2015.csv", "AWARD_VALUE_EURO,CAE_NAME\n-100,a b\n1,c\n", {"LOG_AWARD_VALUE_EURO": pytest.approx(4.60517, abs=1e-5), "CAE_NAME": "a b"}),
        ("consumer_complaints", "consumer_complaints/raw/Consumer_Complaints.csv", "Consumer disputed?,Issue\nYes,x\n,y\n", {"Consumer disputed?": 1.0}),
        ("cacao_flavors", "cacao_flavors/raw/flavors_of_cacao.csv", '"Cocoa\nPercent"\n70%\n', {"Cocoa\nPercent": 70.0}),
        ("house_prices", "house_prices/raw/train.csv", "Id,MSSubClass\n1,60\n", {"MSSubClass": "2-STORY 1946 & NEWER"}),
        ("journal_influence", "journal_influence/raw/estimated-article-influence-scores-2015.csv", ",journal_name,citation_count_sum,paper_count_sum\n0,J,12.0,x\n", {"citation_count_sum": 12, "paper_count_sum": None}),
        ("firefighter_interventions", "firefighter_interventions/raw/interventions-hebdo-2010-2017.csv", "a;b\n1;2\n", {"a": "1", "b": "2"}),
        ("intrusion_detection", "intrusion_detection/raw/kddcup.data_10_percent", ",".join(["0", "tcp"] + ["1"] * 39 + ["normal."]) + "\n", {"protocol_type": "tcp", "attack_type": "normal."}),
        ("drug_directory", "drug_directory/raw/product.txt", "PRODUCTTYPENAME\tROUTENAME\nHUMAN\tORAL\n", {"ROUTENAME": "ORAL"}),
    ],
)
def test_other_recipes(spark, tmp_path, name, path, text, check):
    put(tmp_path, path, text)
    rows = recipes.RECIPES[name].table(spark, str(tmp_path)).collect()
    assert len(rows) == 1
    for column, value in check.items():
        assert rows[0][column] == value


def test_building_permits(spark, tmp_path):
    target = tmp_path / "building_permits/raw"
    target.mkdir(parents=True)
    (target / "building-permits.csv.gz").write_bytes(gzip.compress(b" ESTIMATED_COST,PERMIT_TYPE \n0,x\n"))
    row = recipes.RECIPES["building_permits"].table(spark, str(tmp_path)).first()
    assert row.ESTIMATED_COST == pytest.approx(-23.02585, abs=1e-5) and row.PERMIT_TYPE == "x"


def test_datasets_without_roles_are_refused(tmp_path):
    with pytest.raises(ValueError, match="catalogue"):
        recipes.get_dataset("beer_reviews", str(tmp_path))
    with pytest.raises(ValueError, match="unknown"):
        recipes.get_dataset("nothing", str(tmp_path))
    assert len(recipes.RECIPES) == 29


def test_preamble_with_separator_encoding_and_blank_cell(spark, tmp_path):
    for i in range(2):
        folder = tmp_path / "p"
        folder.mkdir(exist_ok=True)
        (folder / f"{i}.csv").write_bytes("Bericht\nköpfe;;\"b;c\"\n1;ä;x\n".encode("latin1"))
    df = read_delimited(spark, str(tmp_path / "p"), sep=";", encoding="ISO-8859-1", preamble=1)
    assert df.columns == ["köpfe", "_c1", "b;c"]
    assert [tuple(r) for r in df.collect()] == [("1", "ä", "x")] * 2
    (tmp_path / "p" / "2.csv").write_text("other\na;b;c\n1;2;3\n")
    with pytest.raises(ValueError, match="different headers"):
        read_delimited(spark, str(tmp_path / "p"), sep=";", encoding="ISO-8859-1", preamble=1)


def test_row_keys_do_not_depend_on_partitions(spark):
    rows = spark.range(300).select((F.col("id") % 70).alias("v"), F.lit(None).cast("string").alias("w"))
    one, seven = (sorted(map(tuple, with_row_key(rows.repartition(n)).collect())) for n in (1, 7))
    assert one == seven and len({k for *_, k in one}) == 300
    assert with_row_key(rows, index="v").first()["row_id"] is not None


def test_stored_runs_can_be_filtered_by_reduction(spark, tmp_path):
    path = str(tmp_path / "reduced")
    R.write_runs(spark.createDataFrame([record("one", "e1")], R.RUN_SCHEMA), path)
    assert reports.filter_runs(R.read_runs(spark, path), {"reduction_method": "pca", "n_components": 3}).count() == 0


def test_index_columns_are_row_keys(spark, tmp_path):
    put(tmp_path, "house_sales/raw/kc_house_data.csv", "id,price,grade\n71,9,1\n72,8,2\n71,7,3\n,6,4\n71,7,3\n")
    roles = {"house_sales": {"clf_type": "regression", "col_action": {"price": "y", "grade": "Numerical"}}}
    item, df = dataset(spark, tmp_path, "house_sales", roles)
    rows = df.collect()
    keys = sorted(r["row_id"] for r in rows)
    assert item.key == "row_id" and df.columns == ["row_id", "price", "grade"] and len(set(keys)) == 5
    assert {"71", "72", "71#2", "71#3"} < set(keys)
    # The same row has the same key however the table is cut.
    raw = recipes.RECIPES["house_sales"].table(spark, str(tmp_path))
    one, five = (
        sorted((r["row_id"], r["price"]) for r in with_row_key(raw.repartition(n), index="id").collect()) for n in (1, 5)
    )
    assert one == five
    put(tmp_path, "emobank/raw/emobank.csv", "id,V,text\n110_1,3.2,Fine day\n110_2,2.0,Rain\n")
    roles = {"emobank": {"clf_type": "regression", "col_action": {"V": "y", "text": "Special"}}}
    _, df = dataset(spark, tmp_path, "emobank", roles)
    assert {r["row_id"]: r["V"] for r in df.collect()} == {"110_1": 3.2, "110_2": 2.0}


def test_split_read_equals_the_whole_file_read(spark, tmp_path):
    """Records over many lines and blocks, doubled quotes, empty lines and cells, both line ends."""
    import csv

    rows = [["id", "a\nb", "c,d"]]
    for i in range(400):
        rows.append([str(i), "line\n" * (i % 40) + 'say ""\n"' * (i % 3), ["", "x, y", 'q"', "\n\n", "é"][i % 5]])
    for end in ("\n", "\r\n"):
        path = tmp_path / f"rows{len(end)}.csv"
        with open(path, "w", newline="", encoding="utf-8") as out:
            csv.writer(out, lineterminator=end).writerows(rows)
            out.write(end)
        old = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
        try:
            assert spark.read.text(str(path)).rdd.getNumPartitions() > 50
            split = read_delimited(spark, str(path), multiline="split", markers=None)
            assert split.columns == ["id", "a\nb", "c,d"]
            got = {r[0]: [x or "" for x in r] for r in split.collect()}
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        assert got == {r[0]: r for r in rows[1:]}


def test_split_read_of_several_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,v\n1,"x\ny"\n')
    (tmp_path / "b.csv").write_text('k,v\n2,z\n')
    rows = read_delimited(spark, str(tmp_path), multiline="split").collect()
    assert sorted((r.k, r.v) for r in rows) == [("1", "x\ny"), ("2", "z")]
    (tmp_path / "c.csv").write_text("k,w\n3,z\n")
    with pytest.raises(ValueError):
        read_delimited(spark, str(tmp_path), multiline="split")
    named = read_delimited(spark, str(tmp_path / "b.csv"), multiline="split", names=["p", "q"])
    assert sorted(map(tuple, named.collect())) == [("2", "z"), ("k", "v")]
