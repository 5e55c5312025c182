"""How each public dataset is read and cleaned.

A recipe is data: where the raw files lie, how they are read, and the cleaning applied to the
table. Column roles come from a role catalogue in JSON (``tenc.sources.catalog``), apart from the
few datasets that bring their own. Files are looked up under a data folder; every recipe gives a
lazy DataFrame whose cleaning is column expressions only.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenc.functions import cleaning as C
from tenc.functions.cleaning import quoted
from tenc.operators.encoders.stats import BINARY, MULTICLASS, REGRESSION
from tenc.operators.prepare import CATEGORICAL, DELETE, NUMERICAL, TARGET, drop_missing
from tenc.operators.relate import distinct_rows, left_join_suffixed, union_tagged
from tenc.plans.experiment import Dataset
from tenc.sources.cache import cache_or_build
from tenc.sources.catalog import merge_roles
from tenc.sources.delimited import names_from_dictionary, read_delimited, with_row_key

Clean = Callable[[DataFrame], DataFrame]
Load = Callable[[SparkSession, str], DataFrame]

# Column names of files without a header line.
ADULT_COLUMNS = [
    "age", "workclass", "fnlwgt", "education", "education-num", "marital-status", "occupation",
    "relationship", "race", "sex", "capital-gain", "capital-loss", "hours-per-week",
    "native-country", "income",
]
INTRUSION_COLUMNS = [
    "duration", "protocol_type", "service", "flag", "src_bytes", "dst_bytes", "land",
    "wrong_fragment", "urgent", "hot", "num_failed_logins", "logged_in", "num_compromised",
    "root_shell", "su_attempted", "num_root", "num_file_creations", "num_shells",
    "num_access_files", "num_outbound_cmds", "is_host_login", "is_guest_login", "count",
    "srv_count", "serror_rate", "srv_serror_rate", "rerror_rate", "srv_rerror_rate",
    "same_srv_rate", "diff_srv_rate", "srv_diff_host_rate", "dst_host_count",
    "dst_host_srv_count", "dst_host_same_srv_rate", "dst_host_diff_srv_rate",
    "dst_host_same_src_port_rate", "dst_host_srv_diff_host_rate", "dst_host_serror_rate",
    "dst_host_srv_serror_rate", "dst_host_rerror_rate", "dst_host_srv_rerror_rate",
    "attack_type",
]

# Names of dwelling codes.
DWELLINGS = {
    "20": "1-STORY 1946 & NEWER ALL STYLES",
    "30": "1-STORY 1945 & OLDER",
    "40": "1-STORY W/FINISHED ATTIC ALL AGES",
    "45": "1-1/2 STORY - UNFINISHED ALL AGES",
    "50": "1-1/2 STORY FINISHED ALL AGES",
    "60": "2-STORY 1946 & NEWER",
    "70": "2-STORY 1945 & OLDER",
    "75": "2-1/2 STORY ALL AGES",
    "80": "SPLIT OR MULTI-LEVEL",
    "85": "SPLIT FOYER",
    "90": "DUPLEX - ALL STYLES AND AGES",
    "120": "1-STORY PUD (Planned Unit Development) - 1946 & NEWER",
    "150": "1-1/2 STORY PUD - ALL AGES",
    "160": "2-STORY PUD - 1946 & NEWER",
    "180": "PUD - MULTILEVEL - INCL SPLIT LEV/FOYER",
    "190": "2 FAMILY CONVERSION - ALL STYLES AND AGES",
}

# Roles of the datasets that bring their own (deleted columns left out).
_COMPANY = "Applicable_Manufacturer_or_Applicable_GPO_Making_Payment_Name"
_DISPUTE = "Dispute_Status_for_Publication"
_AMOUNT = "Total_Amount_of_Payment_USDollars"
OWN_ROLES: dict[str, dict] = {
    "adult": {
        "clf_type": BINARY,
        "col_action": {
            "age": "Numerical",
            "workclass": "OneHotEncoderDense",
            "education": "OneHotEncoderDense",
            "education-num": "Numerical",
            "marital-status": "OneHotEncoderDense",
            "occupation": "Special",
            "relationship": "OneHotEncoderDense",
            "race": "OneHotEncoderDense",
            "sex": "OneHotEncoderDense",
            "capital-gain": "Numerical",
            "capital-loss": "Numerical",
            "hours-per-week": "Numerical",
            "native-country": "OneHotEncoderDense",
            "income": "y",
        },
    },
    "medical_charge": {
        "clf_type": REGRESSION,
        "col_action": {
            "DRG Definition": "Special",
            "Provider State": "OneHotEncoderDense",
            "Average Covered Charges": "Numerical",
            "Average Total Payments": "y",
        },
    },
    "employee_salaries": {
        "clf_type": REGRESSION,
        "col_action": {
            "Gender": "OneHotEncoderDense",
            "Current Annual Salary": "y",
            "Department Name": "OneHotEncoderDense",
            "Division": "OneHotEncoderDense",
            "Assignment Category": "OneHotEncoderDense-1",
            "Employee Position Title": "Special",
            "Year First Hired": "Numerical",
        },
    },
    "open_payments": {
        "clf_type": BINARY,
        "col_action": {
            _COMPANY: "Special",
            _AMOUNT: "Numerical",
            _DISPUTE: "OneHotEncoderDense-1",
            "status": "y",
        },
    },
}


@dataclass(frozen=True)
class Recipe:
    """``path`` is relative to the data folder; ``load`` replaces the plain read if given.

    ``index`` names the column that identifies a row; an empty name is the first column.
    """

    name: str
    path: str
    read: Mapping = field(default_factory=dict)
    clean: Clean | None = None
    load: Load | None = None
    index: str | None = None

    def table(self, spark: SparkSession, data: str) -> DataFrame:
        """The cleaned raw table, all text columns still text."""
        if self.load is not None:
            return self.load(spark, data)
        df = read_delimited(spark, f"{data}/{self.path}", **self.read)
        return self.clean(df) if self.clean else df


def _set(df: DataFrame, changes: Mapping[str, object]) -> DataFrame:
    """Replace columns by exact name (or add them), keeping the column order."""
    old = [changes.get(c, quoted(c)).alias(c) for c in df.columns]
    new = [e.alias(c) for c, e in changes.items() if c not in df.columns]
    return df.select(*old, *new)


def _adult(df: DataFrame) -> DataFrame:
    known = df.where(C.differs_from(F.col("occupation"), " ?"))
    return _set(known, {"income": C.equals_label(F.col("income"), " >50K")})


def _employees(df: DataFrame) -> DataFrame:
    return _set(df, {"Year First Hired": C.year_of(quoted("Date First Hired"), "M/d/yyyy")})


def _whole_numbers(*names: str) -> Clean:
    """Numeric columns cut to whole numbers; anything unreadable is missing."""

    def clean(df: DataFrame) -> DataFrame:
        present = [n for n in names if n in df.columns]
        return _set(
            df, {n: C.lenient_int(quoted(n).try_cast("double"), "double") for n in present}
        )

    return clean


def _replacing(changes: Mapping[str, str]) -> Clean:
    return lambda df: C.replace_in_text_columns(df, changes)


_NO_BREAK_SPACE = {" ": " "}


def _sentinels(names: list[str], sentinels: list[str]) -> Clean:
    def clean(df: DataFrame) -> DataFrame:
        present = [n for n in names if n in df.columns]
        return _set(df, {n: C.sentinel_to_null(quoted(n), sentinels) for n in present})

    return clean


def _chain(*steps: Clean) -> Clean:
    def clean(df: DataFrame) -> DataFrame:
        for step in steps:
            df = step(df)
        return df

    return clean


def _colleges(df: DataFrame) -> DataFrame:
    changes = {
        "State": F.coalesce(quoted("State"), F.lit("nan")),
        "Predominant Degree": C.containing_to_null(quoted("Predominant Degree"), "None"),
    }
    for c in df.columns:
        if "Mean Earnings" in c or "Median Earnings" in c:
            changes[c] = C.int_unless_containing(quoted(c), "PrivacySuppressed")
    numbers = _whole_numbers(
        "Undergrad Size", "Average Cost Academic Year", "Average Cost Program Year",
        "Tuition (Instate)", "Tuition (Out of state)", "Spend per student", "Faculty Salary",
    )
    return numbers(_set(df, changes))


def _procurement(df: DataFrame) -> DataFrame:
    award = df.withColumn("AWARD_VALUE_EURO", F.col("AWARD_VALUE_EURO").try_cast("double"))
    kept = C.keep_positive_log(award, "AWARD_VALUE_EURO", "LOG_AWARD_VALUE_EURO")
    return C.replace_in_text_columns(kept, _NO_BREAK_SPACE)


def _complaints(df: DataFrame) -> DataFrame:
    known = drop_missing(df, ["Consumer disputed?"])
    return _set(
        known, {"Consumer disputed?": C.equals_label(quoted("Consumer disputed?"), "Yes")}
    )


def _cacao(df: DataFrame) -> DataFrame:
    percent = "Cocoa\nPercent"
    return _set(df, {percent: C.without_last_character(quoted(percent))})


def _houses(df: DataFrame) -> DataFrame:
    return _set(df, {"MSSubClass": C.recode(F.col("MSSubClass"), DWELLINGS)})


def _kickstarter(df: DataFrame) -> DataFrame:
    ended = df.where(quoted("state ").isin("failed", "successful"))
    return _set(
        ended,
        {
            "state ": C.equals_label(quoted("state "), "successful"),
            "usd pledged ": C.log_shifted(quoted("usd pledged ").try_cast("double")),
        },
    )


def _permits(df: DataFrame) -> DataFrame:
    named = C.trim_column_names(df)
    cost = C.log_shifted(quoted("ESTIMATED_COST").try_cast("double"))
    return _set(named, {"ESTIMATED_COST": cost})


def _vancouver(df: DataFrame) -> DataFrame:
    amount = C.number_with_separators(quoted("Remuneration"))
    return _set(df, {"Remuneration": F.ln(amount)})


def _open_payments(spark: SparkSession, data: str) -> DataFrame:
    """Payments of 2013 from research (allowed) and general (disallowed) files, written once."""
    columns = [
        "Physician_Specialty", "Name_of_Associated_Covered_Drug_or_Biological1",
        "Name_of_Associated_Covered_Device_or_Medical_Supply1", _COMPANY, _AMOUNT, _DISPUTE,
    ]
    folder = f"{data}/docs_payments"

    def build() -> DataFrame:
        parts = {
            "allowed": spark.read.parquet(f"{folder}/tables/*RSRCH_PGYR2013*"),
            "disallowed": spark.read.parquet(f"{folder}/tables/*GNRL_PGYR2013*"),
        }
        return distinct_rows(union_tagged(parts, columns, "status"))

    df = cache_or_build(spark, f"{folder}/output/payments", build)
    return df.withColumn("status", C.equals_label(F.col("status"), "allowed"))


def _road_safety(spark: SparkSession, data: str) -> DataFrame:
    """Casualties with make and model of their vehicle, and the sex of its driver as 0 or 1."""
    folder = f"{data}/road_safety/raw"
    models = drop_missing(read_delimited(spark, f"{folder}/2015_Make_Model.csv"), ["make"])
    casualties = read_delimited(spark, f"{folder}/Casualties_2015.csv")
    key = ["Accident_Index", "Vehicle_Reference"]
    joined = left_join_suffixed(casualties, models, key, "_cas", "_model", ["make"])
    sex = F.col("Sex_of_Driver").try_cast("long")
    coded = joined.withColumn("Sex_of_Driver", sex).where(
        C.differs_from(F.col("Sex_of_Driver"), 3) & C.differs_from(F.col("Sex_of_Driver"), -1)
    )
    return coded.withColumn("Sex_of_Driver", F.col("Sex_of_Driver") - 1)


def _federal_election(spark: SparkSession, data: str) -> DataFrame:
    """A headerless file whose column names are listed in a dictionary file."""
    folder = f"{data}/federal_election"
    names = names_from_dictionary(read_delimited(spark, f"{folder}/data_dict.csv"))
    raw = read_delimited(
        spark, f"{folder}/raw/itcont.txt", sep="|", encoding="ISO-8859-1", names=names
    )
    amount = raw.withColumn("TRANSACTION_AMT", F.col("TRANSACTION_AMT").try_cast("double"))
    return C.keep_positive_log(amount, "TRANSACTION_AMT", "TRANSACTION_AMT")


_LATIN1 = "ISO-8859-1"
_MET_SENTINEL_COLUMNS = [
    "Geography Type", "State", "Classification", "Artist Role", "Artist Prefix",
    "Artist Display Bio", "Artist Suffix",
]

RECIPES: dict[str, Recipe] = {
    r.name: r
    for r in (
        Recipe("adult", "adult/raw/adult.data", {"names": ADULT_COLUMNS}, _adult),
        Recipe(
            "medical_charge",
            "medical_charge/raw/Medicare_Provider_Charge_Inpatient_DRG100_FY2011.csv",
        ),
        Recipe(
            "employee_salaries", "employee_salaries/raw/Employee_Salaries_-_2016.csv",
            clean=_employees,
        ),
        Recipe(
            "journal_influence",
            "journal_influence/raw/estimated-article-influence-scores-2015.csv",
            clean=_whole_numbers("citation_count_sum", "paper_count_sum"),
        ),
        Recipe(
            "met_objects", "met_objects/raw/MetObjects.csv", {"multiline": True},
            _chain(
                _replacing({"\r\n": "", "　": " ", "\x1e": ""}),
                _sentinels(_MET_SENTINEL_COLUMNS, ["|", "||", "(none assigned)"]),
            ),
        ),
        Recipe(
            "colleges", "colleges/raw/Colleges.txt", {"sep": "\t", "encoding": _LATIN1},
            _colleges, index="UNITID",
        ),
        Recipe(
            "beer_reviews", "beer_reviews/raw/beer_reviews.csv",
            clean=_replacing(_NO_BREAK_SPACE),
        ),
        Recipe(
            "traffic_violations", "traffic_violations/raw/Traffic_Violations.csv",
            {"multiline": True},
            _chain(
                _whole_numbers("Year"), _sentinels(["Make", "Model"], ["NONE"]),
                _replacing({"\n": ""}),
            ),
        ),
        Recipe(
            "crime_data", "crime_data/raw/Crime_Data_from_2010_to_Present.csv",
            clean=_whole_numbers(
                "Victim Age", "Premise Code", "Weapon Used Code", "Crime Code 1",
                "Crime Code 2", "Crime Code 3", "Crime Code 4",
            ),
        ),
        Recipe("public_procurement", "public_procurement/raw/TED_CAN_2015.csv", clean=_procurement),
        Recipe(
            "intrusion_detection", "intrusion_detection/raw/kddcup.data_10_percent",
            {"names": INTRUSION_COLUMNS}, _replacing(_NO_BREAK_SPACE),
        ),
        Recipe("emobank", "emobank/raw/emobank.csv", index="id"),
        Recipe("text_emotion", "text_emotion/raw/text_emotion.csv", index="tweet_id"),
        Recipe("open_payments", "docs_payments/tables", load=_open_payments),
        Recipe("road_safety", "road_safety/raw", load=_road_safety),
        Recipe(
            "consumer_complaints", "consumer_complaints/raw/Consumer_Complaints.csv",
            {"multiline": True}, _complaints,
        ),
        Recipe("product_relevance", "product_relevance/raw/train.csv", {"encoding": _LATIN1}),
        Recipe("federal_election", "federal_election/raw/itcont.txt", load=_federal_election),
        Recipe(
            "drug_directory", "drug_directory/raw/product.txt", {"sep": "\t", "encoding": _LATIN1}
        ),
        Recipe("dating_profiles", "dating_profiles/raw/profiles.csv", {"multiline": True}),
        Recipe("cacao_flavors", "cacao_flavors/raw/flavors_of_cacao.csv", {"multiline": True}, _cacao),
        Recipe("wine_reviews", "wine_reviews/raw/winemag-data_first150k.csv"),
        Recipe("house_prices", "house_prices/raw/train.csv", clean=_houses, index=""),
        Recipe(
            "kickstarter_projects", "kickstarter_projects/raw/ks-projects-201612.csv",
            {"encoding": _LATIN1}, _kickstarter, index="",
        ),
        Recipe("building_permits", "building_permits/raw/building-permits.csv.gz", clean=_permits),
        Recipe("california_housing", "california_housing/raw/housing.csv"),
        Recipe("house_sales", "house_sales/raw/kc_house_data.csv", index=""),
        Recipe(
            "vancouver_employee",
            "vancouver_employee/raw/2017StaffRemunerationOver75KWithExpenses.csv",
            {"preamble": 3}, _vancouver,
        ),
        Recipe(
            "firefighter_interventions",
            "firefighter_interventions/raw/interventions-hebdo-2010-2017.csv", {"sep": ";"},
        ),
    )
}


def typed_by_role(df: DataFrame, roles: Mapping[str, str], task: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Keep the columns with a role, numbers and numeric targets as doubles, the rest as text; ``keep`` as it is."""
    chosen = [quoted(c) for c in keep]
    for c, role in roles.items():
        if role == DELETE:
            continue
        number = role == NUMERICAL or (role == TARGET and task != MULTICLASS)
        if number:
            chosen.append(quoted(c).try_cast("double").alias(c))
        elif role in CATEGORICAL or role == TARGET:
            chosen.append(quoted(c).cast("string").alias(c))
        else:
            chosen.append(quoted(c))
    return df.select(*chosen)


def get_dataset(name: str, data: str, catalogue: Mapping[str, dict] | None = None) -> Dataset:
    """A dataset ready for experiments; roles come from the catalogue or the recipe's own."""
    entries = merge_roles(OWN_ROLES, dict(catalogue or {}))
    if name not in RECIPES:
        raise ValueError(f"unknown dataset {name!r}")
    if name not in entries:
        raise ValueError(f"no column roles for {name!r}: pass a role catalogue that lists it")
    roles, task = entries[name]["col_action"], entries[name]["clf_type"]

    def load(spark: SparkSession) -> DataFrame:
        recipe = RECIPES[name]
        raw = recipe.table(spark, data)
        if recipe.index is None:
            return with_row_key(typed_by_role(raw, roles, task))
        keyed = with_row_key(raw, index=recipe.index or raw.columns[0])
        return typed_by_role(keyed, roles, task, keep=("row_id",))

    return Dataset(name, task, roles, "row_id", load)
