import datetime as dt
import random

from pyspark.sql import functions as F

from crewgate.functions import exprs as X


def one(spark, col, value, dtype="string"):
    df = spark.createDataFrame([(value,)], f"v {dtype}")
    return df.select(col(F.col("v")).alias("r")).first()["r"]


def test_strip_ws_matches_python_strip(spark):
    samples = ["  a b  ", "\ta\n", " x ", "\x1cy\x85", "", "   ", "x"]
    got = [one(spark, X.strip_ws, s) for s in samples]
    assert got == [s.strip() for s in samples]


def test_clean_company(spark):
    for raw in ["** Acme **", "*Acme", "Acme*", " *Acme* ", "**  A c m e  **"]:
        assert one(spark, X.clean_company, raw) == raw.strip("*").strip().strip("*")


def test_x_flag_exact_upper_x(spark):
    assert [one(spark, X.x_flag, s) for s in ["X", " X ", "x", "", None, "XX"]] == \
        [1, 1, 0, 0, 0, 0]


def test_load_date_two_formats(spark):
    cases = {"01/02/2024": dt.date(2024, 2, 1), "1/2/2024": dt.date(2024, 2, 1),
             "1-2-2024": dt.date(2024, 2, 1), "31/02/2024": None, "01/02/24": None,
             "": None, "2024-02-01": None}
    for text, want in cases.items():
        assert one(spark, X.load_date, text) == want, text


def test_iso_date_and_bad_flag(spark):
    assert one(spark, X.iso_date, "2024-1-5") == dt.date(2024, 1, 5)
    assert one(spark, X.iso_date, "") is None
    assert one(spark, X.bad_iso_date, "") is False
    assert one(spark, X.bad_iso_date, "2024-02-30") is True
    assert one(spark, X.bad_iso_date, None) is False


def test_keys(spark):
    assert one(spark, X.name_key, "Acme  S.p.A ") == "acmes.p.a"
    assert one(spark, X.typed_vat_key, " IT123\t") == "IT123"
    assert one(spark, X.typed_vat_key, "   ") is None
    assert one(spark, X.stored_vat_key, " IT1 ") == "IT1"


def test_flag_value(spark):
    got = [one(spark, X.flag_value, s) for s in ["1", "0", " 1 ", "2", "x", None, "1.5"]]
    assert got == [1, 0, 1, None, None, None, None]


def test_display_and_marks(spark):
    assert one(spark, X.display_date, dt.date(2024, 3, 9), "date") == "09/03/2024"
    assert one(spark, X.display_date, None, "date") == ""
    assert one(spark, X.display_date_text, "2024-03-09") == "09/03/2024"
    assert one(spark, X.display_date_text, "soon") == "soon"
    assert [one(spark, X.x_mark, v, "int") for v in [1, 0, None, 2]] == ["X", "", "", "X"]
    assert [one(spark, X.is_set, v, "int") for v in [1, 0, None]] == [True, False, False]
    assert [one(spark, X.section, v, "int") for v in [1, 0, None]] == \
        ["temporary", "permanent", "permanent"]


def test_badge_status_order(spark):
    as_of = dt.date(2024, 1, 10)
    rows = [(1, 1, 1, dt.date(2024, 1, 1)), (0, 0, 1, None), (0, 1, 0, None),
            (0, 1, 1, dt.date(2024, 1, 10)), (0, 1, 1, dt.date(2024, 1, 11)),
            (None, 1, 1, None), (0, None, 1, None)]
    df = spark.createDataFrame(rows, "badge_cancelled int, badge_issued int, badge_valid int, "
                                     "expiry_date date")
    got = [r[0] for r in df.select(X.badge_status(as_of)).collect()]
    assert got == ["cancelled", "not_issued", "suspended", "expired", "admitted", "admitted",
                   "not_issued"]


def test_strip_ws_every_python_whitespace(spark):
    spaces = [chr(i) for i in range(0x110000) if chr(i).isspace()]
    lookalikes = ["\u200b", "\u00ad", "\u180e", "\ufeff", "\u2060", "x"]
    samples = [f"{c}a b{c}" for c in spaces + lookalikes] + ["".join(spaces) + "z" + "".join(spaces)]
    df = spark.createDataFrame([(s,) for s in samples], "v string")
    got = [r[0] for r in df.select(X.strip_ws("v")).collect()]
    assert got == [s.strip() for s in samples]


def test_date_parsers_match_python_strptime(spark):
    rnd = random.Random(1)
    days = ["", "0", "1", "01", " 1", "9", "09", "29", "30", "31", "32", "00", "001", "1 "]
    months = ["", "0", "1", "01", "2", "02", "12", "13", "00", "001"]
    years = ["2024", "24", "0999", "0000", "99999", "1900", "+2024", "0001", "9999", "2100"]
    pool = set()
    for _ in range(6000):
        d, m, y = rnd.choice(days), rnd.choice(months), rnd.choice(years)
        pool |= {f"{d}/{m}/{y}", f"{d}-{m}-{y}", f"{y}-{m}-{d}", f"{d}.{m}.{y}"}
    pool = sorted(pool)

    def py(s, fmts):
        for f in fmts:
            try:
                return dt.datetime.strptime(s, f).date().isoformat()
            except ValueError:
                pass
        return None

    df = spark.createDataFrame([(s,) for s in pool], "v string")
    rows = df.select("v", X.load_date("v").cast("string").alias("a"),
                     X.iso_date("v").cast("string").alias("b")).collect()
    assert [r.a for r in rows] == [py(r.v, ("%d/%m/%Y", "%d-%m-%Y")) for r in rows]
    assert [r.b for r in rows] == [py(r.v, ("%Y-%m-%d",)) for r in rows]


def test_small_form_rules(spark):
    assert one(spark, X.blank_if_null, None) == "" and one(spark, X.blank_if_null, "a") == "a"
    df = spark.createDataFrame([(None, None), (1, "B7")], "t int, n string")
    got = [tuple(r) for r in df.select(*X.detail_defaults("t", "n")).collect()]
    assert got == [(0, ""), (1, "B7")]
    assert [one(spark, X.optional_id, s) for s in ["", None, "12", "x"]] == [None, None, 12, None]
    assert [one(spark, X.bad_id, s) for s in ["", None, "12", "x"]] == [False, False, False, True]
    assert one(spark, X.empty_as_null, "") is None
    assert [one(spark, X.checkbox, s) for s in ["on", "off", None]] == [1, 0, 0]
    df = spark.createDataFrame([(1, "T1"), (0, "T2"), (1, None)], "t int, n string")
    assert [r[0] for r in df.select(X.badge_number_if_temporary("t", "n")).collect()] == \
        ["T1", "", ""]
