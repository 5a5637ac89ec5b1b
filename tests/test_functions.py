from datetime import date

import pytest
from pyspark.sql import functions as F

from codexmill.functions import compare as C
from codexmill.functions import privacy as P
from codexmill.functions import text as T


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values()) or (1,)], ", ".join(f"{k} {t(v)}" for k, v in values.items()) or "x int")
    return row.select(column).first()[0]


def t(v):
    return {str: "string", int: "int", date: "date", list: "array<string>"}.get(type(v), "string")


@pytest.mark.parametrize("name,slug", [("Jane  Doe!", "jane-doe"), ("--A--", "a"), ("x" * 80, "x" * 60), ("", "")])
def test_slugify(spark, name, slug):
    assert one(spark, T.slugify(F.col("v")), v=name) == slug


@pytest.mark.parametrize("name,normal", [("Dr. Jane Doe (VP), PhD", "jane doe"), ("Mr John O'Neil Jr.", "john o'neil"), ("Prof", "")])
def test_normal_name(spark, name, normal):
    assert one(spark, T.normal_name(F.col("v")), v=name) == normal


def test_profile_cuts_slash_before_query(spark):
    assert one(spark, T.canonical_profile(F.col("v")), v="https://www.LinkedIn.com/in/me/") == "linkedin.com/in/me"
    assert one(spark, T.canonical_profile(F.col("v")), v="http://linkedin.com/in/me/?a=1") == "linkedin.com/in/me/"


def test_fingerprint_ignores_order_and_space(spark):
    a = one(spark, T.pair_fingerprint(F.col("a"), F.col("b"), F.lit("k")), a="One  two", b="three")
    assert a == one(spark, T.pair_fingerprint(F.col("a"), F.col("b"), F.lit("k")), a="three ", b="one two")
    assert len(a) == 16


def test_query_tokens():
    assert T.query_tokens("The Quick, brown-fox a") == ["the", "quick", "brown", "fox"]


D = date
INTERVALS = [
    (D(2024, 1, 1), D(2024, 2, 1), D(2024, 2, 1), D(2024, 3, 1), "DISJOINT"),
    (D(2024, 1, 1), None, D(2024, 1, 1), None, "EQUAL"),
    (None, None, D(2024, 1, 1), D(2024, 2, 1), "CONTAINS"),
    (D(2024, 1, 1), D(2024, 2, 1), D(2024, 1, 15), D(2024, 3, 1), "OVERLAPS"),
    (D(2024, 1, 5), D(2024, 1, 9), D(2024, 1, 1), D(2024, 2, 1), "CONTAINS"),
]


def test_interval_truth_table(spark):
    rows = spark.createDataFrame(INTERVALS, "a date, b date, c date, d date, want string")
    got = rows.select(C.interval(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)
    swapped = rows.select(C.interval(F.col("c"), F.col("d"), F.col("a"), F.col("b")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in swapped)


@pytest.mark.parametrize("a,b,want", [("a/b", "a", "CONTAINS"), ("a/b", "a/c", "DISJOINT"), (" A ", "a", "EQUAL"), ("ab", "a", "DISJOINT"), ("*", "a", "CONTAINS"), ("*", "*", "EQUAL"), (None, None, "UNKNOWN"), (None, "a", "CONTAINS")])
def test_hierarchy(spark, a, b, want):
    assert one(spark, C.hierarchy(F.col("a"), F.col("b")), a=a, b=b) == want


def test_identity_needs_ratification(spark):
    assert one(spark, C.identity(F.col("a"), F.col("b"), F.lit(False)), a="x", b="y") == "UNKNOWN"
    assert one(spark, C.identity(F.col("a"), F.col("b"), F.lit(True)), a="x", b="y") == "DISJOINT"


@pytest.mark.parametrize("source,rank", [("user:me", 1), ("twitter:x", 2), ("claude", 6), ("unsourced", 9), ("nonsense:1", 9), (None, 9)])
def test_source_rank(spark, source, rank):
    assert one(spark, C.source_rank(F.col("v")), v=source) == rank


@pytest.mark.parametrize("token,bad", [("+1-555-0100", False), ("(555) 010-0100", False), ("917-231-6130", False), ("256-257-280", True), ("02-08-2018", True), ("2019-2020", True), ("00075741", True), ("9781234567897", True), ("445--436--435--374", True), ("410-414-416-412", True), ("2015-9988-12", False)])
def test_phone_shapes(spark, token, bad):
    assert one(spark, P.not_a_phone(F.col("v")), v=token) is bad


@pytest.mark.parametrize("text,medical", [("she was diagnosed last year", True), ("a headache", False), ("my doctor says it is a headache", True), ("take 20 mg of ibuprofen", False), ("take 20 mg of zorpium", True), ("", False), (None, False), ("she is pregnant", True), ("seizure disorder noted", True), ("her a1c is high", True), ("cholesterol of 240", True), ("major depressive episode", True), ("radiotherapy next week", True), ("saw the doctor about a cough", True), ("a cough, J45.1", True), ("J45.1 alone", False), ("a cough", False)])
def test_medical(spark, text, medical):
    assert one(spark, P.is_medical(F.col("v")), v=text) is medical


def test_emails_in_order_once(spark):
    assert one(spark, P.emails(F.col("v")), v="b@x.io, a@x.io b@x.io") == ["b@x.io", "a@x.io"]


@pytest.mark.parametrize("text,found", [("she paid 415-555-1234", ["415-555-1234"]), ("upstream 415-555-1234", ["415-555-1234"]), ("account 415-555-1234", ["415-555-1234"]), ("QBO realm: 1008563730", []), ("stream `5139685489`", []), ("ISBN-13 9798123456789", []), ("call (555) 010-0100, or +1-555-0100; (555) 010-0100", ["(555) 010-0100", "+1-555-0100"]), ("on 2024-01-05 or 13-13-2013", ["13-13-2013"][:0]), (None, [])])
def test_phones(spark, text, found):
    assert one(spark, P.phones(F.col("v")), v=text) == found


@pytest.mark.parametrize("mail,name", [("jane.doe@x.io", "Jane Doe"), ("JANE_van-doe@x.io", "Jane Van Doe"), ("jane.doe+tag@x.io", None), ("info@x.io", None), ("no-reply@x.io", None), ("j.doe@x.io", None), ("jane@x.io", None), ("jane.doe2@x.io", None), ("nobody", None)])
def test_display_name(spark, mail, name):
    from codexmill.functions import gates as G

    assert one(spark, G.display_name(F.col("v")), v=mail) == name


@pytest.mark.parametrize("name,rule", [("notes.rst", "extension"), ("a.ipynb", "extension"), ("style.CSS", "extension"), ("index.html", "extension"), ("The Registry", None), ("my file.md", None), ("src/x", None), ("README.md", None)])
def test_code_artifact(spark, name, rule):
    from codexmill.functions import gates as G

    assert one(spark, G.code_artifact(F.col("v"), ("readme.md",)), v=name) == rule
