from metaspan.functions import patterns, types, validators
from metaspan.functions import rules as rule_language
from pyspark.sql import functions as F
import pytest


def applied(spark, f, values):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i").select(f(F.col("v"))).collect()]


def test_format_pattern(spark):
    got = applied(spark, patterns.format_pattern, ["Ab-1", "홍길동", "123.0", "a@b.co", "漢_", "x" * 30, "", None, "12.0.0", "éÉß", "서울 12-3"])
    assert got == ["Aa-n", "KKK", "nnn", "a@a.aa", "ss", "a" * 20, "", None, "nn.n", "aAa", "KK nn-n"]


def test_edges(spark):
    assert applied(spark, lambda c: patterns.edge(c, "first", 2), ["abc", "a", ""]) == ["ab", "a", ""]
    assert applied(spark, lambda c: patterns.edge(c, "last", 2), ["abc", "a", ""]) == ["bc", "a", ""]


@pytest.mark.parametrize(
    "name,good,bad",
    [
        ("DATECHAR", ["20240229", "2024-02-29", "1999.12.31"], ["20240230", "18991231", "2024", "", None, "abc"]),
        ("YYMMDD", ["990431"[:2] + "0430", "720229", "240131.0"], ["720230", "990431", "12345", None, "1234567"]),
        ("YEARMONTH", ["202412", "2024-01", "202401.0"], ["202413", "189912", "2024", None]),
        ("YEAR", ["1991", "2025", "2024.0"], ["199", "1899", "3000", "abcd", None, "1d"]),
        ("LATITUDE", ["37.5665", "-90", " 90.0 "], ["90.1", "x", "NaN", "1d", None]),
        ("LONGITUDE", ["126.97", "-180"], ["180.5", "", None]),
        ("TEL", ["02-123-4567"[:3] + "212-4567", "02-2123-4567", "031-234-5678", "010-2345-6789", "234-5678", "2345-6789"], ["123-4567", "0212345", "010-1234-567", "", None]),
        ("CELLPHONE", ["010-2345-6789", "01123456789", "0162345678", "01023456789.0"], ["1023456789", "012-2345-6789", "010-1345-6789", None]),
        ("URL", ["http://a.com", "HTTPS://Sub.Example.org:80/x?y", "http://localhost/z", "http://1.2.3.4", "http://a.com./"], ["http://a.museums", "http://a.com#x", "ftp://a.com", "a.com", "http://", None]),
        ("EMAIL", ["a.b+c@d-e.co", "x%1@y.zz"], ["x@y.z", "a@b.1", "a@b.cc-", "a.b.c", "@x.y", "a@b", None]),
        ("COUNTRY_ISO3", ["KOR", " usa "], ["KO", "KORE", "K1R", None]),
        ("GENDER", ["남", "여"], ["M", None]),
        ("GENDER_EN", ["m", "F"], ["남", None]),
        ("CAR_NUMBER", ["12가3456", "123나4567", "서울12가3456"], ["1가2345", "12a3456", "12가 3456", None]),
        ("TIME", ["12:34:56", "12:34.5", "12:34x5"], ["1:2", "12:345", " 12:34:56", None]),
        ("KOR_NAME", ["홍길동"], [None]),
        ("ADDRESS", ["서울"], [None]),
        ("TIMESTAMP", ["x", None], []),
    ],
)
def test_validators(spark, name, good, bad):
    assert applied(spark, validators.VALIDATORS[name], good) == [True] * len(good)
    assert applied(spark, validators.VALIDATORS[name], bad) == [False] * len(bad)


def test_reference_sets(spark):
    assert applied(spark, lambda c: validators.korean_name(c, ["김", "이"]), ["김철수", "박영희", None]) == [True, False, False]
    assert applied(spark, lambda c: validators.country_iso3(c, ["KOR"]), ["kor", "USA"]) == [True, False]
    assert applied(spark, lambda c: validators.date(c, ["20240229"]), ["2024-02-29", "20240301"]) == [True, False]
    address = lambda c: validators.korean_address(c, ["서울특별시", "경기도"], ["강남구", "수원시 영통구"])
    assert applied(spark, address, ["서울 강남구 역삼동", "경기도 수원시 영통구 1", "부산 강남구", "서울 없는구", None]) == [True, True, False, False, False]


def test_validator_names():
    assert validators.validator_of("전화") == "TEL" and validators.validator_of("전화번호") is None and validators.validator_of("email") == "EMAIL" and validators.validator_of("a; b") is None


def evaluate(spark, text, sets=None, strict=True, **values):
    kinds = {str: "text", float: "number", int: "number", list: "list"}
    row = {k: float(v) if isinstance(v, int) else v for k, v in values.items()}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'double' if isinstance(v, float) else 'string'}" for k, v in row.items()))
    names = {k: rule_language.Value(F.col(k), kinds[type(v)]) for k, v in values.items()}
    compiled = rule_language.compile_rule(text, names, sets, strict=strict)
    return df.select(compiled.holds).first()[0]


@pytest.mark.parametrize(
    "text,want",
    [
        ("n == 3 and s == 'abc'", True), ("n > 2 or s == 'x'", True), ("not n > 2", False), ("1 < n <= 3", True), ("n + 2 * 3 == 9", True), ("n / 0 > 1", False), ("7 // n == 2 and 7 % n == 1", True),
        ("'b' in s", True), ("'z' not in s", True), ("items in good", True), ("items in few", False), ("items in 'xay'", True), ("len(items) == 4 and size(s) == 3", True), ("s.count('b') == 1", True),
        ("count(items, 'a') == 2", True), ("is_email('a@b.co')", True), ("is_tel(s)", False), ("s == 'abc' & n == 3", False), ("(s == 'abc') & (n == 3)", True), ("~(n == 3)", False), ("-n < 0", True),
        ("(n == 3", True), ("n == 3)", True), ("'10' > '9'", True), ("'a10' > 'a9'", False), ("s in ['abc', 'd']", True), ("True", True),
    ],
)
def test_rules(spark, text, want):
    assert evaluate(spark, text, {"good": ["a", "b"], "few": ["d"]}, n=3, s="abc", items=["a", "a", "c", "d"]) is want


def test_loose_reading(spark):
    assert evaluate(spark, "s == 'abc' & n == 3", strict=False, n=3, s="abc")


@pytest.mark.parametrize("text", ["__import__('os')", "s.upper()", "unknown == 1", "lambda: 1", "[x for x in s]", "n ** 2", "items == 3", "s if n else s", "f(x=1)", "1 +", "s[0]"])
def test_rules_allow_nothing_else(spark, text):
    with pytest.raises(rule_language.RuleError):
        evaluate(spark, text, n=3, s="abc", items=["a"])


def test_decisions_on_types(spark):
    from metaspan.operators import profile

    rows = [(f"id{k}", str(k + 10), "YN"[k % 2], "01"[k % 2], f"2024-01-{k + 10}", f"20240{k % 9 + 1}", f"u{k}@x.com", f"http://a.b/{k}", "same", "37.56" + str(k * 7 + 10), f"010-2345-67{k + 10}", None, f"{k}.5" if k else "12.25", f"0{k}1") for k in range(12)]
    names = ["key", "seq", "yn", "tf", "day", "month", "mail", "url", "one", "lat", "cell", "none", "num", "zero"]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    got = {r.column_name: r for r in profile.profile(df).collect()}
    assert {n: got[n].detail_type for n in names} == {
        "key": "UNIQUE", "seq": "SEQUENCE", "yn": "YN_Flag", "tf": "True_False_Flag", "day": "DATECHAR", "month": "YEARMONTH", "mail": "EMAIL", "url": "URL", "one": "SINGLE VALUE", "lat": "LATITUDE",
        "cell": "CELLPHONE", "none": "", "num": "UNIQUE", "zero": "UNIQUE",
    }
    assert got["num"].oracle_type == "NUMBER(4,2)" and got["zero"].oracle_type.startswith("VARCHAR2") and got["day"].oracle_type == "DATE" and got["none"].oracle_type == "VARCHAR2(255)"
    assert got["none"].dq_score == 10.0 and got["none"].issue_count == 4 and got["key"].pk == 1 and got["one"].top_values[0].cnt == 12
    assert all(0 <= r.dq_score <= 100 for r in got.values())
