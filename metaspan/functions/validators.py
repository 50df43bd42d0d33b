"""Validators: a text column in, a boolean column out. Null is not valid.

Outer blanks are ignored by those of two-digit years, years, degrees, plates, countries and addresses; for the others they are part of the text.
Reference sets are optional; without one the check is on the form only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _whole(c: Column) -> Column:
    """The text without the ``.0`` that a number read as a fraction ends with."""
    return F.regexp_replace(c, r"\.0\z", "")


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def is_real_date(digits: Column) -> Column:
    """Eight digits that name a day from the year 1900 on."""
    return _sure((F.length(digits) == 8) & F.try_to_date(digits, "yyyyMMdd").isNotNull() & (F.substring(digits, 1, 4) >= "1900"))


def date(c: Column, calendar: Iterable[str] | None = None) -> Column:
    d = F.substring(_digits(c), 1, 8)
    return _sure(d.isin(list(calendar))) if calendar else is_real_date(d)


def yymmdd(c: Column) -> Column:
    """Exactly six digits that name a day of the century of two-digit years."""
    d = _digits(_whole(F.trim(c)))
    century = F.when(F.substring(d, 1, 2) >= "69", "19").otherwise("20")
    return _sure((F.length(d) == 6) & F.try_to_date(F.concat(century, d), "yyyyMMdd").isNotNull())


def year_month(c: Column) -> Column:
    d = _digits(_whole(c))
    return _sure((F.length(d) == 6) & F.substring(d, 1, 4).between("1900", "9999") & F.substring(d, 5, 2).between("01", "12"))


def year(c: Column) -> Column:
    t = F.trim(_whole(c))
    return _sure(t.rlike(r"^[0-9]{1,9}\z") & t.try_cast("int").between(1900, 2999))


def _degrees(c: Column, most: int) -> Column:
    t = F.trim(c)
    return _sure(t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)\z") & t.try_cast("double").between(-most, most))


def latitude(c: Column) -> Column:
    return _degrees(c, 90)


def longitude(c: Column) -> Column:
    return _degrees(c, 180)


#: Fixed values. Korean telephone numbers, digits only: local ones; area 02; mobile 010; other areas. A local part starts with 2-9.
TELEPHONE = r"^([2-9][0-9]{6,7}|02[2-9][0-9]{6,7}|010[2-9][0-9]{6,7}|0[3-9][0-9][2-9][0-9]{6,7})\z"
CELLPHONE = r"^01[016789][2-9][0-9]{6,7}\z"
#: What an address of a page and of a mailbox looks like.
URL = r"(?i)^https?://((?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,6}\.?|localhost|[0-9]{1,3}(?:\.[0-9]{1,3}){3})(?::[0-9]+)?(?:/?|[/?]\S+)\z"
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\z"
#: Number plates and times of day.
CAR = r"^([0-9]{2,3}[가-힣][0-9]{4}|[가-힣]{2}[0-9]{2}[가-힣][0-9]{4})\z"
TIME = r"^([0-9]{2}:[0-9]{2}:[0-9]{2}|[0-9]{2}:[0-9]{2}.[0-9])\z"


def telephone(c: Column) -> Column:
    return _sure(_digits(c).rlike(TELEPHONE))


def cellphone(c: Column) -> Column:
    return _sure(_digits(_whole(c)).rlike(CELLPHONE))


def url(c: Column) -> Column:
    return _sure(c.rlike(URL))


def email(c: Column) -> Column:
    return _sure(c.rlike(EMAIL))


def car_number(c: Column) -> Column:
    return _sure(F.trim(c).rlike(CAR))


def time(c: Column) -> Column:
    return _sure(c.rlike(TIME))


def timestamp(c: Column) -> Column:
    return F.lit(True)


def korean_name(c: Column, surnames: Iterable[str] | None = None) -> Column:
    return _sure(F.substring(F.trim(c), 1, 1).isin(list(surnames))) if surnames else c.isNotNull()


def country_iso3(c: Column, codes: Iterable[str] | None = None) -> Column:
    t = F.upper(F.trim(c))
    return _sure(t.rlike(r"^[A-Z]{3}\z") & (t.isin(list(codes)) if codes else F.lit(True)))


def gender(c: Column) -> Column:
    return _sure(c.isin("남", "여"))


def gender_english(c: Column) -> Column:
    return _sure(F.upper(c).isin("M", "F"))


#: Short and full names of provinces that mean the same.
PROVINCES = {
    "서울": "서울특별시", "부산": "부산광역시", "대구": "대구광역시", "인천": "인천광역시", "광주": "광주광역시", "대전": "대전광역시", "울산": "울산광역시",
    "세종": "세종특별자치시", "경기": "경기도", "강원": "강원특별자치도", "충북": "충청북도", "충남": "충청남도", "전북": "전북특별자치도", "전남": "전라남도",
    "경북": "경상북도", "경남": "경상남도", "제주": "제주특별자치도",
}


def korean_address(c: Column, provinces: Iterable[str] | None = None, districts: Iterable[str] | None = None) -> Column:
    """First word a known province, second or third (or both together) a known district; on empty sets every text passes."""
    if not provinces or not districts:
        return c.isNotNull()
    words = F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " ")
    names = F.create_map(*[F.lit(x) for pair in PROVINCES.items() for x in pair])
    word = lambda k: F.try_element_at(words, F.lit(k))
    province = F.coalesce(F.try_element_at(names, word(1)), word(1))
    known = sorted({*provinces} | {PROVINCES.get(p, p) for p in provinces})
    candidates = F.array(word(2), word(3), F.concat_ws(" ", word(2), word(3)))
    inside = F.exists(candidates, lambda w: _sure(w.rlike(r"[시군구]\z") & w.isin(list(districts))))
    return _sure(province.isin(known) & inside)


VALIDATORS: dict[str, Callable[[Column], Column]] = {
    "DATECHAR": date, "YYMMDD": yymmdd, "YEARMONTH": year_month, "YEAR": year, "LATITUDE": latitude, "LONGITUDE": longitude, "TEL": telephone,
    "CELLPHONE": cellphone, "URL": url, "EMAIL": email, "KOR_NAME": korean_name, "COUNTRY_ISO3": country_iso3, "ADDRESS": korean_address, "GENDER": gender,
    "GENDER_EN": gender_english, "CAR_NUMBER": car_number, "TIME": time, "TIMESTAMP": timestamp,
}
#: Other names under which rules know a validator.
SYNONYMS = {
    "주소": "ADDRESS", "국가코드": "COUNTRY_ISO3", "이메일": "EMAIL", "휴대폰": "CELLPHONE", "전화": "TEL", "위도": "LATITUDE", "경도": "LONGITUDE", "연월": "YEARMONTH", "연월일": "DATECHAR",
    "성씨": "KOR_NAME", "성별구분": "GENDER", "성별구분_영문": "GENDER_EN", "시도": "ADDRESS", "차량번호": "CAR_NUMBER",
}


def validator_of(rule: str) -> str | None:
    """The validator key of a rule name or synonym; of several rules none."""
    name = rule.strip()
    return SYNONYMS.get(name) or (name.upper() if name.upper() in VALIDATORS else None)
