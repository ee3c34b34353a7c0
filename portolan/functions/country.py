"""Countries from addresses and from ports: two questions with two answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from portolan.functions.text import contains_any, full_match

#: Country names in the order in which they are looked for: code, what the address must contain, what it must not.
NAMES: list[tuple[str, tuple[str, ...], tuple[str, ...]]] = []


def _names(plain: str) -> None:
    for entry in plain.split():
        code, _, name = entry.partition("=")
        NAMES.append((code, tuple(n.replace("_", " ") for n in name.split("/")), ()))


_names("DE=GERMANY BE=BELGIUM VN=VIETNAM")
NAMES.append(("CN", ("CHINA",), ("MADE IN CHINA", "FROM CHINA")))
_names("HK=HONG_KONG TW=TAIWAN MX=MEXICO")
NAMES.append(("ES", ("SPAIN",), ("PORT OF SPAIN", "PORT-OF-SPAIN", "TRINIDAD")))
_names("FR=FRANCE GB=UNITED_KINGDOM/ENGLAND/SCOTLAND/WALES NL=NETHERLANDS/HOLLAND IT=ITALY JP=JAPAN KR=KOREA IN=INDIA TH=THAILAND ID=INDONESIA MY=MALAYSIA SG=SINGAPORE PH=PHILIPPINES")
_names("BR=BRAZIL AR=ARGENTINA CL=CHILE CO=COLOMBIA PL=POLAND CZ=CZECH AT=AUSTRIA CH=SWITZERLAND SE=SWEDEN DK=DENMARK NO=NORWAY FI=FINLAND PT=PORTUGAL TR=TURKEY CA=CANADA AU=AUSTRALIA")
NAMES.append(("GE", ("GEORGIA",), ("ATLANTA", "GA ", "USA", "U.S.A")))
_names("BH=BAHRAIN AE=UNITED_ARAB_EMIRATES/DUBAI/ABU_DHABI QA=QATAR SA=SAUDI KW=KUWAIT LR=LIBERIA ZA=SOUTH_AFRICA EG=EGYPT NG=NIGERIA RU=RUSSIA")

#: Two-letter codes that count at an address's end, with a separator on both sides.
END_CODES = tuple("DE BE VN CN ES FR MX GB NL IT JP KR".split())

#: State codes before a ZIP code, by first letter. The class after M has a blank in it, and so matches "M 12345" too.
_STATES = {"A": "KLRZ", "C": "AOT", "D": "CE", "F": "L", "G": "A", "H": "I", "I": "ADLN", "K": "SY", "L": "A", "M": "ADEIMNOST ", "N": "CDEHJMVY", "O": "HKR", "P": "A", "R": "I", "S": "CD", "T": "NX", "U": "T", "V": "AT", "W": "AIVY"}
_ZIP = r"[0-9]{5}(?:-[0-9]{4})?"
STATE_ZIP = r".*[\s,](?:" + "|".join(f"{a}[{b}]" for a, b in _STATES.items()) + rf")\s+{_ZIP}(?:\s+USA?)?\s*"
#: With one of these, a bare five-digit code isn't a ZIP code.
FOREIGN = tuple(x.replace("_", " ") for x in "COLONIA C.P._ DELEGACION FRANCE GERMANY ITALY MEXICO S.A._DE_C.V S.A_DE_C.V SPAIN TURKEY _MX_".split())


def extract_country_from_text(address: Column) -> Column:
    """The country code that a party's registered address names, or null.

    Full names come first, then a code at the end, then what marks the United
    States. So a Delaware address ending in ", DE 19801" is German; the rule
    is kept.
    """
    up = F.upper(address)
    named = F.lit(None).cast("string")
    for code, have, lack in reversed(NAMES):
        test = contains_any(up, have)
        if lack:
            test = test & ~contains_any(up, lack)
        named = F.when(test, F.lit(code)).otherwise(named)
    coded = F.lit(None).cast("string")
    for code in reversed(END_CODES):
        coded = F.when(full_match(up, rf".*[\s,]{code}[\s,][-0-9 ]{{0,15}}"), F.lit(code)).otherwise(coded)
    american = (
        full_match(up, r"(?:.*[\s,.])?USA?\s*")
        | full_match(up, r".*UNITED\s+STATES\s*")
        | contains_any(up, (" US ", " US,", " USA ", " USA,", "U.S.A", "UNITED STATES "))
        | full_match(up, STATE_ZIP)
        | (full_match(up, rf".*[\s,]{_ZIP}\s*") & ~contains_any(up, FOREIGN))
    )
    return F.coalesce(named, coded, F.when(american, F.lit("US")))


def port_origin_country(port: Column) -> Column:
    """Which of the eight origin countries a foreign port of lading lies in, or null. Says where cargo left, not who sent it."""
    up = F.upper(port)
    order = ("DE", "BE", "VN", "ES", "GB", "FR", "MX", "CN")
    words = {c: have for c, have, _ in NAMES}
    out = F.lit(None).cast("string")
    for code in reversed(order):
        test = contains_any(up, words[code])
        if code == "ES":
            test = test & ~contains_any(up, ("PORT OF SPAIN", "TRINIDAD"))
        out = F.when(test, F.lit(code)).otherwise(out)
    return out


def port_suffix(port: Column) -> Column:
    """What follows the last comma of ``City,Country``; null without a comma."""
    return F.nullif(F.trim(F.regexp_extract(port, r",([^,]+)$", 1)), F.lit(""))
