"""Normalisation of payment text as Column expressions: everything but NFKC of non-ASCII rows stays in the JVM."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words that say nothing about the counterparty.
STOPWORDS = (
    "eft havale hvl virman transfer gonderim gonderen alici odeme odemesi odem odm tahsilat tahsilati fatura fat "
    "bedel bedeli ref referans dekont aciklama islem islemi masraf komisyon iade tutar tutari no nolu numarali icin ait"
).split()

# Abbreviations and what they stand for.
ABBREVIATIONS = {
    "muh": "muhendislik", "muhend": "muhendislik", "ins": "insaat", "insaat": "insaat", "san": "sanayi", "tic": "ticaret",
    "paz": "pazarlama", "oto": "otomotiv", "otom": "otomotiv", "loj": "lojistik", "tek": "teknoloji", "tekn": "teknoloji",
    "elk": "elektrik", "elek": "elektrik", "elektr": "elektrik", "ener": "enerji", "dag": "dagitim", "dagit": "dagitim",
    "pet": "petrol", "raf": "rafineri", "tur": "turizm", "gyd": "gayrimenkul", "gm": "gayrimenkul", "dan": "danismanlik",
    "danis": "danismanlik", "bil": "bilisim", "bilis": "bilisim", "med": "medikal", "sag": "saglik", "kim": "kimya",
    "mak": "makina", "makine": "makina", "mob": "mobilya", "tar": "tarim", "nak": "nakliyat", "tas": "tasimacilik",
    "ith": "ithalat", "ihr": "ihracat",
}

# Legal forms, tried in this order.
LEGAL_FORMS = (
    ("LIMITED_SIRKETI", r"\blimited\s+sirketi\b"),
    ("LIMITED_SIRKETI", r"\bltd\s*\.?\s*sti\s*\.?\b"),
    ("ANONIM_SIRKETI", r"\banonim\s+sirketi\b"),
    ("ANONIM_SIRKETI", r"\ba\s*\.?\s*s\s*\.?\b"),
    ("KOLLEKTIF_SIRKET", r"\bkollektif\s+sirketi?\b"),
    ("KOMANDIT_SIRKET", r"\bkomandit\s+sirketi?\b"),
    ("KOOPERATIF", r"\bkooperatifi?\b"),
    ("LIMITED_SIRKETI", r"\bltd\b"),
)

# What is read and removed around names.
IBAN = r"\btr(?:\s*[0-9]){24}\b"
TAX = r"\b(?:vkn|vergi\s*(?:kimlik\s*)?(?:no|numarasi)?)\s*[:#=-]?\s*([0-9]{10})\b"
IDENTITY = r"\b(?:tckn|tc\s*kimlik\s*(?:no|numarasi)?)\s*[:#=-]?\s*([0-9]{11})\b"
REFERENCE = r"\b(?:ref(?:erans)?|dekont|islem\s*no|txn|trx|fatura\s*no)\s*[:#=-]?\s*([a-z0-9-]{3,})\b"
DATE = r"\b(?:[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4}|[0-9]{4}[./-][0-9]{1,2}[./-][0-9]{1,2})\b"
TIME = r"\b[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?\b"
LONG_NUMBER = r"\b[0-9]{6,}\b"

#: Java takes the boundary of accented letters only under this flag, as the patterns mean it.
_U = "(?U)"


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def nfkc(c: Column) -> Column:
    """NFKC; ASCII doesn't change under it, so of such rows only a null is sent to Python."""
    return F.when(c.rlike(r"[^\x00-\x7F]"), _nfkc(F.when(c.rlike(r"[^\x00-\x7F]"), c))).otherwise(c)


def turkish_lower(c: Column) -> Column:
    return F.lower(F.translate(c, "Iİ", "ıi"))


def ascii_fold(c: Column) -> Column:
    return F.translate(c, "çÇğĞıİöÖşŞüÜ", "cCgGiIoOsSuU")


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def ascii_source(c: Column, with_nfkc: bool = True) -> Column:
    c = F.trim(c)
    return ascii_fold(turkish_lower(nfkc(c) if with_nfkc else c))


def _remove(c: Column, pattern: str) -> Column:
    return F.regexp_replace(c, _U + pattern, " ")


def _every(c: Column, pattern: str, group: int) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(_U + pattern), group))


def ibans(source: Column) -> Column:
    return F.array_distinct(F.transform(_every(source, IBAN, 0), lambda x: F.upper(F.regexp_replace(x, r"\s+", ""))))


def tax_numbers(source: Column) -> Column:
    return _every(source, TAX, 1)


def identity_numbers(source: Column) -> Column:
    return _every(source, IDENTITY, 1)


def reference_numbers(source: Column) -> Column:
    return F.transform(_every(source, REFERENCE, 1), lambda x: F.upper(x))


def without_identifiers(source: Column) -> Column:
    """IBANs, tax and identity numbers, references, dates and times in turn; but for references, all have digits."""
    number = source.rlike("[0-9]")
    c = _remove(F.when(number, reduce(_remove, (IBAN, TAX, IDENTITY), source)).otherwise(source), REFERENCE)
    return F.when(number, reduce(_remove, (DATE, TIME), c)).otherwise(c)


def _words_of(words) -> str:
    return "(?:" + "|".join(words) + ")"


_STOP = " " + _words_of(STOPWORDS) + "(?= )"
_SHORT = " " + _words_of(ABBREVIATIONS) + "(?= )"


def _between_spaces(text: Column) -> Column:
    return F.concat(F.lit(" "), text, F.lit(" "))


def without_stop_words(text: Column) -> Column:
    """``text``: words of a-z and 0-9 with one space before, between and after them; so is the result."""
    return F.regexp_replace(text, _STOP, "")


def _lookup() -> Column:
    return F.create_map(*(F.lit(x) for kv in ABBREVIATIONS.items() for x in kv))


def written_out(text: Column) -> Column:
    """Abbreviations written out; rows without any are only searched. ``text`` as for without_stop_words()."""
    full = F.array_join(F.transform(F.split(text, " "), lambda x: F.coalesce(_lookup()[x], x)), " ")
    return F.when(text.rlike(_SHORT), full).otherwise(text)


def without_repeats(text: Column) -> Column:
    """Equal neighbours once, in words of a-z and 0-9."""
    return F.regexp_replace(text, r"(?<![a-z0-9])([a-z0-9]+)(?: \1(?![a-z0-9]))+", "$1")


def expansions(text: Column) -> Column:
    """The abbreviations written out, as a map."""
    found = F.array_distinct(F.filter(F.split(text, " "), lambda x: _lookup()[x].isNotNull() & (_lookup()[x] != x)))
    none = F.create_map().cast("map<string,string>")
    return F.when(_between_spaces(text).rlike(_SHORT), F.map_from_arrays(found, F.transform(found, lambda x: _lookup()[x]))).otherwise(F.when(text.isNotNull(), none))


def removed_tokens(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(_between_spaces(text), F.lit(_STOP), 0), lambda x: F.trim(x)))


def unicode_surface(c: Column) -> Column:
    """Words of letters, digits and underscores of any script, one space between them."""
    return F.trim(F.regexp_replace(c, r"(?U)[^\w]+", " "))


def normalize(df, text: str = "text", with_nfkc: bool = True):
    """Adds normalized_text, core_text, ascii_text, tokens, legal_types, reference_numbers, removed_tokens, expanded_tokens and identifiers.

    Null stays null; a blank text has an empty core (see validate() for it as an error). The stages are columns of their
    own, so none is computed twice; legal forms are found in turn, each taken out before the next is looked for. Only
    texts that aren't ASCII are sent to Python for NFKC.
    """
    s = df.withColumn("_clean", nfkc(F.trim(F.col(text))) if with_nfkc else F.trim(F.col(text))).withColumn("_source", ascii_fold(turkish_lower(F.col("_clean"))))
    s = s.withColumn("_l0", without_identifiers(F.col("_source")))
    for i, (name, pattern) in enumerate(LEGAL_FORMS):
        s = s.withColumn(f"_f{i}", F.when(F.col(f"_l{i}").rlike(_U + pattern), F.lit(name))).withColumn(f"_l{i + 1}", _remove(F.col(f"_l{i}"), pattern))
    n = len(LEGAL_FORMS)
    s = s.withColumn("_surface", F.trim(F.regexp_replace(_remove(F.col(f"_l{n}"), LONG_NUMBER), "[^a-z0-9]+", " ")))
    s = s.withColumn("_plain", without_stop_words(_between_spaces(F.col("_surface")))).withColumn("_full", without_stop_words(written_out(F.col("_plain"))))
    ascii_text = F.trim(F.regexp_replace("_source", "[^a-z0-9]+", " "))
    s = fixed(s, F.struct(without_repeats(F.trim("_full")).alias("core"), ascii_text.alias("ascii")), "_t")
    return s.select(
        *df.columns,
        unicode_surface(turkish_lower(F.col("_clean"))).alias("normalized_text"),
        F.col("_t.core").alias("core_text"),
        F.col("_t.ascii").alias("ascii_text"),
        F.filter(F.split("_t.core", " "), lambda x: x != "").alias("tokens"),
        F.array_distinct(F.filter(F.array(*(F.col(f"_f{i}") for i in range(n))), lambda x: x.isNotNull())).alias("legal_types"),
        reference_numbers(F.col("_source")).alias("reference_numbers"),
        removed_tokens(F.col("_surface")).alias("removed_tokens"),
        expansions(F.col("_surface")).alias("expanded_tokens"),
        F.struct(ibans(F.col("_source")).alias("ibans"), tax_numbers(F.col("_source")).alias("tax_numbers"), identity_numbers(F.col("_source")).alias("identity_numbers")).alias("identifiers"),
    )


def fixed(df, column: Column, name: str):
    """Adds a column that filters and joins take as it is: none moves its long expression below, to compute it once more."""
    return df.withColumn(name, F.explode(F.array(column)))


def validate(text: Column, limit: Column) -> Column:
    """Why a request is refused, or null: a text of 1 to 2000 characters that isn't blank, a limit of 1 to 50."""
    return (
        F.when(text.isNull() | (F.trim(text) == ""), "BLANK_TEXT").when(F.length(text) > 2000, "TEXT_TOO_LONG").when(limit.isNull() | (limit < 1) | (limit > 50), "LIMIT_OUT_OF_RANGE")
    )


def matching_text(core: Column, ascii_text: Column) -> Column:
    """The core, or the ASCII text where the core is empty."""
    return F.trim(F.coalesce(F.when(core != "", core), ascii_text))


def name_identifiers(raw: Column) -> Column:
    """Runs of at least six digits with at most three letters on one side, in capitals, from the raw text."""
    return F.array_distinct(F.filter(F.split(F.upper(raw), "[^A-Za-z0-9]+"), lambda x: x.rlike("^([A-Z]{0,3}[0-9]{6,}|[0-9]{6,}[A-Z]{0,3})$")))


def safe_exact(query: Column) -> Column:
    return F.length(F.regexp_replace(query, r"[^\p{L}\p{N}]", "")) >= 3


# Legal forms at the end of names, in several countries.
NAME_ENDINGS = (
    r"incorporated", r"inc\.?", r"corporation", r"corp\.?", r"limited\s+liability\s+company", r"l\.?\s*l\.?\s*c\.?", r"public\s+limited\s+company", r"p\.?\s*l\.?\s*c\.?",
    r"limited", r"ltd\.?", r"gesellschaft\s+mit\s+beschr[aä]nkter\s+haftung", r"gmbh", r"aktiengesellschaft", r"ag", r"soci[eé]t[eé]\s+anonyme", r"s\.?\s*a\.?", r"s\.?\s*a\.?\s*s\.?",
    r"sarl", r"n\.?\s*v\.?", r"b\.?\s*v\.?", r"s\.?\s*p\.?\s*a\.?", r"s\.?\s*r\.?\s*l\.?", r"anonim\s+[şs]irketi", r"limited\s+[şs]irketi", r"a\.?\s*[şs]\.?", r"ltd\.?\s*[şs]ti\.?",
)
_ENDING = r"(?iu)(?:,\s*|\s+)(?:" + "|".join(NAME_ENDINGS) + r")\s*$"


def short_name(name: Column) -> Column:
    """The name without trailing legal forms, taken off one by one while at least three characters are left."""
    bare = lambda c: F.regexp_replace(c, "^[ ,.-]+|[ ,.-]+$", "")

    def less(c, _):
        cut = bare(F.regexp_replace(c, _ENDING, ""))
        return F.when(F.length(cut) >= 3, cut).otherwise(c)

    return F.aggregate(F.sequence(F.lit(1), F.size(F.split(name, r"\s+"))), bare(name), less)  # no name has more forms than words


LETTERS = "A-Za-zÇĞİÖŞÜçğıöşü"


def latin_dominant(c: Column) -> Column:
    """Whether at least .6 of the letters and digits are letters of the Latin or Turkish alphabet."""
    every = F.length(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))
    return F.when(every > 0, F.length(F.regexp_replace(c, f"[^{LETTERS}]", "")) / every >= 0.6).otherwise(False)


def unicode_tokens(c: Column) -> Column:
    """Runs of letters and digits of any script."""
    return F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}]+"), 0)


def query_length(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))


def query_tokens(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"\s+"), lambda x: x != ""))


def stable_id(key: Column) -> Column:
    """10^12 plus the first 15 hex digits of the key's sha256."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 15), 16, 10).cast("long") + F.lit(1_000_000_000_000)


def as_boolean(c: Column) -> Column:
    return F.lower(F.trim(c)).isin("1", "true", "yes", "y", "evet")


def as_integer(c: Column, default: int = 0) -> Column:
    return F.coalesce(F.floor(F.trim(c).try_cast("double")).cast("long"), F.lit(default))


def as_double(c: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.regexp_replace(c, ",", ".").try_cast("double"), F.lit(default))


def clean_identifier(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), r"^([0-9]+)\.0$", "$1")
